"""Chat formatting: linking of tool calls with their results.

Calls and results are hash-joined by identifier. A call may follow another one (it uses that call's result); the calls
are put into topological order by their depth in this forest, found by pointer doubling. Arguments are validated against
the tool's schema, and each linked call is serialised as canonical JSON: keys sorted, no white space, no escapes but the
necessary ones.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.scratch import written

#: half of a surrogate pair: JSON can escape one, but no UTF-8 text can hold it
LONE = re.compile("[\ud800-\udfff]")
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


#: arguments nested deeper than this are no valid arguments
DEEPEST = 100


def canonical(value) -> str:
    """Canonical JSON text of a parsed value of any depth; whole floats are written as integers.

    Numbers beyond the range of doubles, which parse to infinity, become null, and halves of surrogate pairs, which no
    UTF-8 text can hold, become escapes: so the text is always valid JSON and UTF-8.
    """
    out: list[str] = []
    todo = [value]  # values still to be written, the next one last; a tuple is text that is ready
    while todo:
        one = todo.pop()
        if isinstance(one, tuple):
            out.append(one[0])
        elif isinstance(one, dict):
            todo.append(("}",))
            for n, key in enumerate(sorted(one, reverse=True), 1):
                todo += [one[key], ((",", "")[n == len(one)] + _text(str(key)) + ":",)]
            out.append("{")
        elif isinstance(one, list):
            todo.append(("]",))
            for n, item in enumerate(reversed(one), 1):
                todo += [item, ("",) if n == len(one) else (",",)]
            out.append("[")
        elif isinstance(one, str):
            out.append(_text(one))
        elif isinstance(one, float) and not math.isfinite(one):
            out.append("null")
        elif isinstance(one, float) and one.is_integer() and abs(one) < 2 ** 53:
            out.append(str(int(one)))
        elif isinstance(one, int) and not isinstance(one, bool):
            out.append(_digits(one))
        else:
            out.append(json.dumps(one))
    return "".join(out)


def _text(value: str) -> str:
    return LONE.sub(lambda half: f"\\u{ord(half[0]):04x}", json.dumps(value, ensure_ascii=False))


def _digits(value: int) -> str:
    """A whole number of any length: long ones are cut in halves, since the language limits what it turns to text."""
    if abs(value) < 10 ** 4000:
        return str(value)
    if value < 0:
        return "-" + _digits(-value)
    half = int(value.bit_length() * 0.30103) // 2
    high, low = divmod(value, 10 ** half)
    return _digits(high) + _digits(low).rjust(half, "0")


def _bad_numbers_and_depth(value) -> tuple[bool, int]:
    """Whether a number is beyond the range of doubles, and how deep lists and objects are nested."""
    found, deepest, todo = False, 0, [(value, 1)]
    while todo:
        one, depth = todo.pop()
        if isinstance(one, (dict, list)):
            deepest = max(deepest, depth)
            todo += [(item, depth + 1) for item in (one.values() if isinstance(one, dict) else one)]
        elif isinstance(one, float) and not math.isfinite(one):
            found = True
    return found, deepest


def _is_kind(value, kind: str) -> bool:
    return isinstance(value, KINDS[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def violations(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What of ``value`` breaks ``schema``: type (one or a list of them), enum, bounds, lengths, required, properties and
    items."""
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else kind or []
    if kinds and not any(_is_kind(value, k) for k in kinds):
        yield f"{at}: not {' or '.join(kinds)}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not one of the values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            yield f"{at}: out of bounds"
    if isinstance(value, (str, list)):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            yield f"{at}: bad length"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(set(schema.get("required", [])) - set(value)):
            yield f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                yield from violations(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for n, item in enumerate(value):
            yield from violations(item, schema["items"], f"{at}[{n}]")


def _strict(text: str):
    def refuse(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, parse_constant=refuse)


def checked(text: str | None, schema: dict) -> tuple[object, list[str]]:
    """The parsed arguments, None where they cannot be parsed, and what is wrong with them."""
    try:
        value = _strict(text)
    except RecursionError:
        return None, ["nested too deep"]
    except (TypeError, ValueError):
        return None, ["no JSON"]
    endless, depth = _bad_numbers_and_depth(value)
    if depth > DEEPEST:
        return value, ["nested too deep"]
    # a number that no double holds fits no type and no bounds
    return value, [*(["number out of range"] if endless else []), *violations(value, schema),
                   *(["not Unicode"] if LONE.search(_texts_of(value)) else [])]


def _texts_of(value) -> str:
    """All texts of a value behind one another."""
    found, todo = [], [value]
    while todo:
        one = todo.pop()
        if isinstance(one, dict):
            todo += [*one, *one.values()]
        elif isinstance(one, list):
            todo += one
        elif isinstance(one, str):
            found.append(one)
    return "".join(found)


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` with ``content`` and ``n_results`` of the results that bear their identifier, and ``n_calls``.

    Of several results the first by ``nth``, then by content, counts. Calls that share an identifier all get the result
    and have ``n_calls`` over 1. A null identifier is linked with nothing. Results are reduced to one row per identifier
    before the join, so no identifier can be hot on that side; adaptive execution splits one that is on the other.
    """
    first = results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.struct(F.col("nth"), F.col("content"))).alias("__first"), F.count("*").alias("n_results"))
    times = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("n_calls"))
    both = times.join(first, "call_id", "left").withColumnRenamed("call_id", "__id")
    return (calls.join(both.hint("shuffle_hash"), F.col("call_id") == F.col("__id"), "left")
            .select(*[calls[c] for c in calls.columns], F.col("__first.content").alias("content"),
                    F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_calls", F.lit(1)).alias("n_calls")))


def depths(calls: DataFrame) -> DataFrame:
    """``(call_id, depth)``: how many calls come before each along ``after``; null for calls on or behind a cycle.

    ``after`` is the identifier of the call whose result a call uses. One that is null, or that no call has, starts a
    chain. Of calls that share an identifier the smallest ``after`` counts. Each round doubles the distance that is
    known, so a chain of n calls takes log2(n) rounds; each round is written.
    """
    ids = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("after").alias("after"))
    known = ids.select(F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = written(ids.join(known, "after", "left").select(
        "call_id", F.when(F.col("known"), F.col("after")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    total = state.count()
    reach = 1
    while reach <= total and not state.where("up IS NOT NULL").isEmpty():
        upper = state.select(F.col("call_id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"))
        state = written(state.join(upper, "up", "left").select(
            "call_id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")), "depths")
        reach *= 2
    # whatever still has something above it after as many steps as there are calls goes round in a circle
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def format_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Each call once, linked, validated and serialised.

    ``calls``: ``conv_id, nth, call_id, after, name, arguments`` (JSON text); ``results``: ``call_id, nth, content``;
    ``tools``: schema by tool name, a fixed list. Gives ``conv_id, nth, call_id, depth, linked, valid, problems, json``; within a
    conversation, ``(depth, nth, call_id)`` is a topological order. ``problems`` names what is wrong: an unknown tool, arguments that are
    null, no JSON, against the schema, nested too deep (``DEEPEST``, or what the parser takes), numbers beyond the range of
    doubles (null in ``json``) or halves of surrogate pairs (escaped there); an identifier that is null, shared or in a
    cycle; a result that is missing. Arguments and results of any length are taken whole, a row at a time. Other columns of
    the inputs are left out. Empty tables give no rows.
    """
    rows = calls.select("conv_id", "nth", "call_id", "after", "name", "arguments")
    linked = link(rows, results.select("call_id", "nth", "content"))
    depth = depths(rows).withColumnRenamed("call_id", "__id")
    whole = linked.join(depth, F.col("call_id") == F.col("__id"), "left").drop("__id")

    @F.pandas_udf("valid boolean, problems string, json string")
    def serialise(call_id: pd.Series, after: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series,
                  n_results: pd.Series, n_calls: pd.Series, depth: pd.Series) -> pd.DataFrame:
        out = []
        for id_, above, tool, raw, said, answers, times, level in zip(call_id, after, name, arguments, content, n_results, n_calls, depth):
            bad = []
            if tool not in tools:
                bad.append("unknown tool")
            value, wrong = checked(raw, tools.get(tool, {}))
            bad += [LONE.sub("?", problem) for problem in wrong]
            if id_ is None:
                bad.append("no identifier")
            elif math.isnan(level):
                bad.append("cycle")
            if times > 1:
                bad.append("shared identifier")
            if not answers:
                bad.append("no result")
            row = {"type": "tool_call", "id": id_, "after": above, "name": tool, "arguments": value, "result": said}
            out.append((not bad, "; ".join(bad), canonical(row)))
        return pd.DataFrame(out, columns=["valid", "problems", "json"])

    made = serialise("call_id", "after", "name", "arguments", "content", "n_results", "n_calls", F.col("depth").cast("double"))
    return (whole.withColumn("__made", made)
            .select("conv_id", "nth", "call_id", "depth", (F.col("n_results") > 0).alias("linked"), "__made.valid", "__made.problems", "__made.json"))


# The tools that the query's calls name.
TOOLS = {
    "answer": {"type": "object", "required": ["text", "words"], "additionalProperties": False,
               "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 200}}},
    "quote": {"type": "object", "required": ["lines"], "additionalProperties": False,
              "properties": {"lines": {"type": "array", "items": {"type": "string", "minLength": 2}}}},
}


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every assistant message as a call, every message after one as its result, over all conversations."""
    chats = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = chats.where("role = 'assistant'").selectExpr(
        "conv_id", "turn AS nth", "concat_ws('-', 'call', conv_id, turn) AS call_id", "CASE WHEN turn >= 2 THEN concat_ws('-', 'call', conv_id, turn - 2) END AS after",
        "CASE WHEN contains(text, '\\n') THEN 'quote' ELSE 'answer' END AS name",
        "CASE WHEN contains(text, '\\n') THEN to_json(named_struct('lines', split(text, '\\n'))) "
        "ELSE to_json(named_struct('text', text, 'words', size(split(text, ' ')))) END AS arguments")
    answers = chats.where("role <> 'assistant'").selectExpr(
        "concat_ws('-', 'call', conv_id, turn - 1) AS call_id", "turn AS nth", "text AS content")
    return format_calls(said, answers, TOOLS)
