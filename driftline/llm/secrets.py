"""Secret scans with an incremental blob ledger.

A text is addressed by its content: all versions and paths with equal texts share one blob. The ledger, two Parquet tables
in a shared folder, remembers which blob was scanned under which version of a rule and what was found. A scan reads only
blobs for which some rule version is new, each once, whatever the number of its paths; findings are then joined back to
every path that has the blob.

All of it is DataFrame work on the JVM.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.names import every, fresh
from driftline.sources.scratch import scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped.

    The secret is the group; it ends where the match ends.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """Changes whenever the rule would find something else."""
        return hashlib.md5(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"

#: in the order in which spans at one place are listed. A run of hex digits is never preceded by another one, and an
#: access key that is too short stays so from any later start in its run: there the length may stand in the pattern.
BASE = (
    Rule("assign", KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: what this operator looks for besides
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + MORE

_IS, _VALUE = r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]{6,}+"
_BEGIN, _END = (f"-----{edge} [A-Z ]*PRIVATE KEY-----" for edge in ("BEGIN", "END"))
#: what may stand between the lines of a key: ends of lines, written out too, and marks of quotations
_GAP = r"""(?:\s|\\[nr]|[>"',#|*])*+"""
#: lines of a key that has no end: its headers, long runs of base64, and one shorter run that is alone on its line
_LINES = (rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:(?:{_GAP}[A-Za-z0-9+/]{{24,}}+={{0,2}}+)++"
          r"(?:[>\s]*\n[>\x20]*[A-Za-z0-9+/]{1,23}+={0,2}+(?=[\x20\t\r]*(?:\n|\z)))?+)?+")
#: what the stage takes out, all of it: keys with their lines, and assigned values also where a shorter value or a value that
#: is itself a keyword stands before them
REDACTED = (
    Rule("assign", f"{KEYWORD}{_IS}({_VALUE}(?:(?<={KEYWORD}){_IS}{_VALUE})*+)", 2, 6),
    *BASE[1:],
    Rule("private_key", f"{_BEGIN}(?:[^-]*+(?:-{{1,4}}+[^-]++)*+{_END}|{_LINES})"),
    *MORE[1:],
)


def blob(text: Column) -> Column:
    """The address of a text; a null text has that of the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """Per match the length of the text before it (since the match before), its own and that of the rule's group.

    The pieces between matches and the matches themselves alternate, so their lengths give every place.
    """
    pattern = F.lit(rule.pattern)
    size = lambda parts: F.transform(parts, lambda part: F.length(part).cast("long"))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.arrays_zip(size(F.split(text, rule.pattern, -1)).alias("gap"), size(whole).alias("own"),
                        size(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("part"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings ``(blob, version, kind, start, end, secret)`` of rows ``(blob, text, todo)``.

    ``todo`` lists the rule versions to apply. Places count code points, the end is exclusive; the secret itself starts at
    ``secret``. Rows without findings give none.
    """
    found = [F.when(F.array_contains("todo", rule.version) & F.col("text").rlike(rule.pattern),
                    F.struct(F.lit(rule.version).alias("version"), F.lit(rule.kind).alias("kind"),
                             F.lit(rule.least).alias("least"), _matches(F.col("text"), rule).alias("matches")))
             for rule in rules]
    lists = blobs.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r"))
    rows = lists.select("blob", "r.version", "r.kind", "r.least", F.posexplode("r.matches").alias("place", "m"))
    # one group is the matches of one rule in one text
    before = "sum(m.gap + coalesce(m.own, 0)) OVER (PARTITION BY blob, version ORDER BY place)"
    ends = rows.withColumn("end", F.expr(before)).where("m.own IS NOT NULL AND m.part >= least")
    return ends.selectExpr("blob", "version", "kind", "`end` - m.own AS start", "`end`", "`end` - m.part AS secret")


class Ledger:
    """What has been scanned already, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")

    def scans(self) -> DataFrame:
        return self._read("scans", "blob string, version string").distinct()

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """What the given rules have found so far, each finding once even if a scan was written twice."""
        every = self._read("findings", "blob string, version string, kind string, start long, `end` long, secret long")
        return every.where(F.col("version").isin([rule.version for rule in rules])).distinct()

    def update(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the blobs of ``versions`` for which a rule version is new.

        Rows may repeat, share texts or have none (the empty blob). Findings are written before the scans are marked,
        so an update that breaks off is made up for by the next one.
        """
        texts = versions.select(blob(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        todo = F.array(*[F.lit(rule.version) for rule in rules])
        done = self.scans()
        if done.isEmpty():
            fresh = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", todo)
        else:
            seen = done.groupBy("blob").agg(F.collect_set("version").alias("seen"))
            open_blobs = (texts.select("blob").distinct().join(seen, "blob", "left")
                          .select("blob", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
                          .where(F.size("todo") > 0))
            fresh = (texts.join(open_blobs, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
                     .join(open_blobs, "blob"))
        scan(fresh, rules).write.mode("append").parquet(f"{self.folder}/findings")
        marks = texts.select("blob").distinct().select("blob", F.explode(todo).alias("version"))
        marks.join(done, ["blob", "version"], "left_anti").write.mode("append").parquet(f"{self.folder}/scans")


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)``: all spans of a blob by start, then rule order; a list belongs to one text."""
    order = F.create_map(*[x for n, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(n))])
    spans = F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("nth"), "kind", "end")))
    return findings.groupBy("blob").agg(spans.alias("spans"))


def locate(versions: DataFrame, ledger: Ledger, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` with ``spans``: null where its text holds nothing; a column of that name is replaced."""
    key = fresh(versions, "blob")
    found = by_blob(ledger.findings(rules), rules).withColumnRenamed("blob", key)
    marked = versions.select(*every(versions, "spans"), blob(F.col(text)).alias(key))
    return marked.join(found, key, "left").drop(key)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    ledger = Ledger(spark, scratch_path(spark, "blob-ledger"))
    ledger.update(docs)
    # only the address of a text goes through the join
    paths = docs.select("doc_id", blob(F.col("text")).alias("blob"))
    rows = paths.join(by_blob(ledger.findings()), "blob", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,nth:int,kind:string,end:bigint>>"))
    base = F.filter(spans, lambda s: s["nth"] < len(BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *[count(rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
                       F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def covered(findings: DataFrame) -> DataFrame:
    """``(blob, spans)``: the places of all secrets of a blob, those that overlap or touch as one, by start."""
    rows = findings.select("blob", F.coalesce("secret", "start").alias("start"), "end")
    reached = "max(`end`) OVER (PARTITION BY blob ORDER BY start, `end` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    island = "sum(opens) OVER (PARTITION BY blob ORDER BY start, `end` ROWS UNBOUNDED PRECEDING)"
    opened = rows.withColumn("opens", F.expr(f"IF(start <= {reached}, 0, 1)"))
    merged = opened.withColumn("island", F.expr(island)).groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with ``mark`` in the place of each of the ``spans``, at least one, which are ascending and apart."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    kept = lambda start, end: F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))
    pieces = F.transform(spans, lambda s, i: F.concat(kept(before(i), s["start"]), F.lit(mark)))
    return F.concat(F.array_join(pieces, ""), F.substr(text, (F.element_at(spans, -1)["end"] + 1).cast("int")))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents; in those with findings the secrets are replaced and ``n_chars`` follows.

    Of an assignment only the value goes. All rules look at the text as it came, and what any of them finds goes.
    """
    ledger = Ledger(spark, scratch_path(spark, "blob-ledger"))
    ledger.update(docs, rules=REDACTED)
    key, hit, new = fresh(docs, "blob"), fresh(docs, "hit"), fresh(docs, "new_text")
    found = covered(ledger.findings(REDACTED)).select(F.col("blob").alias(key), F.col("spans").alias(hit))
    marked = docs.withColumn(key, blob(F.col("text"))).join(found, key, "left")
    some = F.col(hit).isNotNull()
    # a column of its own: beside a new column ``text`` the pieces would be cut from that one
    marked = marked.withColumn(new, F.when(some, redact(F.col("text"), F.col(hit))).otherwise(F.col("text")))
    changed = {"text": F.col(new).alias("text"),
               "n_chars": F.when(some, F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return marked.select(*[changed.get(name, column) for name, column in zip(docs.columns, every(docs))])


def _sql_rule(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {RULES.index(rule)} AS nth, {rule.least} AS least,
  string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS own, regexp_extract_all(text, '{pattern}', {rule.group}) AS part
 FROM d WHERE regexp_matches(text, '{pattern}')"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_rule(rule) for rule in RULES)}),
i AS (SELECT doc_id, kind, nth, least, own, part, gaps, unnest(range(1, len(own) + 1)) AS n FROM m),
s AS (SELECT doc_id, kind, nth, CAST(list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(own[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS b,
  length(own[n]) AS size FROM i WHERE length(part[n]) >= least),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, nth) FILTER (nth < {len(BASE)}) AS base,
  string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, nth) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
