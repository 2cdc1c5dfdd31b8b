"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes when a string of LENGTH bytes that covers it starts anywhere else too.

1. Sparse suffixes. Every window of LENGTH bytes has an anchor, the place of the smallest hash of 8 bytes among the first
   REACH places of the window (the last of equal ones). Equal windows have their anchors at the same place within, so it
   is enough to compare windows of suffixes that start at anchors. Neighbouring windows share their anchor: about one
   place in 128 is one.
2. Duplicate detection. A window that starts at most REACH - 1 bytes before its anchor covers the CORE bytes from the
   anchor on. Only anchors whose core stands elsewhere, too, take part in the sort.
3. Merge sort. Each task sorts its suffixes to runs, in which equal ones are one, and front-codes them: the length of the
   prefix shared with the one before, and the rest. The runs are cut at splitters and exchanged; each range is merged with a
   loser tree whose nodes know how long a prefix the loser shares with the winner, so known prefixes are never compared again.
4. Suffixes that share their core now stand together. Of equal ones all windows are repeated; windows of different
   ones are compared at equal distance from the anchor.

A core that stands in more than HOT places is not merged in one task: its windows are counted by distributed aggregations
over parts of STEP windows, which collapse what is equal before it is shuffled. There are few such cores, so the tasks
that read the texts know them all and make the parts there: no text is shuffled for them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.bitmaps import bitmap, marked
from driftline.llm.memory import give_back
from driftline.llm.shingles import mix
from driftline.sources.scratch import written

LENGTH, REACH = 400, 256
CORE = LENGTH - REACH + 1
#: bytes that are hashed at once, at about 150 bytes of memory each
BLOCK = 400_000
#: bytes of suffixes in a sorted run, and in a range of the merge
RUN_BYTES, RANGE_BYTES = 32_000_000, 24_000_000
#: places of one core beyond which it is spread over the cluster, and windows that are counted as one there
HOT, STEP = 20_000, 16
#: parts of hot cores that a task makes at once
PARTS = 2_000
#: documents whose suffixes place the splitters; they decide how even the ranges are, nothing else
SAMPLE = 2_000
#: different suffixes whose windows are compared at once
COMPARED = 4_000

_random = np.random.default_rng(11)
_BYTES = _random.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse."""
    if n > len(_tables[0]):
        size = max(n, 2 * len(_tables[0]), 4096)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[at] = np.cumprod(table, dtype=np.uint64)
    return _tables[0][:n], _tables[1][:n]


class Hashes:
    """Hashes of any substring of ``data``; equal substrings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:-1], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + size)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``data`` its start's anchor; the windows' starts are 0, 1, ..."""
    windows = len(data) - LENGTH + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = windows + REACH - 1
    value = np.empty(places, np.uint64)
    for shift in range(8):
        part = data[shift:shift + (places - shift + 7) // 8 * 8]
        value[shift::8] = np.frombuffer(part.tobytes(), "<u8")[:len(value[shift::8])]
    # the place in the low bits: of equal hashes the last place is the least
    low = np.uint64(0xFFFFFF)
    value = (mix(value) | low) ^ np.arange(places, dtype=np.uint64)
    padded = np.full(-(-places // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
    padded[:places] = value
    rows = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[REACH - 1:REACH - 1 + windows])
    return np.arange(windows), ((least & low) ^ low).astype(np.int64)


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts behind one another in blocks: the bytes, and per text its number, its place in the block and its offset there.

    A text longer than a block comes in pieces that overlap by LENGTH - 1 bytes, so that each window is in one of them.
    """
    part, number, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            piece = text[at:at + BLOCK + LENGTH - 1]
            part.append(piece)
            number.append(i)
            offset.append(at)
            size += len(piece)
            if size >= BLOCK:
                yield _block(part, number, offset)
                part, number, offset, size = [], [], [], 0
    if part:
        yield _block(part, number, offset)


def _block(part, number, offset):
    ends = np.cumsum([len(p) for p in part])
    return np.frombuffer(b"".join(part), np.uint8), np.array(number), ends - [len(p) for p in part], np.array(offset)


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block the runs of windows with one anchor: text number, anchor, first and last window (places in the text),
    and the hash of the core."""
    for data, number, starts, offset in _blocks(texts):
        window, anchor = anchors(data)
        if not len(window):
            continue
        owner = np.searchsorted(starts, window, side="right") - 1
        ends = np.append(starts[1:], len(data))
        inside = window + LENGTH <= ends[owner]
        window, anchor, owner = window[inside], anchor[inside], owner[inside]
        if not len(window):
            continue
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        x, who = anchor[first], owner[first]
        core = Hashes(data).of(x, x + CORE)
        shift = offset[who] - starts[who]
        yield number[who], x + shift, window[first] + shift, window[last] + shift, core


# --- front-coded runs and their merge ---------------------------------------------------------------------------------


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two strings that share ``known`` bytes."""
    size = min(len(a), len(b))
    left, right = a[known:size], b[known:size]
    if left == right:
        return size
    return size - ((int.from_bytes(left, "big") ^ int.from_bytes(right, "big")).bit_length() + 7) // 8


class Suffix:
    """A suffix: its bytes from the anchor on, those before it, and the places (doc, hash, anchor) where it stands."""

    __slots__ = ("ahead", "back", "places")

    def __init__(self, ahead: bytes, back: bytes, places: list):
        self.ahead, self.back, self.places = ahead, back, places


def front_coded(run: list[Suffix], part: int) -> dict:
    """A sorted run as one row."""
    shared, rest, before = [], [], b""
    for s in run:
        n = common(before, s.ahead, 0) if before else 0
        shared.append(n)
        rest.append(s.ahead[n:])
        before = s.ahead
    places = [p for s in run for p in s.places]
    return {"part": part, "shared": shared, "rest_sizes": [len(r) for r in rest], "rest": b"".join(rest),
            "back_sizes": [len(s.back) for s in run], "back": b"".join(s.back for s in run),
            "counts": [len(s.places) for s in run], "doc_ids": [p[0] for p in places], "hashes": [p[1] for p in places],
            "anchors": [p[2] for p in places]}


RUN = pa.schema([("part", pa.int32()), ("shared", pa.list_(pa.int16())), ("rest_sizes", pa.list_(pa.int16())), ("rest", pa.binary()),
                 ("back_sizes", pa.list_(pa.int16())), ("back", pa.binary()), ("counts", pa.list_(pa.int32())),
                 ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int64()))])
RUN_SQL = ("part int, shared array<smallint>, rest_sizes array<smallint>, rest binary, back_sizes array<smallint>, back binary, "
           "counts array<int>, doc_ids array<bigint>, hashes array<bigint>, anchors array<bigint>")


def decoded(row: dict) -> Iterator[tuple[Suffix, int]]:
    """The suffixes of a run, each with the length of the prefix it shares with the one before."""
    ahead, at, back_at, place_at = b"", 0, 0, 0
    places = list(zip(row["doc_ids"], row["hashes"], row["anchors"]))
    for shared, size, back_size, count in zip(row["shared"], row["rest_sizes"], row["back_sizes"], row["counts"]):
        ahead = ahead[:shared] + row["rest"][at:at + size]
        yield Suffix(ahead, row["back"][back_at:back_at + back_size], places[place_at:place_at + count]), shared
        at, back_at, place_at = at + size, back_at + back_size, place_at + count


class LoserTree:
    """Merges sorted runs; each node keeps the loser of its match and the prefix it shares with the winner."""

    def __init__(self, runs: list[Iterator[tuple[Suffix, int]]]):
        self.runs = [iter(r) for r in runs]
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.heads: list[Suffix | None] = [None] * self.leaves
        self.losers = [(0, -1)] * self.leaves
        entries = []
        for n in range(self.leaves):
            first = next(self.runs[n], None) if n < len(runs) else None
            self.heads[n] = first[0] if first else None
            # before any output all share the empty prefix; a run that is over shares less than any other
            entries.append((n, 0 if first else -1))
        level = entries
        while len(level) > 1:
            above = []
            for i in range(0, len(level), 2):
                winner, loser = self._match(level[i], level[i + 1])
                self.losers[(len(level) + i) // 2] = loser
                above.append(winner)
            level = above
        self.winner = level[0]

    def _match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser; both numbers are prefixes shared with the last output."""
        if a[1] > b[1]:
            return a, b
        if a[1] < b[1]:
            return b, a
        x, y = self.heads[a[0]], self.heads[b[0]]
        if x is None or y is None:
            return a, b
        n = common(x.ahead, y.ahead, a[1])
        if n == len(x.ahead) == len(y.ahead):
            first = (x.back, a[0]) <= (y.back, b[0])
        else:
            first = n == len(x.ahead) or n < len(y.ahead) and x.ahead[n] < y.ahead[n]
        return (a, (b[0], n)) if first else (b, (a[0], n))

    def __iter__(self) -> Iterator[tuple[Suffix, int]]:
        """All suffixes in order, each with the prefix it shares with the one before."""
        while (suffix := self.heads[self.winner[0]]) is not None:
            run = self.winner[0]
            yield suffix, self.winner[1]
            following = next(self.runs[run], None)
            self.heads[run] = following[0] if following else None
            now = (run, following[1] if following else -1)
            node = (self.leaves + run) >> 1
            while node:
                loser = self.losers[node]
                if now[1] < loser[1]:
                    self.losers[node], now = now, loser
                elif now[1] == loser[1]:
                    now, self.losers[node] = self._match(now, loser)
                node >>= 1
            self.winner = now


def _merged(rows: list[dict]) -> Iterator[tuple[Suffix, int]]:
    """Different suffixes in order; equal ones of several runs become one, a place counts once."""
    last, shared = None, 0
    for suffix, n in LoserTree([decoded(r) for r in rows]):
        if last is not None and n == len(last.ahead) == len(suffix.ahead) and last.back == suffix.back:
            last.places = last.places + suffix.places
            continue
        if last is not None:
            yield last, shared
        last, shared = suffix, n
    if last is not None:
        yield last, shared


def _found(rows: list[dict]) -> Iterator[tuple]:
    """``(doc_id, hash, first, last)``: runs of repeated windows, from the merge of sorted runs."""
    waiting: list[tuple[int, Suffix]] = []
    group: list[Suffix] = []
    number = 0

    def close():
        nonlocal group, number
        for suffix in group:
            suffix.places = list(dict.fromkeys(suffix.places))
            if len(suffix.places) > 1:
                size = len(suffix.ahead) - LENGTH
                yield from ((doc, key, x - len(suffix.back), x + size) for doc, key, x in suffix.places)
        if len(group) > 1:
            waiting.extend((number, suffix) for suffix in group)
            number += 1
        group = []

    for suffix, shared in _merged(rows):
        if shared < CORE:
            yield from close()
            if len(waiting) >= COMPARED:
                yield from _compared(waiting)
                waiting = []
        group.append(suffix)
    yield from close()
    if waiting:
        yield from _compared(waiting)


def _compared(waiting: list[tuple[int, Suffix]]) -> Iterator[tuple]:
    """Repeated windows of suffixes that stand in one place, among all suffixes of their group."""
    texts = [s.back + s.ahead for _, s in waiting]
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[owner] + nth
    hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8)).of(at, at + LENGTH)
    # equal only within a group and at one distance from the anchor
    group = np.array([g for g, _ in waiting], np.uint64)
    distance = np.array([len(s.back) for _, s in waiting])[owner] - nth
    hashes = mix(hashes + group[owner] * np.uint64(0xBF58476D1CE4E5B9) + distance.astype(np.uint64))
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    single = np.array([len(s.places) == 1 for _, s in waiting])
    hit = (counts[which] > 1) & single[owner]
    places = np.flatnonzero(hit)
    if not len(places):
        return
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (np.diff(owner[places]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    for a, b in zip(places[first].tolist(), places[last].tolist()):
        suffix = waiting[owner[a]][1]
        doc, key, x = suffix.places[0]
        begin = x - len(suffix.back)
        yield doc, key, begin + int(nth[a]), begin + int(nth[b])


# --- the Spark side ---------------------------------------------------------------------------------------------------

SPANS = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
SPANS_SQL = "doc_id long, hash long, first long, last long"


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("hash"), body.cast("binary").alias("data"))


def _packed(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A segment as one number: both its ends are less than REACH, that is 256, places before its anchor."""
    return x << 16 | x - first << 8 | x - last


def _unpacked(at: int) -> tuple[int, int, int]:
    x = at >> 16
    return x, x - (at >> 8 & 255), x - (at & 255)


def _cores(rows: DataFrame) -> DataFrame:
    """``(core, doc_id, hash, at)`` of every segment of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for number, x, first, last, core in segments(texts):
                owner = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(_packed(x, first, last))],
                    ["core", "doc_id", "hash", "at"])
            give_back()

    return rows.mapInArrow(run, "core long, doc_id long, hash long, at long")


def _splitters(rows: DataFrame, total: int, parts: int) -> list[bytes]:
    """Strings that cut the suffixes into ``parts`` ranges, from the suffixes of about SAMPLE documents."""
    if parts < 2:
        return []

    def heads(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [texts[i][x:x + 32] for number, anchor, _, _, _ in segments(texts) for i, x in zip(number.tolist(), anchor.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["head"])

    some = rows.select("data").sample(min(1.0, SAMPLE / max(1, total)), 5).mapInArrow(heads, "head binary")
    # long texts have many anchors: again a bounded number of them
    some = some.select(F.xxhash64("head").alias("h"), "head").orderBy("h").limit(40 * SAMPLE)
    sample = sorted(bytes(r.head) for r in some.select("head").collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _runs(joined: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Sorted, front-coded runs of the suffixes of ``(doc_id, hash, data, segments)``, one row per run and range."""

    def rows_of(kept: dict) -> Iterator[pa.RecordBatch]:
        run = [Suffix(ahead, back, places) for (ahead, back), places in sorted(kept.items(), key=lambda item: item[0])]
        keys = [s.ahead for s in run]
        cuts = [0, *(bisect_left(keys, s) for s in splitters), len(run)]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield pa.RecordBatch.from_pylist([front_coded(run[a:b], part)], schema=RUN)

    def run(batches):
        kept: dict[tuple[bytes, bytes], list] = {}
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                doc, key, data = (batch.column(i)[row].as_py() for i in range(3))
                for x, first, last in map(_unpacked, batch.column(3)[row].as_py()):
                    suffix = (data[x:last + LENGTH], data[first:x])
                    if suffix in kept:
                        kept[suffix].append((doc, key, x))
                        size += 24
                    else:
                        kept[suffix] = [(doc, key, x)]
                        size += last + LENGTH - first
                if size >= RUN_BYTES:
                    yield from rows_of(kept)
                    kept, size = {}, 0
                    give_back()
        yield from rows_of(kept)
        del kept
        give_back()

    return joined.mapInArrow(run, RUN_SQL)


def _merge(runs: DataFrame) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        found = list(_found(table.to_pylist()))
        out = pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], schema=SPANS)
        del found
        give_back()
        return out

    return runs.groupBy("part").applyInArrow(merge, SPANS_SQL)


def _hot_parts(rows: DataFrame, cores: np.ndarray) -> DataFrame:
    """Per STEP windows at one distance from a hot anchor: the hash of the bytes that all of them cover, of all bytes of those
    that are this segment's, and of each window."""

    def parts(data: bytes, x: int, first: int, last: int) -> Iterator[tuple]:
        hashes = Hashes(np.frombuffer(data[first:last + LENGTH], np.uint8))
        for j in range((x - last) // STEP, (x - first) // STEP + 1):
            a, b = max(first, x - j * STEP - STEP + 1), min(last, x - j * STEP)
            starts = np.arange(a, b + 1) - first
            wins = mix(hashes.of(starts, starts + LENGTH) + (x - first - starts).astype(np.uint64)).view(np.int64)
            # from the window that is nearest to the anchor to the end of the farthest
            lo, hi = np.array([x - j * STEP - first]), np.array([x - j * STEP - STEP + 1 + LENGTH - first])
            inner = mix(hashes.of(lo, hi) + np.uint64(j)) if hi[0] <= last + LENGTH - first and lo[0] >= 0 else None
            if inner is None:
                # an end of the text is nearer: what stands there is covered in any case
                inner = mix(Hashes(np.frombuffer(data[x - j * STEP:x - j * STEP - STEP + 1 + LENGTH], np.uint8)).of(
                    np.array([0]), hi - lo) + np.uint64(j))
            whole = mix(hashes.of(starts[:1], starts[-1:] + LENGTH) + np.uint64(x - a))
            yield inner.view(np.int64)[0], whole.view(np.int64)[0], a, wins.tolist()

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], kind) for i, kind in enumerate((*[pa.int64()] * 5, pa.list_(pa.int64())))],
            ["doc_id", "hash", "inner", "whole", "first", "windows"])

    def run(batches):
        for batch in batches:
            texts, out = batch.column(2).to_pylist(), []
            for number, x, first, last, core in segments(texts):
                here = np.isin(core.view(np.int64), cores)
                for i, *segment in zip(*(v[here].tolist() for v in (number, x, first, last))):
                    owner = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    out.extend((*owner, *part) for part in parts(texts[i], *segment))
                    if len(out) >= PARTS:
                        yield made(out)
                        out = []
            if out:
                yield made(out)
            del texts, out
            give_back()

    return rows.mapInArrow(run, "doc_id long, hash long, inner long, whole long, first long, windows array<long>")


def _hot(rows: DataFrame, cores: np.ndarray) -> DataFrame:
    """Repeated windows of hot cores, by aggregations that collapse equal parts before they are shuffled."""
    parts = written(_hot_parts(rows, cores).dropDuplicates(["doc_id", "hash", "first", "inner"]), "hot-parts")
    kinds = parts.groupBy("inner", "whole").agg(F.count("*").alias("often"), F.first("windows").alias("windows"))
    mixed = kinds.groupBy("inner").agg(F.count("*").alias("kinds")).where("kinds > 1").select("inner")
    kinds = written(kinds, "hot-kinds")
    repeated = (kinds.join(mixed, "inner").select(F.explode("windows").alias("window"), "often")
                .groupBy("window").agg(F.sum("often").alias("often")).where("often > 1").select("window"))
    same = parts.join(kinds.where("often > 1").select("inner", "whole"), ["inner", "whole"])
    out = same.select("doc_id", "hash", "first", (F.col("first") + F.size("windows") - 1).alias("last"))
    single = parts.join(kinds.where("often = 1").join(mixed, "inner").select("inner", "whole"), ["inner", "whole"])
    each = single.select("doc_id", "hash", "first", F.posexplode("windows").alias("n", "window")).join(repeated, "window")
    return out.union(each.select("doc_id", "hash", (F.col("first") + F.col("n")).alias("first"), (F.col("first") + F.col("n")).alias("last")))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """``(doc_id, hash, first, last)``: runs of places in a document's bytes at which a repeated string of LENGTH starts.

    A document is its id and text (``hash`` is of the text); a row that is repeated in full is the same document, not a
    repeat of itself. Rows with equal ids and different texts, and rows without an id, are documents of their own. Null,
    empty and short texts have no such string.
    """
    rows = _keyed(docs, text, doc_id)
    cores = written(_cores(rows), "cores")
    often = written(cores.groupBy("core").agg(F.count("*").alias("often")).where("often > 1"), "often")
    # most cores stand once and are left out before the shuffle
    shared = marked(cores, bitmap(often, F.col("core")), "shared", F.col("core")).where("shared").drop("shared")
    twice = (shared.join(often, "core").groupBy("doc_id", "hash")
             .agg(F.collect_set(F.when(F.col("often") <= hot, F.col("at"))).alias("segments"), F.max(F.col("often") > hot).alias("hot")))
    twice = written(twice, "twice")
    cold, burning = twice.where(F.size("segments") > 0), twice.where("hot")
    totals = twice.agg(F.sum(F.size("segments")).alias("cold"), F.max("hot").alias("hot")).head()
    # about this many bytes in all, from the mean length of a suffix
    parts = max(1, (totals["cold"] or 0) * (LENGTH + REACH // 2) // RANGE_BYTES)
    chosen = cold.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "segments")

    def of(documents: DataFrame) -> DataFrame:
        # most texts share nothing and are left out before the shuffle
        return marked(rows, bitmap(documents, F.col("doc_id"), F.col("hash")), "some", F.col("doc_id"), F.col("hash")).where("some").drop("some")

    some = of(cold)
    joined = some.join(chosen, (F.col("hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    splitters = _splitters(rows, rows.count() if parts > 1 else 0, parts)
    out = _merge(_runs(joined.select("doc_id", "hash", "data", "segments"), splitters))
    if totals["hot"]:
        # fewer than one in `hot` of all segments: 3 kB a GB of text at HOT
        cores = np.array([r.core for r in often.where(F.col("often") > hot).select("core").collect()], np.int64)
        out = out.union(_hot(of(burning), cores))
    return out


def removed_spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs ``(begin, end)`` of bytes covered by strings that start in the given ranges."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last + LENGTH))
        else:
            spans.append((first, last + LENGTH))
    return spans


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, the ``spans`` that go, and ``kept``, the bytes that stay."""
    found = written(repeated(docs, text, doc_id, hot), "repeats")
    starts = found.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(
        F.collect_list(F.struct("first", "last")).alias("starts"))
    every = marked(_keyed(docs, text, doc_id), bitmap(found, F.col("doc_id"), F.col("hash")), "some", F.col("doc_id"), F.col("hash"))
    # documents that keep all their bytes need no partner and are not shuffled
    whole = every.where("not some").select("doc_id", "data", F.lit(None).cast("array<struct<first: bigint, last: bigint>>").alias("starts"))
    cut_up = every.where("some").join(starts, (F.col("hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    rows = whole.union(cut_up.select("doc_id", "data", "starts"))

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "spans": [], "kept": []}
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = removed_spans([(f["first"], f["last"]) for f in found or ()])
                edges = [0, *(e for span in spans for e in span), len(data)]
                out["n_bytes"].append(len(data))
                out["spans"].append([{"begin": a, "end": b} for a, b in spans])
                out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n_bytes"], pa.int64()),
                 pa.array(out["spans"], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept"], pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])
            del out
            give_back()

    return rows.select("doc_id", "data", "starts").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = remove(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
