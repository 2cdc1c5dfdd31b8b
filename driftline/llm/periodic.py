"""Detection of periodic runs: stretches of words that repeat with some period, four times or more.

Scale-tiled: a document is exploded into overlapping tiles per octave of periods (P to 2P - 1), the larger the period the
larger the tile; small octaves share tiles. Tiles are solved on their own. Within a tile, boundaries stand every 2P words;
at a boundary where a shingle of P words comes again after q words, Z-functions tell how far the words q apart agree to the
right, and a comparison backwards how far to the left. That gives fragments of the interval in which words q apart are
identical. Fragments are shuffled by document and period and stitched to whole intervals, each of which is a run.

Why no run is lost: the places i with word i = word i + q of a run of length 4q or more are at least 3q >= 3P in a row, so a
boundary lies within the first 2P of them, with q or more of them to its right. A tile reaches 2P words over its left edge
and 8P over its right one, so of each such interval it sees 3q places behind its last boundary, and the fragments of
neighbouring tiles overlap.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.llm.bitmaps import bitmap, marked
from driftline.llm.names import every, fresh, mapped
from driftline.llm.ragged import lengths, offsets, packed, slices, spread
from driftline.sources.scratch import written

#: words of a tile between its overlaps; longer documents have several tiles
CORE = 1 << 15
#: bytes of text that are worked on at once, and eight times the words of tiles
PART = 1 << 20
#: pairs of places that are compared at once
PAIRS = 1 << 20
#: a run has at least so many periods, and so many words
POWER, LEAST = 4, 6
WORD = r"[^ \t\n\x0B\f\r]+"
GAP = r"[ \t\n\x0B\f\r]+"

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of text (a string array) behind one another, and the offsets of the rows."""
    texts = texts.cast(pa.large_string())
    ends = np.asarray(pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset))
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _words_in(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of rows of bytes start, how long they are, and which bytes belong to words."""
    inside = ~_GAPS[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a row's first letter starts a word, whatever the row before it ends with
    at = rows[:-1][np.diff(rows) > 0]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return starts, sizes, inside


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of rows of text (a string array) as codes, equal for equal words, and the number of words of each row.
    Null rows have no words."""
    data, rows = _bytes_of(texts)
    starts, sizes, inside = _words_in(data, rows)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets(sizes)), pa.py_buffer(data[inside])])
    return np.asarray(words.dictionary_encode().indices, np.int64), np.diff(np.searchsorted(starts, rows))


def tiles_of(n: int, core: int) -> list[tuple[int, int, int, int, int, int]]:
    """The tiles of a document of ``n`` words: (low octave, high octave, first word, first and last boundary's range, end)."""
    top = max((n // POWER).bit_length() - 1, 0)
    if n <= core:
        return [(0, top, 0, 0, n, n)]
    shared = max(core.bit_length() - 1 - 4, 0)
    bands = [(0, min(shared, top), core)] + [(k, k, 16 << k) for k in range(shared + 1, top + 1)]
    return [(low, high, max(at - (2 << high), 0), at, min(at + step, n), min(at + step + (8 << high), n))
            for low, high, step in bands for at in range(0, n, step)]


@functools.lru_cache(maxsize=1 << 16)
def divisors(q: int) -> tuple[int, ...]:
    """The proper divisors of ``q``, ascending."""
    small = [d for d in range(1, int(q ** 0.5) + 1) if q % d == 0]
    return tuple(sorted({*small, *(q // d for d in small)} - {q}))


def z_function(t: list[int], upto: int) -> list[int]:
    """How many values from each of the places 1 to ``upto`` on agree with those from the start on; place 0 has 0."""
    z, left, right, n = [0] * (upto + 1), 0, 0, len(t)
    for i in range(1, upto + 1):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and t[k] == t[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agree(t: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from ``i`` and from ``j`` > i on agree, before ``end``."""
    at, step = 0, 256
    while j + at < end:
        stop = min(at + step, end - j)
        other = np.flatnonzero(t[i + at:i + stop] != t[j + at:j + stop])
        if len(other):
            return at + int(other[0])
        at, step = stop, step * 2
    return end - j


def _agree_before(t: np.ndarray, i: int, j: int, begin: int) -> int:
    """How many words before ``i`` and before ``j`` > i agree, from ``begin`` on."""
    at, step = 0, 256
    while i - at > begin:
        stop = min(at + step, i - begin)
        other = np.flatnonzero(t[i - stop:i - at] != t[j - stop:j - at])
        if len(other):
            return stop - 1 - int(other[-1])
        at, step = stop, step * 2
    return i - begin


def solve(codes: np.ndarray, tiles: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Fragments (tile, period, start, end) of many tiles whose words lie behind one another in ``codes``.

    ``tiles`` has a row (low octave, high octave, first word, first boundary, boundaries' end, end) per tile, in words of
    ``codes``. A fragment is an interval of places i where word i is word i + period.
    """
    if not len(tiles) or not len(codes):
        return
    high = int(tiles[:, 1].max())
    # shingles of P words, P doubling with the octave; those over a tile's end are never looked at
    shingles = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    shingles ^= shingles >> np.uint64(29)
    for octave in range(high + 1):
        p = 1 << octave
        active = np.flatnonzero((tiles[:, 0] <= octave) & (octave <= tiles[:, 1]) & (tiles[:, 5] - tiles[:, 2] >= POWER * p))
        if len(active):
            yield from _octave(codes, shingles, tiles, active, p)
        if len(shingles) <= p:
            break
        shingles = (shingles[:-p] * np.uint64(0xD6E8FEB86659FD93)) ^ (shingles[p:] + (shingles[p:] << np.uint64(17)))
        shingles = (shingles ^ (shingles >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)


def _octave(codes: np.ndarray, shingles: np.ndarray, tiles: np.ndarray, active: np.ndarray, p: int) -> Iterator[tuple[int, int, int, int]]:
    begins, stops, ends = tiles[active, 3], tiles[active, 4], tiles[active, 5]
    # two shingles q >= p apart must fit behind a boundary
    counts = np.maximum(0, -(-(np.minimum(stops, ends - 2 * p + 1) - begins) // (2 * p)))
    bounds = spread(np.zeros(len(counts), np.int64), counts) * (2 * p) + np.repeat(begins, counts)
    owner = np.repeat(active, counts)
    steps = np.arange(p, 2 * p)
    now, reach = -1, np.zeros(0, np.int64)
    block = max(1, PAIRS // p)
    for start in range(0, len(bounds), block):
        b, own = bounds[start:start + block], owner[start:start + block]
        other = b[:, None] + steps[None, :]
        fits = other <= (tiles[own, 5] - p)[:, None]
        np.minimum(other, len(shingles) - 1, out=other)
        hits = (shingles[other] == shingles[b][:, None]) & fits
        for row in np.flatnonzero(hits.any(axis=1)):
            tile, at = int(own[row]), int(b[row])
            if tile != now:
                now, reach = tile, np.zeros(p, np.int64)
            if (hits[row] & (reach <= at)).any():
                yield from ((tile, *found) for found in _boundary(codes, tiles[tile], at, p, reach))


def _boundary(codes: np.ndarray, tile: np.ndarray, at: int, p: int, reach: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Fragments at one boundary; ``reach`` keeps for each period of the octave where what is known of it ends."""
    begin, end = int(tile[2]), int(tile[5])
    window = codes[at:min(at + 8 * p, end)].tolist()
    z = z_function(window, min(2 * p - 1, len(window) - 1))
    ext: dict[int, int] = {}
    for q in range(p, len(z)):
        if z[q] < q:
            continue
        # the first q words are a smaller word several times: then q is not the smallest period
        root = next((d for d in divisors(q) if z[d] >= q - d), q)
        if root not in ext:
            ext[root] = _agree(codes, at, at + root, end) + root  # so many words have the root's period
        forth = ext[root] - q
        if reach[q - p] > at:
            continue
        reach[q - p] = at + forth
        if root == q:
            back = _agree_before(codes, at, at + q, begin)
            if back + forth >= max((POWER - 1) * q, LEAST - q):
                yield q, at - back, at + forth


#: what a task makes of documents: fragments, and tiles of those documents that have more than one
_PIECES = [T.StructField(n, T.LongType()) for n in ("period", "start", "stop", "low", "high", "first", "begin", "until", "end")]
_PIECES.append(T.StructField("codes", T.ArrayType(T.IntegerType())))


def _fragments(codes: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    return np.array(list(solve(codes, tiles)), np.int64).reshape(-1, 4)


def _pieces(batch: pa.RecordBatch, core: int) -> Iterator[list[pa.Array]]:
    """Of a batch (id, text hash, text): fragments of documents with one tile, and the tiles of the others."""
    codes, counts = cut_words(batch.column(2))
    places = offsets(counts)
    one = np.flatnonzero((counts >= LEAST) & (counts <= core))
    if len(one):
        at, n = places[one], counts[one]
        top = np.array([max((int(x) // POWER).bit_length() - 1, 0) for x in n])
        found = _fragments(codes, np.column_stack([np.zeros_like(at), top, at, at, at + n, at + n]))
        if len(found):
            row = one[found[:, 0]]
            base = places[row]
            values = [found[:, 1], found[:, 2] - base, found[:, 3] - base]
            keys = [batch.column(c).take(pa.array(row)) for c in (0, 1)]
            yield [*keys, *[pa.array(v, pa.int64()) for v in values],
                   *[pa.nulls(len(row), pa.int64())] * 6, pa.nulls(len(row), pa.list_(pa.int32()))]
    for row in np.flatnonzero(counts > core):
        for low, high, first, begin, until, end in tiles_of(int(counts[row]), core):
            words = codes[places[row] + first:places[row] + end].astype(np.int32)
            keys = [batch.column(c).slice(int(row), 1) for c in (0, 1)]
            numbers = [pa.array([v], pa.int64()) for v in (low, high, first, begin, until, end)]
            yield [*keys, *[pa.nulls(1, pa.int64())] * 3, *numbers, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))]


def _solved(batch: pa.RecordBatch) -> list[pa.Array]:
    """Of a batch (id, text hash, low, high, first, begin, until, end, codes): the fragments."""
    codes = np.asarray(batch.column(8).flatten(), np.int64)
    base = offsets(lengths(batch.column(8)))[:-1]
    low, high, first, begin, until, end = (np.asarray(batch.column(c)) for c in range(2, 8))
    shift = base - first
    found = _fragments(codes, np.column_stack([low, high, base, begin + shift, until + shift, end + shift]))
    row = found[:, 0]
    keys = [batch.column(c).take(pa.array(row)) for c in (0, 1)]
    return [*keys, pa.array(found[:, 1]), *[pa.array(found[:, c] - shift[row]) for c in (2, 3)]]


def text_hash(text: str = "text") -> Column:
    """Tells texts of one id apart; null has a hash, too."""
    return F.xxhash64(F.col(text))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", core: int = CORE) -> DataFrame:
    """All runs of all texts: ``key, text_hash, start, length, period``, in words from 0.

    Words are what stands between ASCII white space. A run is a stretch of at least six words and four periods, with
    ``period`` its smallest period, that no neighbouring word extends. Runs are told apart by the key (which may be null
    or stand in many rows) and the hash of the text: repeated rows have their runs once, different texts under one key
    have their own. Null, empty and short texts have none. A text of any length is worked on in tiles: a task holds its
    words once, for cutting them, and later a tile at a time; a tile for periods about P has 26 P words, so only the
    periods of a quarter of a text take a tile as long as the text. Other columns do not matter.
    """
    source = docs.select(F.col(key).alias("id"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    keys = [T.StructField("id", source.schema["id"].dataType), T.StructField("text_hash", T.LongType())]

    def cut(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0)
            for part in slices(batch, np.asarray(sizes, np.int64), PART):
                yield from _pieces(part, core)

    def solve_tiles(batches):
        for batch in batches:
            for part in slices(batch, lengths(batch.column(8)), PART // 8):
                yield _solved(part)

    pieces = written(mapped(source, cut, [*keys, *_PIECES]), "pieces")
    tiles = pieces.where("codes IS NOT NULL").drop("period", "start", "stop")
    # the tiles of a long document go to many tasks
    dealt = tiles.repartition(F.xxhash64("id", "text_hash", "low", "first"))
    columns = ["id", "text_hash", "period", "start", "stop"]
    fields = [*keys, *_PIECES[:3]]
    fragments = pieces.where("period IS NOT NULL").select(*columns).unionByName(mapped(dealt, solve_tiles, fields))
    return stitch(fragments).withColumnRenamed("id", key)


def stitch(fragments: DataFrame) -> DataFrame:
    """The runs of fragments ``id, text_hash, period, start, stop``: touching fragments of one period are one interval.

    There is at most one fragment per tile and run (tasks have put the boundaries of a tile together), so no document and
    period brings many rows into one task.
    """
    by = ["id", "text_hash", "period"]
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.distinct().withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    numbered = opened.withColumn("island", F.sum("opens").over(order))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(
        "id", "text_hash", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")


def with_runs(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "runs") -> DataFrame:
    """``docs`` with their runs as an array of (start, period, length), sorted; null where there are none.

    Texts without a run are not shuffled. A column named like ``out`` is replaced.
    """
    docs = docs.select(*every(docs, out))
    known = written(runs.groupBy(F.col(key).alias("k"), F.col("text_hash").alias("h")).agg(
        F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("r")), "runs")
    hit, mark, one, two, three = (fresh(docs, n) for n in ("hit", "mark", "k", "h", "r"))
    rows = docs.withColumn(mark, text_hash(text))
    noted = marked(rows, bitmap(known, F.col("k"), F.col("h")), hit, F.col(key), F.col(mark))
    found = known.toDF(one, two, three)
    same = F.col(key).eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two))
    kept = every(docs)
    some = noted.where(F.col(hit)).join(found, same, "left").select(*kept, F.col(three).alias(out))
    return noted.where(~F.col(hit)).select(*kept, F.lit(None).cast(known.schema["r"].dataType).alias(out)).union(some)


def collapse(docs: DataFrame, runs: str = "runs", text: str = "text", out: str = "collapsed") -> DataFrame:
    """``docs`` of ``with_runs`` with the words of each text joined by one space, without those that stand in a run after
    its first period. Null and empty texts give an empty one. A column named like ``out`` is replaced."""
    docs = docs.select(*every(docs, out))
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), GAP, " "))
    plain = docs.where(F.col(runs).isNull()).withColumn(out, spaced)
    place, where = docs.columns.index(text), docs.columns.index(runs)

    def run(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0)
            for part in slices(batch, np.asarray(sizes, np.int64), PART):
                yield [*part.columns, _collapsed(part.column(place), part.column(where))]

    return plain.union(mapped(docs.where(F.col(runs).isNotNull()), run, [*docs.schema.fields, T.StructField(out, T.StringType())]))


def _collapsed(texts: pa.Array, runs: pa.ListArray) -> pa.Array:
    """The words of each text that no run drops, joined by one space."""
    data, rows = _bytes_of(texts)
    starts, sizes, _ = _words_in(data, rows)
    places = np.searchsorted(starts, rows)
    # a run drops the words from the end of its first period to its own end
    start, period, length = (np.asarray(column, np.int64) for column in runs.flatten().flatten())
    base = np.repeat(places[:-1], lengths(runs)) + start
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, base + period, 1)
    np.add.at(change, base + length, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    row = np.searchsorted(places, kept, side="right") - 1
    spaced = np.ones(len(kept), np.int64)
    spaced[np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(kept) else []] = 0  # none behind a row's last word
    wide = sizes[kept] + spaced
    out = data[np.minimum(spread(starts[kept], wide), max(len(data) - 1, 0))] if len(kept) else data[:0]
    out[(np.cumsum(wide) - 1)[spaced == 1]] = 0x20
    return packed(out, offsets(wide)[np.searchsorted(row, np.arange(len(rows)))]).cast(pa.string())


def digest(docs: DataFrame, core: int = CORE) -> DataFrame:
    """Per document the number of runs, the one of most periods, and the SHA-256 of all runs and of the collapsed text.

    Ties go to the smaller start, then period. The number of periods is compared as a double, which tells any two
    fractions apart as long as length times period stays below 2^52.
    """
    docs = docs.select("doc_id", "text")
    whole = collapse(with_runs(docs, find(docs, core=core)))
    listed = F.coalesce(F.col("runs"), F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>"))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-(r["length"] / r["period"])).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform(listed, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = whole.select("doc_id", F.size(listed).cast("long").alias("n_runs"), best.alias("best"),
                        F.concat(F.array_join(lines, "\n"), F.when(F.size(listed) > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def repeated(docs: DataFrame) -> DataFrame:
    """The query's table: every tenth document (by the checksum of its id) repeats a part of itself up to its end."""
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).select(
        "*", F.floor(F.col("h") / 10).alias("g"),
        F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words")
    sized = words.select("*", n.alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a")).select(
        "*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    changed = F.expr("""concat(slice(words, 1, cast(a AS int)), slice(flatten(array_repeat(slice(words, cast(a + 1 AS int), cast(p AS int)),
        cast(ceil((n - a) / p) AS int))), 1, cast(n - a AS int)))""")
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digest(repeated(spark.read.parquet(f"{folder}/documents.parquet")))
