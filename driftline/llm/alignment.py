"""Alignment of the tokens of two tokenizers: which tokens overlap, and where both end.

Lockstep: the tokens of all documents of a batch lie behind one another, by the bytes they cover. One state vector holds a
pointer into either side for every lane (a document, or a stretch of a long one); a step links the two tokens pointed at,
marks a cut where both end at the same byte, and moves the pointer, or both, whose token ends first. Lanes that have come
to their end leave the vector.

Tokenizer A is a byte-level vocabulary file (``merge_rounds``), tokenizer B a ``sentencepiece`` model, which puts a space
before the text; so A encodes a space and the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.merge_rounds import Encoder, encoder_of, vocabulary, words_of
from driftline.llm.names import every, fresh, mapped
from driftline.llm.ragged import lengths, listed, offsets, packed, slices, spread
from driftline.sources.scratch import written

#: words that are worked on at once
PART = 200_000
#: tokens of A in a lane: a longer document has several lanes, so that it does not go on alone
LANE = 256
#: linked pairs whose counts are broadcast (this many rows at most); all others are joined by a shuffle
HOT = 200_000
#: a linked pair of ids as one number
SHIFT = 32


class Plain(Encoder):
    """Tokenizer A, for which the strings of added tokens are plain text."""

    def __init__(self, source: str):
        super().__init__(source, False)


class Pieces(Encoder):
    """Tokenizer B, with a memo of segments: a run of spaces and what follows up to the next space.

    No piece goes on behind a space that follows another letter, so segments are encoded one by one. Of a model with
    such pieces, or one that changes spaces, whole texts are encoded.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        bare = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in bare], np.int64)
        self.starts_of = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(bare), np.uint8)
        self.space = self.model.piece_to_id("▁")
        self.segmented = self.space != self.model.unk_id() and not any(regex.search("[^▁]▁", p) for p in pieces) and (
            "".join(self.model.encode("  a  b ", out_type=str)) == "▁▁▁a▁▁b▁")
        self.forget()

    def encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # an empty text gets no space put before it
        found = [ids or [self.space] for ids in self.model.encode([word[1:].decode() for word in words], num_threads=1)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum())), counts

    def rows_of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and their offsets by row, of rows of bytes that start with a space or are empty."""
        starts = ends[:-1][np.diff(ends) > 0]
        if self.segmented:
            space = data == 0x20
            first = space.copy()
            first[1:] &= ~space[:-1]
            first[starts] = True
            starts = np.flatnonzero(first)
        cuts = np.append(starts, len(data))
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        flat, where = self.ids(segments, np.arange(len(starts) + 1))
        return flat.astype(np.int64), where[np.searchsorted(starts, ends)]


class Alignment:
    """The tokens of both sides of a block of texts, with links and cuts; ids, links and cuts are numbered in the block."""

    def __init__(self, plain: Plain, pieces: Pieces, words: pa.ListArray, odd: pa.Array):
        texts, words, sizes = _split(plain, words, odd)
        bytes_of = offsets(texts)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        at = np.asarray(pa.Array.from_buffers(pa.int64(), len(words) + 1, [None, words.buffers()[1]], offset=words.offset))
        data = data[at[0]:at[-1]]
        self.a, a_rows = plain.ids(words, offsets(sizes))
        self.a = self.a.astype(np.int64)
        self.b, b_rows = pieces.rows_of(data, bytes_of)
        whole = self._whole(pieces, data, bytes_of, b_rows)
        # rows that B does not give back keep no token on either side
        self.a, self.a_rows = _kept(self.a, a_rows, whole)
        self.b, self.b_rows = _kept(self.b, b_rows, whole)
        self.a_ends = np.cumsum(plain.model.lengths[self.a])
        self.b_ends = np.cumsum(pieces.lengths[self.b])
        self._align()

    def _whole(self, pieces: Pieces, data: np.ndarray, bytes_of: np.ndarray, b_rows: np.ndarray) -> np.ndarray:
        """Whether the pieces of each row join to its bytes."""
        sizes = pieces.lengths[self.b]
        told = offsets(sizes)[b_rows]
        same = np.diff(told) == np.diff(bytes_of)
        if not same.all():
            # lay the rows of equal length beside each other
            keep = np.repeat(same, np.diff(b_rows))
            ids, sizes = self.b[keep], sizes[keep]
            data = data[np.repeat(same, np.diff(bytes_of))]
        else:
            ids = self.b
        joined = pieces.data[spread(pieces.starts_of[ids], sizes)]
        wrong = np.flatnonzero(joined != data)
        if len(wrong):
            rows = np.flatnonzero(same)
            ends = np.cumsum(np.diff(bytes_of)[rows])
            same[rows[np.searchsorted(ends, wrong, side="right")]] = False
        return same

    def _align(self) -> None:
        a_ends, b_ends = self.a_ends, self.b_ends
        a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
        counts = np.diff(self.a_rows)
        lanes = -(-counts // LANE)
        i = np.repeat(self.a_rows[:-1], lanes) + spread(np.zeros(len(lanes), np.int64), lanes) * LANE
        row = np.repeat(np.arange(len(lanes)), lanes)
        begin = np.where(i > 0, a_ends[i - 1], 0)
        stop = a_ends[np.minimum(i + LANE, self.a_rows[row + 1]) - 1]
        j = np.searchsorted(b_ends, begin, side="right")
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(i):
            left.append(i)
            right.append(j)
            one, two = a_ends[i], b_ends[j]
            both = one == two
            a_cut[i[both]] = True
            b_cut[j[both]] = True
            at = np.minimum(one, two)
            i, j = i + (one <= two), j + (two <= one)
            # a lane's last step ends where it stops; the links from there on are the next lane's
            going = at < stop
            if not going.all():
                i, j, stop = i[going], j[going], stop[going]
        self.left, self.right = np.concatenate(left), np.concatenate(right)
        self.a_cut, self.b_cut = a_cut, b_cut

    def rows(self) -> int:
        return len(self.a_rows) - 1

    def link_rows(self) -> np.ndarray:
        """The row of each link."""
        return np.searchsorted(self.a_rows, self.left, side="right") - 1

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of cuts before the rows: groups of row r are ``[r]`` to ``[r + 1]``; and the group of each A token."""
        of_a = np.cumsum(self.a_cut) - self.a_cut
        return offsets(self.a_cut)[self.a_rows], of_a

    def listed_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The text ``a1,a2|b1;a3|b2,b3`` of each row, as flat bytes and offsets; every row that is not empty ends with a
        semicolon that does not belong to it."""
        of_a, of_b = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        n = int(self.a_cut.sum())
        a_upto = np.cumsum(np.bincount(of_a, minlength=n))
        b_upto = offsets(np.bincount(of_b, minlength=n))
        total = len(self.a) + len(self.b)
        ids, marks = np.empty(total, np.int64), np.empty(total, np.uint8)
        at = np.arange(len(self.a)) + b_upto[of_a]
        ids[at], marks[at] = self.a, np.where(self.a_cut, ord("|"), ord(","))
        at = np.arange(len(self.b)) + a_upto[of_b]
        ids[at], marks[at] = self.b, np.where(self.b_cut, ord(";"), ord(","))
        data, starts, sizes = _decimals(int(ids.max()) + 1 if total else 1)
        sizes = sizes[ids]
        out = data[spread(starts[ids], sizes)]
        ends = np.cumsum(sizes)
        out[ends - 1] = marks
        return out, offsets(sizes)[self.a_rows + self.b_rows]


_numbers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _decimals(upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers below ``upto`` in decimal, each with room for a mark behind it: bytes, starts, lengths."""
    if not _numbers or len(_numbers[0][1]) < upto:
        listed = [b"%d," % n for n in range(upto)]
        sizes = np.array([len(x) for x in listed], np.int64)
        _numbers[:] = [(np.frombuffer(b"".join(listed), np.uint8), np.cumsum(sizes) - sizes, sizes)]
    return _numbers[0]


def _split(plain: Plain, words: pa.ListArray, odd: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The bytes of each row, all words behind one another, and the number of words of each row."""
    if odd.null_count < len(odd):
        found = []
        for n, text in enumerate(odd.to_pylist()):
            found.append(words[n].as_py() or [] if text is None else [text[a:b] for _, (a, b) in plain.splitter.pre_tokenize_str(text)])
        words = pa.array(found, pa.list_(pa.string()))
    sizes = lengths(words)
    flat = words.flatten().cast(pa.large_string())
    if not len(flat):
        flat = pa.array([""], pa.large_string()).slice(1)
    per_word = np.asarray(pa.compute.binary_length(flat), np.int64)
    return offsets(per_word)[offsets(sizes)[1:]] - offsets(per_word)[offsets(sizes)[:-1]], flat, sizes


def _kept(ids: np.ndarray, rows: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if kept.all():
        return ids, rows
    counts = np.diff(rows)
    return ids[np.repeat(kept, counts)], offsets(np.where(kept, counts, 0))


def _aligned(docs: DataFrame, kept: DataFrame, source: str, model: bytes, text: str, finish, fields: list[T.StructField]) -> DataFrame:
    """``kept`` with the columns that ``finish(alignment)`` makes of the texts of ``docs``."""
    context = docs.sparkSession.sparkContext
    one, two = context.broadcast((source,)), context.broadcast((model,))
    names = [fresh(kept, name) for name in ("words", "odd")]
    body = F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text)))
    words, odd = words_of(body, [])
    split = docs.select(*every(kept), words.alias(names[0]), odd.alias(names[1]))

    def run(batches):
        plain, pieces = encoder_of(one, Plain), encoder_of(two, Pieces)
        for batch in batches:
            for part in slices(batch, lengths(batch.column(batch.num_columns - 2)), PART):
                found = Alignment(plain, pieces, part.column(part.num_columns - 2), part.column(part.num_columns - 1))
                yield [*part.columns[:-2], *finish(found)]

    return mapped(split, run, [*kept.schema.fields, *fields])


def _pairs(left: np.ndarray, right: np.ndarray, ends: np.ndarray) -> pa.Array:
    struct = pa.StructArray.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), struct)


def align(docs: DataFrame, source: str, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``a_ids`` and ``b_ids``, the token ids of a space and ``text``; ``links``, all pairs (a, b) of token
    numbers whose bytes overlap, by place; and ``cuts``, the numbers (a, b) of the tokens that end at the same byte.

    The strings of special tokens are plain text. A text that is null, empty, or that the tokens of B do not give back
    (since B turns some characters into others) has empty lists. Repeated rows are aligned each on their own; other columns
    pass unchanged, of any name but the four. A text of any length is aligned whole by the task that reads it. ``source``
    is the content of a vocabulary file and ``model`` that of a sentencepiece model; both have a fixed size and are broadcast.
    """
    made = ("a_ids", "b_ids", "links", "cuts")
    kept = docs.select(*[c for c in every(docs) if docs.select(c).columns[0].lower() not in made])

    def finish(x: Alignment) -> list[pa.Array]:
        order = np.lexsort((x.right, x.left))
        left, right = x.left[order], x.right[order]
        row = np.searchsorted(x.a_rows, left, side="right") - 1
        links = _pairs(left - x.a_rows[row], right - x.b_rows[row], np.searchsorted(left, x.a_rows))
        one, two = np.flatnonzero(x.a_cut), np.flatnonzero(x.b_cut)
        row = np.searchsorted(x.a_rows, one, side="right") - 1
        cuts = _pairs(one - x.a_rows[row], two - x.b_rows[row], np.searchsorted(one, x.a_rows))
        return [listed(x.a, x.a_rows), listed(x.b, x.b_rows), links, cuts]

    ids = T.ArrayType(T.IntegerType())
    pair = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    return _aligned(docs, kept, source, model, text, finish, [
        T.StructField(name, kind) for name, kind in zip(made, (ids, ids, pair, pair))])


def _summary(x: Alignment) -> list[pa.Array]:
    rows = np.arange(x.rows())
    row = x.link_rows()
    n_links = np.bincount(row, minlength=len(rows))
    # distinct pairs of ids by row, and how often each is linked there
    a, b = x.a[x.left], x.b[x.right]
    width = int(b.max()) + 1 if len(b) else 1
    code = a * width + b
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(code)))
    pairs = (code[at] // width) << SHIFT | code[at] % width
    ends = np.searchsorted(row[at], np.arange(len(rows) + 1)).astype(np.int32)
    groups, _ = x.groups()
    text, places = x.listed_groups()
    hashes = [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(places[:-1].tolist(), places[1:].tolist())]
    counts = [np.diff(x.a_rows), np.diff(x.b_rows), np.diff(groups), n_links]
    return [*[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def summaries(docs: DataFrame, source: str, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the numbers of tokens, groups and links, the SHA-256 of the groups' ids, and
    the linked pairs of ids (``a`` shifted left by 32 bits, plus ``b``) with how often each is linked in the text."""
    fields = [*[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("groups_sha256", T.StringType()),
              T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return _aligned(docs, docs.select(*keep), source, model, text, _summary, fields)


def pair_counts(found: DataFrame) -> DataFrame:
    """Over the corpus, ``pair, count, best``: in how many texts a pair of ids is linked, and whether that is the highest
    count of its A id."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    a = F.shiftright("pair", SHIFT)
    # a row per id of tokenizer A at most, a number that its vocabulary fixes
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(rows: DataFrame) -> DataFrame:
    times = F.col("n").cast("long")
    return rows.groupBy("row").agg(F.sum(times * F.col("count")).alias("count_sum"),
                                   F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"))


def scored(found: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``row, count_sum, n_best`` per row of ``found``: the counts of its links summed up, and how many of its links are to
    the B id that their A id is linked with in the most texts.

    The ``hot`` pairs of highest count are broadcast, so that common pairs are not shuffled; all others are joined by pair.
    """
    common = counts.orderBy(F.desc("count"), "pair").limit(hot)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("n"))
    table = written(common, "common")
    known = links.join(F.broadcast(table), "pair")
    rest = links.join(F.broadcast(table.select("pair")), "pair", "left_anti")
    rare = rest.join(counts.join(table.select("pair"), "pair", "left_anti").hint("shuffle_hash"), "pair")
    return _sums(known).union(_sums(rare)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def digest(docs: DataFrame, source: str, model: bytes, hot: int = HOT) -> DataFrame:
    """Per document the numbers of tokens, groups and links, of links that are the most common of their A id, the sum of
    the links' counts, and the SHA-256 of the groups' ids (empty without tokens)."""
    # written, so that the numbers of the rows stay what they are
    found = written(summaries(docs, source, model, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()), "links")
    sums = scored(found, written(pair_counts(found), "counts"), hot)
    zero: Column = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", *_COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The content of a public sentencepiece model."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digest(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary(), piece_model())
