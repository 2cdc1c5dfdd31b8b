"""BPE encoding and decoding in batched merge rounds.

The symbols of many words lie behind one another in one flat array. A round looks up the rank of each pair of neighbours
by binary search over the sorted keys of all pairs that merge, takes the lowest rank of every word, merges that pair
wherever it stands in the word, and closes the gaps; words without a pair left leave the array. A vocabulary has a fixed
number of merges and a word meets each at most once, so there are never more rounds than merges.

The vocabulary is a file of the ``tokenizers`` library (byte-level BPE); ids and decoded texts are those of that library.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.names import every, fresh, mapped
from driftline.llm.ragged import grown, lengths, listed, offsets, packed, slices, spread

#: words a worker remembers; beyond it the memo starts anew, which costs time only
MEMO_WORDS = 500_000
#: words or ids that are worked on at once
PART = 250_000
#: the rank of a pair that does not merge
NONE = np.int64(1 << 62)
#: Fixed value: how byte-level pre-tokenizers split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others
    take the letters from U+0100 on, in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Model:
    """Tokens, merges and added tokens of a vocabulary file."""

    def __init__(self, source: str):
        told = json.loads(source)
        bpe = told["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if bpe.get(k)]
        before, decoder = told.get("pre_tokenizer") or {}, told.get("decoder") or {}
        if (bpe.get("type", "BPE") != "BPE" or odd or told.get("normalizer") or before.get("type") != "ByteLevel"
                or before.get("add_prefix_space") or not before.get("use_regex", True) or decoder.get("type") != "ByteLevel"):
            raise ValueError("only plain byte-level BPE is encoded here")
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told.get("added_tokens", [])):
            raise ValueError("added tokens must stand for themselves")
        letters = byte_letters()
        vocabulary = bpe["vocab"]
        self.tokens: dict[int, bytes] = {}
        for text, number in [*vocabulary.items(), *self.added.items()]:
            known = all(c in letters for c in text)
            self.tokens[number] = bytes(letters[c] for c in text) if known else text.encode()
        self.byte_ids = np.full(256, -1, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        left, right = (np.array([vocabulary[m[side]] for m in merges], np.int64) for side in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        # of a pair that is listed twice the later place counts, as in the library
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.ranks = last
        self.keys = keys[last]
        #: whether merges only ever bring up pairs of later rank: then all places of a pair merge in one round
        rank_of = np.full(max(self.tokens) + 1, -1, np.int64)
        np.maximum.at(rank_of, self.made, np.arange(len(merges)))
        self.rising = bool((np.maximum(rank_of[left], rank_of[right])[last] < last).all())
        size = max(self.tokens) + 1
        self.lengths = np.zeros(size, np.int64)
        for number, data in self.tokens.items():
            self.lengths[number] = len(data)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.tokens.get(n, b"") for n in range(size)), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it does not merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind one another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        numbers = np.flatnonzero(sizes)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        runs = sizes[numbers]
        starts = np.cumsum(runs) - runs
        ranks = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            ranks[:-1] = self.look_up(symbols[:-1], symbols[1:])
        ranks[starts + runs - 1] = NONE  # the last symbol of a word has no neighbour
        while len(numbers):
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NONE
            if over.any():
                gone = np.repeat(over, runs)
                ended.append((numbers[over], symbols[gone]))
                counts[numbers[over]] = runs[over]
                symbols, ranks = symbols[~gone], ranks[~gone]
                numbers, runs, lowest = numbers[~over], runs[~over], lowest[~over]
                starts = np.cumsum(runs) - runs
                if not len(numbers):
                    break
            places = np.flatnonzero(ranks == np.repeat(lowest, runs))
            word = np.searchsorted(starts, places, side="right") - 1
            places, word = self._apart(places, word)
            symbols[places] = self.made[lowest[word]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            merged = np.bincount(word, minlength=len(numbers))
            symbols, ranks = symbols[stay], ranks[stay]
            runs = runs - merged
            starts = np.cumsum(runs) - runs
            places = places - np.arange(len(places))
            # only the pairs of a merged symbol with its two neighbours are new
            ends = (starts + runs - 1)[word]
            inner = places < ends
            ranks[places] = NONE
            at = places[inner]
            ranks[at] = self.look_up(symbols[at], symbols[at + 1])
            at = places[places > starts[word]] - 1
            ranks[at] = self.look_up(symbols[at], symbols[at + 1])
        flat = np.empty(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        for which, ids in ended:
            flat[spread(begin[which], counts[which])] = ids
        return flat, counts

    def _apart(self, places: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that merge in this round, from the left, no two sharing a symbol."""
        if not self.rising:
            first = np.ones(len(places), bool)
            first[1:] = word[1:] != word[:-1]
            return places[first], word[first]
        number = np.arange(len(places))
        fresh_run = np.ones(len(places), bool)
        fresh_run[1:] = (places[1:] != places[:-1] + 1) | (word[1:] != word[:-1])
        within = number - np.maximum.accumulate(np.where(fresh_run, number, 0))
        kept = within % 2 == 0
        return places[kept], word[kept]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each row of ids; bytes that are no UTF-8 become U+FFFD, ids without a token are left out."""
        flat = np.asarray(ids.flatten(), np.int64)
        known = (flat >= 0) & (flat < len(self.lengths))
        flat = np.where(known, flat, 0)
        sizes = np.where(known, self.lengths[flat], 0)
        cuts = offsets(sizes)[offsets(lengths(ids))]
        data = packed(self.data[spread(self.starts[flat], sizes)], cuts)
        try:
            made = data.cast(pa.string())
        except pa.ArrowInvalid:
            made = pa.array([row.decode("utf-8", "replace") for row in data.to_pylist()], pa.string())
        return pa.compute.if_else(ids.is_valid(), made, pa.scalar(None, pa.string()))


class Encoder:
    """Turns words to ids, with a memo of words met before."""

    def __init__(self, source: str, special: bool):
        self.model, self.source = Model(source), source
        self.added = self.model.added if special else {}
        longest = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.splits = regex.compile(f"({'|'.join(longest)})") if longest else None
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.starts, self.counts = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def _learn(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        known = len(self.memo)
        self.memo.update(zip(words, range(known, known + len(words))))
        self.flat = grown(self.flat, self.used + len(flat))
        self.starts, self.counts = (grown(a, known + len(words)) for a in (self.starts, self.counts))
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[known:known + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[known:known + len(words)] = counts
        self.used += len(flat)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's place in the memo."""
        if len(self.memo) + len(words) > MEMO_WORDS and self.memo:
            self.forget()
        new = [word for word in words if word not in self.memo]
        if new:
            self._learn(new, *self.encode_new(new))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.model.merge([word.encode() for word in words])

    def ids(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of rows of words, and the offsets of the rows in them."""
        if not len(words):
            return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
        coded = words.dictionary_encode()
        at = self.numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        counts = self.counts[at]
        return self.flat[spread(self.starts[at], counts)], offsets(counts)[ends]

    @functools.cached_property
    def splitter(self):
        """The library's own splitting, for texts with letters that the JVM's Unicode tables do not know."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source).pre_tokenizer

    def odd_ids(self, text: str) -> np.ndarray:
        """Ids of one text that is split here: around added tokens, then into words."""
        parts = [np.empty(0, np.int32)]
        for part in self.splits.split(text) if self.splits else [text]:
            if part in self.added:
                parts.append(np.array([self.added[part]], np.int32))
            elif part:
                words = [part[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(part)]
                parts.append(self.ids(pa.array(words, pa.string()), np.array([0, len(words)]))[0])
        return np.concatenate(parts)

    def rows(self, words: pa.ListArray, odd: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of rows that are either words or, where these are null, a text to be split here."""
        flat, ends = self.ids(words.flatten(), offsets(lengths(words)))
        if odd.null_count == len(odd):
            return flat, ends
        rare = np.flatnonzero(np.asarray(odd.is_valid()))
        found = [self.odd_ids(odd[int(i)].as_py()) for i in rare]
        sizes = np.diff(ends)
        sizes[rare] = [len(ids) for ids in found]
        out, whole = np.empty(int(sizes.sum()), np.int32), offsets(sizes)
        plain = np.setdiff1d(np.arange(len(odd)), rare)
        out[spread(whole[plain], sizes[plain])] = flat
        out[spread(whole[rare], sizes[rare])] = np.concatenate(found)
        return out, whole


#: encoders of this worker process; tasks that follow one another share the memo
_encoders: dict[tuple, Encoder] = {}


def encoder_of(shared, make=Encoder) -> Encoder:
    """The worker's encoder for a broadcast (source, special)."""
    key = (make, *shared.value)
    if key not in _encoders:
        for other in [k for k in _encoders if k[0] is make]:
            del _encoders[other]
        _encoders[key] = make(*shared.value)
    return _encoders[key]


def words_of(body: Column, added: list[str]) -> tuple[Column, Column]:
    """The words of a text; and the text itself where only the task can split it, since it holds one of ``added`` or a
    character that the JVM's Unicode tables do not know. One of the two is null."""
    odd = body.rlike(r"\p{Cn}")
    for content in added:
        odd = odd | body.contains(content)
    # (?U): letters and white space as Unicode has them
    return F.when(~odd, F.regexp_extract_all(body, F.lit("(?U)" + PATTERN), F.lit(0))), F.when(odd, body)


def load(path: str) -> str:
    """A vocabulary file, read once on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _coded(docs: DataFrame, kept: DataFrame, source: str, text: str, special: bool, finish, fields: list[T.StructField]) -> DataFrame:
    """``kept`` with the columns that ``finish(model, flat ids, offsets)`` makes of the texts of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((source, special))
    added = list(Model(source).added) if special else []
    names = [fresh(kept, name) for name in ("words", "odd")]
    words, odd = words_of(F.coalesce(F.col(text), F.lit("")), added)
    split = docs.select(*every(kept), words.alias(names[0]), odd.alias(names[1]))

    def run(batches):
        encoder = encoder_of(shared)
        for batch in batches:
            for part in slices(batch, lengths(batch.column(batch.num_columns - 2)), PART):
                flat, ends = encoder.rows(part.column(part.num_columns - 2), part.column(part.num_columns - 1))
                yield [*part.columns[:-2], *finish(encoder.model, flat, ends)]

    return mapped(split, run, [*kept.schema.fields, *fields])


def encode(docs: DataFrame, source: str, text: str = "text", ids: str = "ids", special: bool = True) -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array column ``ids``.

    Added tokens (such as an end-of-text mark) that stand in a text get their own id; with ``special`` false they are
    plain text. Nothing is put before or behind a text. A null or empty text has no ids; a text of any length is encoded
    whole, in the task that reads it; repeated rows are encoded each on their own. Other columns pass unchanged, one
    named like ``ids`` is replaced. ``source`` is the content of a vocabulary file (see ``load``), which has a fixed
    size and is broadcast.
    """
    kept = docs.select(*every(docs, ids))
    return _coded(docs, kept, source, text, special, lambda model, flat, ends: [listed(flat, ends)],
                  [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(docs: DataFrame, source: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` stand for, added tokens included; null ids give null.

    Bytes that are no UTF-8 become U+FFFD and ids without a token are left out, as in the library. A column named like
    ``out`` is replaced.
    """
    docs = docs.select(*every(docs, out))
    shared = docs.sparkSession.sparkContext.broadcast((source, True))
    place = docs.columns.index(ids)

    def run(batches):
        model = encoder_of(shared).model
        for batch in batches:
            for part in slices(batch, lengths(batch.column(place)), PART):
                yield [*part.columns, model.decode(part.column(place))]

    return mapped(docs, run, [*docs.schema.fields, T.StructField(out, T.StringType())])


def encode_and_decode(docs: DataFrame, source: str, keep: list[str], text: str = "text", packed_ids: str = "ids",
                      n_tokens: str = "n_tokens", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows, with only the columns ``keep`` of ``docs``.

    ``packed_ids`` holds the ids as they lie in token files: little-endian unsigned 32-bit integers.
    """
    def finish(model, flat, ends):
        return [pa.array(np.diff(ends), pa.int64()), packed(flat.astype("<u4").view(np.uint8), ends * 4),
                model.decode(listed(flat, ends))]

    return _coded(docs, docs.select(*keep), source, text, True, finish, [
        T.StructField(n_tokens, T.LongType()), T.StructField(packed_ids, T.BinaryType()), T.StructField(out, T.StringType())])


def digest(docs: DataFrame, source: str) -> DataFrame:
    """Per document the number of tokens and the SHA-256 of the packed ids and of the decoded text."""
    both = encode_and_decode(docs, source, ["doc_id"])
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The content of a public vocabulary file."""
    import public_tokenizers

    return load(public_tokenizers.path(name))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digest(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary())
