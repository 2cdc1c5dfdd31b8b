"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Spark splits the texts; a task then works on a block, the distinct words of one Arrow batch, not of the corpus. All words
of a block are laid out behind one another as symbols. Words of more than ``STEPPED`` bytes are merged through an inverted
index, which leads from each mergeable pair to the places where it stands: merges are replayed in rank order, and each
touches only the two neighbours of the places it is applied to. Shorter words, nearly all, are merged in step: each round
applies to every word that is open its pair of lowest rank. Ids are the same either way. Words that the worker has met
before come from a memo of bounded size, so no words are shuffled.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.memory import give_back
from driftline.llm.names import every, fresh, mapped

#: words a worker remembers; beyond it the memo starts anew, which costs time only
MEMO_WORDS = 200_000
#: words or ids that are worked on at once: merging them takes about 2 KB each when all are new
PART = 50_000
#: words of up to so many bytes are merged in step, longer ones through the inverted index
STEPPED = 64
#: the rank of a pair that joins to no token
NONE = np.int64(1 << 62)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``<base64 token> <rank>``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks of tokens, and of each pair of tokens that joins to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values()) + 1)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        #: whether no merge can bring up a pair of lower rank than its own
        self.rising = all(rank > max(pair >> 32, pair & 0xFFFFFFFF) for pair, rank in self.pairs.items())
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int64)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind one another, and the number of ids of each.

        In every word the pair of lowest rank is merged first, the leftmost of equal ones; a word that is a token
        itself is that token.
        """
        counts = np.ones(len(words), np.int64)
        whole = [self.ranks.get(word, -1) for word in words]
        ids = np.array(whole, np.int64)
        rest = np.flatnonzero(ids < 0)
        if not len(rest):
            return ids, counts
        sizes = np.array([len(words[i]) for i in rest], np.int64)
        parts = []
        for chosen, merge in ((sizes <= STEPPED, self._step), (sizes > STEPPED, self._merge)):
            if chosen.any():
                parts.append((rest[chosen], *merge([words[i] for i in rest[chosen]], sizes[chosen])))
        for places, _, made in parts:
            counts[places] = made
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        known = np.flatnonzero(ids >= 0)
        out[starts[known]] = ids[known]
        for places, flat, made in parts:
            out[_spread(starts[places], made)] = flat
        return out, counts

    def _laid_out(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words, -1 after each word; the rank of the pair at each place, else NONE; the words' ends."""
        laid = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        symbols = self.byte_ids[laid]
        symbols[ends] = -1
        ranks = np.full(len(laid), NONE)
        ranks[:-1] = self.byte_pairs[laid[:-1], laid[1:]]
        ranks[ends] = NONE
        ranks[ends - 1] = NONE
        return symbols, ranks, ends

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the pair joins to no token."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((right >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], NONE)

    def _step(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replay over many short words: each step applies to every word that is open its pair of lowest rank."""
        symbols, ranks, ends = self._laid_out(words, sizes)
        starts = ends - sizes
        numbers = np.arange(len(words))
        counts = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(numbers):
            lowest = np.minimum.reduceat(ranks, starts)
            finished = lowest == NONE
            if finished.any():
                runs = np.diff(np.append(starts, len(symbols)))
                over = np.repeat(finished, runs)
                kept = symbols[over]
                done.append((numbers[finished], kept[kept >= 0]))
                counts[numbers[finished]] = runs[finished] - 1
                symbols, ranks = symbols[~over], ranks[~over]
                numbers, runs, lowest = numbers[~finished], runs[~finished], lowest[~finished]
                starts = np.cumsum(runs) - runs
                if not len(numbers):
                    break
            runs = np.diff(np.append(starts, len(symbols)))
            hits = np.flatnonzero(ranks == np.repeat(lowest, runs))
            word = np.searchsorted(starts, hits, side="right") - 1
            first = np.ones(len(hits), bool)
            first[1:] = word[1:] != word[:-1]
            places = hits[first]
            # the right one of the pair goes; every open word loses one symbol
            symbols[places] = lowest
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            symbols, ranks = symbols[stay], ranks[stay]
            shift = np.arange(len(places))
            places, starts = places - shift, starts - shift
            ranks[places] = self._joined(symbols[places], symbols[places + 1])
            inner = places > starts
            left = places[inner] - 1
            ranks[left] = self._joined(symbols[left], symbols[left + 1])
        flat = np.empty(int(counts.sum()), np.int64)
        offsets = np.cumsum(counts) - counts
        for which, ids in done:
            flat[_spread(offsets[which], counts[which])] = ids
        return flat, counts

    def _merge(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replay over long words: an inverted index by rank, and links between the symbols that are left.

        A symbol that was joined to its left neighbour becomes -2.
        """
        laid, ranks, ends = self._laid_out(words, sizes)
        symbols = laid.tolist()
        places_of_pairs = np.flatnonzero(ranks != NONE)
        order = places_of_pairs[np.argsort(ranks[places_of_pairs], kind="stable")]
        levels, cuts = np.unique(ranks[order], return_index=True)
        index = {int(level): part.tolist() for level, part in zip(levels, np.split(order, cuts[1:]))}
        queue = list(index)
        heapq.heapify(queue)
        size, pairs, rising = len(symbols), self.pairs.get, self.rising
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        after[-1] = size - 1  # the last symbol is an end of a word, which joins with nothing
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for n, i in enumerate(places):
                left = symbols[i]
                j = after[i]
                right = symbols[j]
                if left < 0 or right < 0 or pairs(left << 32 | right) != rank:
                    continue  # a neighbour's merge has used one of the two
                symbols[i], symbols[j] = rank, -2
                k, h = after[j], before[i]
                after[i] = k
                before[k] = i
                lowest = rank + 1
                right = symbols[k]
                if right >= 0 and (new := pairs(rank << 32 | right)) is not None:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(queue, new)
                    lowest = new
                if h >= 0 and (left := symbols[h]) >= 0 and (new := pairs(left << 32 | rank)) is not None:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(queue, new)
                    lowest = min(lowest, new)
                if not rising and lowest < rank and n + 1 < len(places):
                    # a pair of lower rank has come up: it goes before the rest of this rank
                    index.setdefault(rank, []).extend(places[n + 1:])
                    heapq.heappush(queue, rank)
                    break
        done = np.array(symbols, np.int64)
        alive = np.concatenate([[0], np.cumsum(done >= 0)])
        return done[done >= 0], alive[ends] - alive[ends - sizes]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each row of ids."""
        flat = np.asarray(ids.flatten(), np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.lengths) or not self.lengths[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[flat]
        data = self.bytes[_spread(self.starts[flat], lengths)]
        places = np.concatenate([[0], np.cumsum(lengths)])
        valid = np.asarray(ids.is_valid())
        offsets = np.asarray(ids.offsets, np.int64)
        sizes = np.where(valid, np.diff(offsets), 0)
        cuts = places[np.concatenate([[0], np.cumsum(sizes)])]
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        return pa.compute.if_else(ids.is_valid(), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, behind one another."""
    total = np.cumsum(lengths)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


class Encoder:
    """Turns words to ids, with a memo of words met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.starts, self.counts = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's place in the memo."""
        if len(self.memo) + len(words) > MEMO_WORDS and self.memo:
            self.forget()
        memo, known = self.memo, len(self.memo)
        fresh = [word for word in words if word not in memo]
        if fresh:
            ids, counts = self.vocabulary.replay([word.encode("utf-8", "surrogatepass") for word in fresh])
            memo.update(zip(fresh, range(known, known + len(fresh))))
            self.flat = _grown(self.flat, self.used + len(ids))
            self.starts, self.counts = (_grown(a, known + len(fresh)) for a in (self.starts, self.counts))
            self.flat[self.used:self.used + len(ids)] = ids
            self.starts[known:known + len(fresh)] = self.used + np.cumsum(counts) - counts
            self.counts[known:known + len(fresh)] = counts
            self.used += len(ids)
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def encode(self, words: pa.Array, offsets: np.ndarray) -> pa.ListArray:
        """Ids of texts whose words are ``words[offsets[i]:offsets[i + 1]]``."""
        if not len(words):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(offsets), np.int32)), pa.array([], pa.int32()))
        coded = words.dictionary_encode()
        at = self.numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        counts = self.counts[at]
        flat = self.flat[_spread(self.starts[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    def texts(self, texts: list[str]) -> pa.ListArray:
        """Ids of whole texts, split here."""
        split = [self.pattern.findall(text) for text in texts]
        return self.encode(pa.array([word for words in split for word in words], pa.string()),
                           np.concatenate([[0], np.cumsum([len(words) for words in split])]).astype(np.int64))


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    more = np.empty(max(size, 2 * len(array)), array.dtype)
    more[:len(array)] = array
    return more


#: encoders of this worker process by vocabulary; tasks that follow one another share the memo
_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    ranks, pattern = shared.value
    key = hash((len(ranks), pattern, frozenset(ranks.items())))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array column ``ids``.

    Every match of ``pattern`` is encoded separately, without special tokens. A null or empty text has no ids. Repeated
    rows are encoded each on their own; other columns pass unchanged; one named like ``ids`` is replaced. ``ranks``
    has a fixed size (the vocabulary, which holds all single bytes) and is broadcast.

    The JVM splits the texts. Where a text holds characters that its Unicode tables do not know yet, the task splits it.
    """
    kept = docs.select(*every(docs, ids))
    return mapped(*_encoding(docs, kept, ranks, pattern, text, False), [*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str = "text",
                      ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows, with only the columns ``keep`` of ``docs``."""
    kept = docs.select(*keep)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())]
    return mapped(*_encoding(docs, kept, ranks, pattern, text, True), [*kept.schema.fields, *fields])


def _encoding(docs: DataFrame, kept: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, decoded: bool):
    """The columns of ``kept`` with the split texts, and the function that makes ids (and bytes) of these."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    body = F.coalesce(F.col(text), F.lit(""))
    odd = body.rlike(r"\p{Cn}")
    # (?U): white space as Unicode has it
    words = F.when(~odd, F.regexp_extract_all(body, F.lit("(?U)" + pattern), F.lit(0)))
    names = [fresh(kept, name) for name in ("words", "odd")]
    split = docs.select(*every(kept), words.alias(names[0]), F.when(odd, body).alias(names[1]))

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            for part in _parts(batch, batch.column(batch.num_columns - 2)):
                listed, rare = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                found = encoder.encode(listed.flatten(), _offsets(listed))
                if rare.null_count < part.num_rows:
                    other = encoder.texts([t or "" for t in rare.to_pylist()])
                    found = pa.compute.if_else(rare.is_valid(), other, found)
                yield [*part.columns[:-2], found, *([encoder.vocabulary.decode(found)] if decoded else [])]
            give_back()

    return split, run


def _parts(batch: pa.RecordBatch, lists: pa.ListArray):
    """The batch in slices of about ``PART`` list elements; one row is never cut."""
    ends = _offsets(lists)[1:]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _offsets(rows: pa.ListArray) -> np.ndarray:
    """Where each row starts in the flattened values; null rows are empty."""
    sizes = np.where(np.asarray(rows.is_valid()), np.diff(np.asarray(rows.offsets, np.int64)), 0)
    return np.concatenate([[0], np.cumsum(sizes)])


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for; null ids give null, an unknown id is an error.

    A column named like ``out`` is replaced.
    """
    docs = docs.select(*every(docs, out))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, ""))
    place = docs.columns.index(ids)

    def run(batches):
        vocabulary = Vocabulary(shared.value[0])
        for batch in batches:
            for part in _parts(batch, batch.column(place)):
                yield [*part.columns, vocabulary.decode(part.column(place))]
            give_back()

    return mapped(docs, run, [*docs.schema.fields, T.StructField(out, T.BinaryType())])


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public tokenizer, read once on the driver."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document the number of tokens and the SHA-256 of the ids (decimal, joined by a space) and decoded bytes."""
    both = encode_and_decode(docs, ranks, pattern, ["doc_id"])
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digest(spark.read.parquet(f"{folder}/documents.parquet"), *tokenizer())
