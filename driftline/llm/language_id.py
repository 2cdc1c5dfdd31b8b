"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point and a seed. An n-gram's vector binds its
letters: the letter vectors, each permuted (rolled) by its distance from the last letter, are multiplied. A text's vector
bundles (adds) those of its n-grams, a language's prototype those of its training texts, and a text is given the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.memory import give_back
from driftline.llm.names import every, fresh

DIMENSIONS = 512
GRAM = 3
SEED = 20240229
#: characters and texts that are bundled at once
BLOCK_CHARS, BLOCK_TEXTS = 200_000, 128
#: alphabets of up to so many letters number their n-grams directly
SMALL_ALPHABET = 128
SPACE = 32


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    table = np.full(0x110000, SPACE, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


@functools.cache
def _table() -> np.ndarray:
    return _letters()


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Profiles:
    """Bundles texts to vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.table = _table()
        self.vectors: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.vectors[code] = (2 * bits - 1).astype(np.int8)
        return self.vectors[code]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams (rows of letters); for each n-gram that stands somewhere its text and its number."""
        raw = [text.encode("utf-32-le", "surrogatepass") for text in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4 + 1
        # words stand between single spaces, whatever is no letter being a space; a text ends with one
        codes = self.table[np.frombuffer(b" \0\0\0".join([b"", *raw, b""]), "<u4")]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        owners = np.append(0, np.repeat(np.arange(len(raw)), sizes))[keep]
        codes = codes[keep]
        windows = len(codes) - self.gram + 1
        if windows < 1:
            return np.zeros((0, self.gram), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the space before a text belongs to the text; an n-gram with a space inside would join two words
        owner = owners[1:windows + 1]
        inside = np.ones(windows, bool)
        for i in range(1, self.gram - 1):
            inside &= codes[i:i + windows] != SPACE
        present = np.bincount(codes, minlength=1) > 0
        alphabet = np.flatnonzero(present)
        number = np.cumsum(present) - 1
        small = len(alphabet) <= SMALL_ALPHABET
        base = len(alphabet) if small else 1 << 21
        key = np.zeros(windows, np.int64)
        for i in range(self.gram):
            part = codes[i:i + windows]
            key = key * base + (number[part] if small else part)
        key, owner = key[inside], owner[inside]
        if small:
            there = np.bincount(key, minlength=base ** self.gram) > 0
            distinct, which = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
        else:
            distinct, which = np.unique(key, return_inverse=True)
        letters = np.stack([distinct // base ** (self.gram - 1 - i) % base for i in range(self.gram)], axis=1)
        return (alphabet[letters] if small else letters), owner, which

    def bound(self, letters: np.ndarray) -> np.ndarray:
        """The vector of each n-gram."""
        out = np.ones((len(letters), self.dimensions), np.float32)
        for i in range(self.gram):
            codes, which = np.unique(letters[:, i], return_inverse=True)
            permuted = np.stack([np.roll(self.letter(int(c)), self.gram - 1 - i) for c in codes]) if len(codes) else None
            if permuted is not None:
                out *= permuted[which]
        return out

    def bundles(self, texts: Iterable[str | None], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A vector per text (or per group number), and whether it holds any n-gram.

        Sums are whole numbers, kept exact: blocks of at most ``BLOCK_CHARS`` characters are added in float32, where
        whole numbers below 2 ** 24 are exact, and collected in float64.
        """
        rows = len(texts) if group is None else int(group.max(initial=-1)) + 1
        out, seen = np.zeros((rows, self.dimensions)), np.zeros(rows, bool)
        for part, at in _blocks(texts):
            letters, owner, which = self.grams(part)
            if not len(letters):
                continue
            owner = np.asarray(at)[owner] if group is None else group[np.asarray(at)[owner]]
            owners, row = np.unique(owner, return_inverse=True)
            weight = np.bincount(row * len(letters) + which, minlength=len(owners) * len(letters))
            weight = weight.reshape(len(owners), -1).astype(np.float32)
            for lo in range(0, len(letters), 8192):
                out[owners] += weight[:, lo:lo + 8192] @ self.bound(letters[lo:lo + 8192])
            seen[owners] = True
        return out, seen


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in blocks of bounded size; a longer text comes in pieces."""
    part, at, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            part.append(piece)
            at.append(i)
            size += len(piece)
            if size >= BLOCK_CHARS or len(part) >= BLOCK_TEXTS:
                yield part, at
                part, at, size = [], [], 0
    if part:
        yield part, at


def _pieces(text: str) -> Iterator[str]:
    """The text, cut after white space near every ``BLOCK_CHARS`` characters, so that no word is cut if it can be helped."""
    while len(text) > BLOCK_CHARS:
        cut = text.rfind(" ", BLOCK_CHARS // 2, BLOCK_CHARS) + 1 or BLOCK_CHARS
        yield text[:cut]
        text = text[cut:]
    yield text


def _strings(texts: pa.Array) -> Iterator[str | None]:
    """The texts one after the other; only ``BLOCK_TEXTS`` at a time become Python's."""
    for at in range(0, len(texts), BLOCK_TEXTS):
        yield from texts.slice(at, BLOCK_TEXTS).to_pylist()


_profiles: dict[tuple, Profiles] = {}


def _profile(*key) -> Profiles:
    """Shared by the tasks of one worker process."""
    if key not in _profiles:
        _profiles[key] = Profiles(*key)
    return _profiles[key]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM,
          seed: int = SEED) -> list[tuple[str, np.ndarray]]:
    """One prototype per language, learned from all rows with a text and a language; sorted by language.

    Every task adds the vectors of its rows per language, so only one vector per task and language is shuffled, and only
    one per language comes to the driver. Rows without text, letters or language teach nothing; repeated rows count as
    often as they stand.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches):
        profile = _profile(dimensions, gram, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            made, seen = profile.bundles(_strings(batch.column(0)), coded.indices.to_numpy())
            for name, vector, any_gram in zip(coded.dictionary.to_pylist(), made, seen):
                if any_gram:
                    sums[name] = sums.get(name, 0) + vector
            give_back()
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(vector), pa.string()), "place": np.arange(len(vector)), "value": vector.astype(np.int64)})

    parts = rows.mapInArrow(run, "lang string, place long, value long")
    whole = (parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
             .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("vector"))
             .select("lang", F.col("vector.value").alias("vector")))
    return sorted((row.lang, np.array(row.vector, np.float64)) for row in whole.collect())


def predict(docs: DataFrame, prototypes: list[tuple[str, np.ndarray]], text: str = "text", dimensions: int = DIMENSIONS,
            gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that language's prototype (0 where it is negative).

    ``und`` and 0 where the text is null, empty or without a letter, or where nothing was learned. Ties go to the
    language that sorts first. Columns of these names are replaced, the others pass unchanged.
    """
    name = fresh(docs, "guess")
    kept = every(docs.select(*[c for name_, c in zip(docs.columns, every(docs)) if name_ not in ("lang_pred", "score")]))
    return (docs.withColumn(name, guess(F.col(text), prototypes, dimensions, gram, seed))
            .select(*kept, f"{name}.lang_pred", f"{name}.score"))


def guess(text: Column, prototypes: list[tuple[str, np.ndarray]], dimensions: int = DIMENSIONS, gram: int = GRAM,
          seed: int = SEED, letters: list[int] | None = None) -> Column:
    """``predict`` as a column: a struct of ``lang_pred`` and ``score``; with ``letters`` also ``known``, ``known_share``'s value.

    One function makes all of them, since each function of its own takes a worker process of its own beside every task.
    """
    names = [name for name, _ in prototypes]
    matrix = np.stack([v / (np.linalg.norm(v) or 1) for _, v in prototypes]) if prototypes else np.zeros((0, dimensions))
    known = None if letters is None else np.array(letters, np.int64)

    @F.arrow_udf("lang_pred string, score double" + ("" if known is None else ", known double"))
    def compared(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profile = _profile(dimensions, gram, seed)
        for texts in parts:
            yield _compared(texts, profile, names, matrix, known)
            give_back()

    return compared(text)


def _compared(whole: pa.Array, profile: Profiles, names: list[str], matrix: np.ndarray, known: np.ndarray | None) -> pa.StructArray:
    """``guess`` of a batch of texts. A batch may have 10,000, whose vectors would take 40 MB: ``BLOCK_TEXTS`` are done at once."""
    langs, scores, shares = np.full(len(whole), "und", object), np.zeros(len(whole)), []
    for at in range(0, len(whole), BLOCK_TEXTS):
        texts = whole.slice(at, BLOCK_TEXTS).to_pylist()
        if known is not None:
            shares += _known(texts, known)
        made, seen = profile.bundles(texts)
        if names:
            norms = np.linalg.norm(made, axis=1)
            # rounded, so that the order of additions in a product cannot turn a tie
            cosines = np.round(made @ matrix.T / np.where(norms > 0, norms, 1)[:, None], 12)
            best = cosines.argmax(axis=1)
            langs[at:at + len(texts)][seen] = np.array(names, object)[best[seen]]
            scores[at:at + len(texts)][seen] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[seen]
    columns = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)}
    if known is not None:
        columns["known"] = pa.array(shares, pa.float64())
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), prototypes).drop("text")


#: a letter is a language's if it makes up this part of the language's letters: at most 1 / USED letters for each
USED = 1e-4
#: a text of whose letters a smaller part is used by any learned language is in none of them
KNOWN = 0.5


def used_letters(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[int]:
    """The code points of the (lower-case) letters that the learned languages use, ascending.

    Counted over all rows with a text and a language; a letter counts for a language from a share of ``USED`` on, so a few
    foreign names do not add an alphabet, and at most 1 / ``USED`` letters per language come to the driver.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(1).to_pylist(), _strings(batch.column(0))):
                for at in range(0, len(text), BLOCK_CHARS):
                    found = np.bincount(_table()[_code_points(text[at:at + BLOCK_CHARS])])
                    whole = counts.get(name, found[:0])
                    if len(whole) < len(found):
                        whole, found = found, whole
                    whole[:len(found)] += found
                    counts[name] = whole
            give_back()
        for name, whole in counts.items():
            whole[SPACE] = 0
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "letter": at, "times": whole[at]})

    letters = rows.mapInArrow(run, "lang string, letter long, times long").groupBy("lang", "letter").agg(F.sum("times").alias("times"))
    share = F.col("times") / F.sum("times").over(Window.partitionBy("lang"))
    chosen = letters.select("letter", share.alias("share")).where(F.col("share") >= USED).select("letter").distinct()
    return sorted(row.letter for row in chosen.collect())


def known_share(text: Column, letters: list[int]) -> Column:
    """The part of a text's letters that are in ``letters``; null where it has no letter."""
    known = np.array(letters, np.int64)

    @F.arrow_udf("double")
    def share(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(_known(_strings(texts), known), pa.float64())
            give_back()

    return share(text)


def _known(texts: Iterable[str | None], letters: np.ndarray) -> list[float | None]:
    """``known_share`` of each text."""
    table = np.zeros(0x110000, bool)
    table[letters] = True
    out: list[float | None] = []
    for text in texts:
        there = of = 0
        for at in range(0, len(text or ""), BLOCK_CHARS):
            points = _table()[_code_points(text[at:at + BLOCK_CHARS])]
            points = points[points != SPACE]
            there, of = there + int(table[points].sum()), of + len(points)
        out.append(there / of if of else None)
    return out


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a learned language: rejects those without letters (``und``) and those most of whose letters no learned
    language uses, as texts in another script.

    The cosine rejects nothing: of a short text it is chance (its deviation is 1 / sqrt(dimensions)), so a limit would take
    clean short documents along. A text in another language of a learned script stays, under the language it resembles most.
    """
    taught = docs.where(~held_out(F.col("doc_id")))
    prototypes, letters = train(taught), used_letters(taught)
    name = fresh(docs, "guess")
    guessed = docs.withColumn(name, guess(F.col("text"), prototypes, letters=letters))
    return guessed.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.known") >= KNOWN)).select(*every(docs))
