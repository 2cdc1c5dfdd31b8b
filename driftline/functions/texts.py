"""Text expressions: byte sizes, preserve letters, progress pairs and stored messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter of each file attribute that a copy may preserve.
PRESERVE_LETTERS = {
    "r": "REPLICATION", "b": "BLOCKSIZE", "u": "USER", "g": "GROUP", "p": "PERMISSION",
    "c": "CHECKSUMTYPE", "a": "ACL", "x": "XATTR", "t": "TIMES",
}
# Unit letter of each power of 1024.
BYTE_UNITS = ["B", "K", "M", "G", "T", "P"]
# Longest stored message, length kept of a longer one, mark put behind it.
MESSAGE_LIMIT, MESSAGE_KEPT, MESSAGE_MARK = 4000, 3899, " ..."


def byte_text(size: Column) -> Column:
    """``1536`` to ``1.5K``; below 1024 the plain number of bytes with a B."""

    def number(value: Column) -> Column:
        return F.call_function("format_number", value, F.lit("0.0"))

    text = F.concat(number(size.cast("double")), F.lit(BYTE_UNITS[0]))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        scaled = size / F.lit(float(1024 ** power))
        text = F.when(size >= 1024 ** power,
                      F.concat(number(scaled), F.lit(unit))).otherwise(text)
    return text


def attributes_of(letters: Column) -> Column:
    """``ugp`` to the array of attribute names, in the fixed order of the letters."""
    known = F.array(*[F.when(F.contains(F.lower(letters), F.lit(k)), F.lit(v)) for k, v in PRESERVE_LETTERS.items()])
    return F.array_compact(known)


def letters_of(attributes: Column) -> Column:
    """Array of attribute names back to letters."""
    known = F.array(*[F.when(F.array_contains(attributes, v), F.lit(k)) for k, v in PRESERVE_LETTERS.items()])
    return F.array_join(F.array_compact(known), "")


def unknown_letters(letters: Column) -> Column:
    """Letters that name no attribute; a non-empty result is an error in a preserve string."""
    return F.array_distinct(F.filter(F.split(F.lower(letters), ""),
                                     lambda c: (c != "") & ~c.isin(list(PRESERVE_LETTERS))))


def progress_pair(text: Column) -> tuple[Column, Column]:
    """``x/y`` to (done, total); both 0 when there is no text."""
    parts = F.split(text, "/")
    done = F.coalesce(F.get(parts, 0).try_cast("bigint"), F.lit(0))
    total = F.coalesce(F.get(parts, 1).try_cast("bigint"), F.lit(0))
    return done, total


def short_message(message: Column) -> Column:
    """The message as a fixed-width column of a relational store takes it: over the limit it is cut and marked."""
    cut = F.concat(F.substring(message, 1, MESSAGE_KEPT), F.lit(MESSAGE_MARK))
    return F.when(F.length(message) > MESSAGE_LIMIT, cut).otherwise(message)
