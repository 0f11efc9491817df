"""Visually identical text with different characters: confusables skeletons.

skeleton(text): canonical and compatibility decomposition, removal of invisible characters, every kind of blank to a
space, each character replaced by its prototype from the look-alike table, decomposition again. Two texts look the same
iff their skeletons are equal. Case, accents, punctuation and the number of blanks stay visible.

The decomposition has no JVM built-in, so one Arrow function computes skeleton and digest; plain ASCII texts take a fast
path. Only 16-byte digests are shuffled. Groups are found by a map-side combined aggregate over the digests; rows of
groups with a single spelling, the mass of the data and every hot group of plain copies, drop out before the join.
Spellings of a group meet once each, whatever the number of their rows, and are expanded to rows last; `classes` gives
one row per text instead of pairs.

The table holds the letters of Cyrillic, Greek, Armenian, Cherokee and Lisu that look like Latin ones. Known gaps: other
scripts, digits of other scripts without a decomposition, and look-alikes of several letters (rn and m).

Defined cases: NULL texts have no skeleton and pair with nothing; the empty text and a text of invisible characters
look the same; equal strings are no case; repeated rows each count.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import cut

#: Letters of other alphabets and the Latin letters that they look like (Unicode confusables).
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "һ": "h", "ӏ": "l", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꭲ": "T", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "к": "k", "ĸ": "k", "г": "r", "ь": "b", "т": "ᴛ", "в": "ʙ", "н": "ʜ", "м": "ᴍ", "ε": "ɛ", "ӡ": "ʒ", "є": "ɛ", "Ԍ": "G", "Ꮐ": "G", "Ꮍ": "Y", "Ꭹ": "Y", "Ꭰ": "D", "Ꭱ": "R", "Ꮢ": "R", "Ꭵ": "i", "Ꮃ": "W", "Ꮤ": "W", "Ꮒ": "h", "Ꮓ": "Z", "Ꮞ": "4", "Ꮥ": "S", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮲ": "P", "Ꮷ": "d", "Ꮟ": "b",
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
_TABLE = {ord(a): b for a, b in LOOK_ALIKES.items()}
_INVISIBLE = {c: None for c in [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE01F0)]}
_BLANKS = {c: " " for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 9, 10, 11, 12, 13]}
_FIRST = _INVISIBLE | _BLANKS | _TABLE
_LINES = str.maketrans("\t\n\v\f\r", "     ")


def skeleton(text: str) -> str:
    """What a text looks like."""
    if text.isascii():
        return text.translate(_LINES) if not text.isprintable() else text
    out = unicodedata.normalize("NFKD", text.translate(_FIRST)).translate(_FIRST)
    return unicodedata.normalize("NFKD", out)


@F.pandas_udf(T.StringType())
def skeletons(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([None if t is None else skeleton(t) for t in s], dtype=object)


@F.pandas_udf(T.BinaryType())
def skeleton_digests(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([None if t is None else hashlib.md5(skeleton(t).encode("utf-8", "surrogatepass")).digest() for t in s], dtype=object)


def consistent_form(df: DataFrame, text: str, out: str = "skeleton") -> DataFrame:
    """Adds the one consistent form of a text column."""
    return df.withColumn(out, skeletons(F.col(text)))


def _several(rows: DataFrame, key: str, text: str) -> DataFrame:
    """k, raw and look digests of the rows whose look has more than one spelling."""
    t: Column = F.col(text)
    marked = cut(rows.where(t.isNotNull()).select(F.col(key).alias("k"), F.unhex(F.md5(t)).alias("raw"), skeleton_digests(t).alias("look")))
    several = marked.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look")
    return cut(marked.join(several, "look", "left_semi"))


def look_alikes(rows: DataFrame, key: str = "row_index", text: str = "raw_text") -> DataFrame:
    """row_index_a < row_index_b: rows whose texts look the same and are not the same."""
    inside = _several(rows, key, text)
    kinds = inside.select("look", "raw").distinct()
    a, b = (kinds.select("look", F.col("raw").alias(f"raw_{s}")) for s in "ab")
    met = a.join(b, "look").where("raw_a < raw_b").select("raw_a", "raw_b")
    of = lambda s: inside.select(F.col("raw").alias(f"raw_{s}"), F.col("k").alias(f"k_{s}"))
    pairs = met.join(of("a"), "raw_a").join(of("b"), "raw_b")
    return pairs.select(F.least("k_a", "k_b").alias("row_index_a"), F.greatest("k_a", "k_b").alias("row_index_b"))


def classes(rows: DataFrame, key: str = "row_index", text: str = "raw_text") -> DataFrame:
    """class_id (smallest key of the texts that look the same), spelling_id (smallest key of the equal texts) and key of
    every row whose look has more than one spelling."""
    inside = _several(rows, key, text)
    looks, raws = (inside.groupBy(c).agg(F.min("k").alias(f"{n}_id")) for c, n in (("look", "class"), ("raw", "spelling")))
    return inside.join(looks, "look").join(raws, "raw").select("class_id", "spelling_id", F.col("k").alias(key))
