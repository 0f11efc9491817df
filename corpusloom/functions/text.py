"""Text functions as JVM-side column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = r"[\p{L}\p{M}\p{N}\p{Pc}]"


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; Arrow batches, ASCII untouched."""
    for s in texts:
        yield pd.Series([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in s], dtype=object)


def clean_text(text: Column, normalize: bool = True) -> Column:
    """Lower case and compatibility composition; tags, links, @ and # tokens, words with digits and everything but letters
    removed; words of one character dropped. All but the composition, which skips ASCII, stays in the JVM."""
    t = F.lower(text)
    t = nfkc(t) if normalize else t
    for pattern in ("<.*?>", r"http\S+|www\.\S+", rf"[@#]{_W}+", rf"{_W}*\p{{Nd}}{_W}*", r"[^\p{L}\s]"):
        t = F.regexp_replace(t, pattern, " ")
    return F.array_join(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 1), " ")


def exact_key(text: Column) -> Column:
    """Case folded, blanks collapsed."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def slug(name: Column, style: str = "collapse") -> Column:
    """plain: each foreign character is a _; collapse: runs are one _; joined: also none at the ends."""
    low = F.lower(name)
    if style == "plain":
        return F.regexp_replace(low, r"[^\p{L}\p{N}]", "_")
    run = F.regexp_replace(low, r"[^\p{L}\p{N}]+", "_")
    return F.regexp_replace(run, "^_+|_+$", "") if style == "joined" else run


def trailing_width(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def _slices(n: int, size, cut):
    """Windows of n over a string or array column of this size."""
    return lambda x: F.when(size(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(size(x) - n + 1, F.lit(1))), lambda i: cut(x, i))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """n-grams inside words, each word padded with one blank on both sides."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        return F.flatten(F.transform(padded, _slices(n, F.length, lambda w, i: F.substring(w, i, F.lit(n)))))

    return F.flatten(F.array(*(of(n) for n in range(low, high + 1))))


def word_ngrams(text: Column, high: int = 2) -> Column:
    """Words of two or more characters and their runs up to `high`."""
    w = F.filter(words(text), lambda x: F.length(x) >= 2)

    def of(n: int) -> Column:
        return _slices(n, F.size, lambda x, i: F.array_join(F.slice(x, i, n), " "))(w)

    return F.flatten(F.array(w, *(of(n) for n in range(2, high + 1))))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def chance(row: Column, place: Column, seed: int) -> Column:
    """A portable pseudo-random number in [0, 1) of a row and a place in it: integer arithmetic with squaring steps."""
    p = F.lit(2147483647)
    x = F.pmod(row * 7919 + place * 104729 + seed, p)
    x = F.pmod(x * 48271, p)
    x = F.pmod(x * x, p)
    x = F.pmod(F.pmod(x + row * 31 + place * 17, p) * 69621, p)
    return F.pmod(x * x, p) / 2147483647.0


def _changed(text: Column, row: Column, seed: int, rate: float, fits, change) -> Column:
    draw = lambda i, k: chance(row.cast("bigint"), i.cast("bigint") + k, seed)
    each = F.transform(words(text), lambda w, i: F.when(fits(w) & (draw(i, 0) < rate), change(w, draw(i, 1_000_003))).otherwise(w))
    return F.array_join(each, " ")


def swap_characters(text: Column, row: Column, seed: int = 42, rate: float = 0.35) -> Column:
    """Two inner neighbours of words of five letters or more change places; which ones is drawn."""
    part = lambda w, a, n: F.substring(w, a, n)

    def turn(w: Column, u: Column) -> Column:
        at = (F.floor(u * (F.length(w) - 3)) + 2).cast("int")  # the first of the two, counted from 1
        return F.concat(part(w, F.lit(1), at - 1), part(w, at + 1, F.lit(1)), part(w, at, F.lit(1)), part(w, at + 2, F.length(w)))

    return _changed(text, row, seed, rate, lambda w: (F.length(w) >= 5) & w.rlike(r"^\p{L}+$"), turn)


def insert_spaces(text: Column, row: Column, seed: int = 42, rate: float = 0.35) -> Column:
    """A blank at a drawn place inside words of six letters or more, two letters from the ends at least."""

    def part(w: Column, u: Column) -> Column:
        at = (F.floor(u * (F.length(w) - 4)) + 2).cast("int")
        return F.concat(F.substring(w, F.lit(1), at), F.lit(" "), F.substring(w, at + 1, F.length(w)))

    return _changed(text, row, seed, rate, lambda w: (F.length(w) >= 6) & w.rlike(r"^\p{L}+$"), part)


def leetspeak(text: Column, row: Column, seed: int = 42, rate: float = 0.35) -> Column:
    return _changed(text, row, seed, rate, lambda w: F.length(w) >= 1, lambda w, u: F.translate(w, "aeios", "43105"))


def vary_urls(text: Column) -> Column:
    """Links only: words that hold http, www or .com; blanks are collapsed."""
    link = lambda w: w.contains("http") | w.contains("www") | w.contains(".com")
    change = lambda w: F.replace(F.replace(w, F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit(" dot "))
    return F.array_join(F.transform(words(text), lambda w: F.when(link(w), change(w)).otherwise(w)), " ")
