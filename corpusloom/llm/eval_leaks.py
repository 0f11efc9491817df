"""Evaluation texts leaking into training text: pigeonhole edit matching.

Every window of `RUN` words of a test item may differ from the corpus by `BUDGET` edits of one letter or blank. Pieces
are the aligned blocks of PIECE words of each item: every run of RUN words holds 2 * BUDGET + 1 of them whole, and as an
edit of the blank between two pieces breaks both, one piece must still occur exactly, in an exact run of `LEAST` words.
An Aho-Corasick automaton finds all exact piece hits in a document in one pass. Each hit is extended word by word to an
exact run, once for each run; where that is shorter than RUN, it is carried on beyond one word that differs (or one that
is split or joined) on either side, and a window of RUN words so reached is decided by Myers' bit-parallel edit distance.
A leak as TESTDATA.md defines it is an exact run of RUN words, which is checked last.

Documents are read once and never shuffled. Items go to the workers in blocks of at most `BLOCK_WORDS` words, so the
automaton has a bound whatever the number of items; more items mean more passes.

Words are compared without case, punctuation, blanks, line breaks, quote marks and <br>. Defined cases: NULL texts on
either side match nothing; items of fewer than RUN words leak nothing; an item twice under two ids is reported for both;
a document that holds an item twice is reported once, with its longest run.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 16
BUDGET = 1
PIECE = (RUN + 1) // (2 * BUDGET + 2)
LEAST = (RUN - BUDGET) // (BUDGET + 1)  # words of the longest exact run in a window within the budget
BLOCK_WORDS = 1_000_000
_BREAK = re.compile(r"<br\s*/?>", re.I)


class _Drop(dict):
    """Translation that deletes punctuation and the marks of quoting and markup."""

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = None if unicodedata.category(c)[0] == "P" or c in "<>|`^~" or code in (0x307, 0xAD, 0x200B) else code
        return self[code]


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared."""
    folded = _BREAK.sub(" ", text).casefold().replace("ı", "i")
    return folded.translate(_Drop()).split()


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of the pattern to any part of the text, by bit-parallel columns; most + 1 if above."""
    m = len(pattern)
    if not m:
        return 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return min(best, most + 1)


def _run(item: list[str], at: int, doc: list[str], start: int) -> tuple[int, int]:
    """Words before the piece and in all of the exact run around the piece at item[at:] and doc[start:]."""
    a = 0
    while a < at and a < start and item[at - 1 - a] == doc[start - 1 - a]:
        a += 1
    b = 0
    while at + b < len(item) and start + b < len(doc) and item[at + b] == doc[start + b]:
        b += 1
    return a, a + b


def _near(item: list[str], at: int, doc: list[str], start: int, n: int) -> int:
    """Least distance of a window of RUN words that holds the exact run of n words at item[at:] and doc[start:] and goes
    on beyond one edit, before or after it. One edit changes a word, splits one in two or joins two."""
    best = BUDGET + 1
    for i, d in ((1, 1), (2, 1), (1, 2)):
        e, f = at + n + i, start + n + d
        if e <= len(item) and f <= len(doc):
            more = 0
            while e + more < len(item) and f + more < len(doc) and item[e + more] == doc[f + more] and n + i + more < RUN:
                more += 1
            if n + i + more >= RUN:
                begin = e + more - RUN
                best = min(best, myers(" ".join(item[begin : begin + RUN]), " ".join(doc[start - at + begin : f + more]), BUDGET))
        e, f = at - i, start - d
        if e >= 0 and f >= 0:
            more = 0
            while more < e and more < f and item[e - 1 - more] == doc[f - 1 - more] and n + i + more < RUN:
                more += 1
            if n + i + more >= RUN:
                begin = e - more
                best = min(best, myers(" ".join(item[begin : begin + RUN]), " ".join(doc[f - more : start + begin + RUN - at]), BUDGET))
    return best


def _finder(items: list[tuple[int, str]], near: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = {}, defaultdict(list)
        for key, text in items:
            w = split[key] = words_of(text)
            for at in range(0, len(w) - PIECE + 1, PIECE):
                pieces[" " + " ".join(w[at : at + PIECE]) + " "].append((key, at))
        machine = ahocorasick.Automaton()
        for p, where in pieces.items():
            machine.add_word(p, (len(p), where))
        machine.make_automaton()
        for batch in batches:
            docs, found, longest, distance = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = words_of(text)
                line = " " + " ".join(doc) + " "
                best: dict[int, tuple[int, int]] = {}
                done: dict[tuple[int, int], int] = {}  # of item and diagonal: where the last run ends in the document
                blanks, last = 0, 0
                for end, (size, where) in machine.iter(line) if pieces else ():
                    # Hits come by their ends; those of one end may begin anywhere before.
                    blanks, last = blanks + line.count(" ", last, end + 1), end + 1
                    start = blanks - PIECE - 1
                    for key, at in where:
                        if done.get((key, at - start), -1) > start:
                            continue
                        a, n = _run(split[key], at, doc, start)
                        done[key, at - start] = start - a + n
                        if n < LEAST or n < RUN and not near:
                            continue
                        d = 0 if n >= RUN else _near(split[key], at - a, doc, start - a, n)
                        if d <= BUDGET:
                            old = best.get(key, (0, BUDGET + 1))
                            best[key] = (max(old[0], n), min(old[1], d))
                for key, (n, d) in best.items():
                    docs.append(doc_id)
                    found.append(key)
                    longest.append(n)
                    distance.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(longest, pa.int32()), pa.array(distance, pa.int32())], names=["doc_id", "item_id", "run_words", "distance"])

    return run


def passages(documents: DataFrame, items: DataFrame, near: bool = True) -> DataFrame:
    """doc_id, item_id, run_words (longest exact run), distance (of the nearest window) of every leaked item."""
    items = items.where(F.col("text").isNotNull()).select("item_id", "text")
    n_words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-n_words // BLOCK_WORDS))
    docs = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    out = None
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        part = docs.mapInArrow(_finder(block, near), "doc_id bigint, item_id bigint, run_words int, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: the document holds RUN words of the item in a row."""
    return passages(documents, items).where(F.col("run_words") >= RUN).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, dataset, n_documents with RUN words in a row, n_near documents with a window within the budget only,
    longest run of each test item that leaked."""
    p = passages(documents, items).groupBy("item_id", "doc_id").agg(F.max("run_words").alias("run_words"))
    n = p.groupBy("item_id").agg(F.count_if(F.col("run_words") >= RUN).alias("n_documents"), F.count_if(F.col("run_words") < RUN).alias("n_near"), F.max("run_words").alias("longest_run"))
    return n.join(items.select("item_id", "dataset"), "item_id")
