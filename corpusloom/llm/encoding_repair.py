"""Garbled text from wrong character encoding: code-page swaps as substitution ciphers, learnt per source by EM.

Bytes written in one encoding and read in another turn every letter beyond ASCII into fixed units of one or more
characters: a substitution cipher whose key differs by source. Language bigrams are counted over all clean texts; a pair
counts as known if enough texts hold it, so a few garbled texts among the clean ones teach nothing. A screen in numpy
finds the texts with letter pairs that these bigrams do not know, and their words are looked at further:

- Words that a swap of known code pages deciphers to a far likelier word give their swap a share; EM over the shares of
  each source weighs the swaps that tie, and the letters read give the source's table of units and letters.
- All other words of unknown pairs are read as ciphers of unknown pages, with units of one and of two characters. What EM
  needs of them are the counts of neighbouring units, a table whose size depends on the alphabet only. EM alternates
  between the posterior of the letters behind each pair of units, from the language bigrams and the table of the source,
  and the table; letters of high posterior join the source's table.

Tables are learnt per source on the workers. A word is deciphered by the likeliest of its readings, a swap or the table
of its source applied with translate(), as often as it gets likelier, so texts garbled repeatedly come back too.

A record is garbled if some word deciphers to a far likelier word, or holds the replacement character, or keeps units
of the source's table that no swap can restore. One word with one foreign letter is no sign of a swap between one-byte
pages, unless the table of the source knows that letter from several words.

Defined cases: NULL and plain ASCII texts are never garbled; sources without garbled words use the tables of all sources
together; a record garbled in part is restored in that part; what can't be restored is left as it is; equal texts get
equal results; very long texts are screened as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KNOWN = 1 / 200_000  # least share of the clean texts that hold a known pair, but two texts at least
SURE = 0.9  # posterior of a letter that joins the table
SEEN = 5  # least count of its unit
ALPHABET = 0.005  # least share of an alphabet in the letters beyond ASCII
RARE = 5e-6  # letters of a smaller share of the clean texts are not looked for behind unknown units
GAIN = 1.5  # nats a character by which the deciphered word must be likelier
_PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp857", "cp866", "mac_roman", "mac_cyrillic", "mac_turkish", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_9", "iso8859_15")
_TRUE_PAGES = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1254", "cp857", "mac_turkish", "cp1252", "cp850", "cp437", "mac_roman")
_QUOTES = str.maketrans({c: '"' for c in "“”„«»‘’‚…–—•"} | {c: "$" for c in "€£₹₺¥"})
_HIGH = re.compile(r"[^\x00-\x7f]")
_CONTROL = re.compile(r"[\x80-\x9f]")


def _encode(text: str, page: str) -> bytes | None:
    """The bytes that a page shows as this text; bytes the page leaves undefined show as control characters."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(page)
            except UnicodeEncodeError:
                if 0x80 <= ord(c) < 0xA0:
                    out.append(ord(c))
                else:
                    return None
        return bytes(out)


#: (name, page it was read in, encoding it was written in)
SWAPS = tuple((f"utf-8 as {p}", p, "utf-8") for p in _PAGES) + tuple((f"{t} as {p}", p, t) for t in _TRUE_PAGES for p in _PAGES if p != t)


def _decode(word: str, swap: tuple[str, str, str]) -> str | None:
    raw = _encode(word, swap[1])
    if raw is None:
        return None
    try:
        out = raw.decode(swap[2])
    except UnicodeDecodeError:
        return None
    return out if out != word else None


def decipher(word: str, swap: tuple[str, str, str]) -> str | None:
    out = _decode(word, swap)
    return None if out is None or _CONTROL.search(out) else out


def _chain(word: str, swap: tuple[str, str, str]) -> Iterator[str]:
    """The word deciphered once, and as often again as a swap that shortens it still applies."""
    out = _decode(word, swap)
    while out is not None:
        if not _CONTROL.search(out):
            yield out
        out = _decode(out, swap) if len(out) < len(word) else None


def _units(word: str, swap: tuple[str, str, str]) -> Iterator[tuple[str, str]]:
    """(unit, letter) pairs of a garbled word."""
    at = 0
    for c in decipher(word, swap) or "":
        n = len(c.encode(swap[2], "ignore"))
        if n > 1 or ord(c) > 127:
            yield word[at : at + n], c
        at += n


@dataclass
class Model:
    pairs: np.ndarray  # sorted known pairs, c1 << 21 | c2
    logp: dict[tuple[str, str], float]
    alphabet: dict[str, float]
    joint: dict[tuple[str, str], int]  # counts of pairs as written
    weights: dict[str, dict[int, float]] = field(default_factory=dict)  # of source: swap -> weight
    tables: dict[str, dict[str, tuple[str, int]]] = field(default_factory=dict)  # of source: unit -> letter, count


def _pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter pairs (c1 << 21 | c2), how often they occur, and in how many texts (0 for pairs of ASCII)."""
    lines = [f" {t.translate(_QUOTES)} " for t in texts]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    key = ((codes[:-1] << 21) | codes[1:])[of[1:] == of[:-1]]
    pairs, n = np.unique(key, return_counts=True)
    high = (codes[:-1] > 127) | (codes[1:] > 127)
    high &= of[1:] == of[:-1]
    each = np.unique((of[:-1][high] << 42) | (codes[:-1][high] << 21) | codes[1:][high]) & ((1 << 42) - 1)
    held, times = np.unique(each, return_counts=True)
    out = np.zeros(len(pairs), dtype=np.int64)
    out[np.searchsorted(pairs, held)] = times
    return pairs, n, out


def model_of(rows: list[tuple[int, int, int]], n_texts: int) -> Model:
    """The language bigrams from (pair, occurrences, texts); every pair also counts without its case."""
    counts: Counter = Counter()
    texts: Counter = Counter()
    joint: dict[tuple[str, str], int] = {}
    for key, n, held in rows:
        a, b = chr(key >> 21), chr(key & 0x1FFFFF)
        joint[a, b] = n
        for x, y in {(a, b), (a.lower(), b.lower()), (a.upper(), b.upper())}:
            if len(x) == len(y) == 1:
                counts[x, y] += n
                texts[x, y] += held
    first: Counter = Counter()
    letters: Counter = Counter()
    for (a, b), n in counts.items():
        first[a] += n
        letters[b] += n
    total = sum(letters.values()) or 1
    alphabet = {c: float(np.log(n / total)) for c, n in letters.items()}
    least = max(2, n_texts * KNOWN)
    logp = {(a, b): float(np.log(0.95 * n / first[a] + 0.05 * letters[b] / total)) for (a, b), n in counts.items() if ord(a) < 128 and ord(b) < 128 or texts[a, b] >= least}
    pairs = np.array(sorted({(ord(a) << 21) | ord(b) for (a, b), n in texts.items() if n >= least}) or [0], dtype=np.int64)
    return Model(pairs, logp, alphabet, joint)


def bigrams(texts: list[str]) -> Model:
    """The language bigrams of clean texts."""
    return model_of(list(zip(*(x.tolist() for x in _pair_counts(texts)))), len(texts))


_UNKNOWN = -14.0


def likelihood(m: Model, word: str) -> float:
    """Log probability of a word, in the case that suits it best."""
    low = word.lower()
    return max(_likelihood(m, word), _likelihood(m, low)) if low != word else _likelihood(m, word)


def _likelihood(m: Model, word: str) -> float:
    line = f" {word.translate(_QUOTES)} "
    return sum(m.logp.get((a, b)) or (m.alphabet.get(b, _UNKNOWN) - 3.0) for a, b in zip(line, line[1:]))


_SCRIPTS = (re.compile("[A-Za-z\u00c0-\u024f]"), re.compile("[\u0370-\u03ff]"), re.compile("[\u0400-\u04ff]"), re.compile("[\u0900-\u097f]"))


def _mixed(word: str) -> bool:
    """Whether one word has letters of several alphabets."""
    return sum(1 for s in _SCRIPTS if s.search(word)) > 1


def _evidence(word: str) -> int:
    """Characters beyond ASCII that are no quotation marks, dashes or currency signs."""
    return sum(1 for c in word if ord(c) > 127 and ord(c) not in _QUOTES)


def suspicious(m: Model, texts: list[str]) -> np.ndarray:
    """Which texts have a pair with a character beyond ASCII that the bigrams do not know."""
    lines = [f" {t.translate(_QUOTES)} " for t in texts]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    of = np.repeat(np.arange(len(lines)), sizes)
    high = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
    key = (codes[high] << 21) | codes[high + 1]
    at = np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)
    out = np.zeros(len(texts), dtype=bool)
    out[of[high[m.pairs[at] != key]]] = True
    return out


def _words(m: Model, text: str) -> list[str]:
    return [w for w in re.split(r"[ \n\r\t|]+", text) if _HIGH.search(w)]


def _readings(m: Model, word: str, swaps: list[int]) -> list[tuple[int, str, float]]:
    """(swap, deciphered word, gain in nats) for swaps that read the word better than it stands."""
    base, out, seen = likelihood(m, word), [], {}
    for k in swaps:
        best = (0.0, "")
        for d in _chain(word, SWAPS[k]):
            if _mixed(d) and not _mixed(word):
                continue
            if d not in seen:
                seen[d] = likelihood(m, d)
            # A unit costs its characters once: the shorter reading may not win by length alone.
            best = max(best, (seen[d] + 2.0 * (len(d) - len(word)) - base, d))
        if best[0] > 0:
            out.append((k, best[1], best[0]))
    return out


def _units_of(word: str, size: int) -> list[str]:
    """A word as cipher units: ASCII letters, and runs of other characters in units of this size; [] if they don't fit."""
    out = []
    for piece in re.findall(r"[\x00-\x7f]|[^\x00-\x7f]+", word):
        if piece.isascii():
            out.append(piece)
        elif len(piece) % size:
            return []
        else:
            out += [piece[k : k + size] for k in range(0, len(piece), size)]
    return out


def evidence(m: Model, words: list[tuple[str, str, int]]) -> list[tuple[str, str, str, str, int, int]]:
    """(source, kind, a, b, occurrences, words) from distinct (source, suspicious word, occurrences). swap: the swaps that
    tie as best; table: unit and letter of words that a swap deciphers; 1 and 2: neighbouring units of words that none
    deciphers. What is believed is counted in words, so one frequent word teaches nothing."""
    out: dict[tuple[str, str, str, str], list[int]] = defaultdict(lambda: [0, 0])
    every, read = list(range(len(SWAPS))), {}

    def add(n: int, *key: str) -> None:
        out[key][0] += n
        out[key][1] += 1

    for source, w, n in words:
        if w not in read:
            r = _readings(m, w, every)
            top = max((g for *_, g in r), default=0.0)
            read[w] = [(k, d) for k, d, g in r if g >= top - 0.5] if top >= GAIN * max(2, _evidence(w)) else []
        if read[w]:
            add(n, source, "swap", ",".join(str(k) for k, _ in read[w]), "")
            if decipher(w, SWAPS[read[w][0][0]]) == read[w][0][1]:
                for unit, letter in _units(w, SWAPS[read[w][0][0]]):
                    add(n, source, "table", unit, letter)
            continue
        line = f" {w.translate(_QUOTES)} "
        high = [(a, b) for a, b in zip(line, line[1:]) if ord(a) > 127 or ord(b) > 127]
        if 2 * sum(1 for p in high if p not in m.logp) >= len(high) > 0:
            for size in (1, 2):
                u = _units_of(line, size)
                for a, b in zip(u, u[1:]):
                    add(n, source, str(size), a, b)
    return [(*k, *v) for k, v in out.items()]


def _cipher(m: Model, letters: list[str], units: list[str], unknown: list[int], n: np.ndarray, rounds: int, starts: int) -> tuple[float, np.ndarray]:
    """Log likelihood and expected counts [units, letters] of the best of several starts. The first start expects units
    and letters of like frequency, the others disturb that; the three likeliest after a tenth of the rounds go on."""
    place = {c: k for k, c in enumerate(letters)}
    p = np.full((len(letters), len(letters)), 0.01)
    for (a, b), k in m.joint.items():
        if a in place and b in place:
            p[place[a], place[b]] += k
    p /= p.sum()
    fixed, free = np.zeros((len(units), len(letters))), np.array([ord(c) > 127 for c in letters])
    for k, u in enumerate(units):
        if u in place and u.isascii():
            fixed[k, place[u]] = 1.0
    at = np.ix_(unknown, np.flatnonzero(free))
    shown, common = (n.sum(axis=0) + n.sum(axis=1))[unknown], p.sum(axis=0)[free]
    rank = np.log(shown / shown.sum())[:, None] - np.log(common / common.sum())

    def run(t: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
        last, e = -np.inf, t
        for step in range(rounds):
            z = t @ p @ t.T + 1e-300
            if step % 10 == 0:
                now = float((n * np.log(z)).sum())
                if now - last < 1e-6 * abs(now):
                    break
                last = now
            r = n / z
            e = t * (r @ t @ p.T + r.T @ t @ p)
            t = fixed.copy()
            t[at] = (e[at] + 1e-9) / (e[at].sum(axis=0) + 1e-9 * len(unknown))
        return float((n * np.log(t @ p @ t.T + 1e-300)).sum()), t, e

    tried = []
    for start in range(starts):
        t = fixed.copy()
        noise = np.random.default_rng(start).uniform(0.0, 2.0 if start else 0.0, rank.shape)
        t[at] = np.exp(-np.abs(rank) + noise)
        t[at] /= t[at].sum(axis=0)
        tried.append(run(t, rounds // 10))
    ends = [run(t, rounds) for _, t, _ in sorted(tried, key=lambda x: -x[0])[:3]]
    best = max(ends, key=lambda x: x[0])
    return best[0], best[2]


def decipher_units(m: Model, counts: dict[tuple[str, str], int], words: Counter, rounds: int = 300, starts: int = 20) -> dict[str, tuple[str, int]]:
    """Unit -> letter, count by EM on the counts of neighbouring units: P(u, v) = sum over letters x, y of P(x, y) T(u|x)
    T(v|y), where P are the language bigrams and T the table. ASCII stands for itself; of several random starts the
    likeliest counts."""
    # Units too rare to be learnt take no part.
    counts = {p: k for p, k in counts.items() if all(u.isascii() or words[u] >= SEEN for u in p)}
    units = sorted({u for p in counts for u in p})
    unknown = [k for k, u in enumerate(units) if not u.isascii()]
    times: Counter = Counter()
    for (_, b), k in m.joint.items():
        times[b] += k
    total = sum(times.values())
    letters = sorted(c for c, k in times.items() if ord(c) < 128 or k > RARE * total)
    unknown_n = np.zeros((len(units), len(units)))
    of = {u: k for k, u in enumerate(units)}
    for (a, b), k in counts.items():
        unknown_n[of[a], of[b]] += k
    if not unknown:
        return {}
    # A letter beyond ASCII is shown by an unknown unit, never by ASCII; the letters of a cipher are of one alphabet.
    name = {c: unicodedata.name(c, "").partition(" ")[0] for c in letters if ord(c) > 127}
    best, out, known = -np.inf, np.zeros((len(units), 1)), [""]
    share: Counter = Counter()
    for c, x in name.items():
        share[x] += times[c]
    for alphabet in sorted(x for x, k in share.items() if k >= ALPHABET * share.total()):
        own = [c for c in letters if name.get(c, alphabet) == alphabet]
        fit_, e = _cipher(m, own, units, unknown, unknown_n, rounds, starts)
        if fit_ > best:
            best, out, known = fit_, e, own
    letters = known
    table = {}
    for k in unknown:
        total, top = out[k].sum(), int(out[k].argmax())
        if out[k, top] >= SURE * total and letters[top] != units[k]:
            table[units[k]] = (letters[top], words[units[k]])
    return table


def learn_source(m: Model, rows: list[tuple[str, str, str, int, int]]) -> tuple[dict[int, float], dict[str, tuple[str, int]]]:
    """Weights of the swaps and the table of one source from its (kind, a, b, occurrences, words)
    evidence."""
    ties: Counter = Counter()
    seen: dict[str, Counter] = defaultdict(Counter)
    pairs: dict[str, Counter] = {"1": Counter(), "2": Counter()}
    shown: dict[str, Counter] = {"1": Counter(), "2": Counter()}
    for kind, a, b, n, words in rows:
        if kind == "swap":
            ties[tuple(map(int, a.split(",")))] += words
        elif kind == "table":
            seen[a][b] += words
        else:
            pairs[kind][a, b] += n
            shown[kind][a] += words
    swaps = sorted({k for t in ties for k in t})
    weight = {k: 1.0 / max(1, len(swaps)) for k in swaps}
    for _ in range(ROUNDS):
        expected: Counter = Counter()
        for t, n in ties.items():
            whole = sum(weight[k] for k in t)
            for k in t:
                expected[k] += n * weight[k] / whole
        total = sum(expected.values())
        weight = {k: max(expected[k] / total, 1e-12) for k in swaps}
    table = {}
    for size, counts in pairs.items():
        table |= decipher_units(m, counts, shown[size])
    for unit, c in seen.items():
        letter, n = c.most_common(1)[0]
        if n >= SURE * sum(c.values()):
            table[unit] = (letter, n)
    return weight, table


def learn(m: Model, rows: list[tuple[str, str, str, str, int, int]]) -> Model:
    """The model with the weights and tables of each source and of all together, from the evidence."""
    by: dict[str, list] = defaultdict(list)
    for source, *rest in rows:
        by[source].append(tuple(rest))
        if source:
            by[""].append(tuple(rest))
    for source, own in by.items():
        m.weights[source], m.tables[source] = learn_source(m, own)
    return m


def _apply(table: dict[str, tuple[str, int]], word: str) -> list[str]:
    """The table as translations: units of one character by translate(), longer ones by replacement, longest first."""
    long = word
    for u in sorted((u for u in table if len(u) > 1 and u in word), key=len, reverse=True):
        long = long.replace(u, table[u][0])
    return [word.translate({ord(u): x[0] for u, x in table.items() if len(u) == 1}), long]


class Restorer:
    """Restores texts; words are looked up once."""

    def __init__(self, m: Model):
        self.m, self.known = m, {}
        self.every = sorted({k for w in m.weights.values() for k in w})

    def word(self, source: str, word: str) -> tuple[str, bool, int, bool]:
        """The word restored, whether units of several characters prove it, its letters beyond ASCII, and whether the
        table of the source knows all of them."""
        key = (source, word)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._word(source if source in self.m.weights else "", word)
        return self.known[key]

    def _word(self, source: str, word: str) -> tuple[str, bool, int, bool]:
        m, table = self.m, self.m.tables.get(source, {})
        weights, sure, odd, learnt = m.weights.get(source, {}), False, 0, True
        while n := _evidence(word):
            options = [(g + np.log(weights.get(k, 1e-6) + 1e-6), g, d, SWAPS[k][2] == "utf-8", k) for k, d, g in _readings(m, word, self.every)]
            for t in _apply(table, word):
                if t != word and not (_mixed(t) and not _mixed(word)):
                    g = likelihood(m, t) + 2.0 * (len(t) - len(word)) - likelihood(m, word)
                    options.append((g - 3.0, g, t, len(t) < len(word), -1))
            score, g, d, multi, k = max(options, default=(0.0, 0.0, "", False, 0))
            if g < GAIN * max(2, n) or score < 0 and not multi:
                break
            odd += n
            learnt &= all(table.get(u, ("", 0))[1] >= SEEN for u in ([u for u, _ in _units(word, SWAPS[k])] if k >= 0 else [c for c in word if ord(c) > 127]))
            sure, word = sure or multi, d
        return word, sure, odd, learnt and odd > 0

    def text(self, source: str, text: str) -> tuple[str, bool]:
        """The text with garbled words restored, and whether any word was garbled."""
        out, sure, odd = re.split(r"([ \n\r\t|]+)", text), "\ufffd" in text, {}
        for at, piece in enumerate(out):
            if piece and _HIGH.search(piece):
                word, multi, n, learnt = self.word(source, piece)
                if word != piece:
                    sure, odd[piece], out[at] = sure or multi or learnt, n, word
        if not sure and len(odd) < 2 and sum(odd.values()) < 3:
            return text, False
        return "".join(out), True


def _worker(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(m)
        for batch in batches:
            ids, sources, texts = (c.to_pylist() for c in batch.columns)
            odd = np.flatnonzero(suspicious(m, texts)).tolist() if texts else []
            found = [(ids[k], *restorer.text(sources[k] or "", texts[k])) for k in odd]
            found = [f for f in found if f[2]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["record_id", "restored_text"])

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        pairs, n, held = _pair_counts(texts) if texts else (np.zeros(0, dtype=np.int64),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.append(pairs, -1), np.append(n, len(texts)), np.append(held, 0))], names=["pair", "n", "held"])


def _screen(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, texts = (c.to_pylist() for c in batch.columns)
            seen: Counter = Counter()
            for k in np.flatnonzero(suspicious(m, texts)).tolist() if texts else []:
                own = _words(m, texts[k])
                seen.update((sources[k] or "", own[j]) for j in np.flatnonzero(suspicious(m, own)).tolist())
            yield pa.RecordBatch.from_arrays([*(pa.array([x[j] for x in seen], pa.string()) for j in (0, 1)), pa.array(list(seen.values()), pa.int64())], names=["source", "word", "n"])

    return run


def _gather(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = evidence(m, list(zip(*(c.to_pylist() for c in batch.columns))))
            columns = [pa.array([x[j] for x in e], pa.string() if j < 4 else pa.int64()) for j in range(6)]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "kind", "a", "b", "n", "words"])

    return run


def _learner(m: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        weight, table = learn_source(m, list(zip(g["kind"], g["a"], g["b"], g["n"].tolist(), g["words"].tolist())))
        rows = [(str(k), "", 0, x) for k, x in weight.items()] + [(u, x, n, 0.0) for u, (x, n) in table.items()]
        out = pd.DataFrame(rows, columns=["a", "b", "n", "w"])
        out.insert(0, "source", g["owner"].iloc[0])
        return out

    return run


def fit(records: DataFrame, clean: DataFrame) -> Model:
    """records: dataset, raw_text. clean: text of texts without garbling. All texts are counted; what comes to the driver
    are known letter pairs, and swaps and units of each source."""
    counted = clean.where(F.col("text").isNotNull()).select("text").mapInArrow(_count_pairs, "pair bigint, n bigint, held bigint")
    rows = [(r["pair"], r["n"], r["held"]) for r in counted.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).collect()]
    m = model_of([r for r in rows if r[0] >= 0], sum(n for pair, n, _ in rows if pair < 0))
    texts = records.where(F.col("raw_text").isNotNull()).select("dataset", "raw_text")
    words = texts.mapInArrow(_screen(m), "source string, word string, n bigint").groupBy("source", "word").agg(F.sum("n").alias("n"))
    seen = words.mapInArrow(_gather(m), "source string, kind string, a string, b string, n bigint, words bigint")
    # Every source learns its own table, and the empty name the table of all.
    owners = seen.withColumn("owner", F.explode(F.array_distinct(F.array("source", F.lit("")))))
    learnt = owners.groupBy("owner", "kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).groupBy("owner").applyInPandas(_learner(m), "source string, a string, b string, n bigint, w double")
    for r in learnt.collect():
        if r["w"]:
            m.weights.setdefault(r["source"], {})[int(r["a"])] = r["w"]
        else:
            m.tables.setdefault(r["source"], {})[r["a"]] = (r["b"], r["n"])
    return m


def garbled(records: DataFrame, m: Model) -> DataFrame:
    """record_id, restored_text of each garbled record."""
    return records.where(F.col("raw_text").isNotNull()).select(F.col("record_id").cast("bigint"), "dataset", "raw_text").mapInArrow(_worker(m), "record_id bigint, restored_text string")
