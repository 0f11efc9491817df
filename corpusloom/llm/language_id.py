"""Missing or wrong language labels: interpolated Kneser-Ney character models.

One model per language is fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`, the rows of smallest id hash with
at most `SAMPLE_CHARS` characters). Labels of the sample are partly wrong, so a bigram model, which foreign sentences
hardly bend, first drops the sentences that fit another language better; the final models are fitted on the rest. Each
n-gram is packed into one integer, and the sorted arrays of these keys hold the log probabilities of all languages side
by side, so scoring a character is one binary search for all languages. The tables are bounded by the sample and go to
the workers with the function.

Texts are lower-cased and brought to their confusables skeleton, accents are stripped, so disguised text and text
without accents keep their language; transcribed text is learnt from the labelled rows that hold it. A text is cut into
sentences; each gets the language of the lowest length-normalised cross-entropy. A sentence is rejected (`und`) when its
cross-entropy lies above the language's limit, calibrated on sample sentences that were not fitted, or when the
calibrated posterior, given as its confidence, is below `MIN_CONFIDENCE`.

Defined cases: NULL and empty texts have no segments and the language `und` with confidence 0; sentences of fewer than
five words are scored but never count as a segment of their own in `foreign_languages`; equal rows get equal results;
very long texts are scored in blocks of sentences; ties go to the first language of the list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.confusables import skeleton
from corpusloom.llm.sampling import smallest_hashes

LANGUAGES = ("en", "de", "fr", "es", "pt", "tr", "ru", "hi")
SAMPLE_ROWS = 8000
SAMPLE_CHARS = 4000
MIN_WORDS = 5
MIN_CONFIDENCE = 0.8
ORDER = 4
BITS = 16  # of a letter in a packed n-gram
_SENTENCE = re.compile(r"(?<=[.!?।])\s+|\n+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MARKS = {c: None for c in range(0x300, 0x370)}
_LINK = re.compile(r"https?://\S+|www\.\S+|\S+@\S+")
_BLOCK = 1_000_000


def language_of_label(label: Column) -> Column:
    """The language that a label names, or NULL."""
    c = F.lower(F.trim(label))
    code = F.when(c == "text", "en").when(F.startswith(c, F.lit("text_")), F.substring(c, 6, 99))
    return F.when(code.isin(*LANGUAGES), code)


def sentences(text: str) -> list[tuple[str, int]]:
    """(letters with single blanks, number of words) of each sentence that has letters."""
    out = []
    for s in _SENTENCE.split(skeleton(text.lower())):
        s = _LINK.sub(" ", s)
        words = sum(1 for w in s.split() if any(map(str.isalpha, w)))
        if words:
            out.append((" " + _NOT_LETTERS.sub(" ", s.translate(_MARKS)).strip() + " ", words))
    return out


@dataclass
class Models:
    """Joint tables of all languages: per order the sorted n-gram keys with log probabilities, and the sorted contexts
    with log interpolation weights."""

    letters: np.ndarray
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    limit: np.ndarray
    scale: float


def _ids(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter ids of all texts one after the other (0: unknown), and where each begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    ids = np.where(letters[at] == codes, at + 1, 0).astype(np.uint64)
    return ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _packed(ids: np.ndarray, k: int) -> np.ndarray:
    """The k-gram that ends at each place, as an integer of k times BITS bits."""
    out = ids.copy()
    for j in range(1, k):
        out[j:] |= ids[:-j] << np.uint64(BITS * j)
    return out


def fit(texts: list[list[str]], order: int) -> Models:
    """Kneser-Ney tables from the sentences of each language."""
    every = np.frombuffer("".join(t for ts in texts for t in ts).encode("utf-32-le", "replace"), dtype=np.uint32)
    seen, times = np.unique(every, return_counts=True)
    letters = np.sort(seen[np.argsort(-times, kind="stable")[: (1 << BITS) - 2]])
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for ts in texts:
        ids, begin = _ids(ts or [" "], letters)
        place = np.arange(len(ids)) - np.repeat(begin[:-1], np.diff(begin))
        top = [np.unique(_packed(ids, order)[place >= order - 1], return_counts=True)]
        for k in range(order - 1, 0, -1):  # lower orders: how many different letters precede
            top.append(np.unique(top[-1][0] & np.uint64((1 << (BITS * k)) - 1), return_counts=True))
        counts.append(top[::-1])
    n = len(texts)
    keys, logp, contexts, weights = [], [], [], []
    for k in range(1, order + 1):
        joint = np.unique(np.concatenate([c[k - 1][0] for c in counts]))
        ctx = np.unique(joint >> np.uint64(BITS))
        p, lam = np.zeros((len(joint), n)), np.ones((len(ctx), n))
        of_ctx = np.searchsorted(ctx, joint >> np.uint64(BITS))
        if k > 1:
            lower = np.searchsorted(keys[-1], joint & np.uint64((1 << (BITS * (k - 1))) - 1))
            below = np.exp(logp[-1][np.minimum(lower, len(keys[-1]) - 1)].astype(float))
        for j, c in enumerate(counts):
            own, times = c[k - 1]
            n1, n2 = (times == 1).sum(), (times == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            full, at = np.zeros(len(joint)), np.searchsorted(joint, own)
            full[at] = times
            total, kinds = np.bincount(of_ctx, full, len(ctx)), np.bincount(of_ctx, full > 0, len(ctx))
            lam[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            base = below[:, j] if k > 1 else 1.0 / (len(letters) + 1)
            p[:, j] = np.maximum(full - d, 0) / np.maximum(total, 1)[of_ctx] + lam[of_ctx, j] * base
        keys.append(joint)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(ctx)
        weights.append(np.log(np.maximum(lam, 1e-9)).astype(np.float32))
    return Models(letters, keys, logp, contexts, weights, np.full(n, np.inf), 1.0)


def _find(sorted_keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, want), len(sorted_keys) - 1)
    return at, sorted_keys[at] == want


def cross_entropy(m: Models, texts: list[str]) -> np.ndarray:
    """Nats a character of each text under each language: [texts, languages]."""
    order = len(m.keys)
    ids, begin = _ids(texts, m.letters)
    out = np.empty((len(ids), m.logp[0].shape[1]), dtype=np.float32)
    place = np.arange(len(ids)) - np.repeat(begin[:-1], np.diff(begin))
    grams = _packed(ids, order)
    open_at, extra = np.arange(len(ids)), None
    for k in range(order, 0, -1):
        mask = np.uint64((1 << (BITS * k)) - 1)
        usable = place[open_at] >= k - 1
        g = grams[open_at] & mask
        at, hit = _find(m.keys[k - 1], g)
        hit &= usable
        out[open_at[hit]] = m.logp[k - 1][at[hit]] + (extra[hit] if extra is not None else 0)
        miss = ~hit
        if not miss.any():
            break
        open_at, g, usable = open_at[miss], g[miss], usable[miss]
        extra = np.zeros((len(open_at), out.shape[1]), dtype=np.float32) if extra is None else extra[miss]
        if k > 1:
            at, known = _find(m.contexts[k - 1], g >> np.uint64(BITS))
            known &= usable
            extra[known] += m.weights[k - 1][at[known]]
        else:
            out[open_at] = extra - np.float32(np.log(len(m.letters) + 1))
    return -np.add.reduceat(out, begin[:-1], axis=0) / np.maximum(np.diff(begin), 1)[:, None]


def train(rows: list[tuple[str, str]]) -> Models:
    """Models from (language, text) pairs whose languages may be wrong."""
    s = [(LANGUAGES.index(lang), t, w) for lang, text in rows for t, w in sentences(text)]
    own, texts = np.array([x[0] for x in s], dtype=int), [x[1] for x in s]
    of = lambda keep: [[t for t, o, k in zip(texts, own, keep) if k and o == j] for j in range(len(LANGUAGES))]
    keep = np.ones(len(s), dtype=bool)
    if not len(s):
        return fit([[" "] for _ in LANGUAGES], ORDER)
    for order in (2, 3):
        keep = cross_entropy(fit(of(keep), order), texts).argmin(axis=1) == own
    odd = np.arange(len(s)) % 5 == 0  # held out of the fit to calibrate
    h = cross_entropy(m := fit(of(keep & ~odd), ORDER), texts)
    long, size = np.array([x[2] >= MIN_WORDS for x in s]), np.array([len(t) for t in texts])
    held = np.flatnonzero(odd & keep & long)
    for j in range(len(LANGUAGES)):
        # A language with few sentences leans on those of all languages, the more so the fewer it has.
        x, every = h[held[own[held] == j], j], h[held, own[held]]
        if len(every):
            lean = 20 / (20 + len(x))
            mean = lambda f, x=x, every=every, lean=lean: lean * f(every) + (1 - lean) * (f(x) if len(x) else 0.0)
            m.limit[j] = mean(np.mean) + 5 * mean(np.std) + 0.1
    test = odd & keep
    if test.any():
        def loss(a: float) -> float:
            z = -a * h[test] * size[test, None]
            z -= z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), own[test]]).mean())

        m.scale = min((0.05, 0.1, 0.2, 0.4, 0.7, 1.0), key=loss)
    full = fit(of(keep), ORDER)
    full.limit, full.scale = m.limit, m.scale
    return full


def classify(m: Models, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: rejected) and confidence of each sentence."""
    h = cross_entropy(m, texts)
    z = -m.scale * h * np.array([len(t) for t in texts])[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    best, sure = h.argmin(axis=1), z.max(axis=1) / z.sum(axis=1)
    rejected = (h[np.arange(len(h)), best] > m.limit[best]) | (sure < MIN_CONFIDENCE)
    return np.where(rejected, -1, best), sure


def _segmenter(m: Models) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array([*LANGUAGES, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(block):
            lang, sure = classify(m, [b[2] for b in block])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b[0] for b in block], pa.int64()),
                    pa.array([b[1] for b in block], pa.int32()),
                    pa.array([b[3] for b in block], pa.int32()),
                    pa.array([len(b[2]) for b in block], pa.int32()),
                    pa.array(names[lang].tolist(), pa.string()),
                    pa.array(sure.astype(np.float64)),
                ],
                names=["k", "segment", "words", "chars", "lang", "confidence"],
            )

        for batch in batches:
            block, size = [], 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for j, (t, words) in enumerate(sentences(text)):
                    block.append((k, j, t, words))
                    size += len(t)
                    if size > _BLOCK:
                        yield scored(block)
                        block, size = [], 0
            if block:
                yield scored(block)

    return run


def learn(rows: DataFrame, key: str = "row_index", label: str = "language_column", text: str = "raw_text") -> Models:
    """Models from the bounded sample of labelled rows."""
    known = rows.select(F.col(key).alias("k"), language_of_label(F.col(label)).alias("lang"), F.col(text).alias("t"))
    known = known.where(F.col("lang").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    return train([(r["lang"], r["t"]) for r in smallest_hashes(known, ["k"], SAMPLE_ROWS).select("lang", "t").collect()])


def segments(rows: DataFrame, models: Models, key: str = "row_index", text: str = "raw_text") -> DataFrame:
    """key, segment, words, chars, lang, confidence of each sentence."""
    some = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    out = some.mapInArrow(_segmenter(models), "k bigint, segment int, words int, chars int, lang string, confidence double")
    return out.withColumnRenamed("k", key)


def documents(rows: DataFrame, models: Models, key: str = "row_index", text: str = "raw_text") -> DataFrame:
    """key, lang, confidence, n_languages of each row: the language of most characters."""
    s = segments(rows, models, key, text).groupBy(key, "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
    best = s.groupBy(key).agg(F.max_by(F.struct("lang", "confidence"), F.struct((F.col("lang") != "und").alias("named"), "chars", "lang")).alias("b"), F.count_if(F.col("lang") != "und").alias("n_languages"))
    d = rows.select(key).join(best, key, "left")
    return d.select(key, F.coalesce("b.lang", F.lit("und")).alias("lang"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_languages", F.lit(0)).alias("n_languages"))


def foreign_languages(rows: DataFrame, models: Models, key: str = "row_index", label: str = "language_column", text: str = "raw_text") -> DataFrame:
    """key, lang: languages of whole sentences of five words or more that the row's label does not name."""
    # The label rides in the key's place: the mapping sees one number a row, so rows and labels are never joined.
    codes = F.coalesce(F.array_position(F.array(*map(F.lit, LANGUAGES)), language_of_label(F.col(label))), F.lit(0))
    packed = rows.select((F.col(key).cast("bigint") * 16 + codes).alias("k"), F.col(text).alias(text))
    s = segments(packed, models, "k", text).where((F.col("words") >= MIN_WORDS) & (F.col("lang") != "und"))
    named = F.element_at(F.array(F.lit(""), *map(F.lit, LANGUAGES)), (F.pmod("k", F.lit(16)) + 1).cast("int"))
    return s.where(F.col("lang") != named).select(F.shiftright("k", 4).alias(key), "lang").distinct()
