"""Guards, resumption, padded ids, character blocks, pooled assembly and weighted resampling."""

import base64
import math
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.operators import inference, lexical, tokens, vectors
from corpusloom.sources import files
from tests.conftest import rows


def words(spark, items):
    return spark.createDataFrame([(k, w) for k, w in enumerate(items, 1)], "idx int, word string")


def test_extraction_goes_on_from_its_checkpoint_and_guards_its_input(spark, tmp_path):
    seen, path = [], str(tmp_path / "x")

    def run(w):
        seen.extend(sorted(r[0] for r in w.select("idx").collect()))
        return w.select("idx", F.upper("word").alias("up"))

    w = words(spark, [f"w{k}" for k in range(23)])
    assert len(rows(files.extract(w, path, 5, {"table": "a"}, run, stop_after=2))) == 10
    assert rows(files.extract(w, path, 5, {"table": "a"}, run)) == [(k, f"W{k - 1}") for k in range(1, 24)]
    assert seen == list(range(1, 24))
    with pytest.raises(ValueError, match="different input"):
        files.extract(w, path, 5, {"table": "b"}, run)
    with pytest.raises(ValueError, match="different input"):
        files.extract(words(spark, ["other"]), path, 5, {"table": "a"}, run)


def test_extraction_of_many_batches_takes_few_rounds_and_makes_the_words_once(spark, tmp_path):
    calls, made = [], spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    w = words(spark, [f"w{k}" for k in range(200)]).mapInPandas(counted, "idx int, word string")

    def run(part):
        calls.append(1)
        return part.select("idx", F.upper("word").alias("up"))

    assert len(rows(files.extract(w, str(tmp_path / "x"), 2, {}, run, stop_after=3))) == 6
    assert rows(files.extract(w, str(tmp_path / "x"), 2, {}, run)) == [(k, f"W{k - 1}") for k in range(1, 201)]
    assert len(calls) <= 18 and made.value <= 4 * 200


def test_vocabulary_guard(spark):
    v = words(spark, ["a", "b", "c"]).select("word", "idx")
    assert rows(lexical.guarded(v, v)) == [("a", 1), ("b", 2), ("c", 3)]
    for other in (["a", "c", "b"], ["a", "b"], ["a", "b", "c", "d"]):
        with pytest.raises(Exception, match="drifted"):
            lexical.guarded(v, words(spark, other).select("word", "idx")).collect()


def test_one_to_one_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 0.5), (3, 0.1)], "k int, b double")
    assert rows(inference.one_to_one(a, b, ["k"])) == [(2, "y", 0.5)]
    with pytest.raises(Exception, match="occurs twice"):
        inference.one_to_one(a, b.union(b), ["k"]).collect()


def test_padded_ids_decode_to_the_text(spark):
    t = ["A short text, été 123!", "", None, "word " * 400]
    got = [r for r in tokens.padded(spark.createDataFrame(list(enumerate(t)), "k int, t string"), "t", 64).orderBy("k").collect()]
    with open(tokens.VOCABULARY, "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    for r, x in zip(got, t):
        n = sum(r["attention_mask"])
        assert len(r["input_ids"]) == 64 and n == min(64, r["n_tokens"])
        assert (x or "").startswith(coder.decode(r["input_ids"][:n]))
        assert r["n_tokens"] == len(coder.encode_ordinary(x or ""))
    assert coder.decode(got[0]["input_ids"][: got[0]["n_tokens"]]) == t[0]


def test_character_block_against_numpy(spark):
    v = ["banana", "bandana", "cabana", "nab", "zz"]
    got = {(i, t): w for i, t, w in rows(vectors.character_block(words(spark, v), 2, 3, 2, 1000))}
    grams = [Counter(p[k : k + n] for p in [f" {w} "] for n in (2, 3) for k in range(len(p) - n + 1)) for w in v]
    df = Counter(g for c in grams for g in c)
    kept = sorted(g for g, n in df.items() if n >= 2)
    x = np.array([[(1 + math.log(c[g])) * (math.log((1 + len(v)) / (1 + df[g])) + 1) if c[g] else 0.0 for g in kept] for c in grams])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    x /= x.std(axis=0)
    want = {(i + 1, g): x[i, j] for i in range(len(v)) for j, g in enumerate(kept) if x[i, j]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_out_of_fold_pool_must_be_whole(spark):
    p = spark.createDataFrame([("m", s, k, k % 2, 0.2 * s + 0.1 * k) for s in (1, 2) for k in range(4)], "configuration string, seed int, row_index int, label int, probability double")
    got = {r["row_index"]: r["probability"] for r in inference.out_of_fold(p, ["configuration"], 4).collect()}
    assert all(abs(got[k] - (0.3 + 0.1 * k)) < 1e-9 for k in range(4))
    for bad in (p.where("row_index < 3"), p.withColumn("probability", F.when(F.col("row_index") > 0, F.col("probability")))):
        with pytest.raises(Exception, match="incomplete"):
            inference.out_of_fold(bad, ["configuration"], 4).collect()


def test_weighted_bootstrap_of_a_model_with_itself_and_a_better_one(spark):
    r = np.random.default_rng(9)
    data = [(c, g, *(int(x) for x in ((4, 0, 1, 3) if c == "good" else (3, 1, 2, 2)) + r.integers(0, 2, 4))) for g in range(60) for c in ("good", "poor")]
    cells = spark.createDataFrame(data, "configuration string, group_id bigint, tn int, fp int, fn int, tp int")
    got = {x["pair"]: x for x in inference.weighted_bootstrap(cells, (("good", "poor"), ("poor", "poor")), 200, 3).collect()}
    assert got["good - poor"]["low"] > 0 and got["good - poor"]["p_positive"] == 1.0 and got["good - poor"]["reps"] == 200
    assert got["poor - poor"]["low"] == got["poor - poor"]["high"] == 0 and got["poor - poor"]["p_positive"] == 0.0
