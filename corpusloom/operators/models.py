"""Classifiers: distributed linear, tree and perceptron models from Spark ML, and small numpy networks trained one run a
task (grouped map) over a bounded embedding table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.splits import class_weights


def catalogue(width: int, n: int, seed: int = 42, cost: float = 2.0) -> dict:
    """The classifiers by name, for n training rows. The class weight is applied once, as the row weight; the penalty of
    the linear models is that of `cost` times the summed loss."""
    penalty = 1 / (cost * max(1, n))
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "logistic_regression": LogisticRegression(**common, weightCol="sample_weight", standardization=False, regParam=penalty, maxIter=100),
        "linear_svm": LinearSVC(**common, weightCol="sample_weight", standardization=False, regParam=penalty, maxIter=100),
        "boosted_trees": GBTClassifier(**common, weightCol="sample_weight", maxIter=120, stepSize=0.08, maxDepth=5, seed=seed),
        "perceptron": MultilayerPerceptronClassifier(**common, layers=[width, 64, 2], maxIter=60, seed=seed, blockSize=512),
    }


def fit_predict(train: DataFrame, test: DataFrame, name: str, width: int, seed: int = 42) -> DataFrame:
    """train, test: row_index, vec, label. Gives row_index, label, probability, prediction."""
    w = class_weights(train).select("label", "sample_weight")
    x = lambda df: df.select("row_index", array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    model = catalogue(width, train.count(), seed)[name].fit(x(train).join(F.broadcast(w.withColumn("label", F.col("label").cast("double"))), "label"))
    p = model.transform(x(test))
    score = vector_to_array("probability")[1] if "probability" in p.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return p.select("row_index", F.col("label").cast("int").alias("label"), score.alias("probability"), F.col("prediction").cast("int").alias("prediction"))


class TokenNetwork:
    """Frozen embeddings, convolution over three tokens, maximum over time, one hidden layer, dropout, one logit; Adam on
    weighted cross-entropy with early stopping and the best state restored. With several sources the embeddings are equal
    blocks side by side, fused by a learnt softmax gate: score of a block = its product with the gate's weights + bias."""

    def __init__(self, width: int, seed: int, filters: int = 64, hidden: int = 32, sources: int = 1):
        r = np.random.default_rng(seed)
        s = lambda *d: r.standard_normal(d) * np.sqrt(2.0 / d[0])
        self.p = {"k": s(3 * width, filters), "kb": np.zeros(filters), "a": s(filters, hidden), "ab": np.zeros(hidden), "o": s(hidden, 1), "ob": np.zeros(1)}
        self.r, self.sources = r, sources
        if sources > 1:
            self.p |= {"g": np.zeros((sources, width)), "gb": np.zeros(sources)}

    def fused(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a table with their blocks fused by the gate, and the gate. This is what is deployed: it depends on
        the word alone, so it is computed once a word."""
        blocks = table.reshape(len(table), self.sources, -1)
        z = (blocks * self.p["g"]).sum(axis=2) + self.p["gb"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        gate = z / z.sum(axis=1, keepdims=True)
        return (gate[:, :, None] * blocks).sum(axis=1), gate

    def forward(self, table: np.ndarray, tokens: np.ndarray, dropout: float = 0.0):
        # Of padding on the left of all rows of a batch two columns say all, so a row's logit doesn't depend on its batch.
        first = int(np.argmax((tokens != 0).any(axis=0))) if tokens.any() else tokens.shape[1] - 1
        tokens = tokens[:, max(0, first - 2) :]
        used, words = np.unique(tokens, return_inverse=True)
        rows, gate = self.fused(table[used]) if self.sources > 1 else (table[used], None)
        rows = np.vstack([rows, np.zeros((1, rows.shape[1]))])  # the last lies beside the text
        padded = np.pad(words.reshape(tokens.shape), ((0, 0), (1, 1)), constant_values=len(used))
        self.last = (used, rows, padded, gate)
        # Each word meets the kernel once; the places of the texts add up three products.
        left, own, right = (rows @ k for k in np.split(self.p["k"], 3))
        begins = np.where((tokens != 0).any(axis=1), (tokens != 0).argmax(axis=1), max(0, tokens.shape[1] - 1))
        by = np.argsort(begins, kind="stable")
        at, m = np.zeros((len(tokens), left.shape[1]), dtype=np.int64), np.zeros((len(tokens), left.shape[1]))
        for k in range(0, len(by), 32):  # rows of like length, each block without most of its padding
            own_rows = by[k : k + 32]
            cut = max(0, int(begins[own_rows[0]]) - 2)
            part = padded[own_rows, cut:]
            z = left[part[:, :-2]]
            z += own[part[:, 1:-1]]
            z += right[part[:, 2:]]
            best = z.argmax(axis=1)
            at[own_rows], m[own_rows] = best + cut, np.take_along_axis(z, best[:, None, :], axis=1)[:, 0]
        m = np.maximum(m + self.p["kb"], 0)
        drop = (self.r.random(m.shape) >= dropout) / (1 - dropout) if dropout else 1.0
        h = np.maximum((m * drop) @ self.p["a"] + self.p["ab"], 0)
        return (h @ self.p["o"] + self.p["ob"])[:, 0], (at, m, drop, h)

    def logits(self, table: np.ndarray, tokens, batch: int = 1024) -> np.ndarray:
        """Logits of any number of rows, a batch at a time."""
        return np.concatenate([np.zeros(0), *(self.forward(table, tokens[k : k + batch])[0] for k in range(0, len(tokens), batch))])

    def gradients(self, table, tokens, y, weight, dropout):
        z, (at, m, drop, h) = self.forward(table, tokens, dropout)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y))[:, None]
        g = {"o": h.T @ d, "ob": d.sum(axis=0)}
        dh = (d @ self.p["o"].T) * (h > 0)
        g["a"], g["ab"] = (m * drop).T @ dh, dh.sum(axis=0)
        dm = (dh @ self.p["a"].T) * drop * (m > 0)
        used, rows, padded, gate = self.last
        n = at.shape[1]
        # What each word gets at each place of the kernel: [word, filter].
        per = [np.bincount((np.take_along_axis(padded, at + j, axis=1) * n + np.arange(n)).ravel(), dm.ravel(), len(rows) * n).reshape(-1, n) for j in range(3)]
        g["k"], g["kb"] = np.concatenate([rows.T @ x for x in per]), dm.sum(axis=0)
        if self.sources > 1:
            blocks = table[used].reshape(len(used), self.sources, -1)
            de = sum(x[:-1] @ k.T for x, k in zip(per, np.split(self.p["k"], 3)))
            dg = np.einsum("usw,uw->us", blocks, de)
            dz = gate * (dg - (gate * dg).sum(axis=1, keepdims=True))
            g["g"], g["gb"] = np.einsum("us,usw->sw", dz, blocks), dz.sum(axis=0)
        return g

    def fit(self, table, tokens, y, val_tokens, val_y, epochs=30, batch=256, rate=1e-3, dropout=0.4, patience=4):
        weight = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        best, kept, bad, t = np.inf, None, 0, 0
        for _ in range(epochs):
            order = self.r.permutation(len(y))
            for s in range(0, len(y), batch):
                b = order[s : s + batch]
                t += 1
                for k, g in self.gradients(table, tokens[b], y[b], weight[b], dropout).items():
                    m, v = state[k]
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.999 * v + 0.001 * g * g
                    self.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            z = np.clip(self.logits(table, val_tokens), -30, 30)
            loss = float(np.mean(np.logaddexp(0, z) - val_y * z)) if len(z) else 0.0
            if loss < best - 1e-5:
                best, kept, bad = loss, {k: v.copy() for k, v in self.p.items()}, 0
            else:
                bad += 1
                if bad >= patience:
                    break
        self.p = kept or self.p
        return best


class Tokens:
    """Token rows without their padding, one after the other; rows are padded on the left as they are taken, up to the
    longest of them and two more, never beyond `width`."""

    def __init__(self, rows: pa.Array, width: int):
        self.flat = rows.flatten().to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.width = width

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, rows) -> np.ndarray:
        begin, end = self.ends[:-1][rows], self.ends[1:][rows]
        wide = min(self.width, int((end - begin).max(initial=0)) + 2)
        at = end[:, None] - np.arange(wide, 0, -1)
        inside = at >= begin[:, None]
        return np.where(inside, self.flat[np.where(inside, at, 0)], 0) if len(self.flat) else np.zeros(at.shape, dtype=np.int32)


def train_runs(rows: DataFrame, runs: DataFrame, table: np.ndarray, epochs: int = 30, sources: int = 1) -> DataFrame:
    """rows: fold, part, row_index, label, tokens. runs: configuration, fold, seed. One grouped-map task per run; the
    rows of one fold, without their padding, must fit a task, as they must fit the one machine that trains a run."""
    work = runs.join(rows.withColumn("width", F.size("tokens")).withColumn("tokens", F.filter("tokens", lambda x: x != 0)), "fold")

    def train(key: tuple, f: pa.Table) -> pa.Table:
        configuration, fold, seed = (k.as_py() for k in key)
        f = f.select(["part", "row_index", "label", "width", "tokens"]).sort_by("row_index").combine_chunks()
        part = {p: f.filter(pc.equal(f["part"], p)).combine_chunks() for p in ("train", "validation", "test")}
        width = max(1, pc.max(f["width"]).as_py() or 1)
        del f
        x = {p: Tokens(pa.concat_arrays(t["tokens"].chunks) if t.num_rows else pa.array([], pa.list_(pa.int32())), width) for p, t in part.items()}
        y = {p: t["label"].to_numpy().astype(float) for p, t in part.items()}
        test = part["test"].select(["row_index", "label"])
        del part
        net = TokenNetwork(table.shape[1] // sources, int(seed), sources=sources)
        if len(y["train"]):
            net.fit(table, x["train"], y["train"], x["validation"], y["validation"], epochs)
        p = 1 / (1 + np.exp(-np.clip(net.logits(table, x["test"]), -30, 30)))
        n = test.num_rows
        return pa.table({"configuration": pa.array([configuration] * n, pa.string()), "fold": pa.array([fold] * n, pa.int32()), "seed": pa.array([seed] * n, pa.int32()), "row_index": test["row_index"].cast(pa.int64()), "label": test["label"].cast(pa.int32()), "probability": pa.array(p, pa.float64())})

    return work.groupBy("configuration", "fold", "seed").applyInArrow(train, "configuration string, fold int, seed int, row_index bigint, label int, probability double")
