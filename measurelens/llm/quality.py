"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a whole text are standardised and mapped to random cosines, whose
products approximate a Gaussian kernel.  Each partition sums its part of the normal
equations, the driver adds these (a matrix of fixed size per partition) and solves
the ridge problem.  A share of the labelled rows that the ridge did not see fits an
isotonic curve from raw score to probability.

The model is fitted on at most about ``max_rows`` labelled rows, drawn by a hash of
the id.  Labels other than 0 and 1 are ignored; for repeated labels of an id the
larger counts.  Without training rows, or with one class only, every score is the
share of ones (1 if there are none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import SPACED, Words, documents, joined, learn_bucket, map_texts, mix, name_of, share
from measurelens.operators.common import settle

MAX_ROWS = 40_000
PARTS = 8  # partitions of the labelled sample, each with its part of the normal equations
WAVES = 384
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-3
CALIBRATE = 0.3  # share of the labelled rows for the isotonic curve
SEED = 20_240


def _class(*spans) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    for a, b in spans:
        table[a : b + 1] = True
    return table


_CLASSES = [
    _class((0x41, 0x5A)),  # capitals
    _class((0x30, 0x39)),
    _class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),  # signs
    _class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B)),  # sentence signs
    _class((0x21, 0x21), (0x3F, 0x3F)),
    _class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5E, 0x60), (0x7B, 0x7E)),  # odd signs
    _class((0x0A, 0x0A)),
    _class((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x7F)),
    _class((0x80, 0xFF)),
]
N_STATS = len(_CLASSES) + 11


def statistics(col: pa.Array) -> np.ndarray:
    """One row of statistics per text; an empty text has zeros."""
    words = Words(col, SPACED)
    n = len(col)
    size = np.diff(words.offsets) - 1
    data, offsets = joined(col)  # before lower-casing
    text = np.repeat(np.arange(n), np.diff(offsets))
    per_byte = 1.0 / np.maximum(size, 1)
    out = [np.log1p(size), np.log1p(words.count)]
    for table in _CLASSES:
        hits = np.bincount(text[table[data]], minlength=n).astype(float)
        if table is _CLASSES[6]:
            hits -= 1  # the line feed that ends every text here
        out.append(hits * per_byte)
    length = (words.ends - words.starts).astype(float)
    owner = words.text_of_word()
    per_word = 1.0 / np.maximum(words.count, 1)
    mean = np.bincount(owner, weights=length, minlength=n) * per_word
    square = np.bincount(owner, weights=length**2, minlength=n) * per_word
    out += [mean, np.sqrt(np.maximum(square - mean**2, 0))]
    out += [np.bincount(owner[length <= 3], minlength=n) * per_word, np.bincount(owner[length >= 14], minlength=n) * per_word]
    codes = words.codes()
    out.append(_distinct(owner, codes, n) * per_word)
    pairs = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, np.int64)
    bigram = mix(codes[pairs] * np.uint64(0xD6E8FEB86659FD93) + codes[pairs + 1]) if len(pairs) else codes[:0]
    out.append(_distinct(owner[pairs], bigram, n) / np.maximum(words.count - 1, 1))
    first, last = data[words.starts], data[words.ends - 1]
    out.append(np.bincount(owner[_CLASSES[2][last]], minlength=n) * per_word)
    out.append(np.bincount(owner[_CLASSES[2][first]], minlength=n) * per_word)
    out.append(np.bincount(owner[_CLASSES[0][first] & _CLASSES[0][last]], minlength=n) * per_word)
    return np.stack(out, axis=1)


def _distinct(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each text has."""
    if not len(codes):
        return np.zeros(n)
    order = np.lexsort((codes, owner))
    o, c = owner[order], codes[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))
    return np.bincount(o[new], minlength=n).astype(float)


class Waves:
    """Standardised statistics to random cosines."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = draw.normal(size=(len(mean), WAVES)) / (WIDTH * np.sqrt(len(mean) / 10.0))
        self.shift = draw.uniform(0, 2 * np.pi, WAVES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.sqrt(2.0 / WAVES) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))], axis=1)


VECTOR = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, label: str, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> dict:
    """A model for ``score``; ``train`` is a condition on the id of a label row."""
    value = name_of(label).cast("int")
    known = labels.where(train & value.isin(0, 1)).groupBy(name_of(doc_id).alias("_id")).agg(F.max(value).alias("y"))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return {"level": ones / n if n else 1.0}
    draw = F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30))
    picked = F.broadcast(known.where(draw < int(min(1.0, max_rows / n) * (1 << 30))))  # about max_rows pairs of numbers
    chosen = docs.select(name_of(doc_id).alias("_id"), name_of(text).alias("_text")).join(picked, "_id")
    sample = settle(map_texts(chosen, "_text", VECTOR, lambda: lambda col: [_rows(statistics(col))], carry=["_id", "y"]).repartition(PARTS, "_id"))
    mine = F.pmod(F.xxhash64(F.lit(13), "_id"), F.lit(1000)) >= int(1000 * CALIBRATE)
    summed = T.StructType([T.StructField(c, T.BinaryType()) for c in ("a", "b")])

    def moments(batches):
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for batch in batches:
            x = _matrix(batch.column(0))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()]), pa.array([np.append(q, n).tobytes()])], ["a", "b"])

    parts = sample.select("x").mapInArrow(moments, summed).collect()
    s = sum(np.frombuffer(p.a) for p in parts)
    q = sum(np.frombuffer(p.b) for p in parts)
    mean = s / max(q[-1], 1)
    waves = Waves(mean, np.sqrt(np.maximum(q[:-1] / max(q[-1], 1) - mean**2, 0)))

    def normal(batches):
        g, r = np.zeros((WAVES + 1, WAVES + 1)), np.zeros(WAVES + 1)
        for batch in batches:
            z, y = waves(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            g, r = g + z.T @ z, r + z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([r.tobytes()])], ["a", "b"])

    parts = sample.where(mine).select("x", "y").mapInArrow(normal, summed).collect()  # one matrix per partition
    g = sum(np.frombuffer(p.a).reshape(WAVES + 1, WAVES + 1) for p in parts)
    r = sum(np.frombuffer(p.b) for p in parts)
    penalty = RIDGE * max(g[-1, -1], 1.0) / WAVES * np.eye(WAVES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(g + penalty, r)
    model = {"waves": waves, "weights": weights}
    curve = raw_scores(sample.where(~mine), model, "x").select(F.col("raw").alias("features"), F.col("y").cast("double").alias("label"))
    if curve.isEmpty():
        model["curve"] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return model
    isotonic = IsotonicRegression().fit(curve)
    model["curve"] = (isotonic.boundaries.toArray(), np.clip(isotonic.predictions.toArray(), 0, 1))
    return model


def raw_scores(sample: DataFrame, model: dict, x: str) -> DataFrame:
    @F.pandas_udf("double")
    def raw(v: pd.Series) -> pd.Series:
        return pd.Series(model["waves"](np.array(v.tolist(), float).reshape(len(v), N_STATS)) @ model["weights"])

    return sample.withColumn("raw", raw(x))


RESULTS = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: dict, *, text: str = "text", carry=None) -> DataFrame:
    """``docs`` with ``score``: the calibrated probability that the label is 1."""
    if "level" in model:
        carry = docs.columns if carry is None else carry
        return docs.select(*[name_of(c) for c in carry if c.lower() != "score"], F.lit(float(model["level"])).alias("score"))
    shared = share(docs.sparkSession, model)

    def start():
        m = shared()

        def work(col):
            return [pa.array(np.interp(m["waves"](statistics(col)) @ m["weights"], *m["curve"]))]

        return work

    return map_texts(docs, text, RESULTS, start, carry=carry)


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, learn_bucket(F.col("doc_id"), 3) != 1, label="quality")
    scored = score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (learn_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
