"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with one
word between, each hashed into 2^20 coordinates.  Every coordinate has its own
learning rate, and L1 keeps most weights at exactly zero, so the model is a short
list that is broadcast to score whole texts (2^20 coordinates at most).

The model is fitted on at most about ``max_rows`` labelled rows, drawn by a hash of
the id; shards of them are learned in parallel and averaged.  Labels are 0 or 1,
other values and nulls are ignored; for repeated labels of an id the larger counts.
Without any training row every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import SPACED, Words, documents, learn_bucket, map_texts, mix, name_of

BITS = 20
MAX_ROWS = 20_000
SHARD_ROWS = 10_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
CHECKED = 4  # every fourth row checks the threshold
SURE = 60
FEWEST = 5  # ones among the checked rows, below which the threshold stays


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text index, coordinate) of every n-gram and skip-gram, repeats included."""
    codes, text = words.codes(), words.text_of_word()
    parts_text, parts_code = [text], [codes]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, np.bool_)
        left = np.flatnonzero(same)
        parts_text.append(text[left])
        parts_code.append(mix(codes[left] * np.uint64(0xD6E8FEB86659FD93) + codes[left + gap] + np.uint64(salt)))
    return np.concatenate(parts_text), (np.concatenate(parts_code) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(text: np.ndarray, coordinate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((text.astype(np.int64) << BITS) | coordinate)
    return both >> BITS, both & ((1 << BITS) - 1)


def learn(rows: list[tuple[int, np.ndarray, int]], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) after ``epochs`` passes; coordinate 2^BITS is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(at):
        zi = z[at]
        return np.where(np.abs(zi) > L1 * (at < 1 << BITS), (np.sign(zi) * L1 * (at < 1 << BITS) - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rows = [(np.append(at, 1 << BITS), y) for _, at, y in sorted(rows, key=lambda r: r[0])]
    for _ in range(epochs):
        for at, y in rows:
            w = weight(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            before = n[at]
            after = before + error * error
            z[at] += error - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    w = weight(np.arange(len(z)))
    at = np.flatnonzero(w)
    return at, w[at]


def learn_shifted(rows: list[tuple[int, np.ndarray, int]], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """``learn``, with the intercept moved so that a score of one half is the best cut.

    L1 keeps scores low.  The cut of best F1 is found on rows that a first model
    did not see; the final model sees all.
    """
    rows = sorted(rows, key=lambda r: r[0])
    at, w = learn(rows, epochs)
    checked = rows[::CHECKED]
    ones = np.array([y for *_, y in checked])
    if not FEWEST <= ones.sum() < len(ones):
        return at, w
    first = np.zeros((1 << BITS) + 1)
    some, values = learn([r for i, r in enumerate(rows) if i % CHECKED], epochs)
    first[some] = values
    logit = np.array([first[f].sum() + first[-1] for _, f, _ in checked])
    order = np.argsort(-logit, kind="stable")
    found = np.cumsum(ones[order])
    f1 = 2 * found / (np.arange(1, len(ones) + 1) + ones.sum())
    ends = np.append(logit[order][1:] != logit[order][:-1], True)  # rows of equal score fall on one side
    best = int(np.argmax(np.where(ends, f1, -1.0)))
    cut = logit[order[best]]
    if best + 1 < len(order):
        cut = (cut + logit[order[best + 1]]) / 2
    full = np.zeros((1 << BITS) + 1)
    full[at] = w
    full[-1] -= np.clip(cut, -4.0, 4.0) * ones.sum() / (ones.sum() + SURE)  # a cut that few ones decide counts less
    at = np.flatnonzero(full)
    return at, full[at]


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, label: str, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> dict[int, float] | None:
    """Weights by coordinate, or None without training rows; ``train`` is a condition on the id of a label row."""
    value = name_of(label).cast("int")
    known = labels.where(train & value.isin(0, 1)).groupBy(name_of(doc_id).alias("_id")).agg(F.max(value).alias("_y"))
    n = known.count()
    share = min(1.0, max_rows / max(1, n))
    shards = max(1, round(min(n, max_rows) / SHARD_ROWS))
    draw = F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(1 << 30))
    # about max_rows pairs of numbers
    picked = F.broadcast(known.where(draw < int(share * (1 << 30))))
    order = F.xxhash64(F.lit(11), "_id", "_text")
    rows = docs.select(name_of(doc_id).alias("_id"), F.coalesce(name_of(text).cast("string"), F.lit("")).alias("_text")).join(picked, "_id")
    rows = rows.select("_text", "_y", order.alias("_order"), F.pmod(order, F.lit(shards)).alias("_shard")).repartition(shards, "_shard")
    schema = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("w", T.BinaryType())])

    def shard(batches):
        from measurelens.llm.texts import pieces

        kept: dict[int, list] = {}
        for batch in batches:
            for piece in pieces(batch, 0):
                text_at, at = distinct(*features(Words(piece.column(0), SPACED)))
                cuts = np.searchsorted(text_at, np.arange(piece.num_rows + 1))
                ys, orders, shards = (piece.column(i).to_pylist() for i in (1, 2, 3))
                for i in range(piece.num_rows):
                    kept.setdefault(shards[i], []).append((orders[i], at[cuts[i] : cuts[i + 1]], ys[i]))
        for rows in kept.values():
            at, w = learn_shifted(rows, EPOCHS)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["at", "w"])

    models = rows.mapInArrow(shard, schema).collect()  # one sparse model per shard
    if not models:
        return None
    total = np.zeros((1 << BITS) + 1)
    for m in models:
        total[np.frombuffer(m.at, np.int64)] += np.frombuffer(m.w) / len(models)
    at = np.flatnonzero(total)
    return dict(zip(at.tolist(), total[at].tolist()))


RESULTS = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: dict[int, float] | None, *, text: str = "text", carry=None) -> DataFrame:
    """``docs`` with ``score``: the probability that the label is 1."""
    if model is None:
        carry = docs.columns if carry is None else carry
        return docs.select(*[name_of(c) for c in carry if c.lower() != "score"], F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        w = np.zeros(1 << BITS)
        bias = shared.value.get(1 << BITS, 0.0)
        for at, x in shared.value.items():
            if at < 1 << BITS:
                w[at] = x

        def work(col):
            text_at, at = features(Words(col, SPACED))
            some = w[at] != 0
            text_at, at = distinct(text_at[some], at[some])
            logit = bias + np.bincount(text_at, weights=w[at], minlength=len(col))
            return [pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))]

        return work

    return map_texts(docs, text, RESULTS, start, carry=carry)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, learn_bucket(F.col("doc_id"), 5) != 0, label="toxic")
    scored = score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (learn_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
