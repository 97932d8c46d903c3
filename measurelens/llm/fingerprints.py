"""Document fingerprints: a quartile digest of hashed byte triplets.

Three kinds of byte triplets inside a window of five bytes are hashed into 256
buckets.  The digest says for every bucket in which quarter of the bucket counts
it falls, and keeps the length on a log scale, the ratios of the quartiles and a
check byte, so equal texts have equal digests.  Two digests differ by a score from
0 to ``BOUND``, the expected score of unrelated ones, and their likeness is
1 - score / BOUND.

Empty texts and texts under three bytes have no triplets: their digests differ by
length and check byte only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import documents, map_texts, mix, name_of, pieces, prefix_codes, raw, span_codes

BUCKETS = 256
BOUND = 416.0  # 256 buckets, 1.625 expected points each
_KINDS = ((1, 2, 0x1F), (1, 3, 0x83), (2, 4, 0xE5))  # the two later bytes of a triplet, and a salt


def digest_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bytes per text: length, quartile ratios, check byte, body."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size)
    counts = np.zeros(n * BUCKETS, np.int64)
    wide = data.astype(np.uint32)
    last = np.repeat(offsets[1:], size)  # end of the text that a byte belongs to
    for second, third, salt in _KINDS:
        if len(data) <= third:
            continue
        code = wide[:-third] | (wide[second : len(data) - third + second] << np.uint32(8)) | (wide[third:] << np.uint32(16))
        code = (code ^ np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        inside = np.arange(third, len(data)) < last[: len(code)]
        counts += np.bincount((owner[: len(code)] + (code >> np.uint32(24)))[inside], minlength=len(counts))
    counts = counts.reshape(n, BUCKETS)
    ordered = np.sort(counts, axis=1)
    q = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q[:, :1]).astype(np.uint8) + (counts > q[:, 1:2]) + (counts > q[:, 2:])
    body = code[:, 0::4] | (code[:, 1::4] << 2) | (code[:, 2::4] << 4) | (code[:, 3::4] << 6)
    scale = np.maximum(q[:, 2], 1)
    ratio = np.minimum(q[:, 0] * 16 // scale, 15) << 4 | np.minimum(q[:, 1] * 16 // scale, 15)
    length = np.minimum(np.floor(8 * np.log2(size + 1.0)), 255)
    check = span_codes(prefix_codes(data), offsets[:-1], offsets[1:]) & np.uint64(255)
    head = np.stack([length.astype(np.uint8), ratio.astype(np.uint8), check.astype(np.uint8)], axis=1)
    return np.concatenate([head, body.astype(np.uint8)], axis=1)


def unpack(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(header, quarter of every bucket) of rows of digest bytes."""
    body = digests[:, 3:]
    return digests[:, :3].astype(np.int64), np.stack([(body >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(digests), -1).astype(np.int8)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) of digests row by row."""
    (ha, ba), (hb, bb) = unpack(a), unpack(b)
    step = np.abs(ba - bb).astype(np.int64)
    score = step.sum(axis=1) + 3 * (step == 3).sum(axis=1)  # opposite quarters count double
    score += np.minimum(np.abs(ha[:, 0] - hb[:, 0]), 64) // 2
    score += np.abs((ha[:, 1] >> 4) - (hb[:, 1] >> 4)) + np.abs((ha[:, 1] & 15) - (hb[:, 1] & 15))
    score += (ha[:, 2] != hb[:, 2]).astype(np.int64)
    return 1.0 - np.minimum(score, BOUND) / BOUND


def hexed(digests: np.ndarray) -> list[str]:
    width, text = digests.shape[1] * 2, digests.tobytes().hex()
    return [text[i * width : (i + 1) * width] for i in range(len(digests))]


def unhexed(column: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column)), np.uint8).reshape(len(column), -1)


RESULTS = T.StructType([T.StructField("fingerprint", T.StringType())])


def fingerprint(docs: DataFrame, *, text: str = "text", carry=None) -> DataFrame:
    """``docs`` with ``fingerprint``."""
    return map_texts(docs, text, RESULTS, lambda: lambda col: [pa.array(hexed(digest_bytes(*raw(col))))], carry=carry)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns; null if one is null."""
    both = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index)
    if both.any():
        out[both] = likeness_of(unhexed(a[both].tolist()), unhexed(b[both].tolist()))
    return out.astype(object).where(both, None)


def with_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to that and to the next text.

    The next text is that of the next lower id, and of the highest id after the
    lowest; rows with equal ids are ordered by text, null ids come last.  In the
    edited text the last half is replaced by as many first characters of the next.

    The ids are cut into ranges by approximate quantiles.  Every range is one
    stretch of rows in order, and the first rows of a range also go to the end of
    the range before, so texts move once and nothing is sorted as a whole.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(name_of(text).cast("string"), F.lit("")).alias("_text"), name_of(doc_id).cast("long").alias("_id"))
    rows = rows.withColumn("_order", F.coalesce("_id", lowest))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("_order", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("q")).first().q or []
    borders = np.unique(np.array(cuts, np.int64))  # at most ranges - 1 numbers

    @F.pandas_udf("int")
    def range_of(order: pd.Series) -> pd.Series:
        return pd.Series(len(borders) - np.searchsorted(borders, order.to_numpy(), "left")).astype("int32")

    tops = {r.p: r.top for r in rows.select("_order", range_of("_order").alias("p")).groupBy("p").agg(F.max("_order").alias("top")).collect()}  # one row per range
    filled = sorted(tops)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}

    @F.pandas_udf("array<int>")
    def places(order: pd.Series) -> pd.Series:
        """The row's own range (times 2), and the range before it (times 2, plus 1) for the first rows of a range."""
        own = len(borders) - np.searchsorted(borders, order.to_numpy(), "left")
        return pd.Series([[2 * p] + ([2 * before[p] + 1] if tops[p] == o else []) for p, o in zip(own.tolist(), order.tolist())])

    placed = rows.withColumn("_place", F.explode(places("_order")))
    placed = placed.repartitionById(max(1, len(borders) + 1), F.shiftright("_place", 1)).sortWithinPartitions("_place", F.desc("_order"), "_text")
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def run(batches):
        held = None  # the last row of the piece before: place, id, text, digest
        for batch in batches:
            for piece in pieces(batch, 0):
                texts, ids, place = (piece.column(i).to_pylist() for i in range(3))
                digests = digest_bytes(*raw(piece.column(0)))
                if held is not None:
                    texts, ids, place = [held[2], *texts], [held[1], *ids], [held[0], *place]
                    digests = np.concatenate([held[3], digests])
                held = (place[-1], ids[-1], texts[-1], digests[-1:])
                own = [i for i in range(len(texts) - 1) if place[i] % 2 == 0]
                if not own:
                    continue
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
                new = digest_bytes(*raw(pa.array(edited, pa.large_string())))
                old, following = digests[own], digests[[i + 1 for i in own]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own], pa.int64()),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array(hexed(old)),
                        pa.array(hexed(new)),
                        pa.array(likeness_of(old, new)),
                        pa.array(likeness_of(old, following)),
                    ],
                    schema.fieldNames(),
                )

    return placed.select("_text", "_id", "_place").mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir).select("doc_id", "text"))
