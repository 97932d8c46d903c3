"""Whole texts as numpy arrays inside Spark tasks.

Spark partitions the rows and hands each task Arrow batches; the functions here
work on the bytes of a few megabytes of text at a time, so a task's memory is
bounded by that piece (or by the longest single text).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text that are worked on at once.
PIECE = 400_000

# 1 for bytes of a word.  Bytes from 0x80 on belong to letters beyond ASCII.
SPACED = np.ones(256, np.bool_)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, np.bool_)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def share(spark, value) -> Callable:
    """Broadcast a value; the result is called in a task to get it there.

    It travels with its classes, so workers need no installed copy.
    """
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(box.value)


def name_of(column: str):
    return F.col(f"`{column}`")


def map_texts(docs: DataFrame, text: str, results: T.StructType, start: Callable, *, carry: Sequence[str] | None = None) -> DataFrame:
    """Add ``results`` to every row of ``docs``.

    ``start()`` runs once per task and returns a function from an Arrow string
    array (null texts are empty) to one Arrow array per result.  ``carry`` names
    the input columns that are kept, all by default.
    """
    taken = {f.name.lower() for f in results}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    # a carried text goes to the task once, with a flag where it is null
    twin = next((i for i, c in enumerate(carry) if c == text and isinstance(docs.select(name_of(c)).schema[0].dataType, T.StringType)), None)
    rows = docs.select(
        F.coalesce(name_of(text).cast("string"), F.lit("")).alias("_text"), *[(F.isnull(name_of(c)) if i == twin else name_of(c)).alias(f"_k{i}") for i, c in enumerate(carry)]
    )
    kept = [T.StructField(f"_k{i}", T.StringType() if i == twin else rows.schema[f"_k{i}"].dataType) for i in range(len(carry))]
    schema = T.StructType(kept + list(results))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for piece in pieces(batch, 0):
                work = work or start()
                keys = piece.columns[1:]
                if twin is not None:
                    none = keys[twin].to_numpy(zero_copy_only=False)
                    at = pa.array(np.arange(len(none)), mask=none)
                    keys[twin] = piece.column(0).take(at) if none.any() else piece.column(0)
                yield pa.RecordBatch.from_arrays([*keys, *work(piece.column(0))], names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], *[f.name for f in results])


def pieces(batch: pa.RecordBatch, at: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of column ``at`` fit the limit; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + limit, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def slabs(batches, limit: int):
    """Lists of record batches of about ``limit`` bytes of text in column 0."""
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch, 0):
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column(0))).as_py() or 0
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets); no value may be null."""
    wide = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like ``raw`` with a line feed after every text, so that no word spans two texts."""
    wide = pa.large_string()
    return raw(pc.binary_join_element_wise(col.cast(wide), pa.scalar("", wide), pa.scalar("\n", wide)))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit codes, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i <= n; r is odd and so has an inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        r = 0xD1342543DE82EF95
        size = max(n + 1, PIECE + PIECE // 4)
        up, down = np.full(size, r, np.uint64), np.full(size, pow(r, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Running polynomial code of the bytes, from which ``span_codes`` reads any span."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_codes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit code of each span; equal strings have equal codes."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


class Words:
    """The words of a column: byte spans in ``data``, and how many each text has."""

    def __init__(self, col: pa.Array, table: np.ndarray):
        source, self.offsets = joined(col)
        self.data = LOWER[source]
        inside = table[source]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        first = np.searchsorted(self.starts, self.offsets)
        self.first, self.count = first[:-1], np.diff(first)

    def codes(self) -> np.ndarray:
        return span_codes(prefix_codes(self.data), self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for every n in counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def shingle_codes(codes: np.ndarray, first: np.ndarray, count: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, code) of each text's distinct word shingles, sorted.

    A text with fewer words than ``width``, but not none, has its whole sequence
    as its only shingle.
    """
    texts = np.arange(len(count))
    full = np.maximum(count - width + 1, 0)
    owner = np.repeat(texts, full)
    at = np.repeat(first, full) + ragged(full)
    code = np.zeros(len(at), np.uint64)
    for k in range(width):
        code = mix(code * _ODD + codes[at + k] + np.uint64(k))
    short = np.flatnonzero((count > 0) & (count < width))
    whole = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        whole[has] = mix(whole[has] * _ODD + codes[first[short[has]] + k] + np.uint64(k))
    owner = np.concatenate((owner, short))
    code = np.concatenate((code, mix(whole ^ count[short].astype(np.uint64)) if len(short) else whole)) if len(short) else code
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), np.bool_)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return owner[new], code[new]


def learn_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
