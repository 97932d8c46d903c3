"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of ten consecutive benchmark words is a pattern.  A table of shifts,
indexed by the last few bytes before a cursor, tells how far the cursor may jump
because no pattern can end there; where the shift is zero, the patterns of the
bucket of that block and of the same leading bytes are compared with the text.
Many cursors walk one piece of text side by side as a numpy array.

A document may hold any number of occurrences; all of them count.  Benchmark rows
without words give no windows; the windows of a row without an id hit words but
name no item.  Ids may be whole numbers or texts.  Null and empty texts have no
words and are clean.  The patterns travel by broadcast in blocks of about
``BLOCK_BYTES`` of benchmark text, one pass over the documents per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import ALNUM, LOWER, Words, map_texts, name_of, prefix_codes, ragged, share, span_codes
from measurelens.operators.common import settle

WINDOW = 10
BLOCK_BYTES = 8_000_000
LANE = 256  # bytes that one cursor covers
LONG = 24  # shorter patterns have a table of their own, so that they do not shorten all jumps


class ShiftTable:
    """The tables for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.m = min(map(len, patterns))
        self.block = min(6, self.m)
        self.bits = 18
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int64)
        for end in range(self.block, self.m + 1):
            key = self.key(heads, np.full(len(patterns), end - 1), np.arange(len(patterns)))
            np.minimum.at(self.shift, key, self.m - end)
        # patterns by the code of their first m bytes, within the bucket of the block that ends there
        code = span_codes(prefix_codes(heads.ravel()), np.arange(len(patterns)) * self.m, (np.arange(len(patterns)) + 1) * self.m)
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.buckets = [[(patterns[i], ids[i]) for i in order[a:b]] for a, b in zip(first, [*first[1:], len(order)])]

    def key(self, data: np.ndarray, at: np.ndarray, row=None) -> np.ndarray:
        """Hash of the block of bytes that ends at ``at``."""
        get = (lambda i: data[i]) if row is None else (lambda i: data[row, i])
        h = np.zeros(len(at), np.uint32)
        for k in range(self.block):
            h = h * np.uint32(0x01000193) + get(at - k)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        return (h >> np.uint32(32 - self.bits)).astype(np.int64)

    def search(self, data: np.ndarray, prefix: np.ndarray):
        """(start, pattern id, length) of every occurrence that begins and ends at a word edge."""
        n = len(data)
        lows = np.arange(0, n, LANE)
        at, stop = lows + self.m - 1, np.minimum(lows + LANE + self.m - 1, n)
        found = []
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            jump = self.shift[self.key(data, at)]
            zero = jump == 0
            if zero.any():
                found.append(at[zero])
                jump[zero] = 1
            at = at + jump
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return []
        starts = np.concatenate(found) - self.m + 1
        code = span_codes(prefix, starts, starts + self.m)
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[slot] == code
        text, out = data.tobytes(), []
        for start, s in zip(starts[hit].tolist(), slot[hit].tolist()):
            if start and text[start - 1] > 0x20:
                continue
            for pattern, pid in self.buckets[s]:
                end = start + len(pattern)
                if text.startswith(pattern, start) and (end >= n or text[end] <= 0x20):
                    out.append((start, pid, len(pattern)))
        return out


class Matcher:
    """All windows of some benchmark rows."""

    def __init__(self, rows: list[tuple[int | str | None, str]], window: int):
        texts, self.items, self.words = {}, [], []
        for item, text in rows:
            tokens = words_of(text)
            spans = [tokens] if len(tokens) < window else [tokens[i : i + window] for i in range(len(tokens) - window + 1)]
            for span in spans if tokens else []:
                key = b" ".join(span)
                if key not in texts:
                    texts[key] = len(self.items)
                    self.items.append(set())
                    self.words.append(len(span))
                if item is not None:
                    self.items[texts[key]].add(item)
        self.items = [sorted(s) for s in self.items]
        parts = [[p for p in texts if len(p) >= LONG], [p for p in texts if len(p) < LONG]]
        self.tables = [ShiftTable(part, [texts[p] for p in part]) for part in parts if part]

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, list, list]:
        """Words per text; per text the hit word ranges and the items found."""
        words = Words(col, ALNUM)
        lengths = words.ends - words.starts
        # the words with one space after each, and a line feed after each text
        inside = np.zeros(len(words.data), np.bool_)
        inside[np.repeat(words.starts, lengths) + ragged(lengths)] = True
        keep = inside.copy()
        keep[words.ends] = True
        last = words.offsets[1:] - 1
        keep[last] = True
        data = np.where(inside, words.data, np.uint8(0x20))
        data[last] = 0x0A
        data = data[keep]
        place = np.cumsum(keep) - 1
        starts = place[words.starts]
        ranges: list = [[] for _ in range(len(col))]
        items: list = [set() for _ in range(len(col))]
        prefix = prefix_codes(data)
        for table in self.tables:
            hits = table.search(data, prefix)
            if not hits:
                continue
            word = np.searchsorted(starts, np.array([h[0] for h in hits]))
            text = np.searchsorted(words.first, word, "right") - 1
            for (_, pid, _), w, t in zip(hits, word.tolist(), text.tolist()):
                lo = w - int(words.first[t])
                ranges[t].append((lo, lo + self.words[pid]))
                items[t].update(self.items[pid])
        return words.count, ranges, items


def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return np.where(ALNUM[data], LOWER[data], np.uint8(0x20)).tobytes().split()


def results(item: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_ranges", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))),
            T.StructField("items", T.ArrayType(item)),
        ]
    )


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(r) for r in out]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry=None,
) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``hit_ranges`` (merged word ranges, end exclusive) and ``items``.

    ``items`` are the sorted ids of benchmark rows with an occurring window, as
    whole numbers where the column holds such, else as strings.
    """
    spark = docs.sparkSession
    whole = isinstance(benchmark.select(name_of(item_id)).schema[0].dataType, T.IntegralType)
    item = T.LongType() if whole else T.StringType()
    rows = benchmark.select(name_of(item_id).cast(item).alias("i"), name_of(item_text).cast("string").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for block in range(blocks):
        # about a block's share of bytes: distinct rows are dealt by hash of id and text
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        shared = share(spark, Matcher([(r.i, r.t) for r in part], window))
        source = docs if out is None else settle(out)
        before = out is not None
        keep = list(docs.columns if carry is None else carry)
        needed = keep + [c for c in (text,) if c not in keep and blocks > 1] + (["_ranges", "_items"] if before else [])
        found = map_texts(source, text, results(item), lambda shared=shared: _start(shared, whole), carry=needed)
        if before:
            found = found.withColumns({"hit_ranges": F.concat("_ranges", "hit_ranges"), "items": F.array_distinct(F.concat("_items", "items"))}).drop("_ranges", "_items")
        out = found if block + 1 == blocks else found.withColumnsRenamed({"hit_ranges": "_ranges", "items": "_items"})
    if blocks > 1:
        out = out.withColumns({"hit_ranges": _merge(F.col("hit_ranges")), "items": F.array_sort("items")})
        if carry is not None and text not in carry:
            out = out.drop(text)
    return out


def _merge(ranges):
    """Join overlapping ranges of an array that holds those of several blocks."""
    step = lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= r["lo"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], r["hi"]).alias("hi")))),
    ).otherwise(F.concat(acc, F.array(r)))
    return F.aggregate(F.array_sort(ranges), F.slice(ranges, 1, 0), step)


def _start(shared, whole: bool):
    matcher = shared()

    def work(col):
        count, ranges, items = matcher(col)
        return [
            pa.array(count, pa.int64()),
            pa.array([[{"lo": a, "hi": b} for a, b in merged(r)] for r in ranges], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
            pa.array([sorted(s) for s in items], pa.list_(pa.int64() if whole else pa.string())),
        ]

    return work


def hit_words(ranges):
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hit_ranges")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("hit_ranges") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS win FROM b WHERE len(w) > 0
), x AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k
), h AS (
  SELECT DISTINCT x.doc_id, x.i, x.k, g.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM x) x JOIN g USING (k, win)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
