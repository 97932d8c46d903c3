"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sets are banded by size, so that similar sets lie in the same or in adjacent
bands.  For a band, the feature domain is partitioned by hash into n parts.  Two
similar sets differ in at most K features, so at most K of the n parts differ and
any K + 1 parts of a set, chosen in one order for all sets, hold one on which
both agree.  A signature is the content of one part; a set has the K + 1 that
come first.  In that order parts with a rare feature precede parts of frequent
ones, and empty parts come last, so passages that many texts share hardly ever
make a signature.  The order is only that: whatever counts as frequent, no pair
is lost.

Equal sets are one node.  Sets that share a signature are candidates.  A signature
shared by few sets gives all pairs; a crowded one first pairs its members with one
of them, then each member with its closest partners, and afterwards only members
that are still in different components: these are compared in full block against
block, and a task tells no more links than unite the components it holds.  A
candidate whose bucket counts differ by more than similar sets can differ is
dropped (the difference of counts never exceeds that of the sets); every other one
is compared in full.

Signatures travel as blobs, one per range of codes and slab of texts, so a range
of codes holds an equal share of the work even if one text fills the table.
Features, sets and signatures are compared by 64-bit codes.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.components import components
from measurelens.llm.texts import SPACED, Words, documents, map_texts, mix, name_of, pieces, ragged, shingle_codes, slabs
from measurelens.llm.texts import share as sent
from measurelens.operators.common import settle

WIDTH = 5
SHARE = (3, 4)  # similar: intersection / union >= 3 / 4
SLAB = 4_000_000  # bytes of text whose signatures travel together
SIG_BYTES = 5  # of a signature that travel; its range of codes stands for the high bits
OFTEN = 8  # sets of one slab that hold a feature before it may count as frequent
FREQUENT = 500_000  # frequent features at most; the list only orders the parts
MAP_BITS = 1 << 23  # of the bit map of wanted ids
BLOCK = 1000
NEAREST = 2
FEW = 3
HELD = 500_000  # pairs that a task holds before it hands them on
SPREAD = 16  # tasks over which the signatures with one first member are dealt
CODES = 1_000_000  # features of a block of sets that are compared in full where they meet
CROWD = 8  # members of a signature that are paired at once

_EMPTY = np.zeros(0, np.int64)


def bands(largest: int, share=SHARE) -> np.ndarray:
    """Upper ends of the size bands; entry 0 is 0."""
    ends = [0]
    while ends[-1] < largest:
        ends.append((ends[-1] + 1) * share[1] // share[0])
    ends.append((ends[-1] + 1) * share[1] // share[0])
    return np.array(ends, np.int64)


def sets_of(col: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, size): the distinct shingles of each text, and how many it has."""
    words = Words(col, SPACED)
    owner, code = shingle_codes(words.codes(), words.first, words.count, width)
    return owner, code, np.bincount(owner, minlength=len(col))


def set_keys(owner: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit code of each set."""
    total = np.zeros(len(size), np.uint64)
    some = size > 0
    if some.any():
        starts = (np.cumsum(size) - size)[some]
        total[some] = np.add.reduceat(mix(code ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return mix(total + size.astype(np.uint64)).view(np.int64)


def bucket_counts(owner: np.ndarray, code: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Per set the number of features in each of 2^k buckets, at most 15 and two to a byte, with about two buckets per feature pair.

    Cutting counts at 15 only lowers their differences, so these stay lower bounds.
    """
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 2) / 2)).astype(np.int64))
    base = np.cumsum(width) - width
    spread = mix(code ^ np.uint64(0x3C6EF372FE94F82B)).astype(np.int64)
    counts = np.bincount(base[owner] + (spread & (width[owner] - 1)), minlength=int(width.sum()))
    flat = np.minimum(counts, 15).astype(np.uint8)
    packed = (flat[0::2] | flat[1::2] << 4).tobytes()
    return [packed[a : a + w] for a, w in zip((base // 2).tolist(), (width // 2).tolist())]


def unpacked(data) -> np.ndarray:
    """The counts of packed buckets."""
    pairs = np.frombuffer(data, np.uint8)
    return np.stack((pairs & 15, pairs >> 4), axis=1).ravel()


def least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric differences: rows of bucket counts of one set against those of many.

    Buckets are the low bits of a hash, so the wider counts fold onto the narrower.
    """
    if len(x) > y.shape[1]:
        x = x.reshape(-1, y.shape[1]).sum(axis=0)
    elif y.shape[1] > len(x):
        y = y.reshape(len(y), -1, len(x)).sum(axis=1)
    return np.abs(x.astype(np.int32) - y.astype(np.int32)).sum(axis=1)


def profile(rows: DataFrame, width: int, often: int) -> DataFrame:
    """One row (id, key, n, counts) per text, and rows (code, n) of features that many sets of a slab hold."""
    schema = T.StructType(
        [rows.schema["_id"], T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("code", T.LongType()), T.StructField("counts", T.BinaryType())]
    )

    def run(batches):
        for slab in slabs(batches, SLAB):
            codes, seen = [], set()
            for piece in slab:
                owner, code, size = sets_of(piece.column(0), width)
                key = set_keys(owner, code, size)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1), pa.array(key), pa.array(size.astype(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(bucket_counts(owner, code, size), pa.binary())], schema.fieldNames()
                )
                new = np.array([k not in seen and not seen.add(k) for k in key.tolist()], np.bool_)
                codes.append(code[new[owner]])
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            top = count >= often
            n = int(top.sum())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, piece.column(1).type), pa.nulls(n, pa.int64()), pa.array(count[top].astype(np.int64)), pa.array(code[top].view(np.int64)), pa.nulls(n, pa.binary())], schema.fieldNames()
                )

    return rows.select("_text", "_id").mapInArrow(run, schema)


def signatures(owner, code, size, ends, frequent, share=SHARE):
    """(set index, lower, signatures): the entries of each set for its own band and the next, and their codes.

    ``lower`` marks entries of a set in the band above its own.
    """
    num, den = share
    band = np.searchsorted(ends, size)  # 1 for the first band
    rare = np.ones(len(code), np.bool_)
    if len(frequent) and len(code):
        at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
        rare = frequent[at] != code
    place = mix(code + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)
    lo, hi = (code & np.uint64(0xFFFFFFFF)).astype(np.float64), (code >> np.uint64(32)).astype(np.float64)
    out_set, out_lower, out_count, out_sig = [], [], [], []
    for lower in (False, True):
        tag = band + lower
        reach = np.minimum(size * den // num, ends[np.minimum(tag, len(ends) - 1)])  # the largest partner in this tag
        wanted = (size > 0) & (~np.full(len(size), lower) | (size * den // num > ends[np.minimum(band, len(ends) - 1)]))
        keep = (size + reach) * (den - num) // (den + num) + 1
        top = ends[np.minimum(tag, len(ends) - 1)]
        parts = np.where(wanted, np.where(top >= 64, -(-top // 2), 4 * top), 0)
        base = np.cumsum(parts) - parts
        mine = wanted[owner]
        cell = base[owner[mine]] + ((place[mine] * parts[owner[mine]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        n = int(parts.sum())
        if not n:
            continue
        content = np.bincount(cell, weights=lo[mine], minlength=n).astype(np.uint64) + mix(np.bincount(cell, weights=hi[mine], minlength=n).astype(np.uint64))
        filled = np.bincount(cell, minlength=n)
        good = np.bincount(cell[rare[mine]], minlength=n) > 0
        of = np.repeat(np.arange(len(size)), parts)
        rank = np.zeros(n, np.int64)
        before = np.zeros(len(size), np.int64)
        for kind in (good, (filled > 0) & ~good, filled == 0):
            run = np.cumsum(kind)
            start = np.concatenate(([0], run))[base]
            at = np.flatnonzero(kind)
            rank[at] = before[of[at]] + run[at] - 1 - start[of[at]]
            total = np.zeros(len(size), np.int64)
            total[parts > 0] = (np.concatenate(([0], run))[base + parts] - start)[parts > 0]
            before += total
        first = np.flatnonzero(rank < keep[of])
        p = (first - base[of[first]]).astype(np.uint64)
        salt = mix((tag[of[first]].astype(np.uint64) << np.uint64(40)) + p)
        out_sig.append(mix(content[first] + filled[first].astype(np.uint64) ^ salt))
        count = np.bincount(of[first], minlength=len(size))
        has = np.flatnonzero(count)
        out_set.append(has)
        out_lower.append(np.full(len(has), lower))
        out_count.append(count[has])
    if not out_set:
        return _EMPTY, _EMPTY, _EMPTY, np.zeros(0, np.uint64)
    return np.concatenate(out_set), np.concatenate(out_lower), np.concatenate(out_count), np.concatenate(out_sig)


BLOBS = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("own", T.BinaryType()),
        T.StructField("lower", T.BinaryType()),
        T.StructField("sigs", T.BinaryType()),
    ]
)


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave planes of zeros, which the shuffle packs."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def signature_blobs(rows: DataFrame, frequent: np.ndarray, ranges: int, width: int, share) -> DataFrame:
    """For every slab and range of codes one row of packed (key, size, signatures).

    A set has one entry per range, with the numbers of its signatures for its own
    band and for the next.  Signatures travel by their low ``SIG_BYTES`` bytes: the
    range holds the high bits, and two that are taken for one only make a candidate.
    """
    shared = sent(rows.sparkSession, frequent)

    def run(batches):
        frequent = None
        for slab in slabs(batches, SLAB):
            frequent = shared() if frequent is None else frequent
            keys, sizes, entries, sigs = [], [], [], []
            base = 0
            for piece in slab:
                owner, code, size = sets_of(piece.column(0), width)
                if not len(code):
                    continue
                who, lower, count, sig = signatures(owner, code, size, bands(int(size.max()), share), frequent, share)
                keys.append(set_keys(owner, code, size))
                sizes.append(size)
                entries.append(np.repeat(2 * (base + who.astype(np.int64)) + lower, count))  # odd for the band above a set's own
                sigs.append(sig)
                base += len(size)
            if not keys:
                continue
            key, size, entry, sig = (np.concatenate(x) for x in (keys, sizes, entries, sigs))
            del keys, sizes, entries, sigs
            part = ((sig >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part * (2 * base) + entry)
            part, entry = part[order], entry[order]
            packed = sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
            del sig, order
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            for r in range(ranges):
                first, last = cuts[r], cuts[r + 1]
                if first == last:
                    continue
                e = entry[first:last]
                who, of = np.unique(e >> 1, return_inverse=True)
                above = np.bincount(of[(e & 1) == 1], minlength=len(who))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r], pa.int32()),
                        pa.array([key[who].tobytes()], pa.binary()),
                        pa.array([planes(size[who])], pa.binary()),
                        pa.array([planes(np.bincount(of, minlength=len(who)) - above)], pa.binary()),
                        pa.array([planes(above)], pa.binary()),
                        pa.array([packed[first:last].tobytes()], pa.binary()),
                    ],
                    BLOBS.fieldNames(),
                )

    return rows.select("_text").mapInArrow(run, BLOBS)


PAIRS = T.StructType(
    [
        T.StructField("sig", T.LongType()),  # null for a pair, else the crowded signature
        T.StructField("a", T.LongType()),
        T.StructField("size_a", T.IntegerType()),
        T.StructField("b", T.LongType()),
        T.StructField("size_b", T.IntegerType()),
    ]
)


def meet(blobs: DataFrame, share, crowd: int) -> DataFrame:
    """Candidate pairs, and the members of crowded signatures beside their first member."""
    num, den = share

    def run(batches):
        keys, sizes, counts, sigs = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                key, size = np.frombuffer(row["keys"], np.int64), from_planes(row["sizes"]).astype(np.int32)
                keys.append(np.repeat(key, 2))
                sizes.append(np.stack((size, -size), axis=1).ravel())
                counts.append(np.stack((from_planes(row["own"]), from_planes(row["lower"])), axis=1).ravel())
                wide = np.zeros((len(row["sigs"]) // SIG_BYTES, 8), np.uint8)
                wide[:, :SIG_BYTES] = np.frombuffer(row["sigs"], np.uint8).reshape(-1, SIG_BYTES)
                sigs.append(wide.view("<u8")[:, 0] | np.uint64(row["range"]) << np.uint64(8 * SIG_BYTES))
        if not keys:
            return
        sig = np.concatenate(sigs)
        del sigs
        entry = np.repeat(np.arange(sum(map(len, counts)), dtype=np.int32), np.concatenate(counts))
        key, size = np.concatenate(keys), np.concatenate(sizes)
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        order = order[shared]
        s, k, z = sig[order], key[entry[order]], size[entry[order]]
        order = np.lexsort((k, s))
        s, k, z = s[order], k[order], z[order]
        new = np.ones(len(s), np.bool_)
        new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        s, k, z = s[new], k[new], z[new]  # copies of a set are one member
        if not len(s):
            return
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        load = np.diff(np.append(start, len(s)))
        load_of, start_of = np.repeat(load, load), np.repeat(start, load)
        at = np.arange(len(s))
        a, b = [_EMPTY], [_EMPTY]
        for gap in range(1, crowd):
            left = np.flatnonzero((load_of <= crowd) & (at + gap < start_of + load_of))
            a.append(left)
            b.append(left + gap)
        big = np.flatnonzero((load_of > crowd) & (at > start_of))
        a, b = np.concatenate((*a, start_of[big])), np.concatenate((*b, big))
        za, zb = np.abs(z[a]).astype(np.int64), np.abs(z[b]).astype(np.int64)
        fits = (np.minimum(za, zb) * den >= np.maximum(za, zb) * num) & ((z[a] > 0) | (z[b] > 0))
        a, b = a[fits], b[fits]
        pair = np.unique(np.stack((k[a], k[b])), axis=1, return_index=True)[1] if len(a) else a
        a, b = a[pair], b[pair]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(k[a]), pa.array(np.abs(z[a])), pa.array(k[b]), pa.array(np.abs(z[b]))], PAIRS.fieldNames())
        crowded = np.flatnonzero(load_of > crowd)
        if len(crowded):
            first = start_of[crowded]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[crowded].view(np.int64)), pa.array(k[first]), pa.array(z[first]), pa.array(k[crowded]), pa.array(z[crowded])], PAIRS.fieldNames()
            )

    return blobs.mapInArrow(run, PAIRS)


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, size_a, size_b) of every pair, by the full sets."""
    left = sets.select(F.col("key").alias("a"), F.col("codes").alias("codes_a"))
    right = sets.select(F.col("key").alias("b"), F.col("codes").alias("codes_b"))
    rows = pairs.join(left, "a").join(right, "b")
    count = lambda c: F.size(c).cast("long")
    return rows.select("a", "b", count(F.array_intersect("codes_a", "codes_b")).alias("common"), count("codes_a").alias("size_a"), count("codes_b").alias("size_b"))


def flagged(rows: DataFrame, wanted: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: true if the value is in ``wanted``, and for few others, by a bit map of fixed size (``MAP_BITS`` / 32 words at most)."""
    place = F.pmod(F.xxhash64(column), F.lit(MAP_BITS)).cast("int")
    bit = F.expr("shiftleft(1L, pmod(_p, 32))")
    words = wanted.select(place.alias("_p")).groupBy(F.shiftright("_p", 5).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_p", place).withColumn("_w", F.shiftright("_p", 5)).join(F.broadcast(words), "_w", "left")
    return marked.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_p", "_w", "_bits")


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose value is in ``wanted``, and few others."""
    return flagged(rows, wanted, column, "_likely").where("_likely").drop("_likely")


def load_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, codes) for the texts whose ``_id`` is in ``wanted`` (key, _id); where ``_id`` is null, for those whose key is.

    Equal ids with different texts may bring sets that were not asked for: they
    join with nothing.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                owner, code, size = sets_of(piece.column(0), width)
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(owner, code, size)), codes], schema.fieldNames())

    known, nameless = wanted.where("_id is not null"), wanted.where("_id is null").select("key")
    named = likely(rows.where("_id is not null"), known, "_id").join(known, "_id", "left_semi").select("_text").mapInArrow(run, schema)
    if nameless.isEmpty():
        return named
    # a text without id is found by its set; copies are one
    others = likely(rows.where("_id is null").select("_text").mapInArrow(run, schema), nameless, "key").dropDuplicates(["key"])
    return named.unionByName(others.join(nameless, "key", "left_semi"))


def close_pairs(pairs: DataFrame, counts: DataFrame, share) -> DataFrame:
    """The pairs that the bucket counts do not exclude."""
    num, den = share
    left = counts.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("c_a"))
    right = counts.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("c_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])

    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = []
            for x, y, t in zip(batch.column(4), batch.column(5), total.tolist()):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                keep.append(least_difference(x, y[None, :])[0] * (den + num) <= t * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def in_blocks(members: DataFrame, full: int) -> DataFrame:
    """The members of groups that hold several components, once per pair of blocks (i, j) that they belong to.

    A group is cut into blocks with about ``full`` of the column ``weight``; a pair
    of blocks is one piece of work (with j < 0 for those of the largest component,
    whose members need no pairs among themselves).
    """
    per = members.groupBy("group", "root").agg(F.sum("weight").alias("n"))
    mixed = per.groupBy("group").agg(F.max(F.struct("n", "root")).alias("t"), F.sum("n").alias("load"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    twofold = lambda c: F.pow(F.lit(2), F.ceil(F.log2(F.greatest(c / full, F.lit(1))))).cast("int")
    # written, so that the join deals both sides anew and Spark can split a very crowded group
    mixed = settle(mixed.select("group", F.col("t.root").alias("major"), twofold(F.col("load") - F.col("t.n")).alias("blocks"), twofold(F.col("t.n")).alias("chunks")))
    place = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    among = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    across = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("own").alias("i"), (-1 - c).alias("j")))
    large = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("i"), (-1 - place(F.col("chunks"))).alias("j")))
    rows = members.join(mixed, "group").withColumn("own", F.when(F.col("root") == F.col("major"), -1).otherwise(place(F.col("blocks"))))
    rows = rows.withColumn("u", F.explode(F.when(F.col("own") < 0, large).otherwise(F.concat(among, across))))
    return rows.select(*members.columns, "own", "u.i", "u.j")


def by_piece(work):
    """For mapInArrow over rows sorted by (group, i, j): ``work`` turns the table of each piece into an array (column, row)."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            table = table.combine_chunks()
            where = [table.column(n).to_numpy() for n in ("group", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([w[1:] != w[:-1] for w in where])) + 1
            cuts = [0, *new.tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield work(table.slice(a, b - a))
            rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield work(rest.combine_chunks())

    return run


def told_once(found, names):
    """Batches of the distinct columns of the arrays ``found``, of which at most ``HELD`` are held."""
    held = [np.zeros((len(names), 0), np.int64)]

    def batches():
        rows = held.pop()
        for a in range(0, rows.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(r[a : a + 50_000]) for r in rows], names)

    for one in found:
        held[:] = [np.unique(np.concatenate((*held, one), axis=1), axis=1)]
        if held[0].shape[1] > HELD:
            yield from batches()
            held.append(np.zeros((len(names), 0), np.int64))
    yield from batches()


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


class Close:
    """The partners of a member in other components that sizes and bucket counts do not exclude."""

    def __init__(self, group: pa.Table, share):
        self.num, self.den = share
        self.own, self.key, self.size, self.root = (group.column(n).to_numpy() for n in ("own", "key", "size", "root"))
        self.size = self.size.astype(np.int64)
        self.one_block = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        self.counts = group.column("counts").to_pylist()
        widths = np.array([len(c) for c in self.counts])
        self.by_width = {w: np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.stacked = {w: unpacked(b"".join(self.counts[i] for i in at)).reshape(len(at), -1) for w, at in self.by_width.items()}

    def partners(self, x: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(their places, lower bounds of the differences), from the places that ``among`` marks."""
        num, den, size = self.num, self.den, self.size
        row = unpacked(self.counts[x])
        partners, gaps = [_EMPTY], [_EMPTY]
        for w, at in self.by_width.items():
            fits = among[at] & (self.root[at] != self.root[x]) & (np.minimum(size[at], size[x]) * den >= np.maximum(size[at], size[x]) * num)
            if not self.one_block:
                fits &= self.own[at] != self.own[x]
            some = np.flatnonzero(fits)
            if not len(some):
                continue
            gap = least_difference(row, self.stacked[w][some])
            close = gap * (den + num) <= (size[at[some]] + size[x]) * (den - num)
            partners.append(at[some[close]])
            gaps.append(gap[close])
        return np.concatenate(partners), np.concatenate(gaps)


def nearest_pairs(crowded: DataFrame, counts: DataFrame, roots: DataFrame, share, turn: int) -> DataFrame:
    """(a, b): each member's ``NEAREST`` closest partners by bucket counts that are in other components.

    They are sought in ``FEW`` of its crowded signatures, others at each turn and
    the same for sets that share them.
    """
    members = crowded.select(F.col("sig").alias("group"), "a", F.col("b").alias("key"), F.col("size_b").alias("z"), F.abs("size_b").alias("size"), F.lit(1).alias("weight"))
    members = members.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(turn), "group"), "z"))).where(F.col("_n") <= FEW).drop("_n")
    members = in_blocks(with_roots(members, roots), BLOCK).join(counts.select("key", "counts"), "key")
    parts = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # signatures with the same first member hold much the same sets: together, a pair of theirs is told once
    members = members.withColumn("near", F.xxhash64("a", F.pmod("group", F.lit(SPREAD)))).select("near", "group", "i", "j", "own", "key", "z", "size", "root", "counts")
    dealt = members.repartition(parts, "near", "i", "j").drop("near").sortWithinPartitions("group", "i", "j")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])

    def work(group: pa.Table):
        near, up = Close(group, share), group.column("z").to_numpy() > 0
        out_a, out_b = [], []
        for x, key in enumerate(near.key):
            hit, gaps = near.partners(x, up if not up[x] else np.ones(len(up), np.bool_))
            hit = hit[np.argsort(gaps, kind="stable")[:NEAREST]]
            out_a.append(np.minimum(near.key[hit], key))
            out_b.append(np.maximum(near.key[hit], key))
        return np.stack((np.concatenate(out_a), np.concatenate(out_b)))

    return dealt.mapInArrow(lambda batches: told_once(by_piece(work)(batches), schema.fieldNames()), schema).distinct()


def open_members(crowded: DataFrame, counts: DataFrame, roots: DataFrame, share) -> DataFrame:
    """(group, key, root, size): members with a close partner in another component.

    Signatures of several components that have the same first member are one
    group, so a set is there once, however many of them it has.  No pair leaves a
    task, only the members that have one.
    """
    members = with_roots(crowded.select("sig", "a", F.col("b").alias("key"), F.abs("size_b").alias("size")), roots)
    # written, so that the join below deals both sides anew
    mixed = settle(members.groupBy("sig").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l <> _h").select("sig"))
    members = members.join(mixed, "sig").select(F.col("a").alias("group"), "key", "root", "size", F.lit(1).alias("weight")).distinct()
    members = in_blocks(members, BLOCK).join(counts.select("key", "counts"), "key").select("group", "i", "j", "own", "key", "size", "root", "counts")
    parts = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("group", "key", "root", "size")])

    def work(table: pa.Table):
        near = Close(table, share)
        found = np.zeros(len(near.key), np.bool_)
        # pairs are symmetric: in one block the later ones, else the block with fewer members meets the other
        few = near.own == min(np.unique(near.own), key=lambda o: (near.own == o).sum())
        later = np.ones(len(found), np.bool_)
        for x in range(len(found)) if near.one_block else np.flatnonzero(few):
            later[x] = not near.one_block
            among = later & ~found if found[x] else later
            if not among.any():
                continue
            hit, _ = near.partners(x, among)
            found[hit] = True
            found[x] |= len(hit) > 0
        group = np.full(int(found.sum()), table.column("group")[0].as_py(), np.int64)
        return np.stack((group, near.key[found], near.root[found], near.size[found]))

    return dealt.mapInArrow(lambda batches: told_once(by_piece(work)(batches), schema.fieldNames()), schema).distinct()


def joining_links(members: DataFrame, sets: DataFrame, share) -> DataFrame:
    """(a, b): links between ``members`` of a group, as many as join what belongs together and no more.

    Members are compared in full where they meet; a link unites their components,
    so a piece gives fewer links than it has components, and nothing is kept of
    pairs that are not similar.
    """
    num, den = share
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_blocks(members.withColumn("weight", F.greatest("size", F.lit(CODES // BLOCK))), CODES).join(sets, "key").select("group", "i", "j", "own", "key", "root", "codes")
    dealt = rows.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "key")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])

    def work(table: pa.Table):
        own, key, root = (table.column(n).to_numpy().copy() for n in ("own", "key", "root"))
        one_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        lists = table.column("codes").combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        who = np.repeat(np.arange(len(key)), size)
        code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].ravel()
        order = np.argsort(code, kind="stable")
        holders, start = who[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
        base = np.concatenate(([0], np.cumsum(size)))
        few = own == min(np.unique(own), key=lambda o: (own == o).sum())
        out_a, out_b = [], []
        for x in range(len(key)) if one_block else np.flatnonzero(few):
            fits = (root != root[x]) & (np.minimum(size, size[x]) * den >= np.maximum(size, size[x]) * num)
            if one_block:
                fits[:x] = False
            else:
                fits &= own != own[x]
            if not fits.any():
                continue
            mine = code[base[x] : base[x + 1]]
            count = start[mine + 1] - start[mine]
            common = np.bincount(holders[np.repeat(start[mine], count) + ragged(count)], minlength=len(key))
            for y in np.flatnonzero(fits & (common * den >= (size + size[x] - common) * num)):
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    out_a.append(min(key[x], key[y]))
                    out_b.append(max(key[x], key[y]))
        return np.array([out_a, out_b], np.int64).reshape(2, -1)

    return dealt.mapInArrow(lambda batches: told_once(by_piece(work)(batches), schema.fieldNames()), schema).distinct()


def swept(spark) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def similar_links(rows: DataFrame, seen: DataFrame, *, width: int = WIDTH, share=SHARE, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between different sets, enough of them to give all components."""
    num, den = share
    spark = rows.sparkSession
    often = seen.where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "code").limit(FREQUENT).select("code")
    frequent = np.sort(np.array([r.code for r in often.toLocalIterator()], np.int64).view(np.uint64))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = settle(meet(signature_blobs(rows, frequent, ranges, width, share).repartitionById(ranges, F.col("range")), share, crowd))
    swept(spark)
    counts = settle(seen.where("code is null and n > 0").groupBy("key").agg(F.min(F.struct(F.isnull("_id").alias("_no_id"), "_id", "n", "counts")).alias("r")).select("key", "r._id", "r.n", "r.counts"))
    similar = F.col("common") * den >= (F.col("size_a") + F.col("size_b") - F.col("common")) * num

    def loaded(keys: DataFrame) -> DataFrame:
        wanted = settle(counts.join(keys.distinct(), "key", "left_semi").select("key", "_id"))
        return settle(load_sets(rows, wanted, width))

    def linked(pairs: DataFrame) -> DataFrame:
        sets = loaded(pairs.select(F.explode(F.array("a", "b")).alias("key")))
        return settle(compare(pairs, sets).where(similar).select("a", "b").distinct())

    links = linked(settle(close_pairs(met.where("sig is null").select("a", "b").distinct(), counts, share)))
    swept(spark)
    crowded = met.where("sig is not null")
    # first the closest partners, which as a rule joins all that belongs together, then whatever is still open
    for turn in (0, 1):
        rest = settle(nearest_pairs(crowded, counts, components(links), share, turn))
        if rest.isEmpty():
            continue
        links = links.unionByName(linked(rest))
        swept(spark)
    rest = settle(open_members(crowded, counts, components(links), share))
    if not rest.isEmpty():
        # copies of a set are one; texts with equal ids may bring sets that were not asked for
        links = links.unionByName(settle(joining_links(rest, loaded(rest.select("key")).dropDuplicates(["key"]), share)))
        swept(spark)
    return links


def similar_sets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share=SHARE, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(profile of the texts, (node, root) of every set that resembles another)."""
    rows = docs.select(F.coalesce(name_of(text).cast("string"), F.lit("")).alias("_text"), name_of(doc_id).alias("_id"))
    seen = settle(profile(rows, width, OFTEN))
    return seen, components(similar_links(rows, seen, width=width, share=share, crowd=crowd))


def with_sets(docs: DataFrame, *, text: str = "text", width: int = WIDTH, carry: Sequence[str] | None = None) -> DataFrame:
    """Add set_key, the code of its set, and n_shingles to every row."""

    def work(col):
        owner, code, size = sets_of(col, width)
        return pa.array(set_keys(owner, code, size)), pa.array(size.astype(np.int64))

    results = T.StructType([T.StructField("set_key", T.LongType()), T.StructField("n_shingles", T.LongType())])
    return map_texts(docs, text, results, lambda: work, carry=carry)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share=SHARE, crowd: int = CROWD) -> DataFrame:
    """(``doc_id``, n_shingles, component_id) for every row of ``docs``.

    Rows with equal ids each give a row.  Texts without words have component_id =
    own id and no links.  Rows with a null id take no part in anyone's smallest
    id; a component of null ids only has a null component_id.
    """
    seen, roots = similar_sets(docs, doc_id=doc_id, text=text, width=width, share=share, crowd=crowd)
    each = seen.where("code is null").select("_id", "key", "n")
    each = each.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("_id", "n", F.coalesce("root", "key").alias("root"))
    # written, so that the join below deals both sides anew and Spark can split a large component
    least = settle(each.where("n > 0").groupBy("root").agg(F.min("_id").alias("component_id")))
    out = each.join(least, "root", "left")
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share=SHARE, crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` from each group of similar texts: that of the smallest id, then of the smallest text; null ids come last.

    Rows are told apart by their texts, not by their ids.  Texts without words
    resemble nothing, so all of them stay.  The choice is made on ids and set keys;
    a bit map then lets nearly all rows that stay pass where they are.  Only rows
    that it cannot tell from those that go are dealt anew, and only rows of one
    group with the same smallest id are compared in full.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    plain, id_, text_ = docs.toDF(*names), at[doc_id.lower()], at[text.lower()]
    seen, roots = similar_sets(docs, doc_id=doc_id, text=text, width=width, share=share, crowd=crowd)
    each = seen.where("code is null and n > 0").groupBy("key", "_id").agg(F.count(F.lit(1)).alias("rows"))
    # written, so that the joins below deal both sides anew and Spark can split a large group
    each = settle(each.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    first = each.groupBy("root").agg(F.min(F.struct(F.isnull("_id").alias("no_id"), "_id")).alias("first"), F.sum("rows").alias("load"))
    first = settle(first.where("load > 1").select("root", F.col("first._id").alias("least")))
    met = each.join(first, "root").withColumn("tie", F.col("_id").eqNullSafe(F.col("least")))
    tied = met.where("tie").groupBy("root").agg(F.sum("rows").alias("load")).where("load > 1").select("root", F.lit(True).alias("open"))
    doubt = settle(met.join(tied, "root", "left").where("not tie or open").select("key", F.col("_id").alias("known"), "tie", "root"))
    rows = with_sets(plain, text=text_, width=width, carry=names).withColumn("_pick", F.xxhash64("set_key", id_))
    rows = flagged(rows, doubt.select(F.xxhash64("key", "known").alias("_pick")), "_pick", "_doubt")
    known = rows.where("_doubt").join(doubt, (F.col("set_key") == F.col("key")) & F.col(id_).eqNullSafe(F.col("known")), "left")
    order = [id_, text_, *[n for n in names if n not in (id_, text_)]]
    sortable = [n for n in order if not re.search("map<|variant", plain.schema[n].dataType.simpleString())]
    odd = [n for n in order if n not in sortable]
    best = known.where("tie").select(
        "root",
        F.struct(*[x for n in sortable for x in (F.isnull(n).alias(f"no_{n}"), F.col(n))]).alias("_first"),
        F.struct(F.lit(0).alias("_"), *odd).alias("_odd"),
    )
    best = best.groupBy("root").agg(F.min("_first").alias("_first"), *([F.min_by("_odd", "_first").alias("_odd")] if odd else []))
    best = best.select(*[F.col(f"_odd.{n}" if n in odd else f"_first.{n}").alias(n) for n in names])
    return rows.where("not _doubt").select(*names).unionAll(known.where("tie is null").select(*names)).unionAll(best).toDF(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
