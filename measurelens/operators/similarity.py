"""Exact set-similarity joins, cliffs, nearest neighbours and consensus.

A set is an array of distinct tokens.  Identical sets are collapsed first, so a
group of copies costs one row however many copies it has.  Similar sets are then
found through signatures, never by pairing all sets:

* For thresholds of 0.8 and above the tokens of a set are hashed into parts, one
  more than the largest difference two similar sets can have.  By the pigeonhole
  principle similar sets agree on a whole part, and a part of several tokens is a
  rare key.
* For lower thresholds sets must share one of their rarest tokens (prefix filter).

Sets that share a signature are compared by bit sketches first: a token in one of
two sets alone flips one bit, so more unequal bits than two similar sets can have
rule a pair out before any tokens move.  Signatures move once, to a cell of many of
them, and the sketch of a set moves once per cell, not once per signature.  Tokens
move only to confirm candidates; until then a set goes by a 64-bit number.

Both are exact: candidates are verified, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelens.operators.common import settle, with_scalars
from measurelens.operators.ordered import count_far_pairs, quantiles

# A signature shared by more sets than this is joined in blocks.
_BLOCK = 2000

# Tokens of the sets behind a cell of signatures (at least, at most, and the cells wished for),
# and pairs that a task compares at a time.
_LEAST, _MOST, _WISHED, _PAIRS = 1 << 18, 1 << 23, 64, 1 << 16

# Sets that one step of a task takes up, and cells that tell frequent tokens from rare ones.
_SETS, _CELLS = 2000, 1 << 20

# Sets in a file of a nearest neighbour search, files of queries and of references behind a
# task, tokens of a file that are counted by matrices, and counts that a task holds at a time.
_CHUNK, _ASKED, _TOLD, _HOT, _STRIPE = 4096, 4, 64, 512, 1 << 20

# Words of a sketch come in steps of so many; bits of the filter that says which sets are candidates.
_WORDS, _BITS = 8, 1 << 23


def tanimoto(common: Column, size_a: Column, size_b: Column) -> Column:
    union = size_a + size_b - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common.cast("double") / union)


def token_codes(tokens: Column | str) -> Column:
    """A set as sorted distinct 64-bit codes of its tokens.

    Spark compares arrays of longs through hash tables, arrays of text pair by
    pair.  Two different tokens share a code with probability 2^-64.
    """
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def collapse_sets(df: DataFrame, *, tokens: str) -> DataFrame:
    """Code the tokens and add ``size`` and ``set_key``, a fingerprint of the set."""
    coded = df.withColumn(tokens, token_codes(tokens)).withColumn("size", F.size(tokens))
    return coded.withColumn("set_key", F.unhex(F.md5(F.array_join(F.transform(tokens, lambda c: c.cast("string")), ",").cast("binary"))))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes evenly over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(keys, sizes, tokens, row of each token) of a few sets at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, _SETS):
            part = batch.slice(first, _SETS)
            tokens = part.column(2)
            size = np.diff(tokens.offsets.to_numpy())
            yield part.column(0), size, tokens.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(size)), size)


def _tags(size: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A set's own and next size interval, each with its upper end.

    Sizes of similar sets differ by at most the factor 1/t, so on a logarithmic
    scale to that base they lie in the same or in neighbouring unit intervals.
    Every set is signed for its own interval and for the next one, so similar
    sets share one.
    """
    own = np.floor(np.log(size) / math.log(1.0 / t) + 1e-9)
    for tag in (own, own + 1):
        yield tag.astype(np.int64), np.ceil((1.0 / t) ** (tag + 1) - 1e-9)


def _in_sets(sets: DataFrame, tokens: str, run: Callable, schema: str) -> DataFrame:
    """Run over the sets, which a task sees once however many copies it reads."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            number, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            first = first[~np.isin(number, seen, kind="sort")]
            seen = np.union1d(seen, number)
            if len(first):
                yield batch.take(pa.array(np.sort(first)))

    return sets.where(F.col("size") > 0).select("number", "size", tokens).mapInArrow(lambda batches: run(once(batches)), schema)


def part_signatures(sets: DataFrame, t: float, tokens: str) -> DataFrame:
    """(number, tag, sig): one row per part of the set's own and next interval.

    Below the upper end ``top`` of an interval two similar sets differ in at most
    d = 2 (1-t)/(1+t) top tokens, so of d + 1 parts at least one is untouched.  A
    part without tokens also signs, since two empty parts are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, size, token, row in _slices(batches):
            spread = _mix(token)
            for tag, top in _tags(size, t):
                parts = (np.floor(2.0 * (1.0 - t) / (1.0 + t) * top + 1e-9) + 1).astype(np.int64)
                start = np.cumsum(parts) - parts
                total = np.zeros(parts.sum(), np.uint64)
                np.add.at(total, start[row] + (spread % parts[row].astype(np.uint64)).astype(np.int64), _mix(spread))
                owner = np.repeat(np.arange(len(size)), parts)
                place = (tag[owner] << 32) + np.arange(len(total)) - start[owner]
                sig = _mix(total + _mix(place))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(tag[owner]), pa.array(sig.view(np.int64))], ["number", "tag", "sig"])

    return _in_sets(sets, tokens, run, "number long, tag long, sig long")


def token_loads(sets: DataFrame, tokens: str) -> np.ndarray:
    """How many tokens of all sets fall into each cell: rare tokens lie in cells with few."""
    cells = _CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for _, _, token, _ in _slices(batches):
            total += np.bincount((_mix(token) % np.uint64(cells)).astype(np.int64), minlength=cells)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    found = _in_sets(sets, tokens, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix_signatures(sets: DataFrame, t: float, tokens: str) -> DataFrame:
    """(number, tag, sig): the rarest tokens of a set, of which two similar sets share one.

    Any order of all tokens will do.  This one follows the loads of cells of
    tokens, a table of fixed size, so tokens need not be joined with their counts.
    """
    loads = sets.sparkSession.sparkContext.broadcast(token_loads(sets, tokens))
    cells = _CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = loads.value
        for keys, size, token, row in _slices(batches):
            spread = _mix(token)
            order = np.lexsort((spread, load[(spread % np.uint64(cells)).astype(np.int64)], row))
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            keep = place < (size - np.ceil(t * size - 1e-9) + 1)[row]
            code, owner = spread[order[keep]], row[keep]
            for tag, _ in _tags(size, t):
                sig = _mix(code + _mix(tag[owner]))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(tag[owner]), pa.array(sig.view(np.int64))], ["number", "tag", "sig"])

    return _in_sets(sets, tokens, run, "number long, tag long, sig long")


def set_sketches(sets: DataFrame, t: float, tokens: str) -> DataFrame:
    """(number, tag, own, size, bits): a sketch per set and interval.

    Each token flips one of about as many bits as the largest set of the interval
    has tokens, at least 512 and at most 4096.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, size, token, row in _slices(batches):
            spread = _mix(token + np.uint64(1))
            for step, (tag, top) in enumerate(_tags(size, t)):
                words = _WORDS * np.clip(np.ceil(top / 64 / _WORDS), 1, 8).astype(np.int64)
                start = np.cumsum(words) - words
                at = spread % (words[row] * 64).astype(np.uint64)
                bits = np.zeros(words.sum(), np.uint64)
                np.bitwise_xor.at(bits, start[row] + (at // np.uint64(64)).astype(np.int64), np.uint64(1) << (at % np.uint64(64)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words)), pa.int32()), pa.array(bits.view(np.int64)))
                columns = [keys, pa.array(tag), pa.array(np.full(len(size), step == 0)), pa.array(size, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["number", "tag", "own", "size", "bits"])

    return _in_sets(sets, tokens, run, "number long, tag long, own boolean, size int, bits array<long>")


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of one length as a matrix of 64-bit words."""
    if not rows:
        return np.zeros((0, _WORDS), np.uint64)
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy().view(np.uint64).reshape(rows, -1)


class _Sketched:
    """The sets of a cell, and which of their pairs may be similar."""

    def __init__(self, table: pa.Table, t: float, apart: float | None):
        read = lambda c: table.column(c).to_numpy()
        self.t, self.apart, self.number, self.own, self.size = t, apart, read("number"), read("own"), read("size").astype(np.int64)
        self.lo, self.hi = (read("lo"), read("hi")) if apart is not None else (None, None)
        self.bits = _matrix(table.column("bits"), table.num_rows)

    def alike(self, a: np.ndarray, other: _Sketched, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (row of this, row of the other) with fitting sizes, values and sketches."""
        x, y = self.size[a], other.size[b]
        keep = np.minimum(x, y) >= self.t * np.maximum(x, y) - 1e-9
        if self.apart is not None:
            # a value that is no number stays, to be judged when members meet
            keep &= ~((self.hi[a] - other.lo[b] <= self.apart) & (other.hi[b] - self.lo[a] <= self.apart))
        a, b, most = a[keep], b[keep], ((1.0 - self.t) / (1.0 + self.t) * (x + y) + 1e-9)[keep]
        unequal = np.zeros(len(a), np.int64)
        if not len(a):
            return a, b
        half = _WORDS // 2
        for w in range(0, self.bits.shape[1], half):
            unequal += np.bitwise_count(self.bits[a, w : w + half] ^ other.bits[b, w : w + half]).sum(axis=1, dtype=np.int64)
            keep = unequal <= most
            a, b, most, unequal = a[keep], b[keep], most[keep], unequal[keep]
        return a, b


def _pair_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _pairs_in_cell(t: float, apart: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of the sets of a cell that share a signature, each once; members of crowded signatures leave it as they are."""
    block, step = _BLOCK, _PAIRS

    def run(signed: pa.Table, sketched: pa.Table) -> pa.Table:
        sets = _Sketched(sketched, t, apart)
        by = np.argsort(sets.number)
        at = by[np.searchsorted(sets.number[by], signed.column("number").to_numpy())] if signed.num_rows else np.zeros(0, np.int64)
        sig = signed.column("sig").to_numpy()
        # members for which this interval is their own come first: a pair needs one of them
        order = np.lexsort((at, ~sets.own[at], sig))
        sig, at = sig[order], at[order]
        # copies that different tasks read have signed more than once
        new = np.append(True, (sig[1:] != sig[:-1]) | (at[1:] != at[:-1])) if len(sig) else np.zeros(0, bool)
        sig, at = sig[new], at[new]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        load = np.diff(np.append(first, len(sig)))
        end, crowd = np.repeat(first + load, load), np.repeat(load > block, load)
        left = np.flatnonzero(~crowd & sets.own[at])
        many = end[left] - left - 1
        left, many = left[many > 0], many[many > 0]
        upto = np.cumsum(many)
        n, found, low = len(sets.number), [np.zeros(0, np.int64)], 0
        held = 0
        while low < len(left):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] - many[low] + step)))
            k = many[low:high]
            b = np.repeat(left[low:high] + 1 - (np.cumsum(k) - k), k) + np.arange(k.sum())
            x, y = sets.alike(np.repeat(at[left[low:high]], k), sets, at[b])
            found.append(np.unique(np.minimum(x, y) * n + np.maximum(x, y)))
            held += len(found[-1])
            if held > 16 * step:
                found, held = [np.unique(np.concatenate(found))], 0
            low = high
        pairs = np.unique(np.concatenate(found))
        out = _pair_table(sets.number[pairs // max(n, 1)], sets.number[pairs % max(n, 1)])
        out = out.append_column("sig", pa.nulls(out.num_rows, pa.int64())).append_column("tag", pa.nulls(out.num_rows, pa.int64()))
        if not crowd.any():
            return out
        members = sets.number[at[crowd]]
        tags = sketched.column("tag").to_numpy()[at[crowd]]
        return pa.concat_tables([out, pa.table({"a": pa.array(members), "b": pa.array(members), "sig": pa.array(sig[crowd]), "tag": pa.array(tags)})])

    return run


def _pairs_of_block(t: float, apart: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs between a block of members of a crowded signature and all its members."""
    step = _PAIRS

    def run(block: pa.Table, members: pa.Table) -> pa.Table:
        mine, all_ = _Sketched(block, t, apart), _Sketched(members, t, apart)
        out, wide = [_pair_table(np.zeros(0, np.int64), np.zeros(0, np.int64))], len(all_.number)
        rows = max(1, step // max(wide, 1))
        for low in range(0, len(mine.number), rows):
            a = np.repeat(np.arange(low, min(low + rows, len(mine.number))), wide)
            b = np.tile(np.arange(wide), len(a) // wide if wide else 0)[: len(a)]
            once = np.where(all_.own[b], mine.number[a] < all_.number[b], mine.number[a] != all_.number[b])
            x, y = mine.alike(a[once], all_, b[once])
            out.append(_pair_table(mine.number[x], all_.number[y]))
        return pa.concat_tables(out)

    return run


def candidate_pairs(signatures: DataFrame, sketches: DataFrame, t: float, span: DataFrame | None = None, apart: float | None = None) -> DataFrame:
    """Distinct (a < b), by number, that share a signature and have fitting sizes and sketches.

    An interval is cut into cells by signature; signatures and sketches meet there,
    so a pair of a cell leaves it once, however many signatures it shares.  Two
    sets meet in the own interval of the larger one.  A signature held by very
    many sets is joined block against all in a second step, so that no task
    compares the whole of it.  With ``span`` (number, lo, hi) only pairs stay whose
    values can differ by more than ``apart``.
    """
    sketches = sketches if span is None else sketches.join(span, "number")
    # read for the loads, by the cells and by the crowded signatures
    sketches = settle(sketches.dropDuplicates(["number", "tag"]))
    loads = sketches.groupBy("tag").agg(F.sum("size").alias("n"))
    aim = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.sum("n").over(Window.partitionBy()) / _WISHED))
    cells = F.broadcast(loads.select("tag", F.ceil(F.col("n") / aim).alias("cells")))  # a row per interval
    cell = lambda place: (F.shiftleft(F.col("tag"), 24) + place).alias("cell")
    signed = signatures.join(cells, "tag").select(cell(F.pmod("sig", "cells")), "number", "sig")
    shown = sketches.join(cells, "tag").withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).select(cell(F.col("_r")), *sketches.columns)
    met = signed.groupBy("cell").cogroup(shown.groupBy("cell")).applyInArrow(_pairs_in_cell(t, apart), "a long, b long, sig long, tag long")
    met = settle(met)
    open_ = met.where(F.col("sig").isNotNull()).select(F.col("a").alias("number"), "sig", "tag")
    blocks = open_.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks"))
    sized = open_.join(blocks, "sig").join(sketches, ["number", "tag"])
    side = lambda rows, block: rows.select(*[F.col(c).alias(c) for c in ("sig", *sketches.columns)], block.alias("block"))
    left = side(sized.where("own"), F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    right = side(sized, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowded = left.groupBy("sig", "block").cogroup(right.groupBy("sig", "block")).applyInArrow(_pairs_of_block(t, apart), "a long, b long")
    return met.where(F.col("sig").isNull()).select("a", "b").unionByName(crowded).distinct()


def _listed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that occur in pairs (a, b), with few others: a filter of 2^23 bits, whatever their number."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("n")).select(F.pmod("n", F.lit(_BITS)).alias("bit"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bit").bitwiseAND(7).cast("int"))).alias("bits")
    words = ends.groupBy(F.shiftright("bit", 3).alias("at")).agg(bits).toArrow()
    filled = np.zeros(_BITS >> 3, np.uint8)
    filled[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    filled = sets.sparkSession.sparkContext.broadcast(filled)
    place, size = sets.columns.index("number"), np.int64(_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(place).to_numpy() % size
            yield batch.filter(pa.array((filled.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return sets.mapInArrow(run, sets.schema)


def similar_set_pairs(sets: DataFrame, t: float, *, tokens: str, value: str | None = None, apart: float = 0.0) -> DataFrame:
    """All pairs of distinct sets with similarity strictly above ``t``.

    ``sets`` comes from ``_distinct_sets``.  With ``value`` pairs whose values cannot
    differ by more than ``apart`` are dropped before tokens move.
    """
    if not 0 < t < 1:
        raise ValueError("the similarity threshold lies between 0 and 1")
    signatures = (part_signatures if t >= 0.8 else prefix_signatures)(sets, t, tokens)
    span = sets.groupBy("number").agg(F.min(value).alias("lo"), F.max(value).alias("hi")) if value else None
    # read for the filter and for the comparison
    candidates = settle(candidate_pairs(signatures, set_sketches(sets, t, tokens), t, span, apart if value else None))
    one = _listed(sets.select("number", "set_key", "size", tokens), candidates).groupBy("number", "set_key").agg(F.first("size").alias("size"), F.first(tokens).alias("tok"))
    side = lambda s: one.select(F.col("number").alias(s), F.col("set_key").alias(f"key_{s}"), F.col("size").alias(f"size_{s}"), F.col("tok").alias(f"tok_{s}"))
    verified = candidates.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("tok_a", "tok_b"))
    x, y = F.col("key_a"), F.col("key_b")
    likeness = tanimoto(common, F.col("size_a"), F.col("size_b")).alias("similarity")
    return verified.select(F.least(x, y).alias("key_a"), F.greatest(x, y).alias("key_b"), likeness).where(F.col("similarity") > t)


def pair_spelling(id_a: Column, id_b: Column) -> tuple[Column, Column]:
    """The two ids with the smaller one (length, then text) first."""
    first = (F.length(id_a) < F.length(id_b)) | ((F.length(id_a) == F.length(id_b)) & (id_a <= id_b))
    return F.when(first, id_a).otherwise(id_b), F.when(first, id_b).otherwise(id_a)


def _distinct_sets(members: DataFrame, tokens: str) -> DataFrame:
    """The sets of written members, each under a number.

    Tokens do not move for it: a task drops the copies it reads, and the others
    where signatures or candidates meet.
    """
    return members.withColumn("number", F.xxhash64("set_key"))


def _value_cells(members: DataFrame, value: str) -> DataFrame:
    """(set_key, v, c): how many members of a set have each value."""
    return members.groupBy("set_key", F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def region_counts(df: DataFrame, *, identifier: str, tokens: str, value: str, t: float = 0.9, a: float = 2.0) -> DataFrame:
    """How many pairs are cliffs, smooth, scaffold hops, nondescript or identical.

    Similar pairs are counted through the signature join, weighted by how many
    members share a (set, value).  All remaining pairs follow by subtraction
    from the total and from the number of pairs with a large value difference,
    which needs running totals only.
    """
    members = settle(collapse_sets(df.select(identifier, tokens, value), tokens=tokens))
    n_set = members.where(F.col("size") > 0)
    similar = similar_set_pairs(_distinct_sets(n_set, tokens), t, tokens=tokens)
    cells = _value_cells(members, value)
    left = cells.select(F.col("set_key").alias("key_a"), F.col("v").alias("v_a"), F.col("c").alias("c_a"))
    right = cells.select(F.col("set_key").alias("key_b"), F.col("v").alias("v_b"), F.col("c").alias("c_b"))
    weighed = similar.join(left, "key_a").join(right, "key_b")
    big, weight = F.abs(F.col("v_a") - F.col("v_b")) > a, F.col("c_a") * F.col("c_b")
    near = weighed.agg(
        F.coalesce(F.sum(F.when(big, weight)), F.lit(0)).alias("cliff"), F.coalesce(F.sum(F.when(~big, weight)), F.lit(0)).alias("smooth")
    )
    copies = count_far_pairs(n_set, value, a, ["set_key"]).agg(
        F.coalesce(F.sum(F.col("n_rows") * (F.col("n_rows") - 1) / 2), F.lit(0)).cast("long").alias("identical"), F.coalesce(F.sum("far_pairs"), F.lit(0)).alias("identical_far")
    )
    whole = count_far_pairs(members, value, a)
    one = with_scalars(with_scalars(whole, near), copies)
    pairs = (F.col("n_rows") * (F.col("n_rows") - 1) / 2).cast("long")
    far = F.col("far_pairs")
    return one.select(
        "cliff",
        "smooth",
        ((pairs - far) - F.col("smooth") - (F.col("identical") - F.col("identical_far"))).alias("scaffold_hop"),
        (far - F.col("cliff") - F.col("identical_far")).alias("nondescript"),
        "identical",
    )


def cliffs(df: DataFrame, *, identifier: str, tokens: str, value: str, t: float = 0.9, a: float = 2.0) -> DataFrame:
    """Similar pairs with a value difference above ``a``, with their index (SALI).

    Sets whose value ranges cannot differ by more than ``a`` are dropped before
    tokens and members are attached, so only pairs that become results are expanded.
    """
    members = collapse_sets(df.select(F.col(identifier).cast("string").alias("id"), tokens, F.col(value).cast("double").alias("v")), tokens=tokens).where(F.col("size") > 0)
    members = settle(members)
    far = similar_set_pairs(_distinct_sets(members, tokens), t, tokens=tokens, value="v", apart=a)
    ma = members.select(F.col("set_key").alias("key_a"), F.col("id").alias("x"), F.col("v").alias("v_a"))
    mb = members.select(F.col("set_key").alias("key_b"), F.col("id").alias("y"), F.col("v").alias("v_b"))
    delta = F.abs(F.col("v_a") - F.col("v_b"))
    id_a, id_b = pair_spelling(F.col("x"), F.col("y"))
    rows = far.select("key_a", "key_b", "similarity").join(ma, "key_a").join(mb, "key_b").where(delta > a)
    return rows.select(id_a.alias("id_a"), id_b.alias("id_b"), "similarity", delta.alias("delta"), (delta / (1.0 - F.col("similarity"))).alias("sali"))


def ordered_cliffs(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("sali"), "id_a", "id_b")


def identical_groups(df: DataFrame, *, identifier: str, tokens: str, value: str, a: float = 2.0) -> DataFrame:
    """Groups of identical sets: members, pairs, value range and far pairs.

    Holds the same facts as the list of identical pairs without its quadratic
    length: n members stand for n(n-1)/2 pairs.
    """
    # written without tokens: the pairs below read the members several times
    members = settle(collapse_sets(df.select(F.col(identifier).cast("string").alias("id"), tokens, value), tokens=tokens).where(F.col("size") > 0).select("set_key", "id", value))
    groups = members.groupBy("set_key").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct(F.length("id").alias("l"), F.col("id").alias("id"))).alias("f"), (F.max(value) - F.min(value)).alias("value_range")
    ).where(F.col("members") > 1)
    groups = settle(groups)
    # a set without copies has no pairs
    far = count_far_pairs(settle(members.join(groups.select("set_key"), "set_key", "left_semi").select("set_key", value)), value, a, ["set_key"]).select("set_key", "far_pairs")
    pairs = (F.col("members") * (F.col("members") - 1) / 2).cast("long")
    return groups.join(far, "set_key").select(F.col("f.id").alias("first_id"), "members", pairs.alias("pairs"), "value_range", "far_pairs")


def identical_pairs(df: DataFrame, *, identifier: str, tokens: str, value: str) -> DataFrame:
    """Every pair of members of a group of identical sets, joined block by block."""
    members = collapse_sets(df.select(F.col(identifier).cast("string").alias("id"), tokens, F.col(value).alias("v")), tokens=tokens).where(F.col("size") > 0)
    load = members.groupBy("set_key").agg(F.count(F.lit(1)).alias("load")).where(F.col("load") > 1)
    sized = members.join(load, "set_key").withColumn("blocks", F.ceil(F.col("load") / _BLOCK).cast("int"))
    left = sized.select("set_key", F.col("id").alias("x"), F.col("v").alias("vx"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    right = sized.select("set_key", F.col("id").alias("y"), F.col("v").alias("vy"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    before = (F.length("x") < F.length("y")) | ((F.length("x") == F.length("y")) & (F.col("x") < F.col("y")))
    return left.join(right, ["set_key", "block"]).where(before).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"), F.abs(F.col("vx") - F.col("vy")).alias("delta"))


def far_copies(df: DataFrame, *, identifier: str, tokens: str, value: str, a: float) -> DataFrame:
    """(id): members of a group of identical sets with a copy whose value differs by more than ``a``.

    The smallest or the largest value of the group is such a copy if there is any,
    so the pairs of the group need not be listed.
    """
    members = settle(collapse_sets(df.select(F.col(identifier).cast("string").alias("id"), tokens, F.col(value).cast("double").alias("v")), tokens=tokens).where(F.col("size") > 0).select("set_key", "id", "v"))
    span = members.groupBy("set_key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("hi") - F.col("lo") > a)
    return members.join(span, "set_key").where((F.col("hi") - F.col("v") > a) | (F.col("v") - F.col("lo") > a)).select("id")


def threshold_grid(df: DataFrame, *, identifier: str, tokens: str, value: str, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Cliff counts for several (similarity, difference) cut-offs from one join."""
    t, a = min(g[0] for g in grid), min(g[1] for g in grid)
    base = cliffs(df, identifier=identifier, tokens=tokens, value=value, t=t, a=a)
    sums = [F.count_if((F.col("similarity") > gt) & (F.col("delta") > ga)).alias(f"n{i}") for i, (gt, ga) in enumerate(grid)]
    one = base.agg(*sums)
    cells = [F.struct(F.lit(float(gt)).alias("similarity_threshold"), F.lit(float(ga)).alias("activity_threshold"), F.col(f"n{i}").alias("cliffs")) for i, (gt, ga) in enumerate(grid)]
    return one.select(F.explode(F.array(*cells)).alias("g")).select("g.*")


def cliff_generators(table: DataFrame, n_sd: float = 2.0) -> DataFrame:
    """Cliffs per entity; generators lie above mean + n_sd standard deviations."""
    ids = table.select(F.explode(F.array("id_a", "id_b")).alias("molecule_id"))
    counts = ids.groupBy("molecule_id").agg(F.count(F.lit(1)).alias("n_cliffs"))
    limit = counts.agg((F.avg("n_cliffs") + n_sd * F.stddev_samp("n_cliffs")).alias("threshold"))
    return counts.join(F.broadcast(limit)).select("molecule_id", "n_cliffs", F.coalesce(F.col("n_cliffs") > F.col("threshold"), F.lit(False)).alias("is_generator"))


def consensus_pairs(results: dict[str, DataFrame]) -> DataFrame:
    """Pairs that are cliffs under every definition, with each similarity."""
    if not results:
        raise ValueError("consensus needs at least one result")
    out = None
    for name, table in results.items():
        part = table.select("id_a", "id_b", "delta", F.col("similarity").alias(f"similarity_{name}"))
        out = part if out is None else out.join(part.drop("delta"), ["id_a", "id_b"])
    return out


def consensus_generators(results: dict[str, DataFrame], n_sd: float = 2.0) -> DataFrame:
    out = None
    for table in results.values():
        ids = cliff_generators(table, n_sd).where("is_generator").select("molecule_id")
        out = ids if out is None else out.intersect(ids)
    return out


def nearest_neighbours(queries: DataFrame, reference: DataFrame, *, tokens: str, exclude_self: bool = False) -> DataFrame:
    """For each query (id, tokens): the most similar reference (id, tokens), exactly.

    The first reference in id order wins ties.  A query that shares no token
    with any reference gets similarity 0 and the first reference.

    All queries meet all references: both are written once, in files of bounded
    length, and a task reads some files of queries and a run of files of
    references.  Only the nearest reference of the run leaves a task.  Work and
    bytes read grow with the product of the tables, since sets that resemble
    nothing have no bound that would spare them; bytes written do not.
    """
    coded = lambda rows: settle(rows.select(F.col("id").cast("string").alias("id"), token_codes(tokens).alias("tokens")), _CHUNK)
    q = coded(queries)
    r = q if reference is queries else coded(reference)
    asked, told = sorted(q.inputFiles()), sorted(r.inputFiles())
    groups = [asked[k : k + _ASKED] for k in range(0, len(asked), _ASKED)]
    run = max(1, min(_TOLD, len(told) * len(groups) // _WISHED))
    runs = [told[k : k + run] for k in range(0, len(told), run)]
    tasks = max(1, len(groups) * len(runs))
    near = q.sparkSession.range(0, tasks, 1, tasks).mapInArrow(_nearest_in_files(groups, runs, exclude_self), "q string, s double, r string")
    q, r = q.select(F.col("id").alias("q")), r.select(F.col("id").alias("r"))
    best = near.groupBy("q").agg(F.min(F.struct((-F.col("s")).alias("s"), F.length("r").alias("l"), F.col("r").alias("r"))).alias("b"))
    fallback = _first_reference(r, exclude_self)
    out = q.join(best, "q", "left").join(F.broadcast(fallback))
    zero = F.when(F.col("f1") == F.col("q"), F.col("f2")).otherwise(F.col("f1")) if exclude_self else F.col("f1")
    hit = F.col("b").isNotNull() & (F.col("b.s") < 0)
    return out.select(F.col("q").alias("id"), F.when(hit, -F.col("b.s")).otherwise(F.when(zero.isNotNull(), F.lit(0.0))).alias("similarity"), F.when(hit, F.col("b.r")).otherwise(zero).alias("nearest_id"))


class _Chunk:
    """Sets in id order, with their tokens one after another; empty sets are left out."""

    def __init__(self, tables: Sequence[pa.Table]):
        table = pa.concat_tables(tables).combine_chunks()
        table = table.filter(pc.greater(pc.list_value_length(table.column("tokens")), 0))
        ids = table.column("id").to_pylist()
        first = sorted(range(len(ids)), key=lambda k: (len(ids[k]), ids[k].encode()))
        lists = table.column("tokens").take(pa.array(first, pa.int64()))
        self.ids = [ids[k] for k in first]
        self.size = pc.list_value_length(lists).to_numpy()
        self.tokens = pc.list_flatten(lists).to_numpy()


def _nearest_in_files(groups: list[list[str]], runs: list[list[str]], exclude_self: bool) -> Callable:
    """The nearest reference of each query in a run of files, where they share a token."""

    def read(path: str) -> pa.Table:
        system, at = fs.FileSystem.from_uri(path)
        return pq.read_table(at, filesystem=system, columns=["id", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                if not groups or not runs:
                    continue
                asked = _Chunk([read(f) for f in groups[task // len(runs)]])
                score, names = np.zeros(len(asked.ids)), [""] * len(asked.ids)
                for path in runs[task % len(runs)]:
                    _meet(asked, _Chunk([read(path)]), exclude_self, score, names)
                hit = np.flatnonzero(score > 0)
                yield pa.RecordBatch.from_arrays([pa.array([asked.ids[k] for k in hit], pa.string()), pa.array(score[hit]), pa.array([names[k] for k in hit], pa.string())], ["q", "s", "r"])

    return run


def _meet(asked: _Chunk, told: _Chunk, exclude_self: bool, score: np.ndarray, names: list[str]) -> None:
    """Note the references of a chunk that are nearer to a query than those before, or as near and earlier in order.

    Shared tokens are counted for some queries at a time: the most frequent tokens
    of the chunk by a product of 0/1 matrices, the others along their lists of
    references.
    """
    if not asked.ids or not told.ids:
        return
    known, code, load = np.unique(told.tokens, return_inverse=True, return_counts=True)
    wide = len(told.ids)
    hot = np.full(len(known), -1)
    most = np.argsort(-load, kind="stable")[:_HOT]
    hot[most] = np.arange(len(most))
    at, row = hot[code], np.repeat(np.arange(wide), told.size)
    dense = np.zeros((len(most), wide), np.float32)
    dense[at[at >= 0], row[at >= 0]] = 1
    cold = np.flatnonzero(at < 0)
    cold = cold[np.argsort(code[cold], kind="stable")]
    holders = row[cold].astype(np.int32)
    start = np.concatenate(([0], np.cumsum(np.bincount(code[cold], minlength=len(known))))).astype(np.int32)
    place = np.minimum(np.searchsorted(known, asked.tokens), len(known) - 1)
    place = np.where(known[place] == asked.tokens, place, -1)
    ends = np.concatenate(([0], np.cumsum(asked.size)))
    mine = {name: k for k, name in enumerate(told.ids)} if exclude_self else {}
    step, low = max(1, _STRIPE // wide), 0
    # hits along the lists before each query
    listed = np.where(place >= 0, (start[1:] - start[:-1])[place], 0)
    before = np.concatenate(([0], np.cumsum(listed)))[ends]
    while low < len(asked.ids):
        high = min(low + step, len(asked.ids), max(low + 1, int(np.searchsorted(before, before[low] + 8 * _STRIPE, side="right")) - 1))
        token, asker = place[ends[low] : ends[high]], np.repeat(np.arange(high - low), asked.size[low:high])
        token, asker = token[token >= 0], asker[token >= 0]
        often = hot[token] >= 0
        marks = np.zeros((high - low, len(most)), np.float32)
        marks[asker[often], hot[token[often]]] = 1
        common = (marks @ dense).astype(np.float64)
        token, asker = token[~often], asker[~often].astype(np.int32)
        many = start[token + 1] - start[token]
        # where a token's list starts, less the hits before it, and the row of its query
        begin = np.repeat(start[token] - (np.cumsum(many, dtype=np.int32) - many), many)
        begin += np.arange(len(begin), dtype=np.int32)
        hits = np.repeat(asker * np.int32(wide), many)
        hits += holders[begin]
        common += np.bincount(hits, minlength=(high - low) * wide).reshape(high - low, wide)
        like = asked.size[low:high, None] + told.size[None, :] - common
        np.divide(common, like, out=like)
        for k in range(low, high) if exclude_self else ():
            if asked.ids[k] in mine:
                like[k - low, mine[asked.ids[k]]] = -1.0
        best = like.argmax(axis=1)
        top = like[np.arange(high - low), best]
        for k in np.flatnonzero((top > 0) & (top >= score[low:high])):
            name, held = told.ids[best[k]], names[low + k]
            if top[k] > score[low + k] or (len(name), name.encode()) < (len(held), held.encode()):
                score[low + k], names[low + k] = top[k], name
        low = high


def _first_reference(r: DataFrame, two: bool) -> DataFrame:
    """The first (and second) reference in id order, as one row."""
    head = r.orderBy(F.length("r"), "r").limit(2 if two else 1).select("r", F.length("r").alias("l"))
    return head.agg(F.min(F.struct("l", "r")).getField("r").alias("f1"), F.when(F.count(F.lit(1)) > 1, F.max(F.struct("l", "r")).getField("r")).alias("f2"))


def domain_threshold(neighbours: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Fifth percentile of the non-self nearest similarity; 1.0 below two rows."""
    cut = quantiles(neighbours, [], similarity, {"cut": 0.05})
    n = neighbours.agg(F.count(similarity).alias("n"))
    return n.join(F.broadcast(cut)).select(F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.col("cut")).alias("threshold"))


def near_cliff(neighbours: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Nearest cliff member and whether it is close."""
    return neighbours.select("id", F.coalesce(F.col("similarity") >= threshold, F.lit(False)).alias("near_activity_cliff"), F.coalesce("nearest_id", F.lit("")).alias("nearest_cliff_id"), "similarity")
