"""Greedy disjoint pairs without a scan: the same choice as going through the pairs in order.

In each cell the pairs are taken in (from, to) order as long as neither id was used
before.  A cell of few pairs is folded inside its row.  The pairs of a crowded cell are
never gathered; two facts settle them in joins:

* Ids that are all paired with each other and with nobody else (a complete group: every
  pair of m first and n second ids) give min(m, n) pairs, whatever their order.  Groups are
  found by the fingerprint of each id's partners and then verified by counts.
* A pair that is the smallest at both its ends is taken by the scan too, since nothing
  before it touches either end.  All such pairs are taken at once, the pairs beside them
  are dropped, and the rest is looked at again.

Each round takes at least the first pair of every cell that is left; a cell whose pairs
become few or complete leaves the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.operators.common import settle

# Pairs of a cell that are folded in one row.
FEW = 512


def _fold(pairs: Column, kind: str) -> Column:
    """Number of pairs taken from an array of (f, t) in order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(f"array<{kind}>").alias("used"))

    def step(acc: Column, p: Column) -> Column:
        hit = F.array_contains(acc["used"], p["f"]) | F.array_contains(acc["used"], p["t"])
        return F.when(hit, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), F.concat(acc["used"], F.array(p["f"], p["t"])).alias("used")))

    return F.aggregate(F.array_sort(pairs), start, step, lambda acc: acc["n"])


def _folded(edges: DataFrame) -> DataFrame:
    kind = edges.schema["f"].dataType.simpleString()
    return edges.groupBy("_c").agg(F.collect_list(F.struct("f", "t")).alias("_p")).select("_c", _fold(F.col("_p"), kind).alias("taken"))


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of cells with few, pairs of crowded cells)."""
    crowded = edges.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select("_c")
    return edges.join(crowded, "_c", "left_anti"), edges.join(crowded, "_c", "left_semi")


def _ends(edges: DataFrame) -> DataFrame:
    """Every pair once per end: the id ``v``, its partner ``o`` and its side."""
    one = F.struct(F.col("f").alias("v"), F.col("t").alias("o"), F.lit(0).alias("side"))
    two = F.struct(F.col("t").alias("v"), F.col("f").alias("o"), F.lit(1).alias("side"))
    return edges.select("_c", "f", "t", F.explode(F.array(one, two)).alias("e")).select("_c", "f", "t", "e.*")


def _complete_groups(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs taken from complete groups per cell, the pairs of all other groups)."""
    per = _ends(edges).groupBy("_c", "v").agg(F.count(F.lit(1)).alias("d"), F.bit_xor(F.xxhash64("o")).alias("s"), (F.min("side") != F.max("side")).alias("m"))
    side = lambda v: per.select("_c", F.col("v").alias(v), F.col("d").alias(f"d{v}"), F.col("s").alias(f"s{v}"), F.col("m").alias(f"m{v}"))
    marked = edges.join(side("f"), ["_c", "f"]).join(side("t"), ["_c", "t"])
    groups = marked.groupBy("_c", "sf", "st").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("f").alias("nf"), F.count_distinct("t").alias("nt"), F.max("df").alias("df"), F.max("dt").alias("dt"), F.max(F.col("mf") | F.col("mt")).alias("mixed")
    )
    # all pairs are there, and no id has a partner outside
    whole = (F.col("n") == F.col("nf") * F.col("nt")) & (F.col("df") == F.col("nt")) & (F.col("dt") == F.col("nf")) & ~F.col("mixed")
    done = settle(groups.where(whole).select("_c", "sf", "st", F.least("nf", "nt").alias("taken")))
    rest = marked.join(done, ["_c", "sf", "st"], "left_anti").select("_c", "f", "t")
    return done.groupBy("_c").agg(F.sum("taken").alias("taken")), rest


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that are the smallest at both ends, the pairs that touch none of them)."""
    first = _ends(edges).groupBy("_c", "v").agg(F.min(F.struct("f", "t")).alias("first"))
    mine = F.struct("f", "t")
    at = lambda v: first.select("_c", F.col("v").alias(v), F.col("first").alias(f"first_{v}"))
    taken = settle(edges.join(at("f"), ["_c", "f"]).where(F.col("first_f") == mine).join(at("t"), ["_c", "t"]).where(F.col("first_t") == mine).select("_c", "f", "t"))
    used = taken.select("_c", F.explode(F.array("f", "t")).alias("v"))
    left = edges
    for v in ("f", "t"):
        left = left.join(used.select("_c", F.col("v").alias(v)), ["_c", v], "left_anti")
    return taken, left.select("_c", "f", "t")


def _crowded(edges: DataFrame) -> list[DataFrame]:
    """Counts (_c, taken) of crowded cells, a cell in several of them."""
    out = []
    while True:
        counts, rest = _complete_groups(edges)
        out.append(counts)
        edges = settle(rest)
        if edges.isEmpty():
            break
        taken, rest = _round(edges)
        out.append(taken.groupBy("_c").agg(F.count(F.lit(1)).alias("taken")))
        few, edges = _split(settle(rest))
        out.append(settle(_folded(few)))
        edges = settle(edges)
        if edges.isEmpty():
            break
        if len(out) > 30:  # keeps the plan short
            out = [settle(_sum(out))]
    return out


def _sum(counts: Sequence[DataFrame]) -> DataFrame:
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total.groupBy("_c").agg(F.sum("taken").alias("taken"))


def disjoint_pairs(pairs: DataFrame, cell: Sequence[str], first: str, second: str) -> DataFrame:
    """(cell columns, taken): pairs of each cell in the greedy choice.

    Cells are told apart by 64-bit code.  Rows without an id on either side make no pair.
    """
    cell = list(cell)
    coded = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    edges = settle(coded.select(*cell, F.xxhash64(*[x for c in cell for x in (F.col(c).isNull(), F.col(c))]).alias("_c"), F.col(first).alias("f"), F.col(second).alias("t")).distinct())
    names = edges.groupBy("_c").agg(*[F.first(c).alias(c) for c in cell], F.count(F.lit(1)).alias("_n"))
    few, many = _split(edges.select("_c", "f", "t"))
    if names.where(F.col("_n") > FEW).isEmpty():
        counts = _folded(few)
    else:
        counts = _sum([_folded(few), *_crowded(settle(many))])
    return names.drop("_n").join(counts, "_c").select(*cell, "taken")
