"""Feature screening, imputation, scaling, components and grid fields."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelens.functions.scalar import hash_unit
from measurelens.functions.stats import ratio
from measurelens.operators.common import settle
from measurelens.operators.normal import matrix, means
from measurelens.operators.ordered import quantiles, usable

# Features of a block; the products of two blocks are one value of half a megabyte.
FEATURE_BLOCK = 256
# Pairs of blocks that a task holds at once, and senders of one partial sum per pair.
PASS = 128
FAN = 64


def long_features(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    return df.select(row, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([row], list(columns), "feature", "v")


def long_array(df: DataFrame, row: str, array: str) -> DataFrame:
    """(row, feature number, v) from an array column."""
    return df.select(row, F.posexplode(array).alias("feature", "v")).withColumn("v", F.col("v").cast("double"))


def variance_table(long: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Population variance per feature and whether it is strictly above the threshold."""
    per = long.groupBy("feature").agg(F.var_pop("v").alias("variance"), F.count("v").alias("n"))
    return per.withColumn("kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def correlated_features(df: DataFrame, array: str, features: Sequence[int], threshold: float) -> DataFrame:
    """(f_a, f_b): pairs of features, f_a < f_b, with absolute correlation above the threshold.

    The sums of products are made block by block.  A task holds ``PASS`` pairs of
    blocks at most and sends each as one value; these are added in two steps, so that
    no task receives more than about the root of their number.  Wider tables take
    several passes.  A feature without spread is tied to none.
    """
    spark, p = df.sparkSession, len(features)
    schema = "f_a int, f_b int"
    first = df.select(F.size(array)).head()
    if p < 2 or first is None:
        return spark.createDataFrame([], schema)
    width = first[0]
    rows = df.select(F.col(array).cast("array<double>").alias("_x"))
    centre = means(rows, {"_x": width})[list(features)]
    starts = list(range(0, p, FEATURE_BLOCK))
    pairs = [(i, j) for i in range(len(starts)) for j in range(i, len(starts))]
    box = spark.sparkContext.broadcast((centre, np.array(features)))
    out = None
    for at in range(0, len(pairs), PASS):
        chosen = pairs[at : at + PASS]

        def products(batches, chosen=chosen):
            centre, numbers = box.value
            task, sums = TaskContext.get().partitionId(), {}
            for batch in batches:
                x = matrix(batch.column(0), width)[:, numbers] - centre
                squares = (x * x).sum(0)
                block = lambda i: x[:, starts[i] : starts[i] + FEATURE_BLOCK]  # noqa: B023, E731
                for i, j in chosen:
                    new = np.concatenate((squares[starts[i] : starts[i] + FEATURE_BLOCK], squares[starts[j] : starts[j] + FEATURE_BLOCK], (block(i).T @ block(j)).reshape(-1)))
                    sums[i, j] = sums[i, j] + new if (i, j) in sums else new
            for (i, j), v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([task % FAN], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["i", "j", "salt", "v"])

        def total(table: pa.Table) -> np.ndarray:
            return sum(np.frombuffer(v, np.float64) for v in table.column("v").to_pylist())

        def added(table: pa.Table) -> pa.Table:
            return table.slice(0, 1).set_column(3, "v", pa.array([total(table).tobytes()], pa.binary()))

        def ties(table: pa.Table) -> pa.Table:
            numbers, v = box.value[1], total(table)
            a, b = (numbers[starts[table.column(c)[0].as_py()] :][:FEATURE_BLOCK] for c in ("i", "j"))
            spread = np.sqrt(np.outer(v[: len(a)], v[len(a) : len(a) + len(b)]))
            r = np.abs(v[len(a) + len(b) :].reshape(len(a), len(b))) / np.where(spread > 0, spread, np.inf)
            x, y = np.nonzero((r > threshold) & (a[:, None] < b[None, :]))
            return pa.table({"f_a": pa.array(a[x], pa.int32()), "f_b": pa.array(b[y], pa.int32())})

        part = "i int, j int, salt int, v binary"
        sums = rows.mapInArrow(products, part).groupBy("i", "j", "salt").applyInArrow(added, part)
        edges = settle(sums.groupBy("i", "j").applyInArrow(ties, schema))
        out = edges if out is None else out.unionByName(edges)
    return out


def greedy_keep(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Scan features in order and drop one that is tied to a feature already kept; both are tables.

    The scan's result in rounds: a feature with no undecided smaller neighbour is
    kept, its larger neighbours are dropped, and the rest is looked at again.
    ``features`` has the column ``feature``; the kept ones are returned.
    """
    undecided, kept = settle(features.select("feature").distinct()), None
    left = settle(edges.select(F.least("f_a", "f_b").alias("lo"), F.greatest("f_a", "f_b").alias("hi")).distinct())
    while True:
        new = settle(undecided.join(left.select(F.col("hi").alias("feature")), "feature", "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        gone = left.join(new.select(F.col("feature").alias("lo")), "lo").select(F.col("hi").alias("feature")).distinct()
        gone = settle(gone)
        undecided = settle(undecided.join(new, "feature", "left_anti").join(gone, "feature", "left_anti"))
        if undecided.isEmpty():
            return kept
        # ties between two undecided features stay open
        for side in ("lo", "hi"):
            left = left.join(undecided.select(F.col("feature").alias(side)), side, "left_semi")
        left = settle(left)


def select_features(df: DataFrame, array: str, *, row: str, variance: float = 0.1, correlation: float = 0.95) -> list[int]:
    """Numbers of the features that survive both filters, fitted on these rows only (at most the width of a row)."""
    table = settle(variance_table(long_array(df, row, array), variance).where("kept").select("feature"))
    survivors = sorted(r["feature"] for r in table.collect())
    edges = correlated_features(df, array, survivors, correlation)
    if edges.isEmpty():
        return survivors
    return sorted(r["feature"] for r in greedy_keep(table, edges).collect())


def take_features(df: DataFrame, array: str, features: Sequence[int], out: str = "features", width: int | None = None) -> DataFrame:
    """Apply a fitted selection; a row of another width is an error when the plan runs."""
    values = F.transform(F.array(*[F.lit(int(i)) for i in features]), lambda i: F.get(F.col(array).cast("array<double>"), i))
    if width is not None:
        values = F.when(F.size(array) == width, values).otherwise(F.raise_error(F.lit(f"fitted on {width} features")).cast("array<double>"))
    return df.withColumn(out, array_to_vector(values))


def impute_scale_fit(long: DataFrame) -> DataFrame:
    """Median, mean and deviation per feature; deviations follow imputation.

    A feature without any finite value is filled with zero and has no spread.
    """
    clean = long.withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    middle = quantiles(clean, ["feature"], "v", {"median": 0.5})
    sums = clean.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    joined = sums.join(middle, "feature", "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    gaps = F.col("n") - F.col("known")
    s = F.coalesce("s", F.lit(0.0)) + gaps * F.col("median")
    q = F.coalesce("q", F.lit(0.0)) + gaps * F.col("median") * F.col("median")
    mean = s / F.col("n")
    return joined.select("feature", "median", mean.alias("mean"), F.sqrt(F.greatest(q / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"), gaps.alias("missing"))


def impute_scale_apply(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """z-scores with a fitted table (one row per feature)."""
    filled = F.when(usable(F.col("v")), F.col("v")).otherwise(F.col("median"))
    z = (filled - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return long.join(fitted.select("feature", "median", "mean", "sd"), "feature").withColumn("z", z).drop("median", "mean", "sd")


def screen_field_columns(
    long: DataFrame, *, block: str, keep_fraction: float = 0.3, minimum_sd: float | None = None, max_features: int = 2000, blocks: int = 1, fill_mean: bool = False, scaling: str = "raw"
) -> DataFrame:
    """Per (block, feature): missing counts, deviation, rank, retained flag and scale.

    Columns are ranked by sample deviation within their block, each block with an
    equal share of the budget.  Infinite values are an error.  ``fill_mean`` uses
    the column mean for missing values; otherwise a column with any is undefined.
    """
    v = F.col("v")
    checked = F.when(F.abs(v) == F.lit(float("inf")), F.raise_error(F.lit("infinite field values are numerical errors")).cast("double")).when(F.isnan(v), F.lit(None)).otherwise(v)
    rows = long.withColumn("v", checked)
    per = rows.groupBy(block, "feature").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    defined = (F.col("known") > 0) if fill_mean else (F.col("known") == F.col("n"))
    # mean-filled cells add nothing to the sum of squares but count in the degrees of freedom
    sd = F.when(defined, F.sqrt(ratio(F.coalesce("var", F.lit(0.0)) * (F.col("known") - 1), F.col("n") - 1)))
    per = per.withColumn("sd", F.coalesce(sd, F.lit(0.0))).withColumn("eligible", defined & (F.col("sd") > 1e-12))
    in_block = Window.partitionBy(block, "eligible").orderBy(F.desc("sd"), "feature")
    sized = per.withColumn("place", F.row_number().over(in_block)).withColumn("pool", F.count(F.lit(1)).over(Window.partitionBy(block, "eligible")))
    budget = max(1, max_features // max(1, blocks))
    if minimum_sd is not None:
        keep = F.col("sd") >= minimum_sd
    else:
        keep = F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("pool") * keep_fraction))
    retained = F.col("eligible") & keep & (F.col("place") <= budget)
    out = sized.withColumn("retained", retained)
    scale = F.lit(1.0)
    if scaling == "column_std":
        scale = F.when(retained, F.col("sd")).otherwise(F.lit(1.0))
    return out.select(block, "feature", (F.col("n") - F.col("known")).alias("missing"), "mean", "sd", "retained", scale.alias("scale"))


def missing_counts(long: DataFrame, fitted: DataFrame, row: str, block: str) -> DataFrame:
    """Missing retained values per row."""
    kept = long.join(fitted.where("retained").select(block, "feature"), [block, "feature"], "left_semi")
    return kept.groupBy(row).agg(F.count_if(F.col("v").isNull() | F.isnan("v")).alias("missing_retained"))


def empty_blocks(fitted: DataFrame, block: str) -> DataFrame:
    """One line naming the blocks of which the screen kept nothing (few blocks)."""
    per = fitted.groupBy(block).agg(F.count_if("retained").alias("kept"))
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("kept") == 0, F.col(block).cast("string")))), ", ")
    return per.agg(F.when(F.length(names) > 0, F.concat(F.lit("Filtering retained no columns for: "), names)).otherwise("").alias("warning"))


def contribution_shares(long: DataFrame, *, block: str, coefficient: str, sd: str, percentile: float = 80.0) -> DataFrame:
    """Per block: share of |coefficient * sd|, retained columns and signed levels."""
    rows = long.withColumn("_v", F.col(coefficient) * F.col(sd))
    total = rows.agg(F.sum(F.abs("_v")).alias("total"))
    per = rows.groupBy(block).agg(F.sum(F.abs("_v")).alias("weight"), F.count_if(F.col(coefficient) != 0).alias("retained_columns"))
    up = quantiles(rows.where(F.col("_v") > 0), [block], "_v", {"positive_level": percentile / 100})
    down = quantiles(rows.where(F.col("_v") < 0).withColumn("_v", -F.col("_v")), [block], "_v", {"_n": percentile / 100})
    joined = per.join(up, block, "left").join(down, block, "left").join(F.broadcast(total))
    share = F.coalesce(100 * ratio(F.col("weight"), F.col("total")), F.lit(0.0))
    return joined.select(block, share.alias("percent"), "retained_columns", "positive_level", (-F.col("_n")).alias("negative_level"), (share >= 95).alias("dominant"))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as z-scores with the population deviation, as one vector column."""
    stats = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    joined = df.join(F.broadcast(stats))
    z = [((F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))).alias(f"_z{i}") for i, c in enumerate(columns)]
    joined = joined.select("*", *z)
    out = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(columns))], outputCol="_x").transform(joined)
    return out.drop(*[f"_{k}{i}" for k in "msz" for i in range(len(columns))])


def components(df: DataFrame, columns: Sequence[str], k: int = 3) -> tuple[DataFrame, list[list[float]], list[float]]:
    """Scores, loadings (components x columns) and explained shares.

    The largest loading of each component is made positive.
    """
    k = min(k, len(columns))
    prepared = standardised(df, columns)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(prepared)
    loadings = model.pc.toArray().T
    signs = [1.0 if row[abs(row).argmax()] >= 0 else -1.0 for row in loadings]
    scores = model.transform(prepared).withColumn("_a", vector_to_array("_pc"))
    scores = scores.select(*[c for c in df.columns], *[(F.col("_a")[i] * F.lit(signs[i])).alias(f"PC{i + 1}") for i in range(k)])
    return scores, [[float(x) * s for x in row] for row, s in zip(loadings, signs)], [float(x) for x in model.explainedVariance.toArray()]


def bounding_box_domain(train: DataFrame, query: DataFrame, array: str, k: int = 2) -> DataFrame:
    """Components fitted on the training rows; a query is inside their box of scores."""
    vec = lambda d: d.withColumn("_x", array_to_vector(F.col(array).cast("array<double>")))
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vec(train))
    scored = lambda d: model.transform(vec(d)).withColumn("_a", vector_to_array("_pc"))
    box = scored(train).agg(*[(F.min(F.col("_a")[i]) - 1e-9).alias(f"lo{i}") for i in range(k)], *[(F.max(F.col("_a")[i]) + 1e-9).alias(f"hi{i}") for i in range(k)])
    inside = F.lit(True)
    for i in range(k):
        inside = inside & F.col("_a")[i].between(F.col(f"lo{i}"), F.col(f"hi{i}"))
    return scored(query).join(F.broadcast(box)).withColumn("in_domain", inside).drop("_x", "_pc", "_a", *[f"{s}{i}" for s in ("lo", "hi") for i in range(k)])


# -- grids and fields ---------------------------------------------------------


def grid_spec(points: DataFrame, coords: Sequence[str] = ("x", "y", "z"), *, spacing: float = 2.0, margin: float = 4.0, phase: Sequence[float] = (0.0, 0.0, 0.0), rounded: bool = False, max_points: int = 12000) -> DataFrame:
    """One row: grid origin and shape around all points, within a checked size."""
    aggs = []
    for c in coords:
        snapped = F.rint(F.col(c) / spacing) * spacing if rounded else F.col(c)
        aggs += [F.min(snapped).alias(f"{c}_lo"), F.max(snapped).alias(f"{c}_hi")]
    one = points.agg(*aggs)
    out = []
    for c, p in zip(coords, phase):
        offset = p * spacing
        if rounded:
            low, high = F.col(f"{c}_lo") - margin, F.col(f"{c}_hi") + margin
            n = F.ceil((high - low) / spacing)
        else:
            low = F.floor((F.col(f"{c}_lo") - margin - offset) / spacing) * spacing + offset
            high = F.ceil((F.col(f"{c}_hi") + margin - offset) / spacing) * spacing + offset
            n = F.rint((high - low) / spacing).cast("long") + 1
        out += [low.alias(f"{c}0"), n.cast("int").alias(f"n{c}")]
    spec = one.select(*out, F.lit(float(spacing)).alias("spacing"))
    size = F.col(f"n{coords[0]}") * F.col(f"n{coords[1]}") * F.col(f"n{coords[2]}")
    return spec.withColumn("points", F.when(size <= max_points, size).otherwise(F.raise_error(F.lit("the grid has too many points")).cast("int")))


def padded_box(points: DataFrame, coords: Sequence[str] = ("x", "y", "z"), padding: float = 8.0) -> DataFrame:
    """Centre and size of the box around all points; at least 6 per side."""
    out = []
    for c in coords:
        out += [((F.min(c) + F.max(c)) / 2).alias(f"center_{c}"), F.greatest(F.max(c) - F.min(c) + padding, F.lit(6.0)).alias(f"size_{c}")]
    one = points.agg(*out)
    return one.withColumn("fits", F.greatest(*[F.col(f"size_{c}") for c in coords]) <= 25)


def _on_grid(atoms: DataFrame, grid: DataFrame) -> DataFrame:
    """Every atom beside every grid point; the grid is one row of checked size.

    No join with a table of points: an atom expands into the points in place, and
    sums over atoms combine in the same task before they move.
    """
    point = F.explode(F.sequence(F.lit(0), F.col("points") - 1)).alias("point")
    rows = atoms.join(F.broadcast(grid)).select("*", point)
    iz = F.pmod(F.col("point"), F.col("nz"))
    iy = F.pmod(F.floor(F.col("point") / F.col("nz")), F.col("ny"))
    ix = F.floor(F.col("point") / (F.col("nz") * F.col("ny")))
    d2 = sum(((F.col(c) - (F.col(f"{c}0") + F.col("spacing") * i)) ** 2 for c, i in (("x", ix), ("y", iy), ("z", iz))), F.lit(0.0))
    return rows.withColumn("d2", d2)


def gaussian_field(atoms: DataFrame, grid: DataFrame, weights: Sequence[str], *, alpha: float = 0.3) -> DataFrame:
    """Sum over atoms of weight * exp(-alpha d²), per entity and grid point.

    ``atoms`` has (entity, x, y, z) and the weight columns; ``grid`` is one row.
    """
    kernel = F.exp(-F.lit(alpha) * F.col("d2"))
    return _on_grid(atoms, grid).groupBy("entity", "point").agg(*[F.sum(F.col(w) * kernel).alias(w) for w in weights])


# Fixed value: electrostatic constant in kcal/mol * angstrom / e^2.
COULOMB = 332.0636


def probe_field(atoms: DataFrame, grid: DataFrame, *, probe_radius: float = 1.70, minimum_distance: float = 0.3, dielectric: float = 1.0, distance_dielectric: bool = False, steric_cutoff: float = 30.0, electrostatic_cutoff: float | None = None, coulomb: float = COULOMB) -> DataFrame:
    """12-6 and Coulomb energies per entity and grid point, with caps.

    Radius, epsilon and charge are columns of the atoms.  The electrostatic
    value is undefined where the steric one reaches its cutoff.
    """
    rows = _on_grid(atoms, grid).withColumn("_d", F.sqrt(F.greatest(F.col("d2"), F.lit(minimum_distance**2))))
    ratio6 = F.pow((F.col("radius") + probe_radius) / F.col("_d"), F.lit(6.0))
    denominator = F.col("_d") * F.col("_d") if distance_dielectric else F.col("_d")
    sums = rows.groupBy("entity", "point").agg(F.sum(F.col("epsilon") * (ratio6 * ratio6 - 2 * ratio6)).alias("s"), (F.lit(coulomb / dielectric) * F.sum(F.col("charge") / denominator)).alias("e"))
    e = F.col("e")
    if electrostatic_cutoff is not None:
        e = F.greatest(F.least(e, F.lit(electrostatic_cutoff)), F.lit(-electrostatic_cutoff))
    return sums.select("entity", "point", F.least("s", F.lit(steric_cutoff)).alias("steric"), F.when(F.col("s") < steric_cutoff, e).alias("electrostatic"))


def perturb_poses(atoms: DataFrame, *, seed: int, translation: float = 0.25, degrees: float = 5.0, fixed: Column | None = None) -> DataFrame:
    """A small rigid turn and shift of each entity, drawn from its id by hash.

    The turn is about the entity's centre.  Entities for which ``fixed`` holds
    stay where they are.
    """
    if not (0 <= translation <= 2 and 0 <= degrees <= 30):
        raise ValueError("perturbations need 0-2 length units and 0-30 degrees")
    entity = F.col("entity")

    def unit(tag: str) -> list[Column]:
        # a uniform direction from two draws
        z = 2 * hash_unit(seed, entity, f"{tag}z") - 1
        angle = 2 * math.pi * hash_unit(seed, entity, f"{tag}a")
        r = F.sqrt(1 - z * z)
        return [r * F.cos(angle), r * F.sin(angle), z]

    centre = atoms.groupBy("entity").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    axis, shift = unit("axis"), unit("shift")
    centre = centre.select("*", *[a.alias(f"u{c}") for a, c in zip(axis, "xyz")], *[(translation * s).alias(f"t{c}") for s, c in zip(shift, "xyz")])
    rows = atoms.join(centre, "entity")
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    p = {c: F.col(c) - F.col(f"c{c}") for c in "xyz"}
    u = {c: F.col(f"u{c}") for c in "xyz"}
    dot = p["x"] * u["x"] + p["y"] * u["y"] + p["z"] * u["z"]
    cross = {"x": u["y"] * p["z"] - u["z"] * p["y"], "y": u["z"] * p["x"] - u["x"] * p["z"], "z": u["x"] * p["y"] - u["y"] * p["x"]}
    stay = F.lit(False) if fixed is None else fixed
    moved = {c: F.when(stay, F.col(c)).otherwise(p[c] * cos + cross[c] * sin + u[c] * dot * (1 - cos) + F.col(f"c{c}") + F.col(f"t{c}")) for c in "xyz"}
    others = [c for c in atoms.columns if c not in ("x", "y", "z")]
    return rows.select(*others, *[moved[c].alias(c) for c in "xyz"])


def common_shift(atoms: DataFrame, step: float = 2.0) -> DataFrame:
    """The numerical control: one shift for everything."""
    return atoms.withColumns({c: F.col(c) + F.lit(step * k) for c, k in (("x", 2.0), ("y", 3.0), ("z", -1.0))})
