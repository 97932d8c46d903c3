"""Ranked, diverse selections from a table of predictions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.functions import scalar
from measurelens.operators.common import first_k

# Fixed value: how many of the best structures enter the greedy selection.
POOL = 150


def batch_status(source: DataFrame, predictions: DataFrame, *, key: str) -> DataFrame:
    """Every input row with its prediction or the reason for having none."""
    joined = source.join(predictions, key, "left")
    value = scalar.finite_number("prediction")
    status = F.when(F.col("structure").isNull() | (F.length("structure") == 0), "invalid structure").when(value.isNull(), "not predicted").otherwise("predicted")
    return joined.withColumn("status", status)


def enrich_predictions(predictions: DataFrame, neighbours: DataFrame, reference: DataFrame, *, key: str, threshold: Column | float, half_width: float | None = None) -> DataFrame:
    """Nearest training entity, domain flag, repeat flag and the empirical band."""
    near = neighbours.select(F.col("id").alias(key), F.col("similarity").alias("max_training_similarity"), "nearest_id")
    known = reference.select(F.col("id").alias("nearest_id"), F.col("structure").alias("nearest_structure"), F.col("value").alias("nearest_value"))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    out = predictions.join(near, key, "left").join(known, "nearest_id", "left")
    out = out.withColumn("in_domain", F.coalesce(F.col("max_training_similarity") >= limit, F.lit(False)))
    out = out.withColumn("already_measured", F.coalesce(F.col("structure") == F.col("nearest_structure"), F.lit(False)))
    if half_width is not None:
        out = out.withColumn("empirical_lower", F.col("prediction") - half_width).withColumn("empirical_upper", F.col("prediction") + half_width)
    return out


def _greedy(frame: pd.DataFrame, n: int, weight: float) -> pd.DataFrame:
    """At most POOL rows: repeatedly take the best score minus similarity to the chosen."""
    frame = frame.sort_values(["_place"]).reset_index(drop=True)
    sets = [frozenset(t) for t in frame["tokens"]]
    best_sim = [0.0] * len(frame)
    left, rows = list(range(len(frame))), []
    while left and len(rows) < n:
        score = {i: frame["prediction"][i] - weight * best_sim[i] for i in left}
        pick = max(left, key=lambda i: (score[i], -i))
        rows.append((pick, len(rows) + 1, score[pick], best_sim[pick]))
        left.remove(pick)
        for i in left:
            union = len(sets[i] | sets[pick])
            best_sim[i] = max(best_sim[i], len(sets[i] & sets[pick]) / union if union else 0.0)
    out = frame.iloc[[r[0] for r in rows]].copy()
    out["rank"] = [r[1] for r in rows]
    out["selection_score"] = [float(r[2]) for r in rows]
    out["max_shortlist_similarity"] = [float(r[3]) for r in rows]
    return out


def diverse_shortlist(predictions: DataFrame, *, group: Sequence[str] = (), structure: str, entity: str, caps: dict[str, float], n: int = 20, weight: float = 1.0, in_domain_only: bool = True) -> DataFrame:
    """A diverse choice per group among the best distinct structures.

    The pool is the best POOL structures of a group by predicted value, found by
    ranking in chunks; only a pool ever reaches one Python task.
    """
    if not 1 <= n <= 100 or weight < 0:
        raise ValueError("choose 1-100 rows and a non-negative weight")
    keys = list(group)
    ok = (F.col("status") == "predicted") & scalar.within_caps(caps)
    if in_domain_only:
        ok = ok & scalar.strict_flag("in_domain")
    best = predictions.where(ok).groupBy(*keys, structure).agg(F.min(F.struct((-F.col("prediction")).alias("neg"), F.col(entity).cast("string").alias("entity"), F.col("tokens").alias("tokens"))).alias("b"))
    flat = best.select(*keys, structure, F.col("b.entity").alias("entity"), (-F.col("b.neg")).alias("prediction"), F.col("b.tokens").alias("tokens"))
    pool = first_k(flat, keys, [F.desc("prediction"), "entity"], POOL, ["entity"])
    if not keys:
        pool = pool.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, structure, "entity", "prediction"])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        return _greedy(frame, n, weight)[[*by, structure, "entity", "prediction", "rank", "selection_score", "max_shortlist_similarity"]]

    out = pool.groupBy(*by).applyInPandas(choose, f"{fields}, rank int, selection_score double, max_shortlist_similarity double")
    return out if keys else out.drop("_all")


def qualification(candidates: DataFrame, *, model_ok: Column, parent_ok: Column) -> DataFrame:
    """Why a candidate's score is shown or withheld, first reason first."""
    status = (
        F.when(~F.coalesce(model_ok, F.lit(False)), "withheld: model failed qualification checks")
        .when(~F.coalesce(parent_ok, F.lit(False)), "withheld: parent state changed, ambiguous stereo or outside model domain")
        .when(F.coalesce(F.col("structure_changed"), F.lit(True)), "withheld: standardisation changed the proposed structure")
        .when(F.coalesce(F.col("unresolved_stereo"), F.lit(True)), "withheld: unresolved stereochemistry")
        .when(~scalar.strict_flag("in_domain"), "withheld: outside applicability domain")
        .when(scalar.finite_number("prediction").isNull(), "withheld: non-finite model prediction")
        .otherwise("scored: hypothesis, not a confirmed improvement")
    )
    return candidates.withColumn("prediction_status", status)
