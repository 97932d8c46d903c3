"""Cells of one or two records are settled by their least and greatest record; the others by exact medians."""

from __future__ import annotations

from collections import defaultdict
from statistics import median

from measurelens.functions import variants
from measurelens.operators import pairs as pr

KIND = "id string, assay string, endpoint string, variant string, v double, record string, relation string"
ROWS = [
    ("e1", "N1", "E", "V", 1.0, "r1", "="),
    ("e2", "N1", "E", "V", 1.0, "r3", "="),
    ("e2", "N1", "E", "V", 2.5, "r2", "="),
    ("e3", "N1", "E", "V", 4.0, "r4", "="),  # a copy of one record counts once
    ("e3", "N1", "E", "V", 4.0, "r4", "="),
    ("e4", "N1", "E", "V", 1.0, "r5", "="),  # one record with two values
    ("e4", "N1", "E", "V", 3.0, "r5", "="),
    ("e5", "N1", "E", "V", 1.0, None, "="),
    ("e5", "N1", "E", "V", 2.0, "r6", "="),
    ("e6", "N1", "E", None, 7.0, None, "="),
    ("e7", "N1", "E", " q61l ", 1.0, "r7", "="),
    ("e7", "N1", "E", "Q61L", 3.0, "r8", "="),
    ("e8", "N1", "E", "V", 1.0, "r9", "="),
    ("e8", "N1", "E", "V", 1.0, "r9", "="),
    ("e8", "N1", "E", "V", 5.0, "r10", "="),
    ("e8", "N1", "E", "V", 6.0, "r11", "="),
    ("e9", "N1", "E", "V", 6.0, "r12", ">"),
    ("e9", "N1", "E", "V", float("nan"), "r13", "="),
    (None, "N1", "E", "V", 6.0, "r14", "="),
]


def measured(spark):
    df = spark.createDataFrame(ROWS, KIND)
    return pr.measured_medians(df, entity="id", assay="assay", endpoint="endpoint", variant="variant", value="v", record="record", relation="relation")


def test_medians_and_records_of_every_cell(spark):
    cells = defaultdict(set)
    for n, (i, _, _, variant, v, record, relation) in enumerate(ROWS):
        if i and relation == "=" and v == v:
            cells[i, {None: "Unreported", " q61l ": "Q61L"}.get(variant, variant)].add((v, record, None if record else n))
    want = {k: (median(v for v, *_ in c), ";".join(sorted({r for _, r, _ in c if r}))) for k, c in cells.items()}
    assert {(r.entity, r.variant): (r.value, r.records) for r in measured(spark).collect()} == want


def test_only_cells_of_more_records_are_sorted(spark, monkeypatch):
    """every cell went through a sorted percentile, also one of a single record."""
    seen, quantiles = [], pr.quantiles
    monkeypatch.setattr(pr, "quantiles", lambda df, *rest: seen.append(df.count()) or quantiles(df, *rest))
    measured(spark).count()
    assert seen == [3]


def test_scope_of_texts_with_and_without_digits(spark):
    texts = ["V600E", "p.Val600Glu", " wild type ", "", None, "mutant 5", "q61l, v600e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(variants.scope("t").alias("s")).collect()] == ["V600E", "V600E", "wild type", "Unreported", "Unreported", "mutant 5", "Q61L;V600E"]
