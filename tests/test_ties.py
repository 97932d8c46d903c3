"""Equal draws, and differences that equal a tolerance, are not left to chance."""

from __future__ import annotations

import duckdb

from measurelens.operators import compare, splits
from measurelens.plans.partitions import FOLDS

# The md5 draws of these two group names agree in all 30 bits that order groups.
SAME_DRAW = ("g32678", "g49329")


def test_groups_of_one_draw_have_places_of_their_own(spark):
    names = [*SAME_DRAW, *(f"g{i}" for i in range(40))]
    df = spark.createDataFrame([(i, g, "a") for i, g in enumerate(names)], "id long, grp string, label string")
    got = {(r.id, r.fold) for r in splits.group_folds(df, group="grp", label="label", k=5).select("id", "fold").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE gr AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{g}', 'a')" for i, g in enumerate(names)) + ") t(id, grp, label)")
    assert got == set(con.execute(f"WITH {FOLDS} SELECT id, fold FROM gr JOIN gf USING (grp)").fetchall())
    assert len(got) == len(names)


def test_a_difference_that_equals_the_tolerance_is_within_it(spark):
    """10.24 - 10.2 is a little more than 0.04 as a double, 1.24 - 1.2 is not."""
    a = spark.createDataFrame([(1, 10.24), (2, 1.24), (3, 10.25)], "k int, x double")
    b = spark.createDataFrame([(1, 10.2), (2, 1.2), (3, 10.2)], "k int, x double")
    row = compare.parity(a, b, keys=["k"], value="x", tolerance=0.04).first()
    assert (row.rows, row.beyond_tolerance, row.identical) == (3, 1, 0)
