"""Groups of identical sets compute their sets once."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import similarity


def counted(spark, df, column):
    """``df`` and an accumulator of how often ``column`` was computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf(df.schema[column].dataType)
    def look(x):
        seen.add(1)
        return x

    return df.withColumn(column, look.asNondeterministic()(column)), seen


def test_identical_groups_read_the_sets_once(spark):
    rows = [(i, ["a", "b"] if i % 3 else ["c", f"d{i}"], float(i)) for i in range(30)]
    df, seen = counted(spark, spark.createDataFrame(rows, "id long, tokens array<string>, v double"), "tokens")
    (got,) = similarity.identical_groups(df, identifier="id", tokens="tokens", value="v", a=2.0).collect()
    ids = [i for i in range(30) if i % 3]
    far = sum(abs(i - j) > 2 for i in ids for j in ids if i < j)
    assert (got.first_id, got.members, got.pairs, got.far_pairs) == ("1", 20, 190, far)
    assert seen.value == 30
