"""Readers with explicit schemas, guarded writers and content fingerprints."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.functions.scalar import finite_number, log_molar
from measurelens.operators.common import row_fingerprint, settle

ACTIVITY_SCHEMA = T.StructType(
    [
        T.StructField("activity_id", T.LongType()),
        T.StructField("molecule_chembl_id", T.StringType()),
        T.StructField("parent_molecule_chembl_id", T.StringType()),
        T.StructField("canonical_smiles", T.StringType()),
        T.StructField("standard_type", T.StringType()),
        T.StructField("standard_relation", T.StringType()),
        T.StructField("standard_value", T.StringType()),
        T.StructField("standard_units", T.StringType()),
        T.StructField("pchembl_value", T.StringType()),
        T.StructField("assay_type", T.StringType()),
        T.StructField("assay_chembl_id", T.StringType()),
        T.StructField("document_chembl_id", T.StringType()),
        T.StructField("assay_variant_mutation", T.StringType()),
        T.StructField("assay_variant_accession", T.StringType()),
        T.StructField("potential_duplicate", T.IntegerType()),
        T.StructField("data_validity_comment", T.StringType()),
        T.StructField("bao_label", T.StringType()),
        T.StructField("document_year", T.IntegerType()),
        T.StructField("src_id", T.IntegerType()),
        T.StructField("confidence_score", T.StringType()),
    ]
)


def measurements_from(rows: DataFrame, *, identifier: str, structure: str, value: str, record: Column, unit: str = "p", year: str | None = None) -> DataFrame:
    """Typed measurements from text columns; incomplete rows drop, bad numbers fail."""
    missing = [c for c in (identifier, structure, value) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    rows = rows.dropna(subset=[identifier, structure, value])
    number = finite_number(F.trim(F.col(value).cast("string")))
    number = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), F.col(value).cast("string"))).cast("double"))
    return rows.select(
        F.trim(F.col(identifier).cast("string")).alias("molecule_id"),
        F.trim(F.col(structure).cast("string")).alias("smiles"),
        (number if unit == "p" else log_molar(number, F.lit(unit))).alias("pactivity"),
        record.alias("record_id"),
        *([F.col(year).cast("string").try_cast("double").cast("int").alias("document_year")] if year else []),
    )


# Most splits whose offsets are broadcast (a path and two numbers each); beyond it the lines are shuffled.
MANY_SPLITS = 100_000


def _splits_before(splits: DataFrame, what: str, many: bool) -> DataFrame:
    """Sum of ``what`` over the splits of a file before each one (a file has few splits)."""
    order = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    out = splits.select("_file", "_block", "first", F.coalesce(F.sum(what).over(order), F.lit(0)).alias("before"))
    return out if many else F.broadcast(out)


def numbered_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file_name, record, text columns) of delimited files, with consecutive record numbers per file.

    The header is record 1 and blank lines do not count, so without quoted line breaks
    or blank lines the number is that of the line.  Files are read in splits: what comes
    before a split follows from counts per split and a running total over the splits.
    A line lies inside quotes if an odd number of quotes comes before it in the file, so
    records with line breaks are found in the same way, wherever the splits are cut.  A
    quote that never closes is an error, as are files with different headers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blank = F.trim(F.regexp_replace("value", r"[\r\x0b\x0c]" if sep == "\t" else r"[\t\r\x0b\x0c]", "")) == ""
    lines = lines.withColumns({"_odd": F.pmod(quotes, F.lit(2)), "_blank": blank})
    splits = settle(lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("lines"), F.sum("_odd").alias("odd"), F.count_if("_blank").alias("blanks"), F.min("_m").alias("first")))
    total = splits.groupBy("_file").agg(F.sum("odd").alias("odd")).agg(F.sum("odd").alias("odd"), F.max(F.pmod("odd", F.lit(2))).alias("open")).head()
    if total.open:
        raise ValueError("a quoted field never ends")
    at, many = ["_file", "_block"], splits.count() > MANY_SPLITS
    if not total.odd and splits.where("blanks > 0").isEmpty():
        # rows of a split are numbered one after another
        placed = lines.join(_splits_before(splits, "lines", many), at)
        records = placed.select("_file", "file_name", (F.col("before") + F.col("_m") - F.col("first") + 1).alias("record"), F.col("value").alias("text"))
    else:
        upto = Window.partitionBy(*at).orderBy("_m")
        opened = lines.join(_splits_before(splits, "odd", many), at)
        inside = F.pmod(F.col("before") + F.sum("_odd").over(upto) - F.col("_odd"), F.lit(2)) == 1
        opened = opened.withColumn("_in", inside).drop("before", "first")
        opened = settle(opened.withColumn("_start", (~F.col("_in") & ~F.col("_blank")).cast("long")))
        starts = _splits_before(opened.groupBy(*at).agg(F.sum("_start").alias("starts"), F.min("_m").alias("first")), "starts", many)
        placed = opened.join(starts, at).withColumn("record", F.col("before") + F.sum("_start").over(upto)).where(F.col("_in") | ~F.col("_blank"))
        whole = ~F.col("_in") & (F.col("_odd") == 0)
        keys = ["_file", "file_name", "record"]
        # only the lines of records with line breaks are brought together
        parts = placed.where(~whole).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_m", "value"))).alias("p"))
        joined = parts.select(*keys, F.array_join(F.transform("p", lambda p: p["value"]), "\n").alias("text"))
        records = placed.where(whole).select(*keys, F.col("value").alias("text")).unionByName(joined)
    heads = [r.text for r in records.where("record = 1").select("text").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("the files have different headers")
    if not heads:
        return spark.createDataFrame([], "file_name string, record long")
    names = next(csv.reader([heads[0]], delimiter=sep))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"'})
    rows = records.where("record > 1").select("file_name", "record", parsed.alias("r"))
    return rows.select("file_name", "record", *[F.nullif(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_measurement_table(spark: SparkSession, path: str, *, identifier: str = "molecule_id", structure: str = "smiles", value: str = "pactivity", unit: str = "p", year: str | None = None, record: str | None = None) -> DataFrame:
    """Read delimited files: tabs for .tsv and .tab, else commas; ids stay text.

    The record id is a given column, or the file name and the number of the record.
    """
    rows = numbered_records(spark, path, "\t" if path.endswith((".tsv", ".tab")) else ",")
    source = F.col(record).cast("string") if record else F.concat_ws(":", "file_name", F.col("record").cast("string"))
    return measurements_from(rows, identifier=identifier, structure=structure, value=value, record=source, unit=unit, year=year)


def read_activity_records(spark: SparkSession, path: str, *, expected: int | None = None, multiline: bool = False) -> DataFrame:
    """Read whole JSON records with the fixed schema, checking the total if known."""
    rows = spark.read.schema(ACTIVITY_SCHEMA).option("multiLine", multiline).json(path)
    if expected is not None:
        found = rows.count()
        if found != expected:
            raise ValueError(f"expected {expected} records, found {found}")
    return rows


def read_prediction_input(spark: SparkSession, path: str, *, identifier: str = "molecule_id", structure: str = "smiles") -> DataFrame:
    sep = "\t" if path.endswith((".tsv", ".tab")) else ","
    rows = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    return prediction_input(rows, identifier=identifier, structure=structure)


def prediction_input(rows: DataFrame, *, identifier: str, structure: str) -> DataFrame:
    missing = [c for c in (identifier, structure) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    rows = rows.dropna(subset=[identifier, structure])
    return rows.select(F.trim(F.col(identifier).cast("string")).alias("molecule_id"), F.trim(F.col(structure).cast("string")).alias("smiles"))


def outcome_checks(rows: DataFrame, *, assay: str, constant: Sequence[str], limit: int = 10_000) -> DataFrame:
    """Expectations on an outcome table: one assay, constant metadata, not truncated.

    A table of ``limit`` rows or more may have been cut at the source.
    """
    checks = [F.count(F.lit(1)).alias("rows"), F.count_distinct(assay).alias("assays"), F.count_if(F.col(assay).isNull()).alias("missing_assay")]
    checks += [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"distinct_{c}") for c in constant]
    return rows.agg(*checks).withColumn("possibly_truncated", F.col("rows") >= limit)


def content_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of distinct rows: their number and combined hashes.

    Each row hashes to 256 bits; the first and last 52 bits are added up, which
    does not depend on row order and combines before the shuffle.
    """
    columns = sorted(columns)
    rows = df.select(*columns).distinct().select(row_fingerprint(df, columns).alias("h"))
    part = lambda start: F.sum(F.conv(F.substring("h", start, 13), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), part(1).cast("string").alias("head"), part(52).cast("string").alias("tail"))


MARKER = "provenance.json"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def write_results(spark: SparkSession, tables: dict[str, DataFrame], folder: str, *, record: dict, kind: str = "parquet") -> None:
    """Write each table below ``folder``; only a folder written before is replaced.

    The marker file says that this library wrote the folder.  A folder with
    other content is refused.
    """
    fs, base = _filesystem(spark, folder)
    marker = spark._jvm.org.apache.hadoop.fs.Path(base, MARKER)
    if fs.exists(base) and len(fs.listStatus(base)) > 0 and not fs.exists(marker):
        raise ValueError(f"{folder} holds files that were not written here")
    for name, table in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        writer = table.write.mode("overwrite")
        writer.option("header", True).csv(target) if kind == "csv" else writer.parquet(target)
    out = fs.create(marker, True)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    finally:
        out.close()


def verify_manifest(spark: SparkSession, folder: str, manifest: dict[str, str]) -> None:
    """Compare the sha256 of each listed file before anything is loaded from it."""
    paths = [f"{folder.rstrip('/')}/{name}" for name in manifest]
    files = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha"))
    found = [(r["path"], r["sha"]) for r in files.collect()]  # one row per file of the manifest
    root = "/" + folder.rstrip("/").split("/")[-1] + "/"
    bad = sorted(n for n, sha in manifest.items() if sha not in [s for p, s in found if p.endswith(root + n)])
    if bad:
        raise ValueError(f"content differs from the manifest: {bad}")
