"""From raw documents to token ids: reject, deduplicate, clean, mask, encode.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelens.llm import bpe, decontaminate, jaccard, secrets, toxicity
from measurelens.llm.texts import learn_bucket
from measurelens.operators.common import settle


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """The rows under names that clash with no result, these names, and that of the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity score of at least 0.5; the model learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, learn_bucket(F.col("doc_id"), 5) != 0, label="toxic")
    rows, names, text = renamed(docs)
    return toxicity.score(rows, model, text=text, carry=names).where("score < 0.5").select(*names).toDF(*docs.columns)


def deduplicate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar texts: that of the smallest id, then of the smallest text; null ids come last.

    Rows are told apart by their texts, not by their ids.  Texts without words
    resemble nothing, so all of them stay.
    """
    return jaccard.keep_one(docs)


def clean_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows, names, text = renamed(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=text, carry=names)
    return found.where(F.size("hit_ranges") == 0).select(*names).toDF(*docs.columns)


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind in angle brackets and count the characters anew; all documents stay."""
    rows, names, text = renamed(docs)
    found = secrets.findings(rows, secrets.scan(rows, text=text), text=text)
    masked = found.withColumn(text, secrets.masked(F.col(text), F.col("spans")))
    if "n_chars" in docs.columns:
        count = names[docs.columns.index("n_chars")]
        masked = masked.withColumn(count, F.length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return masked.select(*names).toDF(*docs.columns)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their number."""
    ids = bpe.encode(docs, bpe.vocabulary_path(), carry=["doc_id"])
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", deduplicate),
    ("decontamination", clean_benchmark),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

# a learned score and token ids have no SQL form: tests/llm compares every stage with a plain version
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
