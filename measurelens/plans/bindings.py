"""How the supplied tables play the roles of measurements, entities and panels.

Each binding exists twice: as a DataFrame and as the SQL text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- measurements: one line item is one measurement of its part ----------------


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("."), "l_returnflag").alias("molecule_id"),
        F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("smiles"),
        F.log10("l_extendedprice").alias("pactivity"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.year("l_shipdate").alias("document_year"),
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("assay_chembl_id"),
        F.concat(F.lit("D"), F.year("l_shipdate").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("document_chembl_id"),
        F.col("l_returnflag").alias("standard_type"),
        F.when(F.col("l_discount") >= 0.1, ">").otherwise("=").alias("standard_relation"),
        F.col("l_linestatus").alias("assay_variant_mutation"),
        "l_partkey",
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
    )


M = """m AS (
  SELECT 'P' || l_partkey || '.' || l_returnflag AS molecule_id, 'C' || l_partkey AS smiles,
    log10(l_extendedprice) AS pactivity, l_orderkey || ':' || l_linenumber AS record_id,
    CAST(year(l_shipdate) AS INTEGER) AS document_year, 'A' || l_suppkey AS assay_chembl_id,
    'D' || year(l_shipdate) || '-' || l_linenumber AS document_chembl_id,
    l_returnflag AS standard_type, CASE WHEN l_discount >= 0.1 THEN '>' ELSE '=' END AS standard_relation,
    l_linestatus AS assay_variant_mutation, l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity
  FROM lineitem)"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with a structure key that is missing for one brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_brand") != "Brand#7", F.concat(F.lit("K"), F.col("p_partkey").cast("string"))).alias("inchikey"))
    m = measurements(spark, sf_dir)
    return m.join(part, m.l_partkey == part.p_partkey).withColumn("key", F.coalesce("inchikey", "smiles"))


K = (
    M
    + """, k AS (
  SELECT m.*, CASE WHEN p_brand <> 'Brand#7' THEN 'K' || p_partkey END AS inchikey,
    coalesce(CASE WHEN p_brand <> 'Brand#7' THEN 'K' || p_partkey END, smiles) AS key
  FROM m JOIN part ON l_partkey = p_partkey)"""
)


# -- entities: parts with the median of their measurements ---------------------

BINS = (("potent", 4.77), ("active", 4.72), ("intermediate", 4.65))
CLASS_SQL = "CASE WHEN {v} >= 4.77 THEN 'potent' WHEN {v} >= 4.72 THEN 'active' WHEN {v} >= 4.65 THEN 'intermediate' ELSE 'inactive' END"
GROUP_SQL = "CASE WHEN {v} >= 4.72 THEN 1 ELSE 2 END"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: median log price, class, group, scaffold and skeleton."""
    from measurelens.functions.scalar import class_group, value_class
    from measurelens.operators.ordered import quantiles

    m = table(spark, sf_dir, "lineitem").select("l_partkey", F.log10("l_extendedprice").alias("v"))
    medians = quantiles(m, ["l_partkey"], "v", {"pactivity": 0.5})
    part = table(spark, sf_dir, "part")
    out = part.join(medians, part.p_partkey == medians.l_partkey).select(
        F.col("p_partkey").alias("id"),
        "pactivity",
        F.nullif(F.col("p_name"), F.lit("red widget")).alias("murcko"),
        F.when(F.col("p_name") != "red widget", F.col("p_brand")).alias("skeleton"),
        "p_brand",
        "p_type",
        "p_size",
        "p_retailprice",
    )
    return out.withColumn("activity_class", value_class("pactivity", BINS, strict=False)).withColumn("group", class_group("activity_class"))


E = f"""e AS (
  SELECT p_partkey AS id, pactivity, nullif(p_name, 'red widget') AS murcko,
    CASE WHEN p_name <> 'red widget' THEN p_brand END AS skeleton, p_brand, p_type, p_size, p_retailprice,
    {CLASS_SQL.format(v='pactivity')} AS activity_class, {GROUP_SQL.format(v='pactivity')} AS "group"
  FROM part JOIN (SELECT l_partkey, median(log10(l_extendedprice)) AS pactivity FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


# -- token sets: words of a document ------------------------------------------


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words of every document (copies count once), with a synthetic value."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    value = F.lit(4.5) + F.pmod(F.col("doc_id") * 37, F.lit(50)) / F.lit(10.0)
    return docs.select(F.col("doc_id").cast("string").alias("id"), words.alias("tokens"), value.alias("v"))


def word_pair_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring word pairs: a second definition of similarity."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    but_last = lambda skip: F.slice("w", skip, F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(but_last(1), but_last(2), lambda x, y: F.concat(x, F.lit(" "), y))
    value = F.lit(4.5) + F.pmod(F.col("doc_id") * 37, F.lit(50)) / F.lit(10.0)
    return docs.select("doc_id", words.alias("w")).select(F.col("doc_id").cast("string").alias("id"), pairs.alias("tokens"), value.alias("v"))


TOKENS = r"""doc AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, 4.5::DOUBLE + CAST((doc_id * 37) % 50 AS DOUBLE) / 10.0::DOUBLE AS v,
    list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS tokens
  FROM documents),
 tok AS (SELECT id, doc_id, v, unnest(tokens) AS t FROM doc),
 size AS (SELECT id, doc_id, any_value(v) AS v, count(*) AS n FROM tok GROUP BY 1, 2),
 common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
 sim AS (SELECT x, y, c::DOUBLE / (sa.n + sb.n - c) AS s, abs(sa.v - sb.v) AS d
   FROM common JOIN size sa ON sa.id = x JOIN size sb ON sb.id = y)"""


# -- series: orders of one customer, described by three attributes -------------


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities: the customer is the core, three attributes are positions."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("core"), F.col("o_orderkey").cast("string").alias("id"), F.log10("o_totalprice").alias("v"),
        F.col("o_orderpriority").alias("R1"), F.col("o_orderstatus").alias("R2"), F.year("o_orderdate").cast("string").alias("R3"),
    )


def series_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the orders: the supplier's region is the assay, the flag the endpoint."""
    li, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    return li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("l_orderkey").cast("string").alias("id"), F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("assay"), F.col("l_returnflag").alias("endpoint"),
        F.col("l_linestatus").alias("variant"), F.log10("l_extendedprice").alias("v"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("record"),
        F.when(F.col("l_discount") >= 0.1, ">").otherwise("=").alias("relation"), F.concat(F.lit("Y"), F.year("l_shipdate").cast("string")).alias("document"),
    )


SERIES = """ser AS (
  SELECT o_custkey AS core, CAST(o_orderkey AS VARCHAR) AS id, log10(o_totalprice) AS v, o_orderpriority AS R1, o_orderstatus AS R2,
    CAST(year(o_orderdate) AS VARCHAR) AS R3 FROM orders),
 pos AS (
  SELECT core, id, v, 'R1' AS position, R1 AS fragment, '{"R2":"' || R2 || '","R3":"' || R3 || '"}' AS context FROM ser UNION ALL
  SELECT core, id, v, 'R2', R2, '{"R1":"' || R1 || '","R3":"' || R3 || '"}' FROM ser UNION ALL
  SELECT core, id, v, 'R3', R3, '{"R1":"' || R1 || '","R2":"' || R2 || '"}' FROM ser),
 pp AS MATERIALIZED (
  SELECT a.core, a.position, a.context, a.id AS id_from, b.id AS id_to, a.fragment AS fragment_from, b.fragment AS fragment_to, a.v AS pooled_from, b.v AS pooled_to
  FROM pos a JOIN pos b ON a.core = b.core AND a.position = b.position AND a.context = b.context AND a.fragment < b.fragment)"""

MEASURED = """ev AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, 'N' || n_regionkey AS assay, l_returnflag AS endpoint, l_linestatus AS variant, log10(l_extendedprice) AS v,
    l_orderkey || ':' || l_linenumber AS record, CASE WHEN l_discount >= 0.1 THEN '>' ELSE '=' END AS relation, 'Y' || year(l_shipdate) AS document
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
 me AS MATERIALIZED (
  SELECT id AS entity, assay, endpoint, variant, median(v) AS value, string_agg(DISTINCT record, ';' ORDER BY record) AS records
  FROM (SELECT DISTINCT id, assay, endpoint, variant, v, record FROM ev WHERE relation = '=') GROUP BY ALL)"""

RESOLVED = """sha AS MATERIALIZED (SELECT pp.*, assay, endpoint, variant, value AS value_from, records AS records_from FROM pp JOIN me ON entity = id_from),
 sh AS MATERIALIZED (
  SELECT sha.*, b.value AS value_to, b.records AS records_to
  FROM sha JOIN me b ON b.entity = id_to AND sha.assay = b.assay AND sha.endpoint = b.endpoint AND sha.variant = b.variant),
 rp AS MATERIALIZED (
  SELECT core, position, context, fragment_from, fragment_to, id_from, id_to, assay, endpoint, variant, 'shared assay' AS evidence_tier, value_from, value_to,
    records_from, records_to, value_to - value_from AS delta FROM sh
  UNION ALL
  SELECT core, position, context, fragment_from, fragment_to, id_from, id_to, '', '', '', 'pooled / unmatched', pooled_from, pooled_to, '', '', pooled_to - pooled_from
  FROM pp WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.id_from = pp.id_from AND sh.id_to = pp.id_to)),
 gp AS (SELECT rp.* REPLACE (core || ' ' || context AS context) FROM rp)"""


# -- predictions: a price guess per order --------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a measured value and a prediction from their lines.

    ``block`` is the customer, missing for one segment.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.avg("l_quantity").alias("qty"))
    rows = o.join(li, o.o_orderkey == li.l_orderkey).join(c, o.o_custkey == c.c_custkey)
    base = F.lit(5.2)
    return rows.select(
        F.col("o_orderkey").alias("id"), F.log10("o_totalprice").alias("truth"), (F.lit(5.0) + F.col("qty") / 125.0 + F.col("lines") / 100.0).alias("prediction"), base.alias("baseline"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("o_custkey").cast("string")).alias("block"), "c_mktsegment", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority",
    )


P = """p AS (
  SELECT o_orderkey AS id, log10(o_totalprice) AS truth, 5.0::DOUBLE + qty / 125.0::DOUBLE + lines / 100.0::DOUBLE AS prediction, 5.2::DOUBLE AS baseline,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(o_custkey AS VARCHAR) END AS block, c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, o_orderpriority
  FROM orders JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS lines, avg(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    JOIN customer ON c_custkey = o_custkey)"""
