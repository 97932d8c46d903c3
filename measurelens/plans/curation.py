"""Curation, evidence and origin queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from measurelens.functions import scalar, variants
from measurelens.operators import curate, evidence
from measurelens.operators.common import shared_folder
from measurelens.plans import bindings as b
from measurelens.plans.bindings import CLASS_SQL, E, GROUP_SQL, K, M
from measurelens.plans.registry import query, rounded
from measurelens.sources import tables as sources

RULES = curate.CurationRules(
    standard_types=("A", "R"),
    relations=("=",),
    units=("nM", "uM", "µM"),
    assay_types=("O", "F"),
    source_ids=None,
    variant="any",
    formats=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"),
    assay_ids=None,
    min_confidence=2,
    max_year=2000,
    bins=b.BINS,
)


def raw_records(spark, sf_dir):
    """Raw activity records with text numbers, nulls and bad values."""
    li, o, s = (b.table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    tax = F.col("l_tax")
    return rows.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("activity_id"),
        F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("molecule_chembl_id"),
        F.when(tax == 0.01, F.lit("")).when(tax == 0.02, F.concat(F.lit("Q"), F.col("l_partkey").cast("string"))).alias("parent_molecule_chembl_id"),
        F.when(F.col("l_quantity") == 50, F.lit("")).otherwise(F.concat(F.lit("C"), F.col("l_partkey").cast("string"))).alias("canonical_smiles"),
        F.col("l_returnflag").alias("standard_type"),
        F.when(F.col("l_discount") == 0.1, F.lit(">")).when(F.col("l_discount") > 0, F.lit("=")).alias("standard_relation"),
        F.when(F.col("l_quantity") == 1, F.lit("n/a")).when(F.col("l_quantity") == 2, F.lit("-5")).when(F.col("l_quantity") == 3, F.lit("NaN")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("standard_value"),
        F.when(tax == 0.08, F.lit("mg")).when(tax == 0.07, F.lit("uM")).when(tax == 0.06, F.lit("µM")).otherwise("nM").alias("standard_units"),
        F.col("o_orderstatus").alias("assay_type"),
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("assay_chembl_id"),
        F.col("l_linestatus").alias("assay_variant_mutation"),
        F.when(tax == 0.05, F.lit(1)).when(tax == 0.04, F.lit(0)).alias("potential_duplicate"),
        F.when(F.col("l_quantity") == 49, F.lit("Outside typical range")).when(F.col("l_quantity") == 48, F.lit("")).alias("data_validity_comment"),
        F.col("o_orderpriority").alias("bao_label"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.year("l_shipdate")).alias("document_year"),
        F.col("s_nationkey").alias("src_id"),
        F.col("l_linenumber").cast("string").alias("confidence_score"),
    )


RAW = """raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS activity_id, 'M' || l_partkey AS own,
    CASE l_tax WHEN 0.01 THEN '' WHEN 0.02 THEN 'Q' || l_partkey END AS parent,
    CASE WHEN l_quantity = 50 THEN '' ELSE 'C' || l_partkey END AS smiles, l_returnflag AS kind,
    CASE WHEN l_discount = 0.1 THEN '>' WHEN l_discount > 0 THEN '=' END AS rel,
    CASE WHEN l_quantity > 3 THEN l_quantity END AS val,
    CASE l_tax WHEN 0.08 THEN NULL WHEN 0.07 THEN 6 WHEN 0.06 THEN 6 ELSE 9 END AS off,
    o_orderstatus AS assay_type, l_tax, l_quantity, o_orderpriority AS fmt, l_linenumber AS conf,
    CASE WHEN o_orderstatus <> 'P' THEN year(l_shipdate) END AS yr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
 flag AS (SELECT *, coalesce(nullif(parent, ''), own) AS ent, [
   kind IN ('A','R'), coalesce(rel = '=', false), off IS NOT NULL, assay_type IN ('O','F'), true, true, l_tax <> 0.05, l_quantity <> 49,
   fmt IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW'), true, conf >= 2, coalesce(yr <= 2000, false), smiles <> '', val IS NOT NULL] AS ok FROM raw),
 failing AS (SELECT *, coalesce(list_position(ok, false), 15) - 1 AS f FROM flag)"""


@query(
    "P1_log_molar",
    """SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS qty,
      CASE WHEN l_linestatus = 'O' THEN 'µM' WHEN l_tax > 0.06 THEN 'mg' ELSE 'nM' END AS unit,
      round(CASE WHEN l_linestatus = 'O' THEN 6 - log10(l_quantity) WHEN l_tax > 0.06 THEN NULL ELSE 9 - log10(l_quantity) END, 6) AS pactivity FROM lineitem""",
)
def p1(spark, d):
    li = b.table(spark, d, "lineitem")
    unit = F.when(F.col("l_linestatus") == "O", "μM").when(F.col("l_tax") > 0.06, "mg").otherwise("nM")
    rows = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("qty"), unit.alias("unit"), scalar.log_molar("l_quantity", unit, strict=False).alias("pactivity"))
    return rounded(rows.withColumn("unit", F.when(F.col("unit") == "μM", "µM").otherwise(F.col("unit"))))


@query(
    "P2_number_parse",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL ELSE round(value, 6) END AS number,
      CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def p2(spark, d):
    e = b.table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", "Infinity").when(F.col("event_type") == "signup", "not measured").otherwise(F.col("value").cast("string"))
    parsed = F.from_json("props", "k long")
    return rounded(e.select("event_id", scalar.finite_number(text).alias("number"), parsed["k"].alias("k")))


@query("P3_effective_id", f"WITH {RAW} SELECT ent AS entity, count(*) AS records FROM flag GROUP BY 1")
def p3(spark, d):
    r = raw_records(spark, d)
    return r.groupBy(scalar.effective_id("parent_molecule_chembl_id", "molecule_chembl_id").alias("entity")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "P4_record_filters",
    f"WITH {RAW} SELECT ent AS molecule_id, smiles, round(off - log10(val), 6) AS pactivity, activity_id AS record_id FROM failing WHERE f = 14",
)
def p4(spark, d):
    return rounded(curate.filter_records(raw_records(spark, d), RULES).select("molecule_id", "smiles", "pactivity", "record_id"))


@query(
    "C1_curation_log",
    f"""WITH {RAW}, best AS (SELECT ent, max(f) AS f FROM failing GROUP BY 1),
     s AS (SELECT unnest(range(14)) AS step),
     r AS (SELECT step, count(*) FILTER (f >= step) AS rin, count(*) FILTER (f > step) AS rout FROM s, failing GROUP BY 1),
     i AS (SELECT step, count(*) FILTER (f > step) AS ents FROM s, best GROUP BY 1)
    SELECT CAST(step AS INTEGER) AS step, ['standard_type','relation','units','assay_type','source_origin','variant','potential_duplicate','validity','bao_format','assay_id',
      'target_confidence','document_year','structure','value'][step + 1] AS name, rin AS records_in, rout AS records_out, ents AS molecules_out, rin - rout AS removed
    FROM r JOIN i USING (step)""",
)
def c1(spark, d):
    records = raw_records(spark, d)
    entity = scalar.effective_id("parent_molecule_chembl_id", "molecule_chembl_id")
    return curate.curation_log(records, curate.record_predicates(RULES), entity)


@query(
    "P6_value_classes",
    f"""WITH v AS (SELECT o_orderkey AS id, log10(o_totalprice) AS x FROM orders)
    SELECT id, {CLASS_SQL.format(v='x')} AS activity_class, CAST({GROUP_SQL.format(v='x')} AS INTEGER) AS "group" FROM v""",
)
def p6(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.log10("o_totalprice").alias("x"))
    label = scalar.value_class("x", b.BINS)
    return o.select("id", label.alias("activity_class"), scalar.class_group(label).alias("group"))


VARIANT_TEXT = """vt AS (SELECT p_partkey AS id, CASE p_type
    WHEN 'STANDARD' THEN 'mutant T' || (700 + p_size) || 'M/L858R'
    WHEN 'MEDIUM' THEN ' p.Val' || p_size || 'Glu '
    WHEN 'PROMO' THEN 'Wild-Type'
    WHEN 'ECONOMY' THEN 'exon deletion ' || p_size
    WHEN 'SMALL' THEN 'q61k and Gly0' || p_size || 'Ter, Q61K'
    ELSE NULL END AS raw FROM part)"""


def variant_text(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_type")
    text = (
        F.when(kind == "STANDARD", F.concat(F.lit("mutant T"), (F.col("p_size") + 700).cast("string"), F.lit("M/L858R")))
        .when(kind == "MEDIUM", F.concat(F.lit(" p.Val"), size, F.lit("Glu ")))
        .when(kind == "PROMO", "Wild-Type")
        .when(kind == "ECONOMY", F.concat(F.lit("exon deletion "), size))
        .when(kind == "SMALL", F.concat(F.lit("q61k and Gly0"), size, F.lit("Ter, Q61K")))
    )
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("raw"), kind.alias("kind"), "p_size")


@query(
    "P7_variant_annotation",
    f"""WITH {VARIANT_TEXT}, s AS (SELECT id, raw, CAST(regexp_extract(raw, '[A-Za-z]+0?(\\d+)[A-Za-z]', 1) AS INTEGER) AS n, p_type, p_size FROM vt JOIN part ON id = p_partkey)
    SELECT id, trim(raw) AS raw_annotation,
      CASE p_type WHEN 'STANDARD' THEN 'normalized_variant' WHEN 'MEDIUM' THEN 'normalized_variant' WHEN 'SMALL' THEN 'normalized_variant'
        WHEN 'PROMO' THEN 'explicit_wild_type' WHEN 'ECONOMY' THEN 'variant_unparsed' ELSE 'unannotated' END AS status,
      CASE p_type WHEN 'STANDARD' THEN CASE WHEN p_size + 700 <= 858 THEN 'T' || (700 + p_size) || 'M;L858R' ELSE 'L858R;T' || (700 + p_size) || 'M' END
        WHEN 'MEDIUM' THEN 'V' || p_size || 'E' WHEN 'SMALL' THEN CASE WHEN p_size <= 60 THEN 'G' || p_size || '*;Q61K' ELSE 'Q61K;G' || p_size || '*' END
        ELSE '' END AS normalized,
      CASE p_type WHEN 'STANDARD' THEN 'p.Thr' || (700 + p_size) || 'Met;p.Leu858Arg' WHEN 'MEDIUM' THEN 'p.Val' || p_size || 'Glu'
        WHEN 'SMALL' THEN 'p.Gly' || p_size || 'Ter;p.Gln61Lys' ELSE '' END AS display,
      CASE p_type WHEN 'STANDARD' THEN 'multiple_substitutions' WHEN 'SMALL' THEN 'multiple_substitutions' WHEN 'MEDIUM' THEN 'substitution' WHEN 'PROMO' THEN 'wild_type'
        WHEN 'ECONOMY' THEN 'other' ELSE 'none' END AS variant_class,
      CASE WHEN raw IS NULL THEN 'unknown' ELSE 'structured' END AS confidence FROM s""",
)
def p7(spark, d):
    rows = variant_text(spark, d)
    cols = variants.annotate("raw", source="chembl_structured")
    keep = ("raw_annotation", "status", "normalized", "display", "variant_class", "confidence")
    return rows.select("id", *[cols[k].alias(k) for k in keep])


@query(
    "P8_reference_check",
    f"""WITH {VARIANT_TEXT} SELECT id,
      CASE WHEN p_type NOT IN ('MEDIUM', 'STANDARD', 'SMALL') OR raw IS NULL THEN 'not_checked'
        WHEN p_type = 'MEDIUM' AND p_size <= 10 THEN 'consistent' ELSE 'warning' END AS validation,
      CASE WHEN p_type = 'MEDIUM' AND p_size > 20 THEN 'V' || p_size || 'E: position ' || p_size || ' exceeds reference length 20'
        WHEN p_type = 'MEDIUM' AND p_size > 10 THEN 'V' || p_size || 'E: reference has A at position ' || p_size || ', not V'
        WHEN p_type = 'MEDIUM' THEN '' END AS first_warning
    FROM vt JOIN part ON id = p_partkey""",
)
def p8(spark, d):
    rows = variant_text(spark, d).withColumn("sequence", F.when(F.col("p_size") > 0, F.lit("vvvvv VVVVV AAAAA aaaaa")))
    cols = variants.annotate("raw", source="chembl_structured", sequence=F.col("sequence"))
    return rows.select("id", cols["validation"].alias("validation"), F.when(F.col("kind") == "MEDIUM", cols["warnings"]).alias("first_warning"))


@query(
    "P9_variant_match",
    f"""WITH {VARIANT_TEXT} SELECT id, raw IS NULL AS unannotated, coalesce(p_type = 'PROMO', false) AS wild_type,
      coalesce(p_type = 'MEDIUM' AND p_size = 7, false) AS v7e, coalesce(raw = 'exon deletion 9', false) AS same_text FROM vt JOIN part ON id = p_partkey""",
)
def p9(spark, d):
    rows = variant_text(spark, d)
    return rows.select(
        "id", variants.matches(None, "raw").alias("unannotated"), variants.matches("wild type", "raw").alias("wild_type"), variants.matches("p.Val7Glu", "raw").alias("v7e"),
        variants.matches("Exon   DELETION 9", "raw").alias("same_text"),
    )


@query(
    "P10_origin_names",
    """SELECT CASE WHEN s_nationkey = 1 THEN 'ChEMBL literature' WHEN s_nationkey = 7 THEN 'PubChem BioAssay (integrated)' WHEN s_nationkey = 24 THEN 'Unknown ChEMBL source'
      ELSE 'ChEMBL source ' || s_nationkey END AS origin, count(*) AS suppliers FROM supplier GROUP BY 1""",
)
def p10(spark, d):
    raw = F.when(F.col("s_nationkey") == 24, "x?").otherwise(F.col("s_nationkey").cast("string"))
    return b.table(spark, d, "supplier").groupBy(scalar.origin_name(raw).alias("origin")).agg(F.count(F.lit(1)).alias("suppliers"))


@query("P11_id_order", "SELECT 'X' || l_suppkey AS grp, arg_min(p, (length(p), p)) AS first_id FROM (SELECT l_suppkey, 'P' || l_partkey AS p FROM lineitem) GROUP BY 1")
def p11(spark, d):
    li = b.table(spark, d, "lineitem").select(F.concat(F.lit("X"), F.col("l_suppkey").cast("string")).alias("grp"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("p"))
    return li.groupBy("grp").agg(F.min(scalar.id_order("p")).alias("m")).select("grp", F.col("m.id").alias("first_id"))


@query(
    "P14_facet_filter",
    f"""WITH {M}, r AS (SELECT l_partkey, pactivity FROM m WHERE standard_type IN ('A','N') AND assay_variant_mutation IN ('O'))
    SELECT l_partkey AS id, round(median(pactivity), 6) AS pactivity FROM r GROUP BY 1""",
)
def p14(spark, d):
    m = b.measurements(spark, d).withColumnRenamed("l_partkey", "id")
    members = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    out = evidence.filtered_medians(m, members.withColumn("pactivity", F.lit(None).cast("double")), {"standard_type": ["A", "N"], "assay_variant_mutation": ["O"], "standard_relation": None}, entity="id", value="pactivity")
    return rounded(out.select("id", "pactivity"))


@query("P14_empty_facet", f"WITH {M} SELECT record_id FROM m WHERE false")
def p14_empty(spark, d):
    return b.measurements(spark, d).where(scalar.facet_filter({"standard_type": []})).select("record_id")


@query("P17_substring_search", "SELECT o_orderkey AS id, o_orderpriority AS p FROM orders WHERE contains(lower(o_orderpriority), 'not spec') OR contains(lower(CAST(o_orderkey AS VARCHAR)), 'not spec')")
def p17(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    return o.where(scalar.contains_text("NOT spec", "p", "id"))


@query(
    "P18_property_caps",
    "SELECT p_partkey AS id FROM part WHERE p_size <= 30 AND p_retailprice <= 1000.5 AND p_type <> 'PROMO'",
)
def p18(spark, d):
    part = b.table(spark, d, "part").withColumn("size_text", F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.col("p_size").cast("string")))
    return part.where(scalar.within_caps({"size_text": 30, "p_retailprice": 1000.5})).select(F.col("p_partkey").alias("id"))


@query(
    "P20_strict_flags",
    "SELECT doc_id AS id, coalesce(toxic = 1, false) AS passes FROM documents LEFT JOIN labels USING (doc_id)",
)
def p20(spark, d):
    docs, labels = b.table(spark, d, "documents").select("doc_id"), b.table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), scalar.strict_flag(F.col("toxic") == 1).alias("passes"))


@query(
    "C2_replicate_aggregation",
    f"""WITH {K}, ids AS (SELECT DISTINCT key, molecule_id FROM k),
     mg AS (SELECT key, string_agg(molecule_id, ';' ORDER BY length(molecule_id), molecule_id) AS merged_ids, count(*) AS n_ids FROM ids GROUP BY 1)
    SELECT key, arg_min(molecule_id, (length(molecule_id), molecule_id)) AS molecule_id, any_value(merged_ids) AS merged_ids, min(smiles) AS smiles, min(inchikey) AS inchikey,
      round(median(pactivity), 6) AS value, any_value(n_ids) AS n_ids, count(*) AS n_measurements, round(max(pactivity) - min(pactivity), 6) AS value_range, min(document_year) AS year
    FROM k JOIN mg USING (key) GROUP BY 1""",
)
def c2(spark, d):
    return rounded(curate.aggregate_replicates(b.keyed(spark, d), key="key", entity="molecule_id", value="pactivity", carry=["smiles", "inchikey"], order=["record_id", "pactivity"], year="document_year"))


@query(
    "C2_replicate_mean",
    f"WITH {K} SELECT key, round(avg(pactivity), 6) AS value, count(*) AS n_measurements FROM k GROUP BY 1",
)
def c2_mean(spark, d):
    out = curate.aggregate_replicates(b.keyed(spark, d), key="key", entity="molecule_id", value="pactivity", how="mean", list_ids=False)
    return rounded(out.select("key", "value", "n_measurements"))


@query(
    "C3_replicate_range",
    f"""WITH {K}, a AS (SELECT key, round(median(pactivity), 6) AS value, max(pactivity) - min(pactivity) AS r FROM k GROUP BY 1)
    SELECT key, value, round(r, 6) AS value_range FROM a WHERE r <= 1.2""",
)
def c3(spark, d):
    out = curate.aggregate_replicates(b.keyed(spark, d), key="key", entity="molecule_id", value="pactivity", list_ids=False)
    return rounded(curate.replicate_range_filter(out, 1.2).select("key", "value", "value_range"))


STD = """std AS (SELECT 'C' || p_partkey AS smiles, CASE WHEN p_size < 49 THEN 'S' || p_partkey END AS std_structure, CASE WHEN p_brand <> 'Brand#7' THEN 'K' || p_partkey END AS key,
  CASE WHEN p_size >= 49 THEN 'could not parse' END AS reason FROM part)"""


def standard_mapping(spark, d):
    ok, key = F.col("p_size") < 49, F.col("p_partkey").cast("string")
    return b.table(spark, d, "part").select(
        F.concat(F.lit("C"), key).alias("smiles"), F.when(ok, F.concat(F.lit("S"), key)).alias("std_structure"), F.when(F.col("p_brand") != "Brand#7", F.concat(F.lit("K"), key)).alias("key"),
        F.when(~ok, "could not parse").alias("reason"),
    )


@query("C4_rejected_structures", f"WITH {M}, {STD} SELECT DISTINCT molecule_id, smiles, reason FROM m JOIN std USING (smiles) WHERE reason IS NOT NULL")
def c4(spark, d):
    return curate.standardise(b.measurements(spark, d), standard_mapping(spark, d))[1]


@query(
    "C4_stage_log",
    f"""WITH {M}, {STD}, j AS (SELECT m.*, coalesce(key, std_structure) AS key2, reason FROM m JOIN std USING (smiles)), ok AS (SELECT * FROM j WHERE reason IS NULL),
     ag AS (SELECT key2, max(pactivity) - min(pactivity) AS r FROM ok GROUP BY 1)
    SELECT 14 AS step, 'standardisation' AS name, (SELECT count(*) FROM m) AS records_in, (SELECT count(*) FROM ok) AS records_out, (SELECT count(DISTINCT molecule_id) FROM ok) AS molecules_out,
      (SELECT count(*) FROM m) - (SELECT count(*) FROM ok) AS removed
    UNION ALL SELECT 15, 'aggregation', (SELECT count(*) FROM ok), (SELECT count(*) FROM ag), (SELECT count(*) FROM ag), (SELECT count(*) FROM ok) - (SELECT count(*) FROM ag)
    UNION ALL SELECT 16, 'replicate_range', (SELECT count(*) FROM ag), (SELECT count(*) FROM ag WHERE r <= 1.2), (SELECT count(*) FROM ag WHERE r <= 1.2), (SELECT count(*) FROM ag WHERE NOT r <= 1.2)""",
)
def c4_log(spark, d):
    m = b.measurements(spark, d)
    accepted, _ = curate.standardise(m, standard_mapping(spark, d))
    ents = curate.aggregate_replicates(accepted, key="key", entity="molecule_id", value="pactivity", how="mean", list_ids=False)
    return curate.stage_log(m, accepted, ents, curate.replicate_range_filter(ents, 1.2))


@query(
    "C5_value_breakdown",
    """WITH r AS (SELECT coalesce(CAST(toxic AS VARCHAR), '(none)') AS value FROM documents LEFT JOIN labels USING (doc_id))
    SELECT value, count(*) AS records, round(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1""",
)
def c5(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id").join(b.table(spark, d, "labels"), "doc_id", "left")
    return rounded(evidence.value_breakdown(rows, "toxic"))


@query(
    "C5_field_summary",
    """WITH c AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
     n AS (SELECT field, value, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY field) AS t FROM n)
    SELECT field, string_agg(value || ': ' || n, ', ' ORDER BY r) || CASE WHEN any_value(t) > 6 THEN ' (+' || (any_value(t) - 6) || ' more)' ELSE '' END AS summary, any_value(t) AS distinct_values
    FROM r WHERE r <= 6 GROUP BY 1""",
)
def c5b(spark, d):
    return evidence.field_summary(b.table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "C6_assay_overview",
    f"WITH {M} SELECT assay_chembl_id, standard_type, assay_variant_mutation, count(*) AS records, count(DISTINCT molecule_id) AS molecules FROM m GROUP BY 1, 2, 3",
)
def c6(spark, d):
    return evidence.assay_overview(b.measurements(spark, d), ["assay_chembl_id", "standard_type", "assay_variant_mutation"], record="record_id", entity="molecule_id")


@query(
    "C7_assay_contexts",
    f"""WITH {M} SELECT assay_chembl_id, standard_type, assay_variant_mutation AS variant_scope, count(DISTINCT molecule_id) AS compounds, count(*) AS records
    FROM m WHERE standard_relation = '=' GROUP BY 1, 2, 3""",
)
def c7(spark, d):
    return evidence.assay_contexts(b.measurements(spark, d), assay="assay_chembl_id", endpoint="standard_type", variant="assay_variant_mutation", entity="molecule_id")


@query(
    "C8_context_values",
    f"""WITH {M}, r AS (SELECT DISTINCT l_partkey, record_id, pactivity FROM m WHERE standard_type = 'A' AND assay_variant_mutation = 'F' AND standard_relation = '=')
    SELECT l_partkey, count(*) AS n_measurements, round(max(pactivity) - min(pactivity), 6) AS value_range, round(median(pactivity), 6) AS value FROM r GROUP BY 1""",
)
def c8(spark, d):
    scope = (F.col("standard_type") == "A") & (variants.scope("assay_variant_mutation") == "F")
    return rounded(evidence.context_values(b.measurements(spark, d), entity="l_partkey", record="record_id", value="pactivity", scope=scope))


ORIGIN = f"""{M}, o AS (SELECT m.*, s_nationkey AS src_id, CASE s_nationkey WHEN 1 THEN 'ChEMBL literature' WHEN 7 THEN 'PubChem BioAssay (integrated)' ELSE 'ChEMBL source ' || s_nationkey END AS source
  FROM m JOIN supplier ON l_suppkey = s_suppkey)"""


def with_origin(spark, d):
    s = b.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src_id"))
    m = b.measurements(spark, d)
    return m.join(s, m.l_suppkey == s.s_suppkey)


@query(
    "C9_origin_summary",
    f"""WITH {ORIGIN}, x AS (SELECT l_partkey, count(DISTINCT source) AS k FROM o GROUP BY 1)
    SELECT src_id, source, count(*) AS records, count(DISTINCT l_partkey) AS molecules, count(DISTINCT assay_chembl_id) AS assays,
      count(DISTINCT CASE WHEN k > 1 THEN l_partkey END) AS shared_molecules FROM o JOIN x USING (l_partkey) GROUP BY 1, 2""",
)
def c9(spark, d):
    return evidence.origin_summary(with_origin(spark, d), origin="src_id", entity="l_partkey", assay="assay_chembl_id")


@query(
    "C10_origin_disagreement",
    f"""WITH {ORIGIN}, g AS (SELECT l_partkey, source, median(pactivity) AS md FROM o GROUP BY 1, 2),
     a AS (SELECT l_partkey, count(*) AS k, string_agg(source, '; ' ORDER BY source) AS origins, string_agg(source || ': ' || printf('%.2f', md), '; ' ORDER BY source) AS sm, max(md) - min(md) AS spread FROM g GROUP BY 1),
     r AS (SELECT l_partkey, count(*) AS n, string_agg(DISTINCT standard_type, '; ' ORDER BY standard_type) AS kinds FROM o GROUP BY 1)
    SELECT l_partkey AS molecule_id, origins, k AS origin_count, n AS measurements, kinds AS endpoint_types, sm AS source_medians, round(spread, 6) AS spread FROM a JOIN r USING (l_partkey) WHERE k > 1""",
)
def c10(spark, d):
    return rounded(evidence.origin_disagreement(with_origin(spark, d), origin="src_id", entity="l_partkey", value="pactivity", endpoint="standard_type"))


@query(
    "J1_confidence_lookup",
    f"""WITH {M} SELECT standard_type, CAST(n_regionkey AS INTEGER) AS confidence, count(*) AS records FROM m LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1, 2""",
)
def j1(spark, d):
    n = b.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("src_id"), F.col("n_regionkey").alias("confidence"))
    return with_origin(spark, d).join(n, "src_id", "left").groupBy("standard_type", "confidence").agg(F.count(F.lit(1)).alias("records"))


@query(
    "J2_evidence_lineage",
    f"""WITH {K}, a AS (SELECT key, arg_min(molecule_id, (length(molecule_id), molecule_id)) AS cid, max(pactivity) - min(pactivity) AS r FROM k GROUP BY 1)
    SELECT cid AS molecule_id, molecule_id AS source_molecule_id, record_id, round(pactivity, 6) AS pactivity, CAST(NULL AS VARCHAR) AS activity_url,
      'https://www.ebi.ac.uk/chembl/api/data/assay/' || assay_chembl_id || '.json' AS assay_url FROM k JOIN a USING (key) WHERE r <= 1.2""",
)
def j2(spark, d):
    k = b.keyed(spark, d)
    ents = curate.replicate_range_filter(curate.aggregate_replicates(k, key="key", entity="molecule_id", value="pactivity", how="mean", list_ids=False), 1.2)
    out = evidence.lineage(k, ents, key="key")
    return rounded(out.select("molecule_id", "source_molecule_id", "record_id", "pactivity", "activity_url", "assay_url"))


@query(
    "P12_record_urls",
    """SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN 'https://www.ebi.ac.uk/chembl/api/data/activity/' || event_id || '.json' END AS url FROM events""",
)
def p12(spark, d):
    e = b.table(spark, d, "events")
    ident = F.when(F.col("event_type") == "view", F.concat(F.lit("file:"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), scalar.record_url("activity", ident, digits_only=True).alias("url"))


@query("P13_drop_class", f"WITH {E} SELECT id, activity_class FROM e WHERE activity_class <> 'intermediate'")
def p13(spark, d):
    from measurelens.operators.splits import drop_class

    return drop_class(b.entities(spark, d), "activity_class", "intermediate").select("id", "activity_class")


@query(
    "C17_input_expectations",
    f"""WITH {M}, t AS (SELECT l_partkey, median(pactivity) AS v FROM (SELECT DISTINCT l_partkey, record_id, pactivity FROM m) GROUP BY 1),
     w AS (SELECT l_partkey, median(pactivity) AS v FROM m GROUP BY 1), s AS (SELECT molecule_id FROM m GROUP BY 1 HAVING count(DISTINCT smiles) > 1),
     rc AS (SELECT record_id FROM (SELECT DISTINCT record_id, l_partkey, pactivity FROM m) GROUP BY 1 HAVING count(*) > 1), rr AS (SELECT record_id FROM m GROUP BY 1 HAVING count(*) > 1)
    SELECT 'null id' AS rule, count(*) FILTER (l_partkey IS NULL) AS violations FROM m UNION ALL SELECT 'relation is not exact', count(*) FILTER (standard_relation <> '=') FROM m
    UNION ALL SELECT 'value is not finite', count(*) FILTER (NOT isfinite(pactivity)) FROM m
    UNION ALL SELECT 'mixed standard_type', count(DISTINCT standard_type) - 1 FROM m UNION ALL SELECT 'mixed assay_chembl_id', count(DISTINCT assay_chembl_id) - 1 FROM m
    UNION ALL SELECT 'id names several structures', count(*) FROM s UNION ALL SELECT 'record has conflicting values', count(*) FROM rc UNION ALL SELECT 'record id repeats', count(*) FROM rr
    UNION ALL SELECT 'median differs from evidence', count(*) FILTER (abs(w.v - t.v) > 1e-9) FROM w JOIN t USING (l_partkey)
    UNION ALL SELECT 'id sets differ', count(*) FROM (SELECT DISTINCT l_partkey FROM m) FULL JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NULL OR l_partkey IS NULL""",
)
def c17(spark, d):
    from measurelens.operators.ordered import quantiles

    m = b.measurements(spark, d)
    rows = evidence.rule_counts(
        m,
        {"null id": F.col("l_partkey").isNull(), "relation is not exact": F.col("standard_relation") != "=", "value is not finite": scalar.finite_number("pactivity").isNull()},
    )
    rows = rows.unionByName(evidence.mixed_values(m, ["standard_type", "assay_chembl_id"]))
    rows = rows.unionByName(evidence.ambiguous_keys(m, "molecule_id", ["smiles"], "id names several structures"))
    rows = rows.unionByName(evidence.ambiguous_keys(m, "record_id", ["l_partkey", "pactivity"], "record has conflicting values"))
    rows = rows.unionByName(evidence.repeated_keys(m, "record_id", "record id repeats"))
    table = quantiles(m, ["l_partkey"], "pactivity", {"pactivity": 0.5})
    rows = rows.unionByName(evidence.median_mismatch(table, m, entity="l_partkey", value="pactivity", record="record_id", rule="median differs from evidence"))
    return rows.unionByName(evidence.unmatched_ids(m, b.table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "id sets differ"))


@query(
    "C42_outcome_curation",
    """WITH c AS (SELECT doc_id AS cid, CASE WHEN toxic = 1 THEN 'Active' WHEN quality = 1 THEN 'inactive ' ELSE 'Inconclusive' END AS o, md5(text) AS key FROM labels LEFT JOIN documents USING (doc_id)),
     g AS (SELECT key, min(cid) AS cid, string_agg(DISTINCT cid, ';' ORDER BY cid) AS cids, min(lower(trim(o))) AS lo, max(lower(trim(o))) AS hi, count(*) AS n FROM c WHERE lower(trim(o)) IN ('active','inactive') GROUP BY 1)
    SELECT cid, cids, key, lo AS outcome, n AS n_calls FROM g WHERE lo = hi""",
)
def c42(spark, d):
    return evidence.curate_outcomes(*_calls(spark, d))[0]


def _calls(spark, d):
    labels = b.table(spark, d, "labels")
    call = F.when(F.col("toxic") == 1, "Active").when(F.col("quality") == 1, "inactive ").otherwise("Inconclusive")
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("cid"), F.md5(F.col("text").cast("binary")).alias("key"))
    return labels.select(F.col("doc_id").alias("cid"), call.alias("outcome")), docs


@query(
    "C42_outcome_audit",
    """WITH c AS (SELECT doc_id AS cid, CASE WHEN toxic = 1 THEN 'active' WHEN quality = 1 THEN 'inactive' ELSE 'inconclusive' END AS o, md5(text) AS key FROM labels LEFT JOIN documents USING (doc_id)),
     g AS (SELECT key, count(DISTINCT o) AS k FROM c WHERE o <> 'inconclusive' GROUP BY 1)
    SELECT count(*) AS raw_calls, count(*) FILTER (o = 'inconclusive') AS nonbinary_outcome, count(*) FILTER (o <> 'inconclusive' AND key IS NULL) AS missing_cid_or_structure,
      (SELECT count(*) FROM g WHERE k > 1) AS conflicting_structures, (SELECT count(*) FROM g WHERE k = 1) AS curated_compounds FROM c""",
)
def c42_audit(spark, d):
    return evidence.curate_outcomes(*_calls(spark, d))[1]


@query(
    "C47_variant_evidence",
    f"WITH {M} SELECT DISTINCT assay_variant_mutation, standard_type, document_year FROM m",
)
def c47(spark, d):
    return evidence.variant_evidence(b.measurements(spark, d), ["assay_variant_mutation", "standard_type", "document_year"])


@query(
    "S3_outcome_checks",
    """SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS assays, count(*) FILTER (o_orderstatus IS NULL) AS missing_assay, count(DISTINCT o_orderpriority) AS distinct_o_orderpriority,
      count(*) >= 10000 AS possibly_truncated FROM orders""",
)
def s3(spark, d):
    return sources.outcome_checks(b.table(spark, d, "orders"), assay="o_orderstatus", constant=["o_orderpriority"])


@query(
    "S1_typed_measurements",
    """SELECT trim(CAST(c_custkey AS VARCHAR)) AS molecule_id, c_mktsegment AS smiles, round(9 - log10(1 + abs(c_acctbal)), 6) AS pactivity, 'customer:' || c_custkey AS record_id,
      CASE WHEN c_nationkey <> 3 THEN 2000 + c_nationkey END AS document_year FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def s1(spark, d):
    """The typing step of the delimited reader, on text columns of a table."""
    c = b.table(spark, d, "customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("molecule_id"), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("smiles"), (1 + F.abs("c_acctbal")).cast("string").alias("value"),
        F.when(F.col("c_nationkey") == 3, "n.d.").otherwise((F.col("c_nationkey") + 2000).cast("string")).alias("year"), "c_custkey",
    )
    record = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    return rounded(sources.measurements_from(c, identifier="molecule_id", structure="smiles", value="value", record=record, unit="nM", year="year"))


@query(
    "S1_record_numbers",
    """SELECT CAST(c_custkey AS VARCHAR) AS molecule_id, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || '"' || c_nationkey ELSE '' END AS smiles, round(1 + abs(c_acctbal), 4) AS pactivity, c_nationkey AS document_year,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS record FROM customer""",
)
def s1_numbers(spark, d):
    """Delimited files, one per nation, written and read back: every row has the number of its record in its file."""
    folder = f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    c = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("molecule_id"), F.concat("c_mktsegment", F.when(F.pmod("c_custkey", F.lit(5)) == 0, F.concat(F.lit('\n"'), F.col("c_nationkey").cast("string"))).otherwise("")).alias("smiles"),
        (1 + F.abs("c_acctbal")).alias("pactivity"), F.col("c_nationkey").alias("year"), F.col("c_nationkey").alias("nation"),
    )
    c.repartition("nation").sortWithinPartitions("nation", "molecule_id").write.partitionBy("nation").option("header", True).option("escape", '"').csv(folder)
    out = sources.read_measurement_table(spark, f"{folder}/*/*.csv", year="year")
    return rounded(out.withColumn("record", F.substring_index("record_id", ":", -1).cast("long")).drop("record_id"), 4)


@query("S4_prediction_input", "SELECT CAST(c_custkey AS VARCHAR) AS molecule_id, c_mktsegment AS smiles FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def s4(spark, d):
    c = b.table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("i"), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("s"))
    return sources.prediction_input(c, identifier="i", structure="s")


@query(
    "S6_content_fingerprint",
    """WITH h AS (SELECT sha256(concat_ws(chr(31), p_brand, p_name, CAST(p_size AS VARCHAR))) AS h FROM (SELECT DISTINCT p_brand, p_name, p_size FROM part))
    SELECT count(*) AS rows, CAST(sum(('0x' || substr(h, 1, 13))::BIGINT::HUGEINT) AS VARCHAR) AS head, CAST(sum(('0x' || substr(h, 52, 13))::BIGINT::HUGEINT) AS VARCHAR) AS tail FROM h""",
)
def s6(spark, d):
    return sources.content_fingerprint(b.table(spark, d, "part"), ["p_name", "p_brand", "p_size"])


@query(
    "P15_error_columns",
    f"""WITH {b.P} SELECT id, round(truth - prediction, 6) AS residual, round(abs(truth - prediction), 6) AS absolute_error, abs(truth - prediction) <= log10(3) AS within_3_fold, abs(truth - prediction) <= 1 AS within_10_fold,
      round(prediction - 0.4, 6) AS empirical_lower, round(prediction + 0.4, 6) AS empirical_upper, abs(truth - prediction) <= 0.4 AS inside_band FROM p""",
)
def p15(spark, d):
    p = b.predictions(spark, d)
    return rounded(p.select("id", *[c.alias(n) for n, c in scalar.error_columns("truth", "prediction", 0.4).items()]))


