"""Hand-computed cases of single operators."""

from __future__ import annotations

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from measurelens.functions import scalar, variants
from measurelens.operators import compare, curate, evidence, features, groups, metrics, ordered, pairs, shortlist, similarity, splits, stress


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_units_and_numbers(spark):
    df = spark.createDataFrame([(100.0, "nM"), (1.0, "µM"), (1.0, "μM"), (-1.0, "nM"), (1.0, "mg")], "v double, u string")
    got = [r[0] for r in df.select(scalar.log_molar("v", "u", strict=False)).collect()]
    assert got == [7.0, 6.0, 6.0, None, None]
    with pytest.raises(Exception, match="cannot convert"):
        df.select(scalar.log_molar("v", "u")).collect()
    raw = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "s string")
    assert [r[0] for r in raw.select(scalar.finite_number("s")).collect()] == [1.5, None, None, None, None]


def test_class_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(8.0,), (7.999,), (5.0,), (4.0,)], "v double")
    assert [r[0] for r in df.select(scalar.value_class("v")).collect()] == ["potent", "active", "intermediate", "inactive"]
    with pytest.raises(Exception, match="missing"):
        spark.createDataFrame([(None,)], "v double").select(scalar.value_class("v")).collect()


def record(**changes):
    base = dict(activity_id=1, molecule_chembl_id="X1", parent_molecule_chembl_id="X1", canonical_smiles="C", standard_type="IC50", standard_relation="=", standard_value="100.0", standard_units="nM",
                assay_type="B", assay_chembl_id="A1", assay_variant_mutation=None, potential_duplicate=0, data_validity_comment=None, bao_label="f", document_year=2015, src_id=1, confidence_score=None)
    return {**base, **changes}


SCHEMA = ("activity_id long, molecule_chembl_id string, parent_molecule_chembl_id string, canonical_smiles string, standard_type string, standard_relation string, standard_value string, standard_units string, assay_type string, "
          "assay_chembl_id string, assay_variant_mutation string, potential_duplicate int, data_validity_comment string, bao_label string, document_year int, src_id int, confidence_score string")


@pytest.mark.parametrize(
    "change, step",
    [(dict(standard_type="Ki"), "standard_type"), (dict(standard_relation=None), "relation"), (dict(standard_units="mg"), "units"), (dict(assay_type="F"), "assay_type"), (dict(assay_variant_mutation="T790M"), "variant"),
     (dict(potential_duplicate=1), "potential_duplicate"), (dict(data_validity_comment="bad"), "validity"), (dict(canonical_smiles=""), "structure"), (dict(standard_value="0"), "value")],
)
def test_each_filter_is_logged(spark, change, step):
    df = spark.createDataFrame([record(), record(activity_id=2, molecule_chembl_id="X2", parent_molecule_chembl_id="", **change)], SCHEMA)
    rules = curate.CurationRules()
    log = {r["name"]: r for r in curate.curation_log(df, curate.record_predicates(rules), scalar.effective_id("parent_molecule_chembl_id", "molecule_chembl_id")).collect()}
    assert len(log) == 14 and [n for n, r in log.items() if r["removed"]] == [step]
    kept = curate.filter_records(df, rules).collect()
    assert [(r["molecule_id"], r["pactivity"], r["record_id"]) for r in kept] == [("X1", 7.0, "1")]


def test_time_safe_labels_ignore_later_data(spark):
    m = spark.createDataFrame([("A", "a", 6.0, 2018), ("A", "a", 9.0, 2021), ("B", "b", 7.0, 2021)], "molecule_id string, key string, v double, y int")
    make = lambda d: curate.curate(d, key="key", entity="molecule_id", value="v").select("key", "value", "n_measurements")
    assert rows(make(m), "key", "value") == [("a", 7.5), ("b", 7.0)]
    assert rows(splits.time_safe(m, make, year="y", cutoff=2019, key="key"), "key", "value", "n_measurements", "is_test") == [("a", 6.0, 1, False), ("b", 7.0, 1, True)]


def test_diversity(spark):
    data = [("potent", m, s) for m, s in zip(["A", "A", "B", None], ["S1", "S1", "S1", None])] + [("inactive", m, s) for m, s in zip(["A", "C", "D"], ["S1", "S2", "S2"])]
    df = spark.createDataFrame(data, "c string, m string, s string")
    got = {r["row"]: (r["N"], r["acyclic"], r["Ns"], r["Nss"], r["Ncsk"]) for r in groups.diversity(df, scaffold="m", skeleton="s", class_col="c").collect()}
    assert got == {"complete": (7, 1, 4, 3, 2), "potent": (4, 1, 2, 1, 1), "inactive": (3, 0, 3, 3, 2)}


def test_enrichment_bounds(spark):
    data = [("SERIES", 1)] * 30 + [("LONE", 1)] + [(f"F{i % 400}", 1 if i < 2298 - 31 else 2) for i in range(3952 - 31)]
    df = spark.createDataFrame(data, "m string, g int").withColumn("v", F.lit(1.0))
    got = {r["scaffold"]: r for r in groups.enrichment(df, scaffold="m", group="g", value="v").collect()}
    base, z2 = 2298 / 3952, 1.959963984540054**2
    for name, n in (("SERIES", 30), ("LONE", 1)):
        assert got[name]["ef"] == pytest.approx(1 / base)
        assert got[name]["ef_lower"] == pytest.approx(1 / (1 + z2 / n) / base)
    with pytest.raises(Exception, match="group one"):
        groups.enrichment(df.withColumn("g", F.lit(2)), scaffold="m", group="g", value="v").collect()


LAND = [("m10", list(range(10)), 9.0), ("m2", list(range(11)), 6.0), ("m3", list(range(10)), 5.0), ("m4", list(range(50, 60)), 9.0)]


def test_landscape_fixture(spark):
    df = spark.createDataFrame(LAND, "id string, tokens array<int>, v double")
    args = dict(identifier="id", tokens="tokens", value="v")
    one = similarity.region_counts(df, **args).head().asDict()
    assert one == {"cliff": 1, "smooth": 1, "scaffold_hop": 1, "nondescript": 2, "identical": 1}
    c = similarity.cliffs(df, **args).collect()
    assert [(r["id_a"], r["id_b"], r["delta"]) for r in c] == [("m2", "m10", 3.0)]
    assert c[0]["similarity"] == pytest.approx(10 / 11) and c[0]["sali"] == pytest.approx(3 / (1 - 10 / 11))
    assert rows(similarity.identical_pairs(df, **args), "id_a", "id_b") == [("m3", "m10")]
    assert rows(similarity.identical_groups(df, **args), "first_id", "members", "pairs", "far_pairs") == [("m3", 2, 1, 1)]


@pytest.mark.parametrize("t", [0.95, 0.9, 0.8, 0.6, 0.3])
def test_similarity_join_equals_brute_force(spark, t):
    rng = random.Random(int(t * 100))
    base = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(25)]
    sets = []
    for s in base:
        for _ in range(5):
            near = set(s)
            for _ in range(rng.randint(0, 3)):
                near.add(rng.randrange(200)) if rng.random() < 0.5 or len(near) < 2 else near.discard(rng.choice(sorted(near)))
            sets.append(sorted(near))
    data = [(f"d{i}", s, float(rng.randint(0, 60)) / 10) for i, s in enumerate(sets)] + [("e1", [], 1.0), ("e2", [], 9.0)]
    df = spark.createDataFrame(data, "id string, tokens array<int>, v double")
    want = dict.fromkeys(["cliff", "smooth", "scaffold_hop", "nondescript", "identical"], 0)
    pairs_ = set()
    for (i, s, v), (j, u, w) in itertools.combinations(data, 2):
        a, b = set(s), set(u)
        sim = len(a & b) / len(a | b) if a | b else 0.0
        big = abs(v - w) > 2.0
        name = "identical" if sim >= 1 else ("cliff" if big else "smooth") if sim > t else ("nondescript" if big else "scaffold_hop")
        want[name] += 1
        if name == "cliff":
            pairs_.add(frozenset((i, j)))
    args = dict(identifier="id", tokens="tokens", value="v", t=t)
    assert similarity.region_counts(df, **args).head().asDict() == want
    assert {frozenset((r["id_a"], r["id_b"])) for r in similarity.cliffs(df, **args).collect()} == pairs_
    near = {r["id"]: (round(r["similarity"], 9), r["nearest_id"]) for r in similarity.nearest_neighbours(df, df, tokens="tokens", exclude_self=True).collect()}
    for i, s, _ in data:
        scored = []
        for j, u, _ in data:
            if j != i:
                union = set(s) | set(u)
                scored.append((-(len(set(s) & set(u)) / len(union) if union else 0.0), len(j), j))
        best = min(scored)
        assert near[i] == (round(-best[0], 9), best[2])


def test_far_pairs_use_the_rounded_difference(spark):
    values = [4.5 + (i * 37 % 50) / 10 for i in range(120)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    want = sum(abs(a - b) > 2.0 for a, b in itertools.combinations(values, 2))
    assert ordered.count_far_pairs(df, "v", 2.0).head()["far_pairs"] == want
    per = {r["k"]: r["far_pairs"] for r in ordered.count_far_pairs(df, "v", 2.0, ["k"]).collect()}
    for k in range(3):
        assert per[k] == sum(abs(a - b) > 2.0 for a, b in itertools.combinations(values[k::3], 2))


@pytest.mark.parametrize("hot", [1, 10**9])
def test_quantiles_on_both_paths(spark, hot):
    rng = random.Random(3)
    data = [(i % 4, rng.choice([-2.5, -1.0, 0.0, 1e-9, 3.25, 1e6]) + rng.randint(0, 3)) for i in range(400)] + [(9, 1.5)]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", {"mid": 0.5, "q": 0.9}, hot_rows=hot).collect()}
    for k in (0, 1, 2, 3, 9):
        mine = sorted(v for g, v in data if g == k)
        assert got[k]["mid"] == pytest.approx(statistics.median(mine))
    high = ordered.quantiles(df, [], "v", {"h": 0.9}, method="higher").head()["h"]
    every = sorted(v for _, v in data)
    assert high == every[math.ceil((len(every) - 1) * 0.9)]


def test_small_rank_tests_are_exact(spark):
    # three against three without overlap: two of the twenty arrangements are as extreme
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 4.0), (2, 5.0), (2, 6.0)], "g int, v double")
    assert groups.group_tests(df, ["v"], "g").head()["p_value"] == pytest.approx(0.1)
    constant = df.withColumn("v", F.lit(1.0))
    assert groups.group_tests(constant, ["v"], "g").head()["p_value"] is None
    with pytest.raises(ValueError, match="two groups"):
        groups.group_tests(df.withColumn("g", F.col("v")), ["v"], "g")


def test_transformations_fixture(spark):
    data = [("a", "b", "core1", "*C", "*O", 1.0), ("c", "d", "core2", "*O", "*C", 0.5), ("e", "f", "core2", "*C", "*O", -0.2)]
    df = spark.createDataFrame(data, "id_a string, id_b string, context string, fragment_a string, fragment_b string, delta double")
    ev = spark.createDataFrame([(i, "X") for i in "abcdef"], "molecule_id string, assay string")
    r = pairs.transformation_summary(df, ev, entity="molecule_id", assay="assay").collect()
    assert [(x["fragment_from"], x["fragment_to"], x["assay_context"], x["distinct_contexts"], x["supporting_pairs"], x["positive_pairs"], x["negative_pairs"]) for x in r] == [("*C", "*O", "shared assay", 2, 3, 1, 2)]


def series_fixture(spark):
    r2 = ["C", "N", "O"]
    data = [(f"M{i}{s}", 9.0 if s == "a" else 5.0, "C[*:1]" if s == "a" else "F[*:1]", r2[i]) for i in range(3) for s in "ab"]
    series = spark.createDataFrame(data, "id string, v double, R1 string, R2 string")
    ev = spark.createDataFrame([(m, f"r{k}", 6.0 if f == "C[*:1]" else 7.0, "ASSAY1", "IC50", "=", None, "D1" if k < 4 else "D2") for k, (m, _, f, _) in enumerate(data)],
                               "id string, record string, v double, assay string, endpoint string, relation string, variant string, document string")
    return series, ev


def test_shared_assay_beats_pooled_values(spark):
    series, ev = series_fixture(spark)
    pp = pairs.position_pairs(series, positions=["R1", "R2"], entity="id", value="v")
    me = pairs.measured_medians(ev, entity="id", assay="assay", endpoint="endpoint", variant="variant", value="v", record="record", relation="relation")
    table = pairs.claims(pairs.resolve_evidence(pp, me))
    c = {(r["position"], r["fragment_from"], r["fragment_to"]): r for r in table.collect()}[("R1", "C[*:1]", "F[*:1]")]
    assert (c["median_delta"], c["supporting_pairs"], c["disjoint_pairs"], c["distinct_contexts"], c["evidence_strength"], c["interpretation"]) == (1.0, 3, 3, 3, "strong", "increase")
    full = pairs.resolve_evidence(pp, me)
    checks = stress.omission_checks(full.where("position = 'R1'"), ev, entity="id", assay="assay", endpoint="endpoint", variant=variants.scope("variant"), value="v", record="record", document="document")
    tests = {}
    for r in checks.collect():
        tests.setdefault(r["test"], []).append(r["supporting_pairs"])
    assert tests["Baseline"] == [3] and tests["Leave one assay out"] == [0] and sorted(tests["Leave one publication out"]) == [1, 2] and tests["Leave one compound out"] == [2] * 6
    cycles = stress.interaction_cycles(full, stress.pattern_members(series, core=[], positions=["R1", "R2"], entity="id"))
    assert {r["interaction_delta"] for r in cycles.collect()} == {0.0} and cycles.where("position = 'R1'").count() == 3


def test_greedy_disjoint_pairs(spark):
    df = spark.createDataFrame([("k", "c", a, b) for a, b in [("1", "2"), ("2", "3"), ("3", "4"), ("1", "5"), ("6", "5")]], "k string, context string, id_from string, id_to string")
    assert pairs.disjoint_counts(df, ["k"]).head()["disjoint_pairs"] == 3


def test_compare_fixture(spark):
    a = spark.createDataFrame([("x", "s", 8.0, 1), ("y", "s", 7.0, 1)], "key string, murcko string, va double, ga int")
    b = spark.createDataFrame([("x", "s", 6.0, 2), ("z", "s", 5.0, 2)], "key string, murcko string, vb double, gb int")
    shared = compare.shared_entities(a, b.drop("murcko"), key="key", value_a="va", value_b="vb")
    r = shared.head()
    assert (r["ratio_a_over_b"], r["preferred"], shared.count()) == (100.0, "A", 1)
    g = compare.shared_groups(a, b, shared, scaffold="murcko", value_a="va", value_b="vb", group_a="ga", group_b="gb").collect()
    assert len(g) == 1 and g[0]["fraction_delta"] == 1.0
    with pytest.raises(Exception, match="more than once"):
        compare.activity_matrix(a.union(a), b, key="key", value_a="va", value_b="vb", label_a="ga", label_b="gb").collect()


def test_origin_fixture(spark):
    df = spark.createDataFrame([("1", "A", 1, "X"), ("2", "A", 7, "Y"), ("3", "B", 7, "Y"), ("4", "B", 7, "Y")], "r string, m string, s int, a string")
    got = {r["src_id"]: (r["records"], r["molecules"], r["shared_molecules"]) for r in evidence.origin_summary(df, origin="s", entity="m", assay="a").collect()}
    assert got == {1: (1, 1, 1), 7: (3, 2, 1)}
    d = spark.createDataFrame([("A", 1, 6.0, "IC50"), ("A", 1, 7.0, "IC50"), ("A", 37, 8.0, "Ki"), ("B", 7, 5.0, "IC50")], "m string, s int, v double, e string")
    r = evidence.origin_disagreement(d, origin="s", entity="m", value="v", endpoint="e").collect()
    assert [(x["molecule_id"], x["spread"], x["endpoint_types"]) for x in r] == [("A", 1.5, "IC50; Ki")]


def test_outcome_fixture(spark):
    calls = spark.createDataFrame([(1, "Active"), (2, "Inactive"), (3, "Inconclusive"), (4, "Inactive")], "cid long, outcome string")
    keys = spark.createDataFrame([(1, "k"), (2, "k"), (3, "q"), (4, "z")], "cid long, key string")
    table, audit = evidence.curate_outcomes(calls, keys)
    assert rows(table, "cid", "outcome") == [(4, "inactive")]
    a = audit.head()
    assert (a["conflicting_structures"], a["nonbinary_outcome"], a["curated_compounds"]) == (1, 1, 1)


def test_regression_fixture(spark):
    error = [0, 0.1, -0.4, 1.2, -0.7, 0.2]
    data = [(i, t, t - e, 6.3, g) for i, (t, e, g) in enumerate(zip([5.0, 6.0, 7.0, 8.0, 6.0, 7.0], error, ["a", "a", "b", "b", None, None]))]
    df = spark.createDataFrame(data, "id int, truth double, prediction double, baseline double, block string")
    s = {r["metric"]: r["value"] for r in metrics.regression_summary(df, "truth", "prediction", "baseline").collect()}
    assert s["Within 3-fold"] == pytest.approx(4 / 6) and s["Within 10-fold"] == pytest.approx(5 / 6) and s["Test MAE"] == pytest.approx(2.6 / 6) and s["Typical fold error"] == pytest.approx(10**0.3)
    blocks = metrics.block_sums(df, block="block", row="id", truth="truth", prediction="prediction", baseline="baseline")
    assert blocks.count() == 4
    one = rows(metrics.block_bootstrap(blocks, repeats=25), "metric", "lower_95", "upper_95")
    assert one == rows(metrics.block_bootstrap(blocks, repeats=25), "metric", "lower_95", "upper_95")
    with pytest.raises(ValueError, match="20 repeats"):
        metrics.block_bootstrap(blocks, repeats=5)


def test_variants(spark):
    df = spark.createDataFrame([("L858R, T790M",), ("p.Val600Glu",), ("wild type",), ("exon 19 deletion",), (None,), ("H1047R*",)], "raw string")
    got = [tuple(r) for r in df.select(variants.annotate("raw")["normalized"], variants.annotate("raw")["status"]).collect()]
    assert got[:5] == [("T790M;L858R", "normalized_variant"), ("V600E", "normalized_variant"), ("", "explicit_wild_type"), ("", "variant_unparsed"), ("", "unannotated")]


def test_no_group_is_divided(spark):
    df = spark.createDataFrame([(i, f"g{i % 37}", "ab"[i % 3 == 0]) for i in range(600)], "id int, grp string, label string")
    folds = splits.group_folds(df, group="grp", label="label", k=5)
    assert folds.count() == 600 and folds.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5
    more = splits.oversample(df.select("id", "label"), identifier="id", label="label")
    assert {r["n"] for r in more.groupBy("label").agg(F.count("*").alias("n")).collect()} == {400}
    with pytest.raises(ValueError, match="boundaries"):
        splits.leave_one_out(df, identifier="id", split="scaffold")


def test_shortlist_is_greedy(spark):
    rng = random.Random(5)
    data = [(f"i{i}", f"s{i % 25}", [str(x) for x in rng.sample(range(30), 8)] if i < 25 else ["1"], float(i % 25) / 5, "predicted", True, 100.0) for i in range(40)]
    by = {}
    for d in data:
        if d[1] not in by or (-d[3], d[0]) < (-by[d[1]][3], by[d[1]][0]):
            by[d[1]] = d
    df = spark.createDataFrame(data, "id string, structure string, tokens array<string>, prediction double, status string, in_domain boolean, mw double")
    got = [r["entity"] for r in shortlist.diverse_shortlist(df, structure="structure", entity="id", caps={"mw": 500}, n=6, weight=2.0).orderBy("rank").collect()]
    pool, chosen = sorted(by.values(), key=lambda d: (-d[3], d[0])), []
    while len(chosen) < 6:
        def score(d):
            return d[3] - 2.0 * max([len(set(d[2]) & set(c[2])) / len(set(d[2]) | set(c[2])) for c in chosen], default=0.0)
        best = max(pool, key=score)
        chosen.append(best)
        pool.remove(best)
    assert got == [c[0] for c in chosen]


def test_perturbation_is_rigid(spark):
    df = spark.createDataFrame([(e, float(i), float(i * i % 5), float(e)) for e in range(3) for i in range(4)], "entity int, x double, y double, z double").withColumn("i", F.col("x"))
    moved = features.perturb_poses(df, seed=1, fixed=F.col("entity") == 0)

    def gaps(t):
        out = {}
        for a, b in itertools.combinations(sorted(t.collect(), key=lambda r: (r["entity"], r["i"])), 2):
            if a["entity"] == b["entity"]:
                out[a["entity"], a["i"], b["i"]] = math.dist((a["x"], a["y"], a["z"]), (b["x"], b["y"], b["z"]))
        return out

    before, after = gaps(df), gaps(moved)
    assert all(after[k] == pytest.approx(v) for k, v in before.items())
    assert rows(moved.where("entity = 0"), "x", "y", "z") == rows(df.where("entity = 0"), "x", "y", "z")
    assert rows(moved.where("entity = 1"), "x", "y", "z") != rows(df.where("entity = 1"), "x", "y", "z")
