"""Readers, writers and fingerprints on small files."""

from __future__ import annotations

import csv
import hashlib
import json
import random

import pytest

from measurelens.sources import tables


def test_delimited_reader(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("molecule_id\tsmiles\tIC50_nM\tyear\n007\tC \t100\t2001\n8\tCC\t1000\tx\n9\t\t5\t2000\n10\tC\t\t2000\n")
    got = tables.read_measurement_table(spark, str(path), value="IC50_nM", unit="nM", year="year").collect()
    assert [(r["molecule_id"], r["smiles"], r["pactivity"], r["document_year"]) for r in got] == [("007", "C", 7.0, 2001), ("8", "CC", 6.0, None)]
    assert [r["record_id"] for r in got] == ["m.tsv:2", "m.tsv:3"]
    with pytest.raises(ValueError, match="missing required"):
        tables.read_measurement_table(spark, str(path), value="absent")
    bad = tmp_path / "b.csv"
    bad.write_text("molecule_id,smiles,pactivity\n1,C,abc\n")
    with pytest.raises(Exception, match="not a number"):
        tables.read_measurement_table(spark, str(bad)).collect()
    assert tables.read_prediction_input(spark, str(bad)).collect()[0]["smiles"] == "C"


def test_json_reader_counts(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("\n".join(json.dumps({"activity_id": i, "standard_value": "1.5", "extra": 1}) for i in range(3)))
    assert tables.read_activity_records(spark, str(path), expected=3).count() == 3
    with pytest.raises(ValueError, match="expected 4"):
        tables.read_activity_records(spark, str(path), expected=4)


def test_fingerprint_ignores_order_and_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([("x", 1), (None, 2), ("x", 1)], "b string, a int")
    c = spark.createDataFrame([("x", 1), ("y", 2)], "b string, a int")
    f = lambda d: tables.content_fingerprint(d, ["a", "b"]).head()
    assert f(a) == f(b) and f(a) != f(c)


def test_guarded_writer_and_manifest(spark, tmp_path):
    df = spark.range(3)
    out = str(tmp_path / "out")
    tables.write_results(spark, {"t": df}, out, record={"a": 1})
    tables.write_results(spark, {"t": df}, out, record={"a": 2}, kind="csv")
    assert json.loads((tmp_path / "out" / "provenance.json").read_text()) == {"a": 2}
    other = tmp_path / "other"
    other.mkdir()
    (other / "keep.txt").write_text("x")
    with pytest.raises(ValueError, match="not written here"):
        tables.write_results(spark, {"t": df}, str(other), record={})
    good = hashlib.sha256(b"x").hexdigest()
    tables.verify_manifest(spark, str(other), {"keep.txt": good})
    with pytest.raises(ValueError, match="differs"):
        tables.verify_manifest(spark, str(other), {"keep.txt": "0" * 64})


def plain_records(path, sep=","):
    """[(number, fields)] by one reader over the whole file; blank lines do not count."""
    with open(path, newline="") as f:
        rows = [r for r in csv.reader(f, delimiter=sep) if r and not (len(r) == 1 and not r[0].strip())]
    return [(i, [x.replace("\r\n", "\n") or None for x in r]) for i, r in enumerate(rows[1:], 2)]


@pytest.mark.parametrize("kind", ["plain", "blank", "quoted"])
def test_record_numbers_over_splits(spark, tmp_path, kind):
    """A file of many splits, with blank lines and with line breaks and quotes inside fields, equals one reader's."""
    rng = random.Random(3)
    out = ["id,note,v"]
    for i in range(4000):
        note = rng.choice(["a", "", "x y", "é"])
        if kind == "quoted" and i % 7 == 0:
            note = '"' + rng.choice(["two\nlines", 'say ""so""', "a,b", "one\n\n\nfour", "end\n", '""\n""']) + '"'
        out.append(f"{i},{note},{i / 8}")
        if kind != "plain" and i % 11 == 0:
            out.append(rng.choice(["", "  "]))
    path = tmp_path / "many.csv"
    path.write_text("\n".join(out) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = tables.numbered_records(spark, str(path), ",")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
        got = sorted((r.record, [r.id, r.note, r.v]) for r in df.collect())
        assert got == plain_records(path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_record_numbers_of_several_files(spark, tmp_path):
    for n, rows in (("a", 3), ("b", 5)):
        (tmp_path / f"{n}.csv").write_text("molecule_id,smiles,pactivity\n" + "".join(f'{i},"C\nC",5.0\n' for i in range(rows)))
    got = tables.read_measurement_table(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got) == [f"a.csv:{i}" for i in range(2, 5)] + [f"b.csv:{i}" for i in range(2, 7)]
    assert {r.smiles for r in got} == {"C\nC"}
    (tmp_path / "c.csv").write_text("other,header\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_measurement_table(spark, str(tmp_path))
    (tmp_path / "open.csv").write_text('molecule_id,smiles,pactivity\n1,"C,5.0\n2,C,6.0\n')
    with pytest.raises(ValueError, match="never ends"):
        tables.read_measurement_table(spark, str(tmp_path / "open.csv"))
