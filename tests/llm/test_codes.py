"""Vector codes, fill-in-middle texts and token files against plain versions."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import re
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from measurelens.llm import fim, shards, vectors  # noqa: E402


# -- vector codes -----------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """[(id, label, code, error)] and the components of all entries, by loops over rows, parts and entries."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = sorted(((i, [math.floor(1024 * x) for x in v], g) for i, v, g in kept), key=lambda r: (r[0], r[1]))
    wide = len(whole[0][1]) // parts
    cut = [[v[k * wide : (k + 1) * wide] for k in range(parts)] for _, v, _ in whole]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda: [[min((far(p, e), n) for n, e in enumerate(books[k])) for k, p in enumerate(c)] for c in cut]
    for _ in range(rounds):
        codes = pick()
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [c[k] for c, code in zip(cut, codes) if code[k][1] == e]
                if mine:
                    books[k][e] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, g, "".join(f"{n:02x}" for _, n in code), sum(d for d, _ in code)) for (i, _, g), code in zip(whole, pick())], books


VECTOR = "vec_id long, embedding array<double>, label string, CODE string, error int"


def vector_rows(n, seed=1, wide=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(wide)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(n)]


def test_vector_codes(spark):
    rows = vector_rows(300)
    rows += [(7, rows[9][1], "a"), (7, rows[9][1], "a"), (400, None, "a"), (401, [None] + [0.0] * 7, "b"), (402, [float("nan")] * 8, "b"), (403, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTOR).repartition(5)
    for entries, rounds in ((16, 4), (256, 1), (3, 2)):
        want, books = plain_codes(rows, entries=entries, rounds=rounds)
        coded, fit = vectors.compress(df, entries=entries, rounds=rounds)
        assert sorted(map(tuple, coded.collect()), key=repr) == sorted(want, key=repr)
        assert [b.tolist() for b in fit.codebooks] == books
        assert vectors.digest(fit) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_balls_skip_only_what_is_farther():
    """Whatever ball a part starts in, the nearest entry is found; ties and equal entries go to the lower index."""
    rng = np.random.default_rng(4)
    entries = rng.integers(-50, 50, (40, 3))
    entries[30] = entries[2]
    parts = np.concatenate((rng.integers(-60, 60, (3000, 3)), entries))
    away = vectors.squared(parts, entries)
    for home in (np.zeros(len(parts), np.int64), rng.integers(0, 40, len(parts)), np.full(len(parts), 30)):
        code, best = vectors.Balls(entries).assign(parts, home)
        assert (best == away.min(1)).all() and (code == away.argmin(1)).all()
    large = entries * 200_000  # too large for exact floats
    code, best = vectors.Balls(large).assign(parts * 200_000, np.zeros(len(parts), np.int64))
    assert (code == away.argmin(1)).all() and (best == away.min(1) * 200_000**2).all()


def test_balls_spare_distances(monkeypatch):
    """Stable cores need no distance, rings only those of their neighbours."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-10_000, 10_000, (64, 4))
    home = rng.integers(0, 64, 20_000)
    parts = entries[home] + rng.integers(-400, 400, (20_000, 4))
    balls, seen, real = vectors.Balls(entries), [], vectors.squared
    monkeypatch.setattr(vectors, "squared", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    code, _ = balls.assign(parts, home)
    assert (code == real(parts, entries).argmin(1)).all()
    assert sum(seen) < 0.05 * len(parts) * len(entries)


def test_odd_vectors(spark):
    rows = [(None, [0.5] * 8, None), (None, None, "x"), (3, [0.25] * 8, "x"), (4, [0.25] * 7, "x"), (5, [1e9] * 8, "x"), (6, [0.25] * 8, None), (2, [0.5] * 6, "y"), (9, [], "y")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTOR)
    coded, fit = vectors.compress(df)
    got = sorted(((r._id, r.code, r.error) for r in coded.collect()), key=repr)
    # the smallest id, 2, has six components, filled up to eight
    assert fit.width == 6 and [b.tolist() for b in fit.codebooks] == [[[512, 512]]] * 3 + [[[0, 0]]]
    assert got == sorted([(None, None, None), (3, None, None), (4, None, None), (5, None, None), (6, None, None), (2, "00000000", 0), (9, None, None)], key=repr)
    coded, fit = vectors.compress(df.where("vec_id is null or vec_id > 2 and vec_id < 9"))
    assert fit.width == 8 and {(r._id, r.code) for r in coded.collect()} == {(None, "00000000"), (3, "01010101"), (4, None), (5, None), (6, "01010101")}
    sums = {(r._id, r._label): r.label_error for r in vectors.label_errors(coded).collect()}
    assert sums[(3, "x")] == sum(r.error or 0 for r in coded.collect() if r._label == "x")
    for empty in (df.where("false"), df.where("embedding is null"), df.where("vec_id is null")):
        coded, fit = vectors.compress(empty)
        assert fit is None and vectors.digest(fit) == hashlib.sha256(b"").hexdigest()
        assert {r.code for r in coded.collect()} <= {None}


def test_label_sums_beyond_the_broadcast(spark, monkeypatch):
    coded, _ = vectors.compress(spark.createDataFrame([(*r, "c", 1) for r in vector_rows(200)], VECTOR), entries=8)
    one = sorted(map(tuple, vectors.label_errors(coded).collect()), key=repr)
    monkeypatch.setattr(vectors, "LABELS", 1)
    assert sorted(map(tuple, vectors.label_errors(coded).collect()), key=repr) == one and len(one) == 200


# -- fill in middle ---------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m)


def test_fill_in_middle(spark, odd_docs, odd_texts, no_docs):
    rng = random.Random(6)
    bits = [" ", "\n", "\t", "\x0b", "\x85", " ", "a", "é", "\U0001f600", "<", "P>", "<P", "<S>", "$1", "\\", "日本", ".\r\n"]
    more = [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(600)] + [(2000 + i, "word " * 300_000) for i in range(4)]
    docs = odd_docs.withColumn("N", F.lit("clash")).withColumn("form", F.lit(3)).select("doc_id", "text", "N", "form", "SCORE")
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = fim.transform(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "SCORE", "n", "form", "output", "prefix_chars", "middle_chars"])
    rows = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in rows], key=repr) == sorted([(i, *plain_fim(i, t)) for i, t in odd_texts + more], key=repr)
    assert all(r.back == (r.text or "") for r in rows)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert fim.transform(no_docs).count() == 0


def test_fill_in_middle_is_one_match_without_python(spark, odd_docs):
    plan = fim.transform(odd_docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Project", 1)[0]
    assert plan.count("regexp_replace") == 1


# -- token files ------------------------------------------------------------------


def test_key_index():
    rng = random.Random(2)
    for n in (0, 1, 2, 1000, 20_000):
        keys = [str(rng.getrandbits(60)).encode() for _ in range(n)]
        codes = shards.codes_of(keys, np.zeros(n, np.int64))
        index = shards.KeyIndex.build(codes)
        assert sorted(index.slots(codes).tolist()) == list(range(n))  # minimal and perfect
        strangers = shards.codes_of([b"x" + k for k in keys], np.zeros(n, np.int64))
        assert (index.slots(strangers) == -1).all()
        assert index.base[-1] <= 8 * n + 64 * 8
    with pytest.raises(ValueError):
        shards.KeyIndex.build(np.zeros((2, 2), np.uint64))


def by_hand(rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(shards.vocabulary_path())
    return {t: library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}


def test_token_files(spark, odd_docs, odd_texts, no_docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    ids = by_hand(odd_texts)
    for n, size in enumerate((shards.SHARD, 3_000)):  # one shard a range, and many
        folder = str(tmp_path / f"out{n}")
        listed = shards.write(odd_docs, folder, shard_bytes=size).orderBy("part", "seq").collect()
        assert sum(r.n_docs for r in listed) == len(odd_texts) and (len(listed) > 20 or n == 0)
        payload = b"".join(open(f"{folder}/{r.bin}", "rb").read() for r in listed)
        flat = np.frombuffer(payload, "<u2").tolist()
        got = [tuple(r) for r in shards.scan(spark, folder).collect()]
        got.sort(key=lambda r: r[1])
        # ascending keys, nulls first; the documents lie one after another
        assert [r[0] for r in got] == sorted((i for i, _ in odd_texts), key=lambda i: (i is not None, i))
        assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
        want = sorted(((i, len(ids[t]), zlib.crc32(struct.pack(f"<{len(ids[t])}I", *ids[t]))) for i, t in odd_texts), key=repr)
        assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == want
        assert all(zlib.crc32(struct.pack(f"<{n}I", *flat[a : a + n])) == crc for _, a, n, crc in got)
        keys = spark.createDataFrame([(i,) for i in (8, 10, 8, None, 555_555, 3)], "doc_id long")
        found = [(r.key, r.start, list(r.ids)) for r in shards.lookup(keys, folder).collect()]
        assert sorted(((k, d) for k, _, d in found), key=repr) == sorted(((i, ids[t]) for i, t in odd_texts if i in (8, 10, None, 3)), key=repr)
        assert all(flat[a : a + len(d)] == d for _, a, d in found)
    empty = str(tmp_path / "none")
    assert shards.write(no_docs, empty).count() == 0 and shards.scan(spark, empty).count() == 0


def test_token_files_of_a_hot_key(spark, tmp_path):
    """One key with most rows is divided among tasks; text keys work as well."""
    rows = [("hot", f"text number {i % 50}") for i in range(2000)] + [(f"k{i}", "a b c") for i in range(500)] + [("", "empty key"), ("0", "zero")]
    docs = spark.createDataFrame(rows, "name string, body string").repartition(6)
    folder = str(tmp_path / "out")
    listed = shards.write(docs, folder, key="name", text="body", shard_bytes=4_000).collect()
    hot = [r for r in listed if r.first_key == r.last_key == "hot"]
    assert len({r.part for r in hot}) > 3
    got = shards.scan(spark, folder, "string").collect()
    assert sorted(r.key for r in got) == sorted(k for k, _ in rows)
    found = shards.lookup(spark.createDataFrame([("hot",), ("0",), ("",), ("gone",)], "name string"), folder, key="name").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in found} == {"hot": 2000, "0": 1, "": 1}


def test_damaged_files_are_refused(spark, tmp_path):
    folder = str(tmp_path / "out")
    shards.write(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), folder)
    (bin_,) = glob.glob(f"{folder}/data/*.bin")
    with open(bin_, "ab") as f:
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="differ in length"):
        shards.scan(spark, folder).collect()


def test_mixed_logits_without_a_matrix_of_predictors():
    from measurelens.llm import lm

    draw = np.random.default_rng(3)
    mixer = lm.Mixer(lm.huffman(draw.integers(1, 999, 256)), draw.integers(0, 50, (lm.ALL_SLOTS, 2)), draw.normal(0.3, 0.1, (lm.GATES, len(lm.SLOTS))))
    sizes = draw.integers(1, 9, 300)
    events = lm.Events(*lm.spelled(draw.integers(97, 122, int(sizes.sum())).astype(np.uint8), sizes, np.arange(300)), np.arange(300) % 8)
    for at, node, _ in mixer.steps(events):
        assert np.allclose(mixer.dot(events, at, node), mixer.mixed(*mixer.inputs(events, at, node)), rtol=0, atol=1e-12)
