"""Large groups of texts that share signatures and are not similar: links are told, pairs are not."""

from __future__ import annotations

from measurelens.llm import jaccard


def family(name, n, first):
    """Texts of 86 shingles: 72 that every family has, 13 of the family and one of the text."""
    common = [f"w{i}" for i in range(76)]
    return [(first + i, " ".join([*common, *[f"{name}{k}" for k in range(13)], f"{name}x{i}"])) for i in range(n)]


def components_of(spark, rows, monkeypatch):
    compared = []
    plain = jaccard.compare
    monkeypatch.setattr(jaccard, "compare", lambda pairs, sets: compared.append(pairs.count()) or plain(pairs, sets))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return found, sum(compared)


def test_two_large_families_give_no_pairs(spark, monkeypatch):
    rows = family("a", 150, 0) + family("b", 150, 1000)
    found, compared = components_of(spark, rows, monkeypatch)
    assert found == {i: (86, i // 1000 * 1000) for i, _ in rows}
    assert compared <= 30 * len(rows)


def test_a_link_between_large_families_is_found(spark, monkeypatch):
    rows = family("a", 40, 0) + family("b", 40, 1000) + family("c", 40, 2000)
    # between a and b: half of each tail, similar to both
    words = rows[0][1].split()[:76]
    rows.append((500, " ".join([*words, *[f"a{k}" for k in range(6)], *[f"b{k}" for k in range(6, 13)], "bx0"])))
    monkeypatch.setattr(jaccard, "nearest_pairs", lambda crowded, *_: crowded.select("a", "b").limit(0))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "CODES", 2000)
    found, _ = components_of(spark, rows, monkeypatch)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]) and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {i: c for i, (_, c) in found.items()} == root
    assert len(set(root.values())) == 2
