"""A query goes to a bin of cells once, however many of its cells it visits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from measurelens.operators import neighbours as nb


def test_a_query_travels_once_per_bin(monkeypatch):
    """many small cells that nothing rules out."""
    monkeypatch.setattr(nb, "BLOCK", 1000)
    cells = nb.Cells(np.random.default_rng(6).normal(size=(512, 8)))
    cells.count[:], cells.low[:], cells.high[:] = 10, 0.0, 1e9
    bins = cells.bins()
    assert np.bincount(bins, weights=cells.count).max() <= 1010 and len(np.unique(bins)) == 6
    x = np.random.default_rng(7).normal(size=(100, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(x.tolist()), pa.nulls(100, pa.float64())], ["_q", "_x", "bound"])
    names = ["_q", "_x", "bound", "bin", "cells"]
    parts = [nb._packed(p, bins, names) for p in nb._routes(cells, batch, 8, 4, 2, [*names[:3], "cell"])]
    # a query that lies in two batches may have two rows for a bin
    assert sum(p.num_rows for p in parts) <= 100 * 6 + 6 * (len(parts) - 1)
    found = [(q, c) for p in parts for q, b, cs in zip(p.column(0).to_pylist(), p.column(3).to_pylist(), p.column(4).to_pylist()) for c in cs if bins[c] == b]
    query, cell = cells.visits(x, np.full(100, np.inf), 4, 2)
    assert sorted(found) == sorted(zip(query.tolist(), cell.tolist()))
    assert all(x[q].tolist() == v for p in parts for q, v in zip(p.column(0).to_pylist(), p.column(1).to_pylist()))


def test_nearest_rows_of_many_cells_move_little(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows, asked = draw.normal(size=(900, 12)), draw.normal(size=(200, 12))
    r = spark.createDataFrame([(i, float(i % 3), x.tolist()) for i, x in enumerate(rows)], "id long, v double, x array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "q long, x array<double>")
    moved, plain = [], nb._meet

    def counted(routed, *rest):
        moved.append(routed.count())
        return plain(routed, *rest)

    monkeypatch.setattr(nb, "_meet", counted)
    for block in (nb.BLOCK, 100):
        monkeypatch.setattr(nb, "BLOCK", block)
        moved.clear()
        got = nb.nearest(q, r, query="q", row="id", array="x", value="v", width=12, k=4)
        found = {(g["_q"], g.place): g["_id"] for g in got.collect()}
        away = np.sqrt(((asked[:, None] - rows[None]) ** 2).sum(2))
        best = np.argsort(away, axis=1, kind="stable")[:, :4]
        assert found == {(i, j + 1): int(best[i, j]) for i in range(200) for j in range(4)}
        # one row per query, bin and step at most; before, one per cell of about 30 rows
        assert sum(moved) <= 3 * 200 * -(-900 // block)
