"""What a task of the neighbour search holds does not grow with copies or with the number of cells."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from measurelens.operators import neighbours as nb


def peak(run) -> int:
    tracemalloc.start()
    run()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top


def test_copies_of_a_vector_are_confirmed_in_parts():
    """all copies of a vector are candidates of all queries."""
    x = np.ones((1024, 64))
    ids = np.arange(1024)[::-1].copy()
    assert peak(lambda: nb._best(x, np.full(1024, np.inf), x, ids, 4)) < 80_000_000
    q, r, d = nb._best(x, np.full(1024, np.inf), x, ids, 4)
    assert (d == 0).all() and q.tolist() == np.repeat(np.arange(1024), 4).tolist() and ids[r].tolist() == [0, 1, 2, 3] * 1024


def test_best_rows_equal_brute_force():
    draw = np.random.default_rng(5)
    x, rows = draw.integers(0, 3, (700, 5)).astype(float), draw.integers(0, 3, (900, 5)).astype(float)
    ids = draw.permutation(900)
    q, r, d = nb._best(x, np.full(700, np.inf), rows, ids, 3)
    for i in range(700):
        away = np.sqrt(((rows - x[i]) ** 2).sum(1))
        order = np.lexsort((ids, away))[:3]
        assert r[q == i].tolist() == order.tolist() and np.array_equal(d[q == i], away[order])


def test_queries_that_visit_every_cell_leave_in_parts():
    cells = nb.Cells(np.random.default_rng(6).normal(size=(512, 8)))
    cells.count[:], cells.low[:], cells.high[:] = 10, 0.0, 1e9
    x = np.random.default_rng(7).normal(size=(1000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(x.tolist()), pa.nulls(1000, pa.float64())], ["_q", "_x", "bound"])
    parts = list(nb._routes(cells, batch, 8, 4, 2, ["_q", "_x", "bound", "cell"]))
    assert max(p.num_rows for p in parts) <= nb.PAIRS
    found = {(a, b) for p in parts for a, b in zip(p.column(0).to_pylist(), p.column(3).to_pylist())}
    query, cell = cells.visits(x, np.full(1000, np.inf), 4, 2)
    assert found == set(zip(query.tolist(), cell.tolist())) and len(found) == sum(p.num_rows for p in parts)
