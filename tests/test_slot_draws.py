"""Draws of slots: the md5 of many numbers at once, and parts that are counted together."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from measurelens.operators import metrics


@pytest.mark.parametrize("prefix", ["", "42:1:", "42:500:", "abc:", "a prefix that reaches over several words: "])
def test_hashes_equal_the_library(prefix):
    numbers = np.array([0, 7, 9, 10, 99, 100, 12345, 99999, 10**9, 10**12 - 1, 5])
    want = [int.from_bytes(hashlib.md5(f"{prefix}{i}".encode()).digest()[:8], "big") >> 12 for i in numbers.tolist()]
    assert metrics.numbers_hashed([prefix, f"{prefix}x"], numbers)[0].tolist() == want


def test_a_text_of_more_than_a_block_is_refused():
    with pytest.raises(ValueError):
        metrics.numbers_hashed(["x" * 55], np.array([1]))


def test_small_parts_are_counted_together():
    parts = [np.arange(k, dtype=np.uint32) for k in range(20)]
    joined = list(metrics._joined(iter(parts), 50))
    assert np.concatenate(joined).tolist() == np.concatenate(parts).tolist()
    assert all(len(j) >= 50 for j in joined[:-1]) and len(joined) == 4
    assert list(metrics._joined(iter([]), 5)) == []
