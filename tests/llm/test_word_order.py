"""The language model reads the text before a word, not the word alone."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from measurelens.llm import lm


def test_word_order_counts(spark):
    draw = random.Random(5)
    seen = "the cat sat on that mat and then ran".split()
    texts = [(i, " ".join(seen[draw.randrange(9) :] + seen)) for i in range(40)]
    mixed = "mat the ran cat and sat that on then".split()
    rows = [*texts, (100, " ".join(seen)), (101, " ".join(mixed)), (102, " ".join(reversed(seen)))]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert got[100].n_tokens == got[101].n_tokens and math.isclose(got[100].base_score, got[101].base_score)
    assert got[100].score > got[101].score + 1 and got[100].score > got[102].score + 1 and got[101].score != got[102].score
    for r in got.values():
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (len(dict(rows)[r.doc_id]) + 2))


def test_contexts_cross_the_edge_of_a_word():
    """Bytes of a pair see the same contexts wherever the same text stands before them."""
    pairs = lm.Pairs([pa.array(["Été ab  cd", "x ab cd", "", "zab"])])
    events = pairs.events(np.concatenate((pairs.words, pairs.ends)))
    # the texts as spelled, and the place of every byte in them
    texts = [b"\xc3\xa9t\xc3\xa9 ab cd \n", b"x ab cd \n", b"\n", b"zab \n"]
    texts[0] = b"\xc3\x89t\xc3\xa9 ab cd \n"  # only A-Z are lower-cased
    want = [(t, i) for t in texts for i in range(len(t) - 1)] + [(t, len(t) - 1) for t in texts]
    assert bytes(events.byte) == bytes(t[i] for t, i in want)
    for k, width in ((1, 2), (2, 3), (3, 5)):
        # history ends where the word before begins, so equal codes follow equal bytes, at most ``width`` of them
        history = []
        for t, i in want:
            words = t[:i].split(b" ")
            reach = len(words[-1]) + (1 + min(len(words[-2]), 4) if len(words) > 1 else 0)
            history.append(t[max(i - min(width, reach), 0) : i])
        codes = events.contexts[k].tolist()
        assert len(set(zip(history, codes))) == len(set(history)) == len(set(codes))


def test_counts_of_all_slabs_and_tasks_are_learned(spark, monkeypatch):
    """One table whatever the cut of the texts: scores differ only by the order in which weights are learned."""
    rows = [(i, f"alpha beta{i % 7} gamma delta{i % 3} omega") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.score for r in lm.score_texts(docs.coalesce(1), F.lit(True)).collect()}
    many = {r.doc_id: r.score for r in lm.score_texts(docs.repartition(5), F.lit(True)).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 0.2 * abs(one[i]) for i in one)
