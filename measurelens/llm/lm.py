"""Language-model scores: a unigram base and online logistic context mixing.

A text is its lower-cased words and one end; a word is spelled as its bytes and a
space, the end as a line feed, so the model is a distribution over token
sequences.  Bytes are coded as bits along a Huffman tree of the training bytes.
Every bit has several predictors, one per hashed context: the last one, two, three
and five bytes of the text, across the edge of a word, the word so far, and the word
so far after the word before it.  Their logits are mixed with weights chosen by how
much the contexts have seen, learned by online logistic regression, and the result
is refined by an adaptive map of probability and place in the word.

All training texts count.  A token's contexts end at the word before it, so equal
pairs of words within a slab of texts are learned and scored once, with their
number as weight.  For the base, words travel to the task of their code range as a
dictionary per slab with short indexes.  The tables that are broadcast have a fixed
number of slots.  A predictor's own occurrence is left out while the mixing
weights are learned.  Words are told apart by 64-bit code.

Null and empty texts are one end token.  Without training texts every count is 0
and the model is uniform over bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import SPACED, Words, documents, learn_bucket, mix, name_of, prefix_codes, ragged, share, slabs, span_codes
from measurelens.operators.common import settle

ADD = 0.1  # to every count of the base
SLAB = 12_000_000  # bytes of text that share one dictionary
SLOTS = (16, 18, 20, 20, 20, 20)  # bits of the table of each context
CHUNK = 1 << 17  # slots that travel in one row
SPLITS = 16  # of the input that share one table of counts, on inputs of many splits
PIECE = 10_000  # pairs of words that are worked on at once
PRIOR = 0.4
RATE = 0.05
GATES = 8 * 4
PLACES, KNOTS = 8, 33
END = 0x0A


class Tokens:
    """Word codes and spans of one column of texts."""

    def __init__(self, col: pa.Array):
        w = Words(col, SPACED)
        self.words, self.count = w, w.count
        self.codes = w.codes()


def dictionary(tokens: list[Tokens]):
    """(distinct codes, index of every word, bytes of the distinct words, their lengths)."""
    code = np.concatenate([t.codes for t in tokens])
    names, first, index = np.unique(code, return_index=True, return_inverse=True)
    base = np.cumsum([0] + [len(t.codes) for t in tokens])
    part = np.searchsorted(base, first, "right") - 1
    sizes, bodies = np.zeros(len(names), np.int64), []
    order = np.argsort(part, kind="stable")
    for i, t in enumerate(tokens):
        mine = order[np.searchsorted(part[order], i) : np.searchsorted(part[order], i + 1)]
        at = first[mine] - base[i]
        start, size = t.words.starts[at], (t.words.ends - t.words.starts)[at]
        sizes[mine] = size
        bodies.append(t.words.data[np.repeat(start, size) + ragged(size)])
    body = np.concatenate(bodies)
    begin = np.zeros(len(names), np.int64)
    begin[order] = np.cumsum(sizes[order]) - sizes[order]
    return names, index.ravel(), body[np.repeat(begin, sizes) + ragged(sizes)], sizes


PARTS = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("slab", T.LongType()),
        T.StructField("codes", T.BinaryType()),  # of the dictionary's words in this range
        T.StructField("body", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("uses", T.BinaryType()),  # word index of training tokens
        T.StructField("times", T.BinaryType()),
        T.StructField("texts", T.BinaryType()),  # how many entries each text has here
        T.StructField("entries", T.BinaryType()),  # word index of every token
    ]
)


def dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """One row per slab and code range, and a row per slab with the ids (as range of the slab's own)."""
    head = T.StructType([*PARTS, T.StructField("id", T.ArrayType(rows.schema["_id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in ("hash", "train")]])
    names = head.fieldNames()

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, slab in enumerate(slabs(batches, SLAB)):
            slab_id = (task << 32) + number
            tokens = [Tokens(p.column(0)) for p in slab]
            train = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in slab]).astype(np.bool_)
            hashes = np.concatenate([p.column(3).to_numpy() for p in slab])
            count = np.concatenate([t.count for t in tokens])
            ids = pa.concat_arrays([p.column(1) for p in slab])
            n = len(count)
            codes, index, body, sizes = dictionary(tokens)
            text = np.repeat(np.arange(n), count)
            cell = ((codes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)  # codes are sorted, so ranges are stretches
            cuts = np.searchsorted(cell, np.arange(ranges + 1))
            body_at = np.concatenate(([0], np.cumsum(sizes)))
            word_cell = cell[index]
            order = np.argsort(word_cell.astype(np.int32), kind="stable")
            word_cuts = np.searchsorted(word_cell[order], np.arange(ranges + 1))
            empty = pa.array([None], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([slab_id % ranges], pa.int32()), pa.array([slab_id]), *[empty] * 7, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.array([hashes.tobytes()]), pa.array([train.tobytes()])],
                names,
            )
            for r in range(ranges):
                mine = order[word_cuts[r] : word_cuts[r + 1]]
                if not len(mine):
                    continue
                a, b = cuts[r], cuts[r + 1]
                entry = index[mine] - a
                used, times = np.unique(entry[train[text[mine]]], return_counts=True)
                small = np.uint16 if b - a <= 1 << 16 else np.uint32
                values = [codes[a:b], body[body_at[a] : body_at[b]], sizes[a:b].astype(np.uint32), used.astype(np.uint32), times.astype(np.uint32), np.bincount(text[mine], minlength=n).astype(np.uint32), entry.astype(small)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([slab_id]), *[pa.array([v.tobytes()], pa.binary()) for v in values], pa.nulls(1, pa.list_(ids.type)), *[empty] * 2], names
                )

    return rows.select("_text", "_id", "_train", "_hash").mapInArrow(run, head)


def reduced(parts: DataFrame) -> DataFrame:
    """Per code range: sums for every text of every slab, and totals of the vocabulary; slab heads pass through."""
    head = parts.schema
    schema = T.StructType(
        [
            T.StructField("what", T.StringType()),
            T.StructField("slab", T.LongType()),
            *[T.StructField(c, T.BinaryType()) for c in ("a", "b", "c")],
            head["id"],
        ]
    )
    names = schema.fieldNames()

    def run(batches):
        held, id_type = [], None

        def row(what, slab, blobs, ids=None):
            blobs = [*blobs, *[None] * (3 - len(blobs))]
            return pa.RecordBatch.from_arrays([pa.array([what]), pa.array([slab], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs], ids if ids is not None else pa.nulls(1, id_type)], names)

        for batch in batches:
            id_type = batch.column(9).type
            for i, r in enumerate(batch.select(names_in).to_pylist()):
                if r["codes"] is None:
                    one = batch.slice(i, 1)
                    yield row("head", r["slab"], [r["hash"], r["train"]], one.column(9))
                else:
                    held.append({k: np.frombuffer(r[k], t) for k, t in (("codes", np.uint64), ("body", np.uint8), ("sizes", np.uint32), ("uses", np.uint32), ("times", np.uint32), ("texts", np.uint32))} | {"slab": r["slab"], "entries": r["entries"]})
        if not held:
            return
        codes, first = np.unique(np.concatenate([h["codes"] for h in held]), return_index=True)
        total = np.zeros(len(codes), np.int64)
        where = [np.searchsorted(codes, h["codes"]) for h in held]
        for h, w in zip(held, where):
            np.add.at(total, w[h["uses"]], h["times"].astype(np.int64))
        value = np.log10(total + ADD)
        for h, w in zip(held, where):
            entries = np.frombuffer(h["entries"], np.uint16 if len(h["codes"]) <= 1 << 16 else np.uint32)
            text = np.repeat(np.arange(len(h["texts"])), h["texts"])
            word = w[entries]
            n = len(h["texts"])
            yield row("sums", h["slab"], [np.bincount(text, weights=value[word], minlength=n).tobytes(), h["texts"].astype(np.int64).tobytes(), np.bincount(text, weights=total[word] > 0, minlength=n).astype(np.int64).tobytes()])
        # the vocabulary: distinct trained words
        size = np.concatenate([h["sizes"] for h in held]).astype(np.int64)
        body = np.concatenate([h["body"] for h in held])
        begin = np.cumsum(size) - size
        known = np.flatnonzero(total > 0)
        size, begin = size[first[known]], begin[first[known]]
        chosen = body[np.repeat(begin, size) + ragged(size)]
        weights = np.repeat(total[known], size).astype(float)
        bytes_ = np.bincount(chosen, weights=weights, minlength=256).astype(np.int64)
        bytes_[0x20] += int(total.sum())
        yield row("totals", 0, [np.array([total.sum(), len(known)], np.int64).tobytes(), bytes_.tobytes()])

    names_in = ["slab", "codes", "body", "sizes", "uses", "times", "texts", "entries", "hash", "train"]
    return parts.mapInArrow(run, schema)


def huffman(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, bit) of every step of each byte's path, and the path's length."""
    heap = [(int(f) + 1, b, (b,)) for b, f in enumerate(freq)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        x, y = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in enumerate((x, y)):
            for b in side[2]:
                paths[b].append((node, bit))
        heapq.heappush(heap, (x[0] + y[0], min(x[1], y[1]), x[2] + y[2]))
    length = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((256, length.max()), np.int64), np.zeros((256, length.max()), np.int8)
    for b, p in enumerate(paths):
        for k, (node, bit) in enumerate(reversed(p)):
            nodes[b, k], bits[b, k] = node, bit
    return nodes, bits, length


class Events:
    """The bytes of spelled tokens with their contexts.

    ``before`` is a code of the word before each token, 0 where the text begins;
    ``tails`` its last bytes, as ``last_bytes`` packs them.
    """

    def __init__(self, body: np.ndarray, sizes: np.ndarray, before: np.ndarray, tails: np.ndarray | None = None):
        starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = ragged(sizes)
        self.byte = body
        before = before.astype(np.uint64)
        tails = np.zeros(len(sizes), np.uint64) if tails is None else tails
        # bytes back from the token's start: the space between, then the end of the word before
        back = np.where(before != 0, np.uint64(0x21), np.uint64(0)) + (tails << np.uint64(9))
        wide = body.astype(np.uint64) + np.uint64(1)
        past = []
        for k in range(1, 6):
            x = np.zeros(len(body), np.uint64)
            x[k:] = wide[: max(len(body) - k, 0)]
            cross = np.flatnonzero(self.place < k)
            x[cross] = (back[self.owner[cross]] >> (9 * (k - 1 - self.place[cross])).astype(np.uint64)) & np.uint64(511)
            past.append(x)
        prefix = prefix_codes(body)
        so_far = span_codes(prefix, starts[self.owner], starts[self.owner] + self.place)
        near = np.minimum(self.place, 3).astype(np.uint64)
        two = past[0] + (past[1] << np.uint64(9))
        three = two + (past[2] << np.uint64(18))
        five = three + (past[3] << np.uint64(27)) + (past[4] << np.uint64(36))
        raw_contexts = [past[0] * np.uint64(4) + near, two, three, five, so_far, so_far + before[self.owner] * np.uint64(0x9E3779B97F4A7C15)]
        self.contexts = [mix(c + np.uint64((i + 1) << 56)) for i, c in enumerate(raw_contexts)]

    def slots(self, at: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """Slot in the joint table of every context, for bytes ``at`` at tree nodes ``node``."""
        out, base = [], 0
        code = node.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for c, bits in zip(self.contexts, SLOTS):
            h = c[at]
            h += code
            h *= np.uint64(0xD6E8FEB86659FD93)
            h >>= np.uint64(64 - bits)
            out.append(h.view(np.int64))
            out[-1] += base
            base += 1 << bits
        return out


def steps_of(tree, events: Events):
    """(bytes that take a k-th step, node, bit) for k = 0, 1, ..."""
    nodes, bits, length = tree
    live = np.arange(len(events.byte))
    for k in range(nodes.shape[1]):
        live = live[length[events.byte[live]] > k]
        if not len(live):
            return
        b = events.byte[live]
        yield live, nodes[b, k], bits[b, k].astype(np.float32)


ALL_SLOTS = sum(1 << b for b in SLOTS)


def classes(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight and four classes of how often a context was seen."""
    size = np.log2(seen + 1)
    return np.minimum(size, 7).astype(np.uint8), np.minimum(size / 3, 3).astype(np.uint8)


class Mixer:
    """Tables of bit counts, mixing weights and the refining map."""

    def __init__(self, tree, counts: np.ndarray, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.tree = tree
        self.counts = counts  # [slot, bit]
        self.ready: dict[bool, tuple] = {}  # logit and classes of every slot, once the counts are final
        self.weights = np.full((GATES, len(SLOTS)), 0.3) if weights is None else weights
        self.refine = refine

    def final(self, left_out: bool) -> tuple:
        """Logit and classes of every slot; where one occurrence of a bit is left out, of every slot and bit."""
        if left_out not in self.ready:
            size = len(self.counts) * (2 if left_out else 1)
            logit, eight, four = self.ready[left_out] = np.empty(size, np.float32), np.empty(size, np.uint8), np.empty(size, np.uint8)
            for a in range(0, len(self.counts), CHUNK):
                n = self.counts[a : a + CHUNK].astype(np.float32)
                less = np.maximum(n - 1, 0)
                # [slot, bit that is left out]
                n0, n1 = (np.stack((less[:, 0], n[:, 0]), axis=1), np.stack((n[:, 1], less[:, 1]), axis=1)) if left_out else (n[:, 0], n[:, 1])
                at = slice(a * size // len(self.counts), a * size // len(self.counts) + n0.size)
                logit[at] = np.log((n1 + PRIOR) / (n0 + PRIOR)).ravel()
                eight[at], four[at] = (c.ravel() for c in classes(n0 + n1))
        return self.ready[left_out]

    def gathered(self, events: Events, at, node, own=None):
        """(logits of each predictor, gate); ``own`` is a bit whose one occurrence is left out.

        The gate is the set of mixing weights: how often the word so far was seen
        after the word before, and after any.
        """
        logit, eight, four = self.final(own is not None)
        slots = events.slots(at, node)
        if own is not None:
            side = own > 0
            slots = [s * 2 + side for s in slots]
        return [np.take(logit, s) for s in slots], np.take(eight, slots[5]).astype(np.int64) * 4 + np.take(four, slots[4])

    def inputs(self, events: Events, at, node, own=None):
        """Like ``gathered``, the logits as one matrix."""
        logits, gate = self.gathered(events, at, node, own)
        return np.stack(logits, axis=1), gate

    def mixed(self, logits, gate):
        return np.clip(np.einsum("ij,ij->i", logits, self.weights[gate]), -12, 12)

    def blend(self, logits: list, gate):
        """Mixed logits without a matrix of all predictors."""
        total = np.zeros(len(gate))
        for logit, weight in zip(logits, np.ascontiguousarray(self.weights.T)):
            total += logit * np.take(weight, gate)
        return np.clip(total, -12, 12, out=total)

    def dot(self, events: Events, at, node):
        """Mixed logits from the final counts."""
        return self.blend(*self.gathered(events, at, node))

    def refined(self, dot, place):
        p = 1.0 / (1.0 + np.exp(-dot))
        if self.refine is None:
            return p
        x = (dot + 12) / 24 * (KNOTS - 1)
        low = np.minimum(x.astype(np.int64), KNOTS - 2)
        part, row = x - low, np.minimum(place, PLACES - 1)
        return 0.5 * p + 0.5 * (self.refine[row, low] * (1 - part) + self.refine[row, low + 1] * part)

    def steps(self, events: Events):
        return steps_of(self.tree, events)

    def log10(self, events: Events, n: int) -> np.ndarray:
        """log10 probability of every token."""
        out = np.zeros(len(events.byte))
        for at, node, bit in self.steps(events):
            p = self.refined(self.dot(events, at, node), events.place[at])
            out[at] += np.log10(np.clip(np.where(bit > 0, p, 1 - p), 1e-9, 1.0))
        return np.bincount(events.owner, weights=out, minlength=n)


def spelled(body: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words ``which``, each with a space behind it; word len(sizes) is the end."""
    ends = np.cumsum(sizes)
    data = np.concatenate((body, np.array([END], np.uint8)))
    begin = np.concatenate((ends - sizes, [len(body)]))[which]
    size = np.concatenate((sizes, [1]))[which]
    is_end = which == len(sizes)
    full = size + ~is_end
    place = ragged(full)
    at = np.repeat(begin, full) + place
    inside = place < np.repeat(size, full)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(0x20)), full


def last_bytes(body: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last four bytes of every word, nine bits each and the last one lowest; 0 stands for none."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.uint64)
    for k in range(4):
        has = np.flatnonzero(sizes > k)
        out[has] += (body[ends[has] - 1 - k].astype(np.uint64) + np.uint64(1)) << np.uint64(9 * k)
    return out


class Pairs:
    """Every token of a slab of texts with the word before it, as one number; the end is a token too."""

    def __init__(self, texts: list[pa.Array]):
        tokens = [Tokens(t) for t in texts]
        codes, index, self.body, self.sizes = dictionary(tokens)
        count = np.concatenate([t.count for t in tokens])
        self.n = len(codes) + 1
        self.before = np.concatenate((np.zeros(1, np.uint64), codes | np.uint64(1)))  # 0 is the start of a text
        self.tails = np.concatenate((np.zeros(1, np.uint64), last_bytes(self.body, self.sizes)))
        self.text = np.repeat(np.arange(len(count)), count)
        last = np.concatenate((np.zeros(1, np.int64), index + 1))
        previous = last[:-1].copy()
        ends = np.cumsum(count)
        previous[(ends - count)[count > 0]] = 0
        self.words = index * self.n + previous
        self.ends = (self.n - 1) * self.n + np.where(count > 0, last[ends], 0)
        self.bytes = np.bincount(self.text, weights=self.sizes[index] + 1, minlength=len(count)) + 1

    def events(self, keys: np.ndarray) -> Events:
        which, previous = np.divmod(keys, self.n)
        return Events(*spelled(self.body, self.sizes, which), self.before[previous], self.tails[previous])


def learned(batches):
    """(Events, times) of the distinct pairs of training texts, in pieces of moderate size."""
    for slab in slabs(batches, SLAB):
        pairs = Pairs([p.column(0) for p in slab])
        used, times = np.unique(np.concatenate((pairs.words, pairs.ends)), return_counts=True)
        for a in range(0, len(used), PIECE):
            yield pairs.events(used[a : a + PIECE]), times[a : a + PIECE]


def train(texts: DataFrame, freq: np.ndarray) -> Callable[[], Mixer]:
    """Fit the mixer on the column ``_text`` and return how tasks get it."""
    spark = texts.sparkSession
    tree = huffman(freq)
    chunks = -(-ALL_SLOTS // CHUNK)
    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("n", T.BinaryType())])

    def tabled(batches):
        counts = None
        for events, times in learned(batches):
            counts = np.zeros(chunks * CHUNK * 2, np.uint32) if counts is None else counts
            for at, node, bit in steps_of(tree, events):
                weight, side = times[events.owner[at]].astype(np.uint32), bit > 0
                for s in events.slots(at, node):
                    np.add.at(counts, s * 2 + side, weight)
        for c in range(chunks if counts is not None else 0):
            part = counts[c * CHUNK * 2 : (c + 1) * CHUNK * 2]
            if part.any():
                filled = np.flatnonzero(part)
                packed = np.stack((filled.astype(np.uint32), part[filled]))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([packed.tobytes()])], ["chunk", "n"])

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, value = np.frombuffer(n.as_buffer(), np.uint32).reshape(2, -1)
                held.setdefault(c, np.zeros(CHUNK * 2))[at] += value
        for c, n in held.items():
            filled = np.flatnonzero(n)
            packed = np.concatenate((filled.astype(np.uint32).view(np.float32), n[filled].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([packed.tobytes()])], ["chunk", "n"])

    counts = np.zeros((chunks * CHUNK, 2), np.float32)
    # every task sends a table, so few tasks make them
    tables_made = max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // SPLITS)
    total = texts.coalesce(tables_made).mapInArrow(tabled, schema).repartitionById(chunks, F.col("chunk")).mapInArrow(summed, schema)
    for r in total.toLocalIterator():  # a fixed number of chunks
        at, value = np.frombuffer(r.n, np.float32).reshape(2, -1)
        counts.reshape(-1)[at.copy().view(np.uint32).astype(np.int64) + r.chunk * CHUNK * 2] = value
    # half precision: large counts shrink in proportion
    counts *= np.minimum(1.0, 60_000 / np.maximum(counts.max(axis=1, keepdims=True), 1)).astype(np.float32)
    tables = share(spark, (tree, counts.astype(np.float16)))
    sums = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("h", T.BinaryType()), T.StructField("n", T.DoubleType())])

    def weigh(batches):
        mixer = None
        seen, hist = 0.0, np.zeros(PLACES * KNOTS * 2)
        for events, times in learned(batches):
            if mixer is None:
                mixer = Mixer(*tables())
                energy = np.full(mixer.weights.shape, 1e-3)
            for at, node, bit in mixer.steps(events):
                for a in range(0, len(at), 8192):
                    i, b = at[a : a + 8192], bit[a : a + 8192]
                    logits, gate = mixer.gathered(events, i, node[a : a + 8192], b)
                    w = times[events.owner[i]].astype(float)
                    dot = mixer.blend(logits, gate)
                    # the refining map learns from what the weights gave before this step
                    knot = np.rint((dot + 12) / 24 * (KNOTS - 1)).astype(np.int64)
                    hist += np.bincount((np.minimum(events.place[i], PLACES - 1) * KNOTS + knot) * 2 + (b > 0), weights=w, minlength=len(hist))
                    error = (b - 1.0 / (1.0 + np.exp(-dot))) * w
                    mass = np.maximum(np.bincount(gate, weights=w, minlength=GATES), 1.0)[:, None]
                    step = np.stack([np.bincount(gate, weights=error * logit, minlength=GATES) for logit in logits], axis=1) / mass
                    energy += step**2
                    mixer.weights = np.clip(mixer.weights + RATE * step / np.sqrt(energy), -2, 4)
                    seen += w.sum()
        if mixer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([(mixer.weights * seen).tobytes()]), pa.array([hist.tobytes()]), pa.array([seen])], ["a", "h", "n"])

    weights = refine = None
    parts = texts.mapInArrow(weigh, sums).collect()  # two small matrices per partition
    if parts:
        weights = sum(np.frombuffer(p.a).reshape(GATES, -1) for p in parts) / sum(p.n for p in parts)
        hist = sum(np.frombuffer(p.h) for p in parts).reshape(PLACES, KNOTS, 2)
        knots = 1.0 / (1.0 + np.exp(-np.linspace(-12, 12, KNOTS)))
        refine = (hist[:, :, 1] + 20 * knots) / (hist.sum(axis=2) + 20)
    return lambda: Mixer(*tables(), weights, refine)  # the tables are already there


def model_scores(rows: DataFrame, fetch: Callable[[], Mixer]) -> DataFrame:
    """(_id, _hash, score, bits_per_byte) per text."""
    schema = T.StructType([rows.schema["_id"], rows.schema["_hash"], T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches):
        mixer = None
        for slab in slabs(batches, SLAB):
            mixer = mixer or fetch()
            pairs = Pairs([p.column(0) for p in slab])
            used, where = np.unique(np.concatenate((pairs.words, pairs.ends)), return_inverse=True)
            value = np.zeros(len(used))
            for a in range(0, len(used), PIECE):
                part = used[a : a + PIECE]
                value[a : a + PIECE] = mixer.log10(pairs.events(part), len(part))
            value = value[where]
            n = len(pairs.words)
            total = np.bincount(pairs.text, weights=value[:n], minlength=len(pairs.ends)) + value[n:]
            ratio = -total / np.log10(2) / pairs.bytes
            done = 0
            for p in slab:
                m = p.num_rows
                yield pa.RecordBatch.from_arrays([p.column(1), p.column(2), pa.array(total[done : done + m]), pa.array(ratio[done : done + m])], schema.fieldNames())
                done += m

    return rows.select("_text", "_id", "_hash").mapInArrow(run, schema)


def base_scores(slim: DataFrame, n_train: int, tokens: int, distinct: int) -> DataFrame:
    """(_id, _hash, _train, n_tokens, n_known, base_score) per text, from the sums of all code ranges."""
    schema = T.StructType(
        [
            T.StructField("_id", slim.schema["id"].dataType.elementType),
            T.StructField("_hash", T.LongType()),
            *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
            T.StructField("base_score", T.DoubleType()),
        ]
    )
    whole = np.log10(tokens + ADD * (distinct + 1))
    end = np.log10(n_train + ADD)

    def run(batches):
        sums: dict[int, list] = {}
        heads = {}
        for batch in batches:
            for i, r in enumerate(batch.select(["what", "slab", "a", "b", "c"]).to_pylist()):
                if r["what"] == "head":
                    heads[r["slab"]] = (batch.column(5).slice(i, 1).flatten(), np.frombuffer(r["a"], np.int64))
                    continue
                new = [np.frombuffer(r["a"]), np.frombuffer(r["b"], np.int64), np.frombuffer(r["c"], np.int64)]
                old = sums.get(r["slab"])
                sums[r["slab"]] = new if old is None else [x + y for x, y in zip(old, new)]
        for slab, (ids, hashes) in heads.items():
            value, n, known = sums.get(slab, [np.zeros(len(hashes)), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes), pa.array(n + 1), pa.array(known + (1 if n_train else 0)), pa.array(value + end - (n + 1) * whole)], schema.fieldNames())

    return slim.where("what in ('head', 'sums')").repartition("slab").mapInArrow(run, schema)


def score_texts(docs: DataFrame, train_on: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row of ``docs``.

    ``train_on`` is a condition on the rows of ``docs``; null counts as false.
    """
    spark = docs.sparkSession
    body = F.coalesce(name_of(text).cast("string"), F.lit(""))
    rows = docs.select(body.alias("_text"), name_of(doc_id).alias("_id"), F.coalesce(train_on, F.lit(False)).alias("_train"), F.xxhash64(body).alias("_hash"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = settle(reduced(dealt(rows, ranges).repartitionById(ranges, F.col("range"))))
    totals = slim.where("what = 'totals'").select("a", "b").collect()  # one row per code range
    n_train = rows.where("_train").count()
    counted = sum((np.frombuffer(t.a, np.int64) for t in totals), np.zeros(2, np.int64))
    freq = sum((np.frombuffer(t.b, np.int64) for t in totals), np.zeros(256, np.int64))
    freq[END] += n_train
    tokens, distinct = int(counted[0]) + n_train, int(counted[1]) + (1 if n_train else 0)
    mixer = train(rows.where("_train").select("_text"), freq)
    base = base_scores(slim, n_train, tokens, distinct).dropDuplicates(["_id", "_hash"])
    scored = model_scores(rows, mixer).withColumnRenamed("_id", "_i").withColumnRenamed("_hash", "_h")
    out = scored.join(base, (F.col("_i").eqNullSafe(F.col("_id"))) & (F.col("_h") == F.col("_hash")))
    return out.select(F.col("_i").alias(doc_id), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op10(spark, sf_dir: str) -> DataFrame:
    held = learn_bucket(F.col("doc_id"), 10) == 0
    out = score_texts(documents(spark, sf_dir).select("doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
