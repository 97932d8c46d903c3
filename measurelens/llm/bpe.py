"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words by the byte-level rule (letters, numbers, other signs,
each with one leading space; contractions; white space), many texts at a time on
arrays of code points.  The distinct words of a slab of texts are then merged
together: an index maps each pair to all its positions in the slab, the active
ranks are applied in ascending order, each at all its positions at once, and only
the lists of the pairs next to a merge are updated.  A merge makes a symbol that
only later ranks can use, so one ascending sweep equals word-by-word merging.

The vocabulary file is read on the driver and broadcast (a few megabytes).  Words
are told apart by 64-bit code and length.  Null and empty texts have no tokens.
Strings of special tokens in a text become their ids, as the library's default.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import documents, joined, name_of, pieces, prefix_codes, ragged, raw, share, span_codes

SLAB = 6_000_000  # bytes of text whose words are merged together
NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Plain tables of a byte-level BPE file in the format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = np.array([ids[c] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.twins = np.array([a == b for a, b in merges], np.bool_)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # fixed values: the white space of Unicode
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def cut(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, special: dict[str, int]):
    """Word spans in bytes of texts that each end with a one-byte terminator.

    Returns (starts, ends, ids of special tokens by index of their span).
    """
    text = data.tobytes().decode("utf-8")
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000), out=place[1:])
    kind = np.full(len(chars) + 3, EDGE, np.uint8)
    kind[: len(chars)] = classes[chars]
    kind[np.searchsorted(place, offsets[1:] - 1)] = EDGE
    specials = []
    if special:
        ends = set(np.searchsorted(place, offsets[1:] - 1).tolist())
        for m in re.finditer("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text):
            if not any(e in ends for e in range(m.start(), m.end())):
                kind[m.start() : m.end()] = EDGE
                specials.append((m.start(), m.end(), special[m.group()]))
    n = len(chars)
    chars = np.concatenate((chars, np.zeros(3, np.uint32)))
    here, after = kind[:n], kind[1 : n + 1]
    before = np.concatenate((np.array([EDGE], np.uint8), kind[: n - 1])) if n else kind[:0]
    char_before = np.concatenate((np.zeros(1, np.uint32), chars[: n - 1])) if n else chars[:0]
    begins = (here != before) & (here != EDGE) & ~((here != SPACE) & (before == SPACE) & (char_before == 0x20))
    begins |= (here == SPACE) & (after != SPACE) & (after != EDGE)
    quote = np.flatnonzero(begins & (chars[:n] == 0x27) & (after == LETTER))
    if len(quote):
        a, b = chars[quote + 1], chars[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, length in ((quote[one], 2), (quote[two], 3)):
            begins[found + 1] = False
            rest = found + length
            rest = rest[kind[rest] == LETTER]
            begins[rest] = True
    ids = {}
    for a, b, i in specials:
        begins[a] = True
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(begins | (here == EDGE))
    ends = stops[np.minimum(np.searchsorted(stops, starts, "right"), max(len(stops) - 1, 0))] if len(stops) else starts
    if specials:
        at = np.searchsorted(starts, [s[0] for s in specials])
        ends[at] = [s[1] for s in specials]
        ids = dict(zip(at.tolist(), [s[2] for s in specials]))
    return place[starts], place[ends], ids


def merge_words(data: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words, tokens per word); ``data`` has the bytes of the words one after another."""
    n = len(data)
    symbol = vocabulary.first[data]
    ends = np.cumsum(counts)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[counts > 0] - 1] = -1
    before[(ends - counts)[counts > 0]] = -1
    rank = np.full(n, NONE, np.int32)
    has = np.flatnonzero(after >= 0)
    rank[has] = vocabulary.rank(symbol[has], symbol[has + 1])

    # the index: rank of a pair -> arrays of positions of its left symbol
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        r = rank[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        bounds = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)])).tolist()
        for which, a, b in zip(r[bounds[:-1]].tolist(), bounds, bounds[1:]):
            held = index.get(which)
            if held is None:
                index[which] = [at[a:b]]
                heapq.heappush(active, which)
            else:
                held.append(at[a:b])

    live = np.flatnonzero(rank != NONE)
    if len(live):
        enter(live)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))  # each list is free of repeats
        at = at[rank[at] == r]
        if not len(at):
            continue
        if vocabulary.twins[r] and len(at) > 1:
            linked = after[at[:-1]] == at[1:]  # in a run of equal symbols every other pair merges
            head = np.concatenate(([True], ~linked))
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        then = after[gone]
        symbol[at] = vocabulary.made[r]
        symbol[gone] = -1
        rank[gone] = NONE
        after[at] = then
        some = then >= 0
        before[then[some]] = at[some]
        left = before[at]
        left = left[left >= 0]
        right = at[some]
        rank[at] = NONE
        touched = np.unique(np.concatenate((right, left)))
        if len(touched):
            rank[touched] = vocabulary.rank(symbol[touched], symbol[after[touched]])
            touched = touched[rank[touched] != NONE]
            if len(touched):
                enter(touched)
    keep = symbol >= 0
    word = np.repeat(np.arange(len(counts)), counts)
    return symbol[keep], np.bincount(word[keep], minlength=len(counts))


class Encoder:
    """Turns columns of texts into token ids, a slab at a time."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray):
        self.vocabulary, self.classes = vocabulary, classes

    def __call__(self, columns: list[pa.Array]) -> list[pa.Array]:
        """A list<int> array for every column."""
        codes, lengths, sources, per_text, specials = [], [], [], [], []
        total = 0
        for col in columns:
            data, offsets = joined(col)
            starts, ends, ids = cut(data, offsets, self.classes, self.vocabulary.special)
            code = span_codes(prefix_codes(data), starts, ends)
            _, first = np.unique(code, return_index=True)
            size = ends - starts
            # keep the bytes of this column's distinct words only
            at = np.repeat(starts[first], size[first]) + ragged(size[first])
            sources.append((code[first], size[first], data[at]))
            codes.append(code)
            lengths.append(size)
            specials += [(total + k, i) for k, i in ids.items()]
            total += len(code)
            per_text.append(np.diff(np.searchsorted(starts, offsets)))
        code = np.concatenate(codes)
        known = np.concatenate([s[0] for s in sources])
        size = np.concatenate([s[1] for s in sources])
        data = np.concatenate([s[2] for s in sources])
        names, first = np.unique(known, return_index=True)
        begin = np.cumsum(size) - size
        counts = size[first]
        bytes_ = data[np.repeat(begin[first], counts) + ragged(counts)]
        ids, n = merge_words(bytes_, counts, self.vocabulary)
        word = np.searchsorted(names, code)
        where = np.cumsum(n) - n
        out, done = [], 0
        special = dict(specials)
        for col, texts, mine in zip(columns, per_text, codes):
            w = word[done : done + len(mine)]
            count = n[w]
            start = where[w]
            flat = ids[np.repeat(start, count) + ragged(count)]
            here = [k for k in special if done <= k < done + len(mine)]
            if here:
                flat, count = self._with_special(flat, count, {k - done: special[k] for k in here})
            tokens = np.zeros(len(mine) + 1, np.int64)
            np.cumsum(count, out=tokens[1:])
            offsets = tokens[np.concatenate(([0], np.cumsum(texts)))]
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
            done += len(mine)
        return out

    @staticmethod
    def _with_special(flat, count, ids):
        ends = np.cumsum(count)
        keep = np.ones(len(flat), np.bool_)
        new = count.copy()
        for k, i in ids.items():
            a = ends[k] - count[k]
            flat[a] = i
            keep[a + 1 : ends[k]] = False
            new[k] = 1
        return flat[keep], new


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", carry=None, slab: int = SLAB) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the text, by the vocabulary file at that path (on the driver)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "ids"]
    rows = docs.select(F.coalesce(name_of(text).cast("string"), F.lit("")).alias("_text"), *[name_of(c).alias(f"_k{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*[T.StructField(f"_k{i}", rows.schema[f"_k{i}"].dataType) for i in range(len(carry))], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = schema.fieldNames()
    shared = share(docs.sparkSession, (Vocabulary(vocabulary), char_classes()))

    def run(batches):
        encoder, held, size = Encoder(*shared()), [], 0

        def flush():
            for piece, ids in zip(held, encoder([p.column(0) for p in held])):
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], ids], names)

        for batch in batches:
            for piece in pieces(batch, 0):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column(0))).as_py() or 0
                if size >= slab:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], "ids")


def decode(df: DataFrame, vocabulary: str, *, ids: str = "ids", carry=None) -> DataFrame:
    """``df`` with ``decoded``: the text of the token ids; bytes that are not UTF-8 become U+FFFD.  A null list decodes to null."""
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != "decoded"]
    rows = df.select(name_of(ids).cast("array<int>").alias("_ids"), *[name_of(c).alias(f"_k{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*[T.StructField(f"_k{i}", rows.schema[f"_k{i}"].dataType) for i in range(len(carry))], T.StructField("decoded", T.StringType())])
    names = schema.fieldNames()
    shared = share(df.sparkSession, Vocabulary(vocabulary).token_bytes)

    def run(batches):
        tokens = pa.array(shared(), pa.large_binary())
        flat, offsets = raw(tokens)
        size = np.diff(offsets)
        for batch in batches:
            for a in range(0, max(batch.num_rows, 0), 256):
                part = batch.slice(a, 256)
                col = part.column(0)
                inner = col.flatten()
                wanted = inner.fill_null(0).to_numpy(zero_copy_only=False)
                count = size[wanted]
                out = flat[np.repeat(offsets[wanted], count) + ragged(count)]
                total = np.zeros(len(wanted) + 1, np.int64)
                np.cumsum(count, out=total[1:])
                per = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
                cuts = total[np.concatenate(([0], np.cumsum(per)))].tolist()
                whole = out.tobytes()
                texts = [whole[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string(), mask=np.asarray(col.is_null()))], names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], "decoded")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or vocabulary_path()
    ids = encode(documents(spark, sf_dir).select("doc_id", "text"), path, carry=["doc_id"])
    digest = ids.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)})
    return decode(digest, path, carry=["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
