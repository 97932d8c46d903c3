"""Token ids in binary files, with a minimal perfect hash index for keyed access.

Documents are dealt into ranges of ascending key; each task encodes its range and
writes shards.  A shard is two files in the target folder:

``*.bin``  the ids of its documents as little-endian unsigned integers, one document
after another, each closed by the end id; nothing else.  They have 16 bits where no id
of the vocabulary needs more, else 32.
``*.idx``  little-endian 64-bit integers: a mark, the number of documents, of levels,
of words of bits, of bytes of keys and of bytes of an id; then the level sizes in bits,
the bits, 32-bit fingerprints (filled up to 8 bytes), begin and length (in ids) of the
documents by slot, the slots' document numbers, the ends of the keys, and the keys in
document order.

The index.  A key's 128-bit code picks one bit in each level; a key is placed in the
first level where it is alone, the others go on to the next.  The rank of its bit among
all set bits is its slot, so n keys use exactly n slots and a lookup reads one bit of a
level or two.  A slot's fingerprint tells other keys apart (one in 2^32 passes).

Files have names of their own for every attempt of a task.  The manifest, written
by Spark after the files, lists those of the attempts that ended, so lost executors
and repeated tasks leave no trace in the result.

Order: ascending key, nulls first; rows with equal keys follow a hash of their text.
Rows with one key may lie in several shards, so a hot key is not one task's work.
Such rows have an occurrence number in their shard, which is part of the indexed key.
Null and empty texts hold the end id only.  An empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelens.llm.bpe import Encoder, Vocabulary, char_classes, vocabulary_path
from measurelens.llm.texts import documents, mix, name_of, pieces, share
from measurelens.operators.common import shared_folder
from measurelens.operators.ordered import prefix_sums

SHARD = 16_000_000  # bytes of text after which a shard is closed
SLAB = 4_000_000  # bytes of text that are encoded together
ROUTES = 1_000_000  # most shards whose key ranges are broadcast for a lookup
SPREAD = 2  # bits per key of a level
MARK = 0x31544E454B4F54  # "TOKENT1" as a number
MANIFEST = "part int, seq int, bin string, idx string, n_docs long, n_ids long, bytes long, first_key string, last_key string"


# -- the index ------------------------------------------------------------------


def codes_of(keys: list[bytes], occurrence: np.ndarray) -> np.ndarray:
    """128-bit codes (n x 2) of keys with their occurrence numbers."""
    raw = b"".join(hashlib.blake2b(k, digest_size=16, salt=int(o).to_bytes(8, "little")).digest() for k, o in zip(keys, occurrence.tolist()))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _bit(codes: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return (mix(codes[:, 0] + step) ^ mix(codes[:, 1] - step)) % np.uint64(size)


class KeyIndex:
    """Minimal perfect hash of distinct 128-bit codes, with 32-bit fingerprints by slot."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray):
        self.sizes, self.words, self.prints = sizes, words, prints
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64)

    @classmethod
    def build(cls, codes: np.ndarray) -> KeyIndex:
        left, sizes, bits = codes, [], []
        while len(left):
            if len(sizes) > 200:
                raise ValueError("some keys are equal")
            size = -(-max(64, SPREAD * len(left)) // 64) * 64
            at = _bit(left, len(sizes), size).astype(np.int64)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(count == 1)
            left = left[count[at] > 1]
        flat = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        index = cls(np.array(sizes, np.int64), flat, np.zeros(len(codes), np.uint32))
        index.prints[index._slot(codes)] = cls.fingerprint(codes)
        return index

    @staticmethod
    def fingerprint(codes: np.ndarray) -> np.ndarray:
        return (mix(codes[:, 0] ^ codes[:, 1]) >> np.uint64(32)).astype(np.uint32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int64)
        open_ = np.arange(len(codes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _bit(codes[open_], level, size).astype(np.int64) + self.base[level]
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            found = (self.words[word] >> shift) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(below)
            out[open_[found]] = rank[found]
            open_ = open_[~found]
        return out

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """The slot of every code, -1 for those whose fingerprint is not there."""
        slot = self._slot(codes)
        some = np.flatnonzero(slot >= 0)
        slot[some[self.prints[slot[some]] != self.fingerprint(codes[some])]] = -1
        return slot


# -- files ----------------------------------------------------------------------


def _key_bytes(keys: list[str | None]) -> list[bytes]:
    """A null key is one zero byte, others are "k" and their text."""
    return [b"\0" if k is None else b"k" + k.encode() for k in keys]


def _occurrences(keys: list) -> np.ndarray:
    """0, 1, ... within runs of equal neighbours."""
    out = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys)):
        if keys[i] == keys[i - 1]:
            out[i] = out[i - 1] + 1
    return out


def index_bytes(keys: list[str | None], lengths: np.ndarray, width: int) -> bytes:
    raw = _key_bytes(keys)
    codes = codes_of(raw, _occurrences(keys))
    index = KeyIndex.build(codes)
    slot = index._slot(codes)
    number = np.zeros(len(keys), "<i8")
    number[slot] = np.arange(len(keys))
    begins = np.cumsum(lengths) - lengths
    head = np.array([MARK, len(keys), len(index.sizes), len(index.words), sum(map(len, raw)), width], "<i8")
    prints = index.prints.astype("<u4").tobytes()
    return b"".join([
        head.tobytes(), index.sizes.astype("<i8").tobytes(), index.words.tobytes(), prints + b"\0" * (-len(prints) % 8),
        begins[number].astype("<i8").tobytes(), lengths[number].astype("<i8").tobytes(), number.tobytes(), np.cumsum([len(k) for k in raw]).astype("<i8").tobytes(), b"".join(raw),
    ])


class Shard:
    """An opened shard: documents by key, or all of them in order."""

    def __init__(self, ids: bytes, idx: bytes):
        mark, self.n, levels, words, key_bytes, width = np.frombuffer(idx, "<i8", 6).tolist()
        if mark != MARK:
            raise ValueError("not an index of token ids")
        self.ids = np.frombuffer(ids, f"<u{width}")
        at = 48

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(idx, kind, count, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.index = KeyIndex(take("<i8", levels), take("<u8", words), take("<u4", self.n))
        self.begin, self.length, self.number, self.key_ends = (take("<i8", self.n) for _ in range(4))
        self.raw_keys = idx[at : at + key_bytes]
        if int(self.length.sum()) != len(self.ids) or len(self.raw_keys) != key_bytes:
            raise ValueError("an index and its ids differ in length")

    def keys(self) -> list[str | None]:
        ends = self.key_ends.tolist()
        raw = [self.raw_keys[a:b] for a, b in zip([0, *ends], ends)]
        return [None if k == b"\0" else k[1:].decode() for k in raw]

    def find(self, keys: list[str | None], occurrence: np.ndarray) -> np.ndarray:
        return self.index.slots(codes_of(_key_bytes(keys), occurrence))

    def document(self, slot: int) -> np.ndarray:
        a = int(self.begin[slot])
        return self.ids[a : a + int(self.length[slot])]


def _open(folder: str):
    """(file system, path) of a folder that every task can reach."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _load(system, base: str, bin_: str, idx: str) -> Shard:
    def whole(name):
        with system.open_input_file(f"{base}/{name}") as f:
            return f.read()

    return Shard(whole(bin_), whole(idx))


# -- Spark ----------------------------------------------------------------------


def write(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2, shard_bytes: int = SHARD) -> DataFrame:
    """Write all documents into ``folder`` (new or empty) and return the manifest, one row per shard."""
    spark, folder = docs.sparkSession, folder.rstrip("/")
    t = F.coalesce(name_of(text).cast("string"), F.lit(""))
    rows = docs.select(t.alias("_t"), name_of(key).alias("_key"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)), F.count(F.lit(1))).head()
    ranges = max(1, min(-(-size[0] // shard_bytes) * 2, size[1]))
    # the text's hash and a row number divide the rows of a hot key
    rows = rows.withColumns({"_x": F.xxhash64("_t"), "_r": F.monotonically_increasing_id()})
    order = ["_key", "_x", "_r"]
    rows = rows.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    rows = rows.select("_t", F.col("_key").cast("string").alias("_key"), F.spark_partition_id().alias("_part"))
    tables = Vocabulary(vocabulary or vocabulary_path())
    width = 2 if max(len(tables.token_bytes) - 1, end_id) < 1 << 16 else 4
    shared = share(spark, (tables, char_classes()))
    system, base = _open(folder)
    system.create_dir(f"{base}/data", recursive=True)
    names = [c.split()[0] for c in MANIFEST.split(", ")]

    def run(batches):
        encoder, held, held_size, seq, part = Encoder(*shared()), [], 0, 0, 0
        keys, lengths, ids, done = [], [], [], 0
        system, base = _open(folder)

        def encode():
            for piece, coded in zip(held, encoder([p.column(0) for p in held])):
                count = pc.list_value_length(coded).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = coded.flatten().to_numpy(zero_copy_only=False)
                ids.append(np.insert(flat, np.cumsum(count), end_id).astype(f"<u{width}"))
                lengths.append(count + 1)
                keys.extend(piece.column(1).to_pylist())

        def close():
            count = np.concatenate(lengths)
            payload = b"".join(x.tobytes() for x in ids)
            name = f"data/{part:07d}-{seq:04d}-{uuid.uuid4().hex}"
            for end, data in (("bin", payload), ("idx", index_bytes(keys, count, width))):
                with system.open_output_stream(f"{base}/{name}.{end}") as f:
                    f.write(data)
            row = [part, seq, f"{name}.bin", f"{name}.idx", len(keys), len(payload) // width, len(payload), keys[0], keys[-1]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names)

        for batch in batches:
            for piece in pieces(batch, 0):
                part = piece.column(2)[0].as_py()
                held.append(piece)
                size = pc.sum(pc.binary_length(piece.column(0))).as_py() or 0
                held_size, done = held_size + size, done + size
                if held_size >= SLAB or done >= shard_bytes:
                    encode()
                    held, held_size = [], 0
                if done >= shard_bytes:
                    yield close()
                    keys, lengths, ids, done, seq = [], [], [], 0, seq + 1
        if held:
            encode()
        if keys:
            yield close()

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark, folder: str) -> DataFrame:
    """One row per shard: its files, sizes, key range and ``start``, the ids of all shards before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    place = F.col("part") * F.lit(1 << 20).cast("long") + F.col("seq")
    before = prefix_sums(rows, place, {"n": F.col("n_ids")}).select(F.col("v").cast("long").alias("_v"), F.col("n_before").alias("start"))
    return rows.join(before, place == F.col("_v")).drop("_v")


def scan(spark, folder: str, key_type: str = "long") -> DataFrame:
    """(key, start, n_ids, ids_crc32) of every document, read from the files; each is fetched by its key through the index.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    folder = folder.rstrip("/")
    shards = manifest(spark, folder).select("bin", "idx", "start")
    # a shard a task, however small the manifest is
    tasks = max(1, min(spark.read.parquet(f"{folder}/manifest").count(), 100_000))

    def run(batches):
        system, base = _open(folder)
        for batch in batches:
            for bin_, idx, start in zip(*[c.to_pylist() for c in batch.columns]):
                shard = _load(system, base, bin_, idx)
                keys = shard.keys()
                slot = shard.find(keys, _occurrences(keys))
                if (slot < 0).any() or len(np.unique(slot)) != shard.n:
                    raise ValueError(f"{idx} misses some of its keys")
                crc = [zlib.crc32(shard.document(s).astype("<u4")) for s in slot.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shard.begin[slot] + start), pa.array(shard.length[slot]), pa.array(crc, pa.int64())], ["key", "start", "n_ids", "ids_crc32"])

    out = shards.repartition(tasks).mapInArrow(run, "key string, start long, n_ids long, ids_crc32 long")
    return out.withColumn("key", F.col("key").cast(key_type))


def lookup(keys: DataFrame, folder: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of the documents with the keys in ``keys``; keys that no document has give no row.

    Keys are sent to the shards whose range holds them, and sorted by shard, so that
    a task opens each shard once.  Up to ``ROUTES`` ranges are broadcast; a larger
    output needs larger shards.
    """
    spark, folder = keys.sparkSession, folder.rstrip("/")
    kind = keys.select(name_of(key)).schema[0].dataType
    table = manifest(spark, folder)
    if table.count() > ROUTES:
        raise ValueError(f"more than {ROUTES} shards: write with larger shards")
    plain = table.orderBy("part", "seq").select("bin", "idx", "start", F.col("first_key").cast(kind).alias("a"), F.col("last_key").cast(kind).alias("b")).collect()
    none = lambda x: (x is not None, x)  # noqa: E731  # nulls come first
    routes = share(spark, ([none(r.a) for r in plain], [none(r.b) for r in plain], [(r.bin, r.idx, r.start) for r in plain]))
    wanted = keys.select(name_of(key).alias("k"), name_of(key).cast("string").alias("text")).distinct()

    def route(batches):
        from bisect import bisect_left, bisect_right

        first, last, _ = routes()
        for batch in batches:
            texts, shards = [], []
            for k, text in zip(*[c.to_pylist() for c in batch.columns]):
                for s in range(bisect_left(last, (k is not None, k)), bisect_right(first, (k is not None, k))):
                    texts.append(text)
                    shards.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(shards, pa.int64())], ["text", "shard"])

    def fetch(batches):
        _, _, files = routes()
        system, base = _open(folder)
        shard, opened = None, None
        for batch in batches:
            out = [[], [], []]
            texts, numbers = (c.to_pylist() for c in batch.columns)
            for text, number in zip(texts, numbers):
                if number != opened:
                    shard, opened = _load(system, base, *files[number][:2]), number
                occurrence = 0
                while (slot := int(shard.find([text], np.array([occurrence]))[0])) >= 0:
                    out[0].append(text)
                    out[1].append(files[number][2] + int(shard.begin[slot]))
                    out[2].append(shard.document(slot).astype(np.int64))
                    occurrence += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["key", "start", "ids"])

    routed = wanted.mapInArrow(route, "text string, shard long")
    found = routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(fetch, "key string, start long, ids array<long>")
    return found.withColumn("key", F.col("key").cast(kind))


def op13(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir).select("doc_id", "text")
    write(docs, folder)
    out = scan(spark, folder, docs.schema["doc_id"].dataType.simpleString())
    return out.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
