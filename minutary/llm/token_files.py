"""Operator 4: token ids in shard files with a minimal perfect hash index.

File format (little endian): ``MTK1``, one byte of id width (2 or 4), three zero bytes, then
the ids of the shard's documents in ascending key order; then a NumPy archive with the index;
then 8 bytes with the archive's place. The index is a minimal perfect hash over the shard's
keys (levels of bit arrays; a key stays at the first level where it alone holds its bit), and
for each hash value a 32-bit fingerprint and the record's number; ``starts`` has the offset of
each record. A look-up costs a few bit tests, one fingerprint test and one read. A shard ends
at ``SHARD_BYTES`` of ids, which bounds what a task holds.

Keys may be of any type that sorts (whole numbers are their own hash, all else is hashed as
text, under a salt that tells a shard's keys apart). Null text gives just the end id. Null keys
come first, one record each; repeated keys have one index entry for their run of records, in
each shard that holds some. Extra columns are ignored; an empty table writes no shard. A failed
attempt may leave a file that no manifest names; readers never see it.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .units import ByteUnits, public_path

MAGIC, HEAD = b"MTK1", 8
#: Bytes of ids at which a shard is closed; a task writes as many as it needs.
SHARD_BYTES = 64 << 20


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, vectorised."""

    GAMMA = 2.0

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(n + np.concatenate(([0], np.cumsum(bits)))[:-1])
            n += int(bits.sum())
        self.size = n

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (common.mix64(keys ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        keys, levels = keys.astype(np.uint64), []
        while len(keys):
            size = max(8, int(cls.GAMMA * len(keys)))
            at = cls.slot(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """A number below ``size`` for each key; -1 for some keys that aren't there, any number for others."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self.slot(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (common.mix64(keys.astype(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def key_hashes(keys: pa.Array, salt: int) -> np.ndarray:
    """64 bits for each key: whole numbers stand for themselves, all else is hashed as text."""
    if pa.types.is_integer(keys.type) and not salt:
        return keys.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
    plain = (lambda k: str(k + 0.0)) if pa.types.is_floating(keys.type) else str  # equal keys have one text: 0.0 and -0.0 do
    return np.array([xxhash.xxh3_64_intdigest(plain(k), salt) for k in keys.to_pylist()], np.uint64)


def _to_bytes(keys: pa.Array) -> np.ndarray:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("key", keys.type)])) as w:
        w.write_batch(pa.record_batch([keys], ["key"]))
    return np.frombuffer(out.getvalue(), np.uint8)


class ShardReader:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 8)
        place = int.from_bytes(self.file.read(8), "little")
        self.file.seek(0)
        head = self.file.read(HEAD)
        if head[:4] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.width = head[4]
        self.file.seek(place)
        with np.load(io.BytesIO(self.file.read(size - 8 - place))) as z:
            self.starts, self.n_null, self.salt = z["starts"], int(z["n_null"]), int(z["salt"])
            #: the keys of all records but those without a key, in order
            self.keys = pa.ipc.open_stream(z["keys"].tobytes()).read_all().column("key").combine_chunks()
            self.hash = PerfectHash([np.unpackbits(z[f"level{i}"], count=int(n)).astype(bool) for i, n in enumerate(z["sizes"])])
            self.prints, self.records = z["prints"], z["records"]

    def find(self, keys: pa.Array) -> np.ndarray:
        """First record of each key; -1 where the stored fingerprint says that the key isn't here."""
        hashes = key_hashes(keys, self.salt)
        at = self.hash(hashes)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == fingerprints(hashes[ok])
        return np.where(ok, self.records[np.where(ok, at, 0)] if len(self.records) else -1, -1)

    def read(self, first: int, last: int) -> bytes:
        """Raw ids of records first..last-1."""
        self.file.seek(HEAD + int(self.starts[first]) * self.width)
        return self.file.read(int(self.starts[last] - self.starts[first]) * self.width)


def _index(keys: pa.Array, starts: list[int]) -> bytes:
    """The archive of a shard whose records have these keys (those without a key first) and begin at ``starts``."""
    nulls = keys.null_count
    known = keys.slice(nulls)
    first = np.ones(len(known), bool)
    if len(known):
        first[1:] = pc.not_equal(known.slice(1), known.slice(0, len(known) - 1)).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(known.type):  # NaN is one key
            nan = pc.is_nan(known).to_numpy(zero_copy_only=False)
            first[1:] &= ~(nan[1:] & nan[:-1])
    records = np.flatnonzero(first)
    for salt in range(64):  # until no two keys of the shard have one hash
        hashes = key_hashes(known.take(pa.array(records)), salt)
        if len(np.unique(hashes)) == len(hashes):
            break
    else:
        raise ValueError("keys that differ but hash alike whatever the salt: sort keys so that equal ones stand together")
    table = PerfectHash.build(hashes)
    at = table(hashes)
    prints, numbers = np.zeros(len(hashes), np.uint32), np.zeros(len(hashes), np.int64)
    prints[at], numbers[at] = fingerprints(hashes), records + nulls
    archive = io.BytesIO()
    np.savez(archive, starts=np.array(starts, np.int64), keys=_to_bytes(known), n_null=np.array(nulls), salt=np.array(salt), prints=prints, records=numbers, sizes=np.array([len(x) for x in table.levels], np.int64), **{f"level{i}": np.packbits(x) for i, x in enumerate(table.levels)})
    return archive.getvalue()


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, vocabulary: int, bin_: list[str] | None = None) -> DataFrame:
    """Writes the shards; the manifest (part and number in key order, uri, n_docs, n_ids), settled, one row a shard."""
    width = 2 if vocabulary <= 1 << 16 else 4
    end = end_id.to_bytes(width, "little")

    def run(batches):
        fs, place = common.filesystem(folder)
        out, keys, starts, number, cache = None, [], [0], 0, None

        def done():
            out.write(_index(pa.concat_arrays(keys), starts))
            out.write((HEAD + starts[-1] * width).to_bytes(8, "little"))
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "number": pa.array([number], pa.int64()), "uri": [uri], "n_docs": pa.array([len(starts) - 1], pa.int64()), "n_ids": pa.array([starts[-1]], pa.int64())})

        for b in common.batches(batches):
            cache = cache or ByteUnits.of_worker(path, width)
            for row, units in enumerate(cache.documents(b.column("text").to_pylist())):
                if out is None:
                    name = f"{uuid.uuid4().hex}.tok"
                    uri = f"{folder}/{name}"
                    fs.create_dir(place, recursive=True)
                    out = fs.open_output_stream(f"{place}/{name}")
                    out.write(MAGIC + bytes([width, 0, 0, 0]))
                    begun = row
                raw = b"".join(units) + end
                out.write(raw)
                starts.append(starts[-1] + len(raw) // width)
                if starts[-1] * width >= SHARD_BYTES:
                    keys.append(b.column("doc_id").slice(begun, row + 1 - begun))
                    yield done()
                    out, keys, starts, number = None, [], [0], number + 1
            if out is not None:
                keys.append(b.column("doc_id").slice(begun))
                begun = 0
        if out is not None:
            yield done()

    spark = docs.sparkSession
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(common.partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return common.settle(ranged.mapInArrow(run, "part long, number long, uri string, n_docs long, n_ids long"), "manifest", bin_)


def read_shards(spark: SparkSession, manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, found by key through each shard's index."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))  # one row a shard

    def run(batches):
        for b in batches:
            for uri, before in zip(b.column("uri").to_pylist(), b.column("before").to_pylist()):
                shard = ShardReader(uri)
                first = shard.find(shard.keys)
                if (first < 0).any():
                    raise ValueError(f"{uri}: a key is not in the index")
                # a key's records follow its first; those without a key come before all
                again = np.arange(len(first)) - np.searchsorted(first, first) if len(first) else first
                record = np.concatenate((np.arange(shard.n_null), first + again)).astype(np.int64)
                starts = shard.starts
                raw = memoryview(np.frombuffer(shard.read(0, len(starts) - 1), f"<u{shard.width}").astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts[record].tolist(), starts[record + 1].tolist())]
                ids = pa.concat_arrays([pa.nulls(shard.n_null, shard.keys.type), shard.keys])
                yield pa.RecordBatch.from_arrays([ids, pa.array(before + starts[record]), pa.array(starts[record + 1] - starts[record]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(common.partitions(spark)).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 0, vocabulary: int = 50_257) -> DataFrame:
    """Writes docs(doc_id, text) as shards and returns what the files hold."""
    spark = docs.sparkSession
    bin_: list[str] = []
    own = folder or common.scratch(spark, "tokens")
    manifest = write_shards(docs, own, path or public_path("byte_bpe_50k.json"), end_id, vocabulary, bin_)
    rows = read_shards(spark, manifest, docs.schema["doc_id"].dataType.simpleString())
    if not folder and not manifest.isEmpty():
        bin_.append(own)  # a folder that the caller names stays
    return common.final(rows, "tokens-read", bin_)
