"""Operator 3: token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the units (pre-tokens between single spaces) that a bounded
sample of documents holds most often, with their lengths in tokens; tier two is a cache in
each Python worker, filled by encoding what tier one lacks. No unit is ever shuffled, and the
sample decides only how many lookups hit, never a count.

Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .units import ByteUnits, public_path

#: Documented bounds of the first tier: documents looked at, and units kept.
SAMPLE_DOCS, TABLE_UNITS = 2000, 32_768


def frequent_units(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, units: int = TABLE_UNITS) -> bytes:
    """The compact table: units, each on a line; a NUL line; one byte of length each."""
    share = min(1.0, 2 * sample_docs / max(1, docs.count()))
    words = docs.select("text").sample(share, seed=11).limit(sample_docs).select(F.explode(F.split("text", " ")).alias("u")).filter("u <> '' and length(u) < 64 and not contains(u, '\\0') and not contains(u, '\\n')")
    top = [r[0] for r in words.groupBy("u").count().orderBy(F.desc("count"), "u").limit(units).collect()]
    cache = ByteUnits(path, 0, limit=10**9)
    cache.documents([f"a {u}" for u in top])
    lengths = [cache.known.get(" " + u, 0) for u in top]
    kept = [(" " + u, n) for u, n in zip(top, lengths) if 0 < n < 256]
    return "\n".join(u for u, _ in kept).encode() + b"\0" + bytes(n for _, n in kept)


def _open_table(raw: bytes) -> dict[str, int]:
    names, _, lengths = raw.partition(b"\0")
    return dict(zip(names.decode().split("\n"), lengths)) if lengths else {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    path = path or public_path("byte_bpe_50k.json")
    table = spark.sparkContext.broadcast(frequent_units(docs, path))

    def run(batches):
        cache = ByteUnits.of_worker(path, 0, lambda: _open_table(table.value))
        for b in common.batches(batches):
            texts = b.column("text").to_pylist()
            counts = [sum(v) for v in cache.documents(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
