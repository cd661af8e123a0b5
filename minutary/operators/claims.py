"""Claims that are settled in order without a fold over all rows.

Rows in order want keys. A row that is the first of all open rows for each of its keys can't be refused by any other, so all such
rows are settled at once; then the rows that lost a key to them go, and the next round begins. The first open row is settled in
every round, and rows without rivals in the first.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import settle

#: Open rows (an order and keys) that one task may settle.
FINISH = 50_000


def firsts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with ``_ready``: whether the row is the first of each of its keys that isn't null."""
    for i, k in enumerate(keys):
        least = rows.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(order).alias(f"_first{i}"))
        rows = rows.join(least, F.col(k) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    ready = reduce(lambda x, y: x & y, (F.coalesce(F.col(f"_first{i}") == F.col(order), F.lit(True)) for i in range(len(keys))))
    return rows.withColumn("_ready", ready).drop(*(f"_first{i}" for i in range(len(keys))))


def _greedy(keys: list[str]):
    """Rows in order: each gets its keys if all of them are free."""

    def run(batches):
        taken: list[set] = [set() for _ in keys]
        for b in batches:
            won = []
            for row in zip(*(b.column(k).to_pylist() for k in keys)):
                free = all(v is None or v not in t for v, t in zip(row, taken))
                won.append(free)
                if free:
                    for v, t in zip(row, taken):
                        t.add(v)
            yield b.filter(pa.array(won, pa.bool_()))

    return run


def winners(rows: DataFrame, keys: list[str], order: str, bin_: list[str]) -> DataFrame:
    """The rows that get all of their keys, where a row that lacks one gets none and so leaves the others free.

    Most rows are settled in the first rounds; once at most FINISH are open, these are settled one after another in one task.
    """
    won: list[DataFrame] = []
    while True:
        marked = settle(firsts(rows, keys, order), "claims", bin_)
        ready = marked.filter("_ready").drop("_ready")
        won.append(ready)
        rows = marked.filter("not _ready").drop("_ready")
        for k in keys:
            rows = rows.join(ready.filter(F.col(k).isNotNull()).select(k), k, "left_anti")
        rows = rows.select(*ready.columns)
        left = rows.limit(FINISH + 1).count()
        if left and left <= FINISH:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            won.append(rows.coalesce(1).sortWithinPartitions(order).mapInArrow(_greedy(keys), schema))
        if left <= FINISH:
            return reduce(DataFrame.unionByName, won)
