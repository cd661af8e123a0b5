"""Operator 11: hard negatives by bit-sliced integer products.

A component x becomes the integer floor(256 x), in two's complement. Rows are stored by bit-planes:
the signs of all components, then their next bits, down to the last. The product with an anchor is
the sum of the planes' products, weighted by powers of two. After each plane, most significant
first, a product lies in an interval: the planes not yet read add at most their weights times the
anchor's positive components, and at least times its negative ones. A pair is dropped once its
interval can't qualify any more: for a positive when its upper end falls under the fifth score
found so far, for a negative when it misses the band of every positive or falls under the tenth
score that is found in the band. All dropping is exact; what is left after the last plane has its
exact score.

Anchors and rows are segments of bounded size (``segments``); each task works on tiles of them, and
each tile gives at most 5 rows an anchor, or 10 a positive, from which the best are taken over all
tiles. So nothing is shuffled but results, and no pairs stand in rows.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
part. Rows of one vec_id count once: the least label, then the least vector. Vectors of different
lengths are never compared. Equal vectors are rows of their own; ties go to the smaller vec_id. An
anchor without other rows of its label has no rows in the result, and an empty table gives none. A
component of 2**25 or more after scaling is an error, as its products might not fit a long. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common, segments

#: Rows and anchors of a segment at most; rows and anchors that are compared at a time.
SEGMENT_ROWS, SEGMENT_ANCHORS, ROWS, ANCHORS = 1 << 18, 1 << 14, 4096, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Share of pairs left at which they are held one by one.
SPARSE = 0.05
LEAST = np.iinfo(np.int64).min


def _integers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x, size = segments.matrix(table.column("vector"))
    x = np.floor(256.0 * x)
    if len(x) and np.abs(x).max() >= 1 << 25:
        raise OverflowError("a scaled component has 2**25 or more, so that its products may not fit a long")
    return x.astype(np.int64), size


def pack_rows(table: pa.Table) -> dict[str, np.ndarray]:
    """Blocks of rows of one length: ids, labels, and bit-planes from the sign down."""
    x, size = _integers(table)
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    first, out = np.cumsum(size) - size, {}
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        own = own[np.argsort(labels[own], kind="stable")]
        for at in range(0, len(own), ROWS):
            part = own[at : at + ROWS]
            m = x[first[part][:, None] + np.arange(d)]
            n = max(1, int(np.maximum(m, -m - 1).max()).bit_length())
            planes = np.stack([np.packbits((m >> b) & 1, axis=1) for b in range(n, -1, -1)])
            k = len(out) // 4
            out |= {f"ids{k}": ids[part], f"labels{k}": labels[part], f"planes{k}": planes, f"size{k}": np.array(d)}
    return out


def pack_anchors(table: pa.Table) -> dict[str, np.ndarray]:
    """ids, labels, integers one after another with their lengths, and the positives' ids and scores, as far as they are there (else -1 and the least long)."""
    x, size = _integers(table)
    out = {"ids": table.column("vec_id").to_numpy(), "labels": table.column("label").to_numpy(), "x": x, "size": size}
    if "positives" in table.column_names:
        ids, scores = np.zeros((len(size), POSITIVES), np.int64), np.full((len(size), POSITIVES), LEAST)
        for i, found in enumerate(table.column("positives").to_pylist()):
            for j, p in enumerate(found):
                ids[i, j], scores[i, j] = p["vec_id"], p["score"]
        out |= {"positives": ids, "scores": scores}
    return out


def _blocks(seg: dict):
    for k in range(len(seg) // 4):
        yield seg[f"ids{k}"], seg[f"labels{k}"], seg[f"planes{k}"], int(seg[f"size{k}"])


def survivors(planes: np.ndarray, size: int, anchors: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, product) of all pairs whose interval fits to the end.

    planes: bits of the rows' components, sign first; anchors: integers; fits(low, high, row, anchor) is asked after each
    plane, with matrices first (row and anchor are slices then) and lists of pairs once few are left.
    """
    n = len(planes) - 1
    bits = lambda k, rows=slice(None): np.unpackbits(planes[k][rows], axis=1, count=size)
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    # a plane's product is at most the sum of an anchor's components, which single precision holds exactly up to 2**24
    exact = np.float32 if max(up.max(initial=0), -down.min(initial=0)) < 1 << 24 else np.float64
    across, dense, row, col, total = anchors.T.astype(exact), True, slice(None), slice(None), np.zeros((planes.shape[1], len(anchors)), np.int64)
    for k in range(n + 1):
        b = n - k
        weight = -(1 << b) if k == 0 else 1 << b
        if dense:
            total += weight * (bits(k).astype(exact) @ across).astype(np.int64)
        else:
            for at in range(0, len(row), 1 << 16):
                part = slice(at, at + (1 << 16))
                total[part] += weight * np.einsum("ij,ij->i", bits(k, row[part]).astype(np.int64), anchors[col[part]])
        rest = (1 << b) - 1
        ok = fits(total + rest * down[col], total + rest * up[col], row, col)
        if not dense:
            row, col, total = row[ok], col[ok], total[ok]
        elif k == n or np.count_nonzero(ok) < SPARSE * ok.size:
            row, col = np.nonzero(ok)
            total, dense = total[row, col], False
    return row, col, total


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (by score, then id) of each group, in order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(g)) - first < k]


def _anchor_groups(seg: dict):
    first = np.cumsum(seg["size"]) - seg["size"]
    for d in np.unique(seg["size"]):
        own = np.flatnonzero(seg["size"] == d)
        for at in range(0, len(own), ANCHORS):
            part = own[at : at + ANCHORS]
            yield int(d), part, seg["x"][first[part][:, None] + np.arange(d)]


def _floors(group: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best score of each of n groups, the least long where there are fewer; rows are in order of group and score."""
    out = np.full(n, LEAST)
    first = np.searchsorted(group, np.arange(n))
    full = np.flatnonzero(np.searchsorted(group, np.arange(n), "right") - first >= k)
    out[full] = score[first[full] + k - 1]
    return out


def find_positives(anchor_seg: dict, row_segs):
    """For each anchor of a segment the best rows of its label in the given row segments."""
    groups = [(d, part, x, seg_state) for d, part, x in _anchor_groups(anchor_seg) for seg_state in [[np.zeros(0, np.int64)] * 3]]
    for seg in row_segs:
        for ids, labels, planes, size in _blocks(seg):
            for d, part, x, state in groups:
                mine = anchor_seg["labels"][part]
                if d != size or not np.isin(mine, labels).any():
                    continue
                own, floor = anchor_seg["ids"][part], _floors(state[0], state[2], len(part), POSITIVES)

                def fits(low, high, row, col):
                    if isinstance(row, slice):
                        return (labels[:, None] == mine) & (ids[:, None] != own) & (high >= floor)
                    return high >= floor[col]

                row, col, score = survivors(planes, size, x, fits)
                found = [np.concatenate(p) for p in zip(state, (col, ids[row], score))]
                keep = _best(found[0], found[2], found[1], POSITIVES)
                state[:] = [f[keep] for f in found]
    for _, part, _, (col, ids, score) in groups:
        if len(col):
            yield pa.RecordBatch.from_arrays([pa.array(anchor_seg["ids"][part][col]), pa.array(ids), pa.array(score)], ["anchor_id", "vec_id", "score"])


def _share(score: np.ndarray, percent: int) -> np.ndarray:
    """percent of a score, rounded down, without leaving the range of a long."""
    return score // 100 * percent + score % 100 * percent // 100


def find_negatives(anchor_seg: dict, row_segs):
    """For each positive of the anchors of a segment the best rows of other labels within its band."""
    groups = [(d, part, x, state) for d, part, x in _anchor_groups(anchor_seg) for state in [[np.zeros(0, np.int64)] * 3]]
    for seg in row_segs:
        for ids, labels, planes, size in _blocks(seg):
            for d, part, x, state in groups:
                mine = anchor_seg["labels"][part]
                if d != size:
                    continue
                scores = anchor_seg["scores"][part]
                there = scores != LEAST
                known = np.where(there, scores, 0)
                bottom, top = np.where(there, -_share(-known, LOW), 1), np.where(there, _share(known, HIGH), 0)
                floor = np.maximum(bottom, _floors(state[0], state[2], len(part) * POSITIVES, NEGATIVES).reshape(len(part), POSITIVES))
                floor[floor > top] = np.iinfo(np.int64).max

                def fits(low, high, row, col):
                    ok = labels[:, None] != mine if isinstance(row, slice) else True
                    some = np.zeros(high.shape, bool)
                    for j in range(POSITIVES):
                        some |= (high >= floor[col, j]) & (low <= top[col, j])
                    return some & ok

                row, col, score = survivors(planes, size, x, fits)
                hit = (score[:, None] >= floor[col]) & (score[:, None] <= top[col])
                at, j = np.nonzero(hit)
                found = [np.concatenate(p) for p in zip(state, (col[at] * POSITIVES + j, ids[row[at]], score[at]))]
                keep = _best(found[0], found[2], found[1], NEGATIVES)
                state[:] = [f[keep] for f in found]
    for _, part, _, (slot, ids, score) in groups:
        if len(slot):
            a, j = part[slot // POSITIVES], slot % POSITIVES
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor_seg["ids"][a], anchor_seg["positives"][a, j], anchor_seg["scores"][a, j], ids, score)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def mine(vectors: DataFrame, anchors: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors (by their id alone, ``vec_id``); those divisible by 100 unless given. label: the label
    of a row; the column ``label`` unless given.
    """
    anchors = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    bin_: list[str] = []
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & segments.usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")
    rows = common.settle(rows, "vectors", bin_)
    spark, folder = rows.sparkSession, common.scratch(rows.sparkSession, "planes")
    bin_.append(folder)
    own = rows.filter(anchors)
    rows_at = folder, segments.write(segments.dealt(rows, SEGMENT_ROWS), folder, pack_rows, SEGMENT_ROWS)
    if not rows_at[1]:
        common.discard(bin_[:1])
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    alone = folder, segments.write(segments.dealt(own, SEGMENT_ANCHORS), folder, pack_anchors, SEGMENT_ANCHORS)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = segments.tiles(spark, alone, rows_at, find_positives, "anchor_id long, vec_id long, score long")
    positives = positives.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= POSITIVES)
    lists = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))  # five at most
    banded = common.settle(own.join(lists, "vec_id"), "bands", bin_)
    banded_at = folder, segments.write(segments.dealt(banded, SEGMENT_ANCHORS), folder, pack_anchors, SEGMENT_ANCHORS)
    found = segments.tiles(spark, banded_at, rows_at, find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return common.final(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", bin_)


def shifted_label() -> Column:
    """The label, and one further (of ten) where the id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, min({'l': label, 'v': embedding}) AS m FROM r GROUP BY vec_id),
v AS (SELECT vec_id, m.l AS label, list_transform(m.v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM u),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
