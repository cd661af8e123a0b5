"""Operator 2: near-duplicate classes by BagMinHash.

A text is the bag of its 5-word shingles. BagMinHash assigns to every shingle Poisson processes
over dyadic ranges of its weight ([0,1), [1,2), [2,4), ...), seeded by shingle and range alone;
a point counts if its place in the range lies below the shingle's weight, and each signature
component keeps the point with the least time. Two bags share a component with a probability
equal to their weighted Jaccard similarity. Points are drawn up to a time that all components
almost surely have been reached by; documents for which that fails are drawn further.

Equal texts are one node. Signatures are cut into bands; each bucket of a band links its
members to one member chosen at random (a star, never all pairs). Linked pairs are verified by
exact bag overlap. Buckets whose members are still in several components are then searched for
links across components: exactly, by prefix filtering within the bucket, so that no pair that
shares a bucket is lost unless its ends are joined already. Components are found by minimum
labels with pointer jumping, settled after each round.

Null text is the empty text; texts of no words are near only to equal texts; texts of fewer
than five words have one shingle. Repeated rows fall in one class; extra columns are ignored;
an empty table gives no rows. With 24 bands of 4 a pair at the threshold is missed with a
probability of 3e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import common

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
#: Texts sketched at a time in a worker; their shingles' points are held together.
SKETCH_ROWS, SKETCH_BYTES = 384, 4 << 20
#: Texts that a task remembers having sketched.
SEEN = 100_000
#: Members up to which a bucket is compared by pairs; members and bytes of bags at which it is dealt out in chunks.
SMALL, CHUNK, CHUNK_BYTES = 8, 4096, 16 << 20
#: Parts into which a class is dealt when its members learn its name.
SALTS = 16


def _word_hashes(texts: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    parts, n = [], []
    for t in texts:
        w = t.split()
        n.append(len(w))
        try:
            parts.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for x in set(w).difference(known):
                known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            parts.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(n, np.int64)


def bags(texts: list[str], known: dict, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle of 48 bits, weight) for at most 65,536 texts, sorted by document and shingle."""
    h, n = _word_hashes(texts, known)
    first = np.concatenate(([0], np.cumsum(n)))[:-1] if len(n) else n
    roll = np.zeros(max(0, len(h)), np.uint64)
    prime = np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        tail = h[j:]
        roll[: len(tail)] = (roll[: len(tail)] + tail) * prime
    roll = common.mix64(roll)
    count = np.where(n >= size, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count) if len(n) else n
    doc, shingle = [doc], [roll[at] if len(at) else roll[:0]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        own = np.array([n[d]], np.uint64)
        for x in h[first[d] : first[d] + n[d]]:
            own = common.mix64(own ^ x) * prime
        doc.append(np.array([d]))
        shingle.append(own)
    key = (np.concatenate(doc).astype(np.uint64) << np.uint64(48)) | (np.concatenate(shingle) >> np.uint64(16))
    key, weight = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(0xFFFFFFFFFFFF), weight


def _uniform(seed: np.ndarray, draw: np.ndarray, salt: int) -> np.ndarray:
    return common.mix64(seed + draw * np.uint64(0x632BE59BD9B4E019) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """n_docs x size signature; rows of documents without shingles are 0."""
    total = np.bincount(doc, weight, n_docs)
    # one process for each dyadic range that the weight reaches into
    level = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    own = np.repeat(np.arange(len(doc)), level)
    k = np.arange(len(own)) - np.repeat(np.concatenate(([0], np.cumsum(level)))[:-1], level) if len(own) else own
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    span = np.where(k == 0, 1, low)
    d, w = doc[own], weight[own]
    seed = common.mix64(shingle[own] ^ common.mix64(k.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    t, draw = np.zeros(len(own)), np.zeros(len(own), np.uint64)
    limit = np.where(total > 0, size / np.maximum(total, 1) * (np.log(size) + 3), 0)
    best_t, best = np.full(n_docs * size, np.inf), np.zeros(n_docs * size, np.uint64)
    active = np.arange(len(own))
    fresh = np.ones(len(own), bool)  # the next point is not drawn yet
    while len(active):
        new = active[fresh[active]]
        draw[new] += np.uint64(1)
        u = ((_uniform(seed[new], draw[new], 1) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        t[new] -= np.log(u) / span[new]
        fresh[new] = False
        live = active[t[active] <= limit[d[active]]]
        x = _uniform(seed[live], draw[live], 2)
        place = low[live] + (x >> np.uint64(32)).astype(np.int64) % span[live]
        hit = live[place < w[live]]
        if len(hit):
            x = _uniform(seed[hit], draw[hit], 3)
            cell = d[hit] * size + (x >> np.uint64(33)).astype(np.int64) % size
            order = np.argsort(t[hit], kind="stable")
            cell, times, mark = cell[order], t[hit][order], common.mix64(seed[hit] + draw[hit])[order]
            # of several points in a cell the earliest stays
            uniq, pick = np.unique(cell, return_index=True)
            better = times[pick] < best_t[uniq]
            best_t[uniq[better]], best[uniq[better]] = times[pick][better], mark[pick][better]
        fresh[live] = True
        active = live
        if not len(active):
            poor = np.unique(np.flatnonzero(np.isinf(best_t)) // size)
            poor = poor[total[poor] > 0]
            if len(poor):
                again = np.zeros(n_docs, bool)
                again[poor] = True
                limit[poor] *= 2
                active = np.flatnonzero(again[d])
    return best.reshape(n_docs, size)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def with_node(docs: DataFrame) -> DataFrame:
    """Adds the node of each row: 128 bits of its text's SHA-256."""
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_node", F.unhex(F.substring(F.sha2("_text", 256), 1, 32)))


def sketch(docs: DataFrame, bands: int, rows: int, bin_: list[str] | None = None) -> DataFrame:
    """node, n (rows with this text), doc_id (least), bands; one row for each different text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: dict = {}
        seen: set = set()
        for b in common.batches(batches, SKETCH_ROWS, SKETCH_BYTES):
            # a text that this task has sketched already isn't sketched again: its row has no bands
            nodes, fresh = b.column("_node").to_pylist(), []
            for i, node in enumerate(nodes):
                if node not in seen:
                    fresh.append(i)
                    if len(seen) < SEEN:
                        seen.add(node)
            texts = b.column("_text").take(pa.array(fresh, pa.int64())).to_pylist()
            doc, shingle, weight = bags(texts, known)
            keys = band_keys(signatures(doc, shingle, weight, len(texts), bands * rows), bands, rows)
            some = np.zeros(len(texts), bool)
            some[doc] = True
            size = np.zeros(len(nodes), np.int64)
            size[np.array(fresh, np.int64)[some]] = bands
            flat = pa.array(keys[some].ravel())
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_node"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "node", "bands"])

    found = docs.select("doc_id", "_text", "_node").mapInArrow(run, f"doc_id {kind}, node binary, bands array<long>")
    return common.settle(found.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max_by("bands", F.size("bands")).alias("bands")), "sketch", bin_)


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _rewritten(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Different edges between the roots of to(node, root); a node that it lacks stays itself."""
    for end in ("a", "b"):
        edges = edges.join(to.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    x, y = (F.coalesce(f"root_{end}", end).alias(end) for end in ("a", "b"))
    return edges.select(x, y).filter("a <> b").select(*_pair("a", "b")).distinct()


def _followed(labels: DataFrame, to: DataFrame) -> DataFrame:
    """labels(node, root) with roots that are nodes of to(node, root) replaced by their roots."""
    to = common.small(to).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return labels.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def components(edges: DataFrame, bin_: list[str], known: DataFrame | None = None) -> DataFrame:
    """node, root (least node that it is connected with) for every node of edges(a, b), and of known: components by other edges.

    Each node points to its least neighbour if that is less than itself; pointers are followed to
    their ends, and the edges are rewritten to these ends. Edges inside a tree go, and of those
    between two trees one stays, so at most half of the nodes go on to the next round, and no
    round but the first reads all edges.
    """
    edges = edges.filter("a <> b").select(*_pair("a", "b")).distinct() if known is None else _rewritten(edges, known)
    edges, labels = common.settle(edges, "edges", bin_), None
    while labels is None or edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        up = common.settle(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("root")), "up", bin_)
        while True:
            one, two = up.select(F.col("node").alias("root"), F.col("root").alias("mid")), up.select(F.col("node").alias("mid"), F.col("root").alias("far"))
            jumped = common.settle(up.join(one, "root").join(two, "mid").select("node", "mid", F.col("far").alias("root")), "up", bin_)
            up = jumped.select("node", "root")
            if not jumped.filter("mid <> root").limit(1).count():
                break
        labels = up if labels is None else common.settle(_followed(labels, up), "labels", bin_)
        edges = common.settle(_rewritten(edges, up), "edges", bin_)
    if known is None:
        return labels
    return common.settle(_followed(known, labels).union(labels.join(known, "node", "left_anti")), "labels", bin_)


def verify(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough; shingles: node, bag (8 bytes a shingle), weights (4 bytes)."""
    left = shingles.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"), F.col("weights").alias("w_a"))
    right = shingles.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"), F.col("weights").alias("w_b"))

    def run(batches):
        for batch in common.batches(batches):
            ok = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("bag_a", "w_a", "bag_b", "w_b"))):
                x, wx, y, wy = (np.frombuffer(v, t) for v, t in zip(row, ("<u8", "<u4") * 2))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = y[at] == x if len(y) else np.zeros(len(x), bool)
                common_weight = int(np.minimum(wx[same], wy[at[same]]).sum())
                ok.append(common_weight >= threshold * (int(wx.sum()) + int(wy.sum()) - common_weight) and common_weight > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def cross_links(members: list[dict], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links that join components of a bucket's members (node, root, bag, weights), by prefix filtering.

    Bags become sets of (shingle, copy); ordered by how few members have them, two sets that
    overlap enough share one of the first n - ceil(threshold n) + 1 elements of each. Every
    pair across components that shares such an element is verified, until its ends are joined.
    """
    n = len(members)
    sets, up = [], list(range(n))
    for m in members:
        bag, w = np.frombuffer(m["bag"], "<u8"), np.frombuffer(m["weights"], "<u4").astype(np.int64)
        copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        sets.append(np.sort(common.mix64(np.repeat(bag, w) ^ (copy.astype(np.uint64) << np.uint64(48)))))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict = {}
    for i, m in enumerate(members):
        up[i] = first.setdefault(m["root"], i)
    every = np.concatenate(sets)
    _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner, element, at = [], [], 0
    for i, s in enumerate(sets):
        r = np.sort(rank[inverse[at : at + len(s)]])[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]
        at += len(s)
        owner.append(np.full(len(r), i))
        element.append(r)
    owner, element = np.concatenate(owner), np.concatenate(element)
    order = np.argsort(element, kind="stable")
    owner = owner[order]
    lists = np.split(owner, np.flatnonzero(np.diff(element[order])) + 1)
    out, tried = [], set()
    for own in lists:
        if len(own) < 2:
            continue
        own = own.tolist()
        tops = [top(i) for i in own]
        main = max(set(tops), key=tops.count)
        for x in (i for i, t in zip(own, tops) if t != main):
            for y in own:
                key = (x, y) if x < y else (y, x)
                if x == y or key in tried or top(x) == top(y):
                    continue
                tried.add(key)
                p, q = sets[x], sets[y]
                if min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                if both >= threshold * (len(p) + len(q) - both):
                    out.append((members[x]["node"], members[y]["node"]))
                    up[top(x)] = top(y)
    return out


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, nodes_too: bool = False, into: list[str] | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id of the class; null if none has one), class_size, n_copies (rows of equal text), kept.

    kept: the row stands for its class; repeated rows all do.
    """
    keyed = with_node(docs.select("doc_id", "text"))
    bin_: list[str] = []
    nodes = sketch(keyed, bands, rows, bin_)
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    hub = member.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    crowded = common.settle(member.join(hub, "bucket"), "crowded", bin_)
    stars = common.settle(crowded.filter("node <> hub").select(*_pair("node", "hub")).distinct(), "stars", bin_)

    # bags of the texts that stand in some pair
    wanted = crowded.select("node").distinct()
    ids = nodes.join(wanted, "node").select("node", "doc_id")

    def to_bags(batches):
        known: dict = {}
        for b in common.batches(batches, SKETCH_ROWS, SKETCH_BYTES):
            texts = b.column("_text").to_pylist()
            doc, shingle, weight = bags(texts, known)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle[i:j].astype("<u8").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([weight[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array(12 * np.diff(cut), pa.int64())], ["node", "bag", "weights", "size"])

    one = ids.select(F.col("node").alias("_n"), F.col("doc_id").alias("_i"))
    texts = keyed.select("doc_id", "_text", F.col("_node").alias("node")).join(one, (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_i"))).select("node", "_text")
    shingles = common.settle(texts.mapInArrow(to_bags, "node binary, bag binary, weights binary, size long").dropDuplicates(["node"]), "bags", bin_)
    links = common.settle(verify(stars, shingles, threshold), "links", bin_)
    roots = components(links, bin_)

    # buckets that still hold several components: small ones by pairs across components, others as a whole
    placed = crowded.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    torn = parts.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n")).filter("k > 1").select("bucket", "n")
    open_ = common.settle(placed.join(torn, "bucket").join(shingles.select("node", "size"), "node"), "open", bin_)
    few = open_.filter(F.col("n") <= SMALL)
    other = few.select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"))
    across = few.join(other, "bucket").filter("x < node and root <> rx").select(*_pair("x", "node")).distinct().join(stars, ["a", "b"], "left_anti")
    # a bucket of more than CHUNK members or CHUNK_BYTES of bags is dealt out as pairs of its chunks
    heavy = open_.filter(F.col("n") > SMALL).groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES)).alias("k"))
    many = open_.filter(F.col("n") > SMALL).drop("size").join(heavy, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), "k"))
    many = many.select("bucket", "node", "root", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    whole = many.join(shingles, "node").groupBy("bucket", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_list(F.struct("node", "root", "bag", "weights")).alias("members"))

    def join_in_bucket(batches):
        for b in common.batches(batches, 1):
            for members in b.column("members").to_pylist():
                found = cross_links(members, threshold)
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], ["a", "b"])

    more = common.settle(verify(across, shingles, threshold).union(whole.select("members").mapInArrow(join_in_bucket, "a binary, b binary")), "links", bin_)
    roots = components(more, bin_, roots)

    # classes of several texts learn their names by a salted join, so that a large class is many keys; all others are their own
    linked = common.settle(nodes.drop("bands").join(roots, "node"), "linked", bin_)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("r")
    classes = linked.groupBy("root").agg(first, F.sum("n").alias("class_size")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(classes, ["root", "salt"])
    members = members.select(F.col("node").alias("_node"), F.col("r.doc_id").alias("class_id"), F.col("r.node").alias("_rep"), "class_size", F.col("n").alias("n_copies"))
    alone = nodes.join(roots.select("node"), "node", "left_anti").select(F.col("node").alias("_node"), F.col("doc_id").alias("class_id"), F.col("node").alias("_rep"), F.col("n").alias("class_size"), F.col("n").alias("n_copies"))
    named = common.final(members.unionByName(alone), "classes", bin_, into)
    out = keyed.select("doc_id", "_node").join(named, "_node")
    kept = (F.col("_node") == F.col("_rep")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "class_id", "class_size", "n_copies", kept.alias("kept"), *(["_node"] if nodes_too else []))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class, with their own columns; repeated rows once."""
    bin_: list[str] = []
    keep = common.final(near_classes(docs, nodes_too=True, into=bin_).filter("kept").groupBy("doc_id", "_node").agg(F.count("*").alias("n")), "kept", bin_)
    wide = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_i"), "text")
    wide = wide.withColumn("_n", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    found = wide.join(keep.select("doc_id", "_node"), (F.col("_n") == F.col("_node")) & F.col("_i").eqNullSafe(F.col("doc_id")), "left_semi")
    if keep.filter("n > 1").limit(1).count():  # rows with one id and one text: their first columns' row stays
        found = found.dropDuplicates(["_i", "_n"])
    return found.select("_row.*")
