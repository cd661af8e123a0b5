"""Operator 13: the prefix trie of conversations by an external mergesort that knows common prefixes.

Conversations become sequences of turn digests (128 bits of SHA-256 over role and text). Tasks sort
them in runs of bounded size; a run carries with each sequence how many turns it shares with the
one before (its LCP). Spark deals the runs' rows to ranges of the order, and each range merges its
pieces of runs with a loser tree: of two heads the one that shares more turns with the last output
comes first, and only where both share as many are turns compared, from there on. The merged
stream, with its LCPs, moves an open path: nodes below the shared part are finished and leave.

Equal sequences are ordered by conversation, so that ranges are even however many are equal. What a
range can't finish are the nodes on the paths of its first and last sequence: it gives them as
fragments, in order, and a second stream over these (two paths a range) adds up the fragments of
each node with the same open path. Conversations that end in such a node are passed as text and
hashed as they come.

Conversations are rebuilt first: the first h turns of the hundred's first conversation, then the
own ones after h, where h is the CRC-32 of the id modulo 6. Turns are ordered by number, null
first, equal numbers by digest. Null role or text is empty. Rows without conv_id take no part; a
repeated row is a turn of its own; turnless conversations end in the root; an empty table gives no
rows, not even a root. Other columns are ignored. One conversation is held as one row (20 bytes a
turn), a range of about PART_BYTES in a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Bytes of a digest; of the sequences of a run, and of a range.
WIDTH, RUN_BYTES, PART_BYTES = 16, 16 << 20, 32 << 20
#: Ids of one row of a fragment's conversations; parts into which names are dealt when they are too many to broadcast.
CHUNK, SALTS = 50_000, 16
HEAD = 6
_RUN = "run long, place int, conv_id long, keys binary, sizes array<int>, lcp int"
_PART = "kind int, part int, pos int, path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, size int"
_BORDER = "path binary, parent_path binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: What a row of a part is: finished; finished with a parent that isn't; a fragment.
DONE, LOOSE, FRAGMENT = 0, 1, 2


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and turns (array of digest in hexadecimal, size in code points), in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("key"), F.length(text).alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from its hundred's first."""
    return (F.crc32(conv_id.cast("string")) % HEAD).cast("int")


def rebuild(own: DataFrame) -> DataFrame:
    """conv_id, turns: borrowed turns, then the own ones after as many."""
    base = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEAD - 1).alias("_head"))
    both = own.join(base, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left").withColumn("_h", borrowed(F.col("conv_id")))
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def shared(x: bytes, y: bytes, at: int = 0) -> int:
    """Turns that two sequences have in common from the start, given that they share the first ``at``."""
    n = min(len(x), len(y)) // WIDTH
    while at < n and x[at * WIDTH : (at + 1) * WIDTH] == y[at * WIDTH : (at + 1) * WIDTH]:
        at += 1
    return at


def make_runs(batches):
    """Sorted runs of at most about RUN_BYTES, with LCPs."""
    first, count, rows, held = TaskContext.get().partitionId() << 32, 0, [], 0

    def put():
        rows.sort(key=lambda r: r[:2])
        lcp = [0] + [shared(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32())
        cols = [first + count] * len(rows), range(len(rows)), [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows], lcp
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split(" ")[0] for c in _RUN.split(", ")])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("keys", "conv_id", "sizes"))):
            rows.append(row)
            held += len(row[0]) + 64
            if held >= RUN_BYTES:
                yield put()
                rows, held, count = [], 0, count + 1
    if rows:
        yield put()


def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges runs of (keys, conv_id, sizes, lcp) with a loser tree; yields the same, with the LCP to the one before."""
    k = len(runs)
    sources = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources]
    lcp = [0] * k  # of each head with the last output

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if lcp[a] != lcp[b]:  # the head that shares more with the last output comes first, and the other shares no more with it
            return lcp[a] > lcp[b]
        same = shared(x[0], y[0], lcp[a])
        p, q = (v[0][same * WIDTH : (same + 1) * WIDTH] for v in (x, y))
        won = p < q or p == q and x[1] < y[1]
        lcp[b if won else a] = same
        return won

    losers = [-1] * max(1, k)

    def enter(run: int, node: int) -> int:
        """Plays from a leaf's parent to the root; the winner goes on."""
        while node:
            rival = losers[node]
            if rival < 0:  # the first to come waits for its rival while the tree is built
                losers[node] = run
                return -1
            if not beats(run, rival):
                losers[node], run = run, rival
            node //= 2
        return run

    winner = 0 if k == 1 else -1
    for run in range(k if k > 1 else 0):
        winner = max(winner, enter(run, (run + k) // 2))
    while winner >= 0 and heads[winner] is not None:
        keys, conv, sizes, _ = heads[winner]
        yield keys, conv, sizes, lcp[winner]
        heads[winner] = after = next(sources[winner], None)
        lcp[winner] = after[3] if after else 0
        winner = enter(winner, (winner + k) // 2) if k > 1 else winner


class _Node:
    __slots__ = ("path", "size", "left", "n", "conv", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, path, size, left):
        self.path, self.size, self.left = path, size, left
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends, self.waiting = 0, None, 0, 0, 0, [], []


def _below(path: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(path + key, digest_size=WIDTH).digest()


def _joined(ids) -> str:
    return ",".join(map(str, ids))


def trie_rows(merged: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Rows of _PART: nodes that the range finishes, and fragments of those on its first and last path."""
    stack: list[_Node] = []
    left: list[_Node] = []  # the first sequence's path
    keys: list[bytes] = []  # of the open path

    def close(depth: int):
        while len(stack) - 1 > depth:
            node, at = stack.pop(), len(stack)
            keys.pop()
            up = stack[-1]
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            if node.left:  # its fragment is given at the end
                continue
            up.children += 1
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
            up.leaves += node.leaves
            up.saved += node.saved
            for row in node.waiting:
                yield (DONE, part, 0, None, *row[:2], node.conv, *row[2:], None)
            row = (node.conv, at, node.n, node.children, node.leaves, node.saved, hashlib.sha256(_joined(node.ends).encode()).hexdigest())
            if up.left:
                yield (LOOSE, part, 0, up.path, *row[:2], None, *row[2:], None)
            else:
                up.waiting.append(row)

    for sequence, conv, sizes, lcp in merged:
        depth = len(sequence) // WIDTH
        if not stack:
            stack.append(_Node(b"\0" * WIDTH, 0, True))
            for d in range(depth):
                keys.append(sequence[d * WIDTH : (d + 1) * WIDTH])
                stack.append(_Node(_below(stack[-1].path, keys[-1]), sizes[d], True))
            left = stack[:]
        else:
            yield from close(lcp)
            for d in range(lcp, depth):
                keys.append(sequence[d * WIDTH : (d + 1) * WIDTH])
                stack.append(_Node(None, sizes[d], False))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
    right = [n for n in stack if not n.left]
    # the last path's nodes are fragments too; what waits for them learns their place
    base = len(stack) - len(right)
    for i, node in enumerate(right):
        node.path = _below(stack[base + i - 1].path, keys[base + i - 1])
        for row in node.waiting:
            yield (LOOSE, part, 0, node.path, *row[:2], None, *row[2:], None)
    for below, node in zip(stack[:0:-1], stack[-2::-1]):  # members of open nodes are members above
        node.n += below.n
        node.conv = below.conv if node.conv is None else min(node.conv, below.conv)
    pos = 0
    for depth, node in [*enumerate(left), *((base + i, n) for i, n in enumerate(right))]:
        for at in range(0, max(1, len(node.ends)), CHUNK):
            head = (node.n, node.children, node.leaves, node.saved) if at == 0 else (0, 0, 0, 0)
            ends = _joined(node.ends[at : at + CHUNK]) if node.ends else None
            yield (FRAGMENT, part, pos, node.path, node.conv, depth, None, *head, ends, node.size)
            pos += 1


def _batches(rows: Iterator[tuple], schema: str, size: int = 4096):
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    held: list[tuple] = []

    def put():
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held), fields)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield put()
            held = []
    if held:
        yield put()


def merge_range(batches):
    """A range's pieces of runs, in order of run and place, to the rows of the range."""
    runs: dict[int, list[tuple]] = {}
    for b in batches:
        for run, *row in zip(*(b.column(c).to_pylist() for c in ("run", "keys", "conv_id", "sizes", "lcp"))):
            runs.setdefault(run, []).append(tuple(row))
    if runs:
        yield from _batches(trie_rows(merge(list(runs.values())), TaskContext.get().partitionId()), _PART)


def join_fragments(batches):
    """Fragments, in order of range and place, to finished nodes; only the open path is held."""
    stack: list[list] = []  # path, size, n, conv, children, leaves, saved, hash, whether it has ends

    def close(depth: int):
        while len(stack) > depth:
            path, size, n, conv, children, leaves, saved, digest, _ = stack.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            if stack:
                up = stack[-1]
                up[4] += 1
                up[5] += leaves
                up[6] += saved
            yield (path, stack[-1][0] if stack else None, conv, len(stack), n, children, leaves, saved, digest.hexdigest())

    def rows():
        for b in batches:
            for depth, path, size, n, conv, children, leaves, saved, ends in zip(*(b.column(c).to_pylist() for c in ("depth", "path", "size", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends"))):
                if len(stack) <= depth or stack[depth][0] != path:
                    yield from close(depth)
                    stack.append([path, size, 0, conv, 0, 0, 0, hashlib.sha256(), False])
                own = stack[depth]
                own[2:7] = own[2] + n, min(own[3], conv), own[4] + children, own[5] + leaves, own[6] + saved
                if ends:
                    own[7].update((("," if own[8] else "") + ends).encode())
                    own[8] = True
        yield from close(0)

    yield from _batches(rows(), _BORDER)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node."""
    bin_: list[str] = []
    spark = conversations.sparkSession
    own = common.settle(sequences(conversations.select("conv_id", "turn", "role", "text")), "turns", bin_)
    packed = rebuild(own).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    runs = common.settle(packed.mapInArrow(make_runs, _RUN), "runs", bin_)
    n, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.length("keys") + 64), F.lit(0))).first()
    ranges = max(1, -(-size // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))
    dealt = runs.repartitionByRange(ranges, "keys", "conv_id").sortWithinPartitions("run", "place")
    parts = common.settle(dealt.mapInArrow(merge_range, _PART), "parts", bin_)
    fragments = parts.filter(F.col("kind") == FRAGMENT).select("part", "pos", "depth", "path", "size", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends")
    border = common.settle(fragments.repartition(1).sortWithinPartitions("part", "pos").mapInArrow(join_fragments, _BORDER), "border", bin_)
    loose = parts.filter(F.col("kind") == LOOSE).withColumnsRenamed({"path": "parent_path", "ends": "ends_sha256"})
    columns = [c for c in RESULT if c != "parent_conv_id"]
    lost = loose.select("parent_path", *columns).unionByName(border.select("parent_path", *columns))
    names = border.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    known = common.small(names)
    if known is names:  # a node with very many children is dealt out
        names = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lost.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(names, ["parent_path", "_salt"], "left")
    else:
        found = lost.join(known, "parent_path", "left")
    done = parts.filter(F.col("kind") == DONE).withColumnRenamed("ends", "ends_sha256")
    return common.final(done.select(*RESULT).unionByName(found.select(*RESULT)), "trie", bin_)


ORACLE_SQL = """WITH t0 AS (SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS i FROM t0),
d AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(s) + 1), lambda j: list_concat([CAST(ascii(substring(s, j, 1)) AS BIGINT)], [CAST(0 AS BIGINT) FOR z IN range(7)])))),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 6 AS h FROM d),
r0 AS (SELECT c.conv_id, 0 AS src, t.i, key, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i < h UNION ALL SELECT c.conv_id, 1, t.i, key, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= h),
r AS (SELECT conv_id, size, row_number() OVER w AS depth, md5(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY src, i ROWS UNBOUNDED PRECEDING)) AS path FROM r0 WINDOW w AS (PARTITION BY conv_id ORDER BY src, i)),
m AS (SELECT conv_id, depth, path, size FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM m GROUP BY 1, 2),
p AS (SELECT n.*, u.path AS up FROM n LEFT JOIN m u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
k AS (SELECT up AS path, count(*) AS n_children FROM p WHERE up IS NOT NULL GROUP BY 1),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k USING (path)),
a AS (SELECT m.path, CAST(count(*) FILTER (WHERE q.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((q.n_convs - 1) * q.size) AS BIGINT) AS saved_tokens FROM q JOIN m ON m.conv_id = q.conv_id AND m.depth <= q.depth GROUP BY 1),
l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY 1),
e AS (SELECT path, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY 1)
SELECT q.conv_id, q.depth, o.conv_id AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM q JOIN a USING (path) LEFT JOIN e USING (path) LEFT JOIN n o ON o.path = q.up"""
