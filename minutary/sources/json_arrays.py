"""Items of JSON arrays of any size: files are cut into byte ranges, and each range gives the items that begin in it.

Where a range begins inside the JSON (in a string, behind a backslash, how deep) is not known to the task that reads it. So a first
pass describes every range for each way in which it can begin: how it then ends, and how many commas stand at each depth. A range
gives one narrow row. The rows of a file are chained in order, which gives each range its true beginning and the number of its
first item. The second pass reads the ranges again and cuts the items, each with the bytes that it has beyond its range.

Files are read through ``pyarrow.fs`` (local, HDFS and object-store URIs) and must not be compressed. A task holds a piece of a range, or one item.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a range, and those that a task scans at a time.
RANGE, PIECE = 32 << 20, 1 << 20
_OUT, _IN, _ESCAPED = range(3)  # outside of strings, in one, and in one behind a backslash
_COMMA, _OPEN, _CLOSE, _SLASH, _QUOTE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
for _kind, _chars in ((_COMMA, b","), (_OPEN, b"[{"), (_CLOSE, b"]}"), (_SLASH, b"\\"), (_QUOTE, b'"')):
    _KIND[list(_chars)] = _kind
_SPACE = b" \t\r\n"


def marks(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and kinds of commas and brackets outside of strings, and the state at the end."""
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    at = np.flatnonzero(kinds)
    kind = kinds[at]
    slash = kind == _SLASH
    # the run of backslashes before a mark: an odd one takes its meaning; a run at the beginning goes on from the range before
    fresh = np.ones(len(at), bool)
    fresh[1:] = ~slash[1:] | ~slash[:-1] | (at[1:] != at[:-1] + 1)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else at
    run_from = at[first]
    run = np.where(slash, at - run_from + 1, 0) + ((run_from == 0) & slash & (state == _ESCAPED))
    before = np.zeros(len(at), np.int64)
    if len(at) > 1:
        before[1:] = np.where(at[1:] == at[:-1] + 1, run[:-1], 0)
    if len(at) and at[0] == 0 and not slash[0]:
        before[0] = state == _ESCAPED
    quote = (kind == _QUOTE) & (before % 2 == 0)
    inside = (np.cumsum(quote) + (state != _OUT)) % 2 == 1
    keep = (kind <= _CLOSE) & ~inside
    end = _IN if (bool(inside[-1]) if len(at) else state != _OUT) else _OUT
    if end == _IN:
        if len(at) and slash[-1] and at[-1] == len(data) - 1:
            end = _ESCAPED if run[-1] % 2 else _IN
        elif not data:
            end = state
    return at[keep], kind[keep], end


def levels(kind: np.ndarray, depth: int) -> np.ndarray:
    """The depth behind each mark."""
    return np.cumsum((kind == _OPEN).astype(np.int64) - (kind == _CLOSE)) + depth


def describe(data: Iterable[bytes]) -> list[dict]:
    """For each state that a range may begin in: the state at its end, its change of depth, and its commas and closing brackets by the depth
    behind them (counted from the beginning's)."""
    ways = [{"state": s, "depth": 0, "commas": {}, "closes": {}} for s in (_OUT, _IN, _ESCAPED)]
    for piece in data:
        seen = {s: marks(piece, s) for s in {w["state"] for w in ways}}
        for way in ways:
            _, kind, way["state"] = seen[way["state"]]
            level = levels(kind, way["depth"])
            for name, what in (("commas", _COMMA), ("closes", _CLOSE)):
                for d, n in zip(*(x.tolist() for x in np.unique(level[kind == what], return_counts=True))):
                    way[name][d] = way[name].get(d, 0) + n
            way["depth"] = int(level[-1]) if len(level) else way["depth"]
    return ways


def pieces(f, start: int, end: int, size: int = PIECE) -> Iterator[bytes]:
    f.seek(start)
    while start < end:
        data = f.read(min(size, end - start))
        if not data:
            return
        start += len(data)
        yield data


def items(f, start: int, end: int, n_bytes: int, state: int, depth: int, ord_: int, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of the items that begin in a range, which starts in a state and depth, before the item after ``ord_`` commas.

    An item begins behind the array's bracket or a comma of the array; what stands there up to the next such comma, or the bracket
    that closes the array, is the item. A range that begins within an item leaves it to the range before.
    """
    open_, held, at = False, [], start
    for data in pieces(f, start, n_bytes, size):
        places, kind, state = marks(data, state)
        level = levels(kind, depth)
        cut = (kind == _COMMA) & (level == 1) | (kind == _OPEN) & (level == 1) | (kind == _CLOSE) & (level == 0)
        from_ = 0
        for place, what in zip(places[cut].tolist(), kind[cut].tolist()):
            if open_:
                held.append(data[from_:place])
                item = b"".join(held).strip(_SPACE)
                if item or what == _COMMA:
                    yield ord_, item
            ord_ += what == _COMMA
            if at + place >= end or what == _CLOSE:
                return
            open_, held, from_ = True, [], place + 1
        if open_:
            held.append(data[from_:])
        depth = int(level[-1]) if len(level) else depth
        at += len(data)
        if at >= end and not open_:
            return


_RANGE = "path string, start long, end long, n_bytes long"
_SEEN = "lead int, ends array<struct<state: int, depth: int, commas: map<int, long>, closes: map<int, long>>>"


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, start, end, n_bytes: the byte ranges of the files under a path; nothing is read of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("n_bytes"))
    out = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(size))).alias("start"), "n_bytes")
    out = out.withColumn("end", F.least(F.col("start") + size, "n_bytes"))
    return out.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start").select("path", "start", "end", "n_bytes")


def _opened(path: str):
    """A file by the path that Spark gives it, in which nothing is escaped."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, place = rest.removeprefix("//").partition("/")
    found, root = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
    return found.open_input_file(f"{root.rstrip('/')}/{place}")


def chained(spark: SparkSession, path: str, size: int = RANGE, strict: bool = False) -> DataFrame:
    """The ranges with their true state, depth and ord; ranges of files that are no closed array are left out, or an error if ``strict``."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                with _opened(row["path"]) as f:
                    lead = next((x[0] for x in (p.strip(_SPACE) for p in pieces(f, row["start"], row["end"])) if x), None)
                    ways = describe(pieces(f, row["start"], row["end"]))
                row |= {"lead": lead, "ends": [w | {"commas": list(w["commas"].items()), "closes": list(w["closes"].items())} for w in ways]}
                yield pa.RecordBatch.from_pylist([row], schema)

    counts = pa.map_(pa.int32(), pa.int64())
    end = pa.struct([("state", pa.int32()), ("depth", pa.int32()), ("commas", counts), ("closes", counts)])
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_bytes", pa.int64()), ("lead", pa.int32()), ("ends", pa.list_(end))])
    seen = ranges(spark, path, size).mapInArrow(run, f"{_RANGE}, {_SEEN}")
    # the chain of a file folds one narrow row a range: 32,000 rows for a terabyte
    rows = seen.groupBy("path").agg(F.collect_list(F.struct("start", "end", "n_bytes", "ends")).alias("r"), F.min_by("lead", F.when(F.col("lead").isNotNull(), F.col("start"))).alias("lead"))

    def chain(batches):
        for b in batches:
            for file in b.to_pylist():
                state, depth, ord_, closed, out = _OUT, 0, 0, 0, []
                for r in sorted(file["r"], key=lambda r: r["start"]):
                    out.append({"path": file["path"], "start": r["start"], "end": r["end"], "n_bytes": r["n_bytes"], "state": state, "depth": depth, "ord": ord_})
                    went = r["ends"][state]
                    ord_ += dict(went["commas"]).get(1 - depth, 0)
                    closed += dict(went["closes"]).get(-depth, 0)
                    state, depth = went["state"], depth + went["depth"]
                whole = file["lead"] == ord("[") and state == _OUT and depth == 0 and closed == 1
                if not whole and strict:
                    raise ValueError(f"no closed JSON array: {file['path']}")
                yield pa.RecordBatch.from_pylist(out if whole else [], known)

    known = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_bytes", pa.int64()), ("state", pa.int32()), ("depth", pa.int32()), ("ord", pa.int64())])
    return rows.mapInArrow(chain, f"{_RANGE}, state int, depth int, ord long")


def array_items(spark: SparkSession, path: str, size: int = RANGE, strict: bool = False) -> DataFrame:
    """file, ord, value: every item of the JSON arrays under a path as its own JSON text, with its place in the file from 0.

    A file that isn't one closed array (an object, broken JSON, an empty file) gives no rows, or fails the job if ``strict``. An item is
    not checked itself: ``from_json`` shows what it is. Bytes that aren't UTF-8 become the replacement character.
    """

    def run(batches):
        for b in batches:
            out, n = [], 0
            for row in b.to_pylist():
                with _opened(row["path"]) as f:
                    for k, item in items(f, row["start"], row["end"], row["n_bytes"], row["state"], row["depth"], row["ord"]):
                        out.append((row["path"], k, item.decode("utf-8", "replace")))
                        n += len(item)
                        if n >= PIECE:
                            yield _rows(out)
                            out, n = [], 0
            if out:
                yield _rows(out)

    known = chained(spark, path, size, strict)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return known.repartition(parts, "path", "start").mapInArrow(run, "file string, ord long, value string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    file, ord_, value = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(ord_, pa.int64()), pa.array(value, pa.string())], ["file", "ord", "value"])
