"""Overlapping chunks of documents, and context of transcript segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as C, text as T
from . import ordered


_CHUNK_ROWS = 512
_LINE_END = re.compile(r"\r\n?")


def spans(n: int, last_mark: Callable[[int, int], int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the chunks of a text of n characters; last_mark(i, j) is the place of the last mark in that stretch, or -1."""
    st = en = 0
    while en < n:
        hard = min(n, st + size)
        mark = last_mark(st + size // 2, hard) if hard < n else -1
        en = mark + 1 if mark >= 0 else hard
        yield st, en
        st = max(en - overlap, st + 1)


def chunks(docs: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, marks: str = C.SENTENCE_MARKS) -> DataFrame:
    """doc_id, chunk_no, st, en, chunk: stretches of at most size characters that end behind a mark where one stands in their second half.

    One pass over each document, in its own row: nothing is shuffled, and a long text takes time in proportion to its length. Blank
    stretches keep their number and give no row; null and blank texts have no chunk.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                t = _LINE_END.sub("\n", text or "").strip(T.BLANKS)
                last = lambda i, j, t=t: max(t.rfind(m, i, j) for m in marks)
                for k, (st, en) in enumerate(spans(len(t), last, size, overlap)):
                    chunk = t[st:en].strip(T.BLANKS)
                    if chunk:
                        out.append((i, k, st, en, chunk))
                    if len(out) == _CHUNK_ROWS:
                        yield _chunk_rows(b, out)
                        out = []
            if out:
                yield _chunk_rows(b, out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_no int, st int, en int, chunk string")


def _chunk_rows(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    row, no, st, en, chunk = zip(*out)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int32()) for c in (no, st, en)), pa.array(chunk, pa.string())], ["doc_id", "chunk_no", "st", "en", "chunk"])


def with_context(segments: DataFrame, chars: int = C.CONTEXT_CHARS, by: tuple[str, ...] = ("file",), block: int = ordered.BLOCK) -> DataFrame:
    """Adds prev_context and next_context: the neighbouring segment's last or first characters, if it is of the same session.

    ``by`` names the file, within which the neighbour is that in order (``ord``); a neighbour of another session gives no context,
    and is not skipped. A file of more than ``block`` segments is cut into blocks that see each other's edge rows.
    """
    title = F.col("session_title")
    same = lambda x: F.coalesce(x == title, F.lit(False))

    def made(w):
        prev, after = F.lag("clean_text").over(w), F.lead("clean_text").over(w)
        return {
            "prev_context": F.when(same(F.lag(title).over(w)), F.right(prev, F.lit(chars))).otherwise(F.lit("")),
            "next_context": F.when(same(F.lead(title).over(w)), F.left(after, F.lit(chars))).otherwise(F.lit("")),
        }

    return ordered.neighbours(segments, list(by), ["ord"], 1, made, block=block)


def segment_faults(segments: DataFrame) -> DataFrame:
    """Counts of what breaks the segment contract: blank ids, repeated ids, blank texts."""
    ids = segments.groupBy("segment_id").agg(F.count("*").alias("n"), F.count_if(T.strip(F.col("clean_text")) == "").alias("blank"))
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_segments"),
        F.coalesce(F.sum(F.when(T.strip(F.col("segment_id")) == "", F.col("n"))), F.lit(0)).alias("blank_ids"),
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_texts"),
    )
