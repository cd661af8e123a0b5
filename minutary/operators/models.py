"""Language models as pluggable clients: prompts as expressions, calls by partition, one repair for bad responses."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types

from ..functions import constants as C, text as T
from ..sources.scratch import filesystem, settle

RETRY_CODES = frozenset((408, 409, 429, 500, 502, 503, 504))


class ModelError(Exception):
    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code


def ask(rows: DataFrame, make_client: Callable[[], Callable[[str], str]], prompt: str = "prompt", attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds response and error. A partition makes one client; transient errors are tried again with growing waits.

    A failed call gives a null response and an error, never a failed task: the rest of the partition is kept.
    """
    schema = types.StructType([*rows.schema.fields, types.StructField("response", types.StringType()), types.StructField("error", types.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            answers = [_call(client, p, attempts, wait) for p in b[prompt]]
            yield b.assign(response=[a for a, _ in answers], error=[e for _, e in answers])

    return rows.mapInPandas(run, schema)


def _call(client, prompt, attempts, wait):
    for k in range(attempts):
        try:
            return client(prompt), None
        except ModelError as e:
            if e.code not in RETRY_CODES or k + 1 == attempts:
                return None, f"{e.code}: {e}"
        except (ConnectionError, TimeoutError) as e:
            if k + 1 == attempts:
                return None, f"{type(e).__name__}: {e}"
        time.sleep(wait * 2**k)
    return None, "no attempt"


_ANSWER = pa.schema([("digest", pa.string()), ("prompt", pa.string()), ("response", pa.string())])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """digest, response of all prompts that were answered into a folder; one answer a prompt."""
    try:
        rows = spark.read.schema("digest string, prompt string, response string").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest string, response string")
    return rows.groupBy("digest").agg(F.min("response").alias("response"))


def ask_once(rows: DataFrame, make_client: Callable[[], Callable[[str], str]], folder: str, prompt: str = "prompt", attempts: int = 3, wait: float = 1.0, flush: int = 1) -> DataFrame:
    """Adds response and error like ``ask``, but no prompt that was answered into ``folder`` is sent again.

    Prompts are told apart by their digest, so that equal ones are sent once. Answers are put into the folder as they come, ``flush`` at
    a time: at most so many are lost with an executor. A task that runs again first reads what its earlier attempts have put there, and
    a run that is repeated leaves out all that is answered. Failed calls are not kept, and are made again by the next run.
    """
    spark, run_id = rows.sparkSession, uuid.uuid4().hex
    keyed = rows.withColumn("_digest", F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256))
    open_ = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first(prompt).alias("prompt")).join(answers(spark, folder).select("digest"), "digest", "left_anti")

    def run(batches):
        fs, place = filesystem(folder)
        fs.create_dir(place, recursive=True)
        mine = f"{run_id}-{TaskContext.get().partitionId()}-"
        known: set[str] = set()
        for f in fs.get_file_info(FileSelector(place)):
            if f.base_name.startswith(mine):
                known.update(pq.read_table(f.path, filesystem=fs, columns=["digest"]).column(0).to_pylist())
        client, held = make_client(), []

        def put():
            name = f"{mine}{uuid.uuid4().hex}"
            pq.write_table(pa.Table.from_pylist(held, _ANSWER), f"{place}/_{name}", filesystem=fs)  # names with _ are not read
            fs.move(f"{place}/_{name}", f"{place}/{name}.parquet")
            held.clear()

        for b in batches:
            failed = []
            for digest, text in zip(b.column("digest").to_pylist(), b.column("prompt").to_pylist()):
                if digest in known:
                    continue
                response, error = _call(client, text, attempts, wait)
                if error:
                    failed.append((digest, error))
                    continue
                held.append({"digest": digest, "prompt": text, "response": response})
                if len(held) >= flush:
                    put()
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in failed], pa.string()) for i in (0, 1)], ["_digest", "error"])
        if held:
            put()

    failed = settle(open_.mapInArrow(run, "_digest string, error string"), "failed-calls")
    got = answers(spark, folder).withColumnRenamed("digest", "_digest")
    return keyed.join(got, "_digest", "left").join(failed, "_digest", "left").drop("_digest")


def ask_twice(rows: DataFrame, make_client, fault: Column, repair: Column, **kw) -> DataFrame:
    """Like ask; rows whose response has a fault are asked once more with the repair prompt. Adds calls and fault.

    Only faulty rows reach the second call: the frame is split and put together again.
    """
    first = ask(rows, make_client, **kw).withColumn("fault", F.coalesce(F.when(F.col("error").isNotNull(), F.lit("model_error")), fault))
    good = first.filter("fault is null").withColumn("calls", F.lit(1))
    again = first.filter("fault is not null").withColumn("prompt", repair).drop("response", "error", "fault")
    second = ask(again, make_client, **kw).withColumn("fault", F.coalesce(F.when(F.col("error").isNotNull(), F.lit("model_error")), fault)).withColumn("calls", F.lit(2))
    return good.unionByName(second.select(*good.columns))


def tagged(name: str, value: Column, **attributes: Column) -> Column:
    """``<name attr="...">value</name>`` with everything escaped and blanks shown as UNKNOWN."""
    attrs = [F.concat(F.lit(f' {k}="'), T.xml_text(v), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), T.xml_text(value), F.lit(f"</{name}>"))


def segment_prompt(instruction: str) -> Column:
    """Prompt for one segment with its neighbours (columns of ``with_context``)."""
    return F.concat_ws(
        "\n",
        F.lit(instruction),
        tagged("session", F.col("session_title")),
        tagged("before", F.col("prev_context")),
        tagged("current_segment", F.col("clean_text"), id=F.col("segment_id"), speaker=F.col("speaker_id")),
        tagged("after", F.col("next_context")),
    )


def repair_prompt(instruction: str, fault: Column, response: Column, request: Column) -> Column:
    """Prompt that asks once more: what was wrong, what was answered, what had been asked."""
    return F.concat_ws("\n", F.lit(instruction), tagged("fault", fault), tagged("response", response), tagged("request", request))


def chunk_prompt(chunk: Column, tag: str = "chunk") -> Column:
    """A chunk of a session's text between marks, as it is."""
    return F.concat(F.lit(f"<{tag}>\n"), F.coalesce(chunk, F.lit("")), F.lit(f"\n</{tag}>"))


def command_prompt(source_key: Column, source: Column, candidates: Column, unique_target: Column, mode: Column, actions: tuple[str, ...] = C.COMMAND_ACTIONS) -> Column:
    """JSON of what a command is made from: the source (a struct), the matched tasks (an array), the clear target, and the shape wanted."""
    patch = F.struct(*(F.lit(None).cast("string").alias(f) for f in C.PATCH_FIELDS))
    shape = F.struct(F.lit("|".join(actions)).alias("db_action"), F.lit(None).cast("string").alias("target_task_id"), F.lit(None).cast("long").alias("expected_version"), patch.alias("task_patch"), source.alias("evidence"))
    whole = F.struct(source_key.alias("source_key"), source.alias("source"), candidates.alias("task_candidates"), unique_target.alias("unique_target_task_id"), mode.alias("match_mode"), F.array(*map(F.lit, actions)).alias("allowed_actions"), F.array(shape).alias("required_commands"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def project_prompt(text: Column, source_name: Column, catalogue: Column) -> Column:
    """JSON of a text, the project name that stands in it, and the catalogue (an array) that the name may belong to."""
    return F.to_json(F.struct(text.alias("task_text"), source_name.alias("source_name"), catalogue.alias("project_catalog")), {"ignoreNullFields": "false"})


def resolution(value: Column, project_id: Column, canonical: Column) -> Column:
    """existing, new or none from the spellings that models use; an unknown spelling falls back on the other fields."""
    # Spellings of each resolution.
    spellings = {"existing": "existing exist match matched reuse existing_project".split(), "new": "new create new_project".split(), "none": "none no_project unknown".split()}
    word = F.lower(T.strip(value))
    out = F
    for name, words in spellings.items():
        out = out.when(word.isin(*words), F.lit(name))
    return out.when(T.strip(project_id) != "", F.lit("existing")).when(T.strip(canonical) != "", F.lit("new")).otherwise(F.lit("none"))
