"""Tasks that a stream of commands keeps up to date, in buckets of which only those with new commands are written anew.

A micro-batch is applied to the stored tasks as a batch is (``store.apply_commands``): event keys and source keys are unique over all
tasks, so a batch decides on them as a whole, which state kept task by task could not. What is stored: tasks by bucket of their id,
event keys and source keys by bucket of the key, and the events of each batch. A batch writes folders of its own and then its
manifest, which names the folder of each bucket; the manifest is what counts. A batch that is repeated after a failure overwrites what
it left, and one that is in a manifest already is passed over.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import store

_TASK = "task_id string, version long, status string, is_deleted int, " + ", ".join(f"{f} {k}" for f, k in store._KINDS.items()) + ", source_key string, bucket int"


@dataclass(frozen=True)
class TaskStore:
    """A folder that holds tasks, keys and events; buckets is fixed when the folder is first used."""

    folder: str
    buckets: int = 256

    def _fs(self, spark: SparkSession, path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def manifest(self, spark: SparkSession) -> dict:
        """batch: the last batch that counts, -1 before the first; tasks: folder of each bucket; keys: folders of each kind of key."""
        fs, place = self._fs(spark, f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        done = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not done:
            return {"batch": -1, "buckets": self.buckets, "tasks": {}, "event_key": {}, "source_key": {}}
        text = spark.read.text(f"{self.folder}/manifests/{max(done)}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, spark: SparkSession, found: dict) -> None:
        fs, part = self._fs(spark, f"{self.folder}/manifests/{found['batch']}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/{found['batch']}.json"))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
        """Parquet of folders that end in bucket=N, with that bucket as a column."""
        if not paths:
            return spark.createDataFrame([], schema)
        kept = ", ".join(x for x in schema.split(", ") if not x.startswith("bucket "))
        rows = spark.read.schema(kept).parquet(*paths)
        return rows.withColumn("bucket", F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).cast("int"))

    def tasks(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The stored tasks (of some buckets)."""
        there = self.manifest(spark)["tasks"]
        return self._read(spark, [p for b, p in there.items() if buckets is None or int(b) in buckets], _TASK)

    def events(self, spark: SparkSession) -> DataFrame:
        """Events of all batches that count."""
        last = self.manifest(spark)["batch"]
        try:
            return spark.read.parquet(f"{self.folder}/events").filter(F.col("batch") <= last)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return spark.createDataFrame([], store.RESULT + ", batch long")

    def _keys(self, spark: SparkSession, found: dict, kind: str, asked: DataFrame) -> DataFrame:
        """The stored keys among those asked for; only their buckets are read."""
        wanted = [r[0] for r in asked.select(self._bucket(kind)).distinct().collect()]  # at most ``buckets``
        paths = [p for b in wanted for p in found[kind].get(str(b), [])]
        return self._read(spark, paths, f"{kind} string, bucket int").select(kind).join(asked.select(kind).distinct(), kind, "left_semi")

    def _put(self, rows: DataFrame, kind: str, batch: int) -> dict[str, str]:
        """Writes rows by bucket; the folders of the buckets."""
        path = f"{self.folder}/{kind}/batch={batch}"
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        fs, place = self._fs(rows.sparkSession, path)
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return {n.removeprefix("bucket="): f"{path}/{n}" for n in names if n.startswith("bucket=")}

    def apply(self, commands: DataFrame, batch: int) -> None:
        """Applies commands (as ``store.apply_commands`` takes them) once, as the batch of this number."""
        spark = commands.sparkSession
        found = self.manifest(spark)
        if batch <= found["batch"]:
            return
        if found["buckets"] != self.buckets:
            raise ValueError(f"the folder has {found['buckets']} buckets")
        rows = store._filled(commands, **store._KINDS, source_key="string", status="string", expected_version="long")
        touched = [r[0] for r in rows.select(self._bucket("task_id")).distinct().collect()]
        mine = self._read(spark, [found["tasks"][str(b)] for b in touched if str(b) in found["tasks"]], _TASK)
        named = rows.filter("source_key is not null")
        owners = self._keys(spark, found, "source_key", named).join(mine.select("source_key"), "source_key", "left_anti")
        other = owners.select(F.concat(F.lit("\0"), "source_key").alias("task_id"), "source_key")  # owners in other buckets: their keys are taken
        log = self._keys(spark, found, "event_key", rows)
        events = store.apply_commands(rows, mine.drop("bucket").unionByName(other, allowMissingColumns=True), log)
        events.write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        events = spark.read.schema(events.schema).parquet(f"{self.folder}/events/batch={batch}")

        applied = events.filter("execution_status = 'applied'")
        state = F.struct("seq", F.col("version_after").alias("version"), "status", "is_deleted", *store.FIELDS)
        last = applied.groupBy("task_id").agg(F.max_by(state, "seq").alias("s")).select("task_id", "s.version", "s.status", "s.is_deleted", *(f"s.{f}" for f in store.FIELDS))
        made = applied.filter("db_action = 'CREATE'").select("seq").join(named.select("seq", "task_id", "source_key"), "seq").select("task_id", F.col("source_key").alias("_made"))
        old = mine.select("task_id", F.col("source_key").alias("_had"))
        last = last.join(made, "task_id", "left").join(old, "task_id", "left").withColumn("source_key", F.coalesce("_had", "_made")).drop("_had", "_made").withColumn("bucket", self._bucket("task_id"))
        changed = last.select("bucket").distinct()
        kept = mine.join(last.select("task_id"), "task_id", "left_anti").join(F.broadcast(changed), "bucket", "left_semi")  # at most ``buckets`` rows
        columns = [f.split(" ")[0] for f in _TASK.split(", ")]
        tasks = self._put(last.select(*columns).unionByName(kept.select(*columns)), "tasks", batch)
        keys = self._put(events.select("event_key", self._bucket("event_key").alias("bucket")).distinct().join(log, "event_key", "left_anti"), "event_keys", batch)
        sources = self._put(made.filter("_made is not null").select(F.col("_made").alias("source_key"), self._bucket("_made").alias("bucket")), "source_keys", batch)
        for kind, new in (("event_key", keys), ("source_key", sources)):
            for b, path in new.items():
                found[kind].setdefault(b, []).append(path)
        self._commit(spark, found | {"batch": batch, "tasks": found["tasks"] | tasks})

    def follow(self, spark: SparkSession, path: str, schema: StructType | str, checkpoint: str, files: int = 1000) -> StreamingQuery:
        """Applies the commands that have landed as Parquet, some files a micro-batch, and stops; goes on where it was when it is called again."""
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        return landed.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
