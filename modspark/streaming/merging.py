"""Tables that a stream keeps up to date: status and map entries per id, and output made with versioned parameters."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from modspark.sources.readers import newest_run, params_of_run

_POINTER = "base string, folded map<string, long>, version long"


class StatusMaps:
    """Last status and merged map per id, from updates ``key, seq, status, entries``.

    Every id keeps its status and each entry of its map with the ``seq`` that set it; of equal ones the larger
    value stays. Folding is therefore the same in any order and any number of times: a batch adds its own reduced rows
    as a delta, a replayed batch overwrites its delta, a read reduces base and deltas. ``compact`` writes a new base and then
    one pointer, from which reads take it; streams may run meanwhile, and none of two compactions at a time is lost:
    the second fails. An update with a null seq loses against any other; an id without entries has a null map.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, seq: str, status: str, entries: str):
        self.spark, self.path = spark, path
        self.key, self.seq, self.status, self.entries = key, seq, status, entries
        kind = schema[entries].dataType
        if not isinstance(kind, MapType):
            raise TypeError(f"{entries} is no map")
        newest = [StructField("seq", schema[seq].dataType), StructField("status", schema[status].dataType), StructField("value", kind.valueType)]
        self.stored = StructType([StructField("key", schema[key].dataType), StructField("name", kind.keyType), StructField("newest", StructType(newest))])

    def _rows(self, updates: DataFrame) -> DataFrame:
        """A row for the status (a null name) and one for each entry, reduced map-side to the newest."""
        kinds = {f.name: f.dataType for f in self.stored["newest"].dataType.fields}
        row = lambda name, status, value: F.struct(
            name.cast(self.stored["name"].dataType).alias("name"),
            F.struct(F.col(self.seq).alias("seq"), status.cast(kinds["status"]).alias("status"), value.cast(kinds["value"]).alias("value")).alias("newest"),
        )
        none = F.lit(None)
        of_map = F.transform(F.map_entries(self.entries), lambda e: row(e["key"], none, e["value"]))
        rows = F.concat(F.array(row(none, F.col(self.status), none)), F.coalesce(of_map, F.array()))
        return self._newest(updates.select(F.col(self.key).alias("key"), F.inline(rows)))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "name").agg(F.max("newest").alias("newest"))

    def follow(self, updates: DataFrame, checkpoint: str) -> StreamingQuery:
        run = "c" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

        def merge(batch: DataFrame, batch_id: int) -> None:
            self._rows(batch).write.mode("overwrite").parquet(f"{self.path}/delta/run={run}/batch={batch_id}")

        return (
            updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def _pointer(self):
        try:
            rows = self.spark.read.schema(_POINTER).json(f"{self.path}/current")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.orderBy(F.desc("version")).first()

    def _parts(self, pointer) -> tuple[DataFrame, DataFrame]:
        """The base and the deltas that it does not hold yet, by folder."""
        named = StructType([*self.stored.fields, StructField("run", StringType()), StructField("batch", LongType())])
        deltas = self.spark.read.schema(named).parquet(f"{self.path}/delta")
        if pointer is None:
            return self.spark.createDataFrame([], self.stored), deltas
        for run, batch in sorted((pointer["folded"] or {}).items()):
            deltas = deltas.where(~((F.col("run") == run) & (F.col("batch") <= batch)))
        return self.spark.read.schema(self.stored).parquet(pointer["base"]), deltas

    def read(self) -> DataFrame:
        """``key, seq, status, entries`` under the names of the updates."""
        base, deltas = self._parts(self._pointer())
        entry = F.when(F.col("name").isNotNull(), F.struct("name", F.col("newest.value").alias("value")))
        of_status = F.max(F.when(F.col("name").isNull(), F.col("newest")))
        wide = self._newest(base.unionByName(deltas.drop("run", "batch"))).groupBy("key").agg(of_status.alias("own"), F.collect_list(entry).alias("all"))
        merged = F.when(F.size("all") > 0, F.map_from_entries(F.array_sort("all")))
        return wide.select(F.col("key").alias(self.key), F.col("own.seq").alias(self.seq), F.col("own.status").alias(self.status), merged.alias(self.entries))

    def compact(self) -> None:
        pointer = self._pointer()
        base, deltas = self._parts(pointer)
        # One row for each stream that ever wrote here.
        folded = {r["run"]: r["batch"] for r in deltas.groupBy("run").agg(F.max("batch").alias("batch")).collect()}
        within = F.lit(False)
        for run, batch in sorted(folded.items()):
            within = within | ((F.col("run") == run) & (F.col("batch") <= batch))
        target = f"{self.path}/base/{uuid.uuid4().hex}"
        self._newest(base.unionByName(deltas.where(within).drop("run", "batch"))).write.parquet(target)
        version = 1 if pointer is None else pointer["version"] + 1
        every = {**((pointer["folded"] or {}) if pointer else {}), **folded}
        line = self.spark.createDataFrame([(target, every)], "base string, folded map<string, long>")
        line.coalesce(1).write.mode("error").json(f"{self.path}/current/version={version}")


def bound_run(spark: SparkSession, path: str, batch_id: int, params: str) -> str | None:
    """The parameter run of a micro-batch: that of its first attempt, or the newest one, written down before use."""
    note = f"{path}/bound/batch={batch_id}"
    try:
        first = spark.read.schema("run_id string").json(note).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        first = None
    if first is None:
        first = {"run_id": newest_run(spark, params)}
        spark.createDataFrame([(first["run_id"],)], "run_id string").coalesce(1).write.mode("overwrite").json(note)
    return first["run_id"]


def with_newest_params(
    stream: DataFrame, params: str, schema: StructType, apply: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """``apply(batch, parameters)`` for each micro-batch, with the parameters that are newest when it starts.

    A newer run is taken up from the next micro-batch on, without a restart. A batch keeps its run: repeated after a failure,
    it gives the same rows again and overwrites its own. Without a run the parameters are empty. Rows go to ``path/out``,
    a folder for each batch, the runs to ``path/bound``.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        run = bound_run(batch.sparkSession, path, batch_id, params)
        given = params_of_run(batch.sparkSession, params, schema, run)
        apply(batch, given).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
