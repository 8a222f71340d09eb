"""Structured Streaming forms of ingestion, windows and the lineage fold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemoframe.operators.ingest import new_arrivals
from mnemoframe.operators.lineage import Fold, Kept
from mnemoframe.session import local_folder


def workspace(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder; a temporary one only on a local master where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared or local_folder(spark, 'stream')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table as a stream of its files; times are taken as UTC so that watermarks can follow them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        df = reader.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is there and reads its output back."""
    place = workspace(df.sparkSession)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{place}/out").awaitTermination()
    else:  # complete or update: each batch is written by its own id, the last one holds
        last: list[int] = []

        def put(batch: DataFrame, k: int) -> None:
            batch.write.mode("overwrite").parquet(f"{place}/out/{k}")
            last[:] = [k]

        writer.foreachBatch(put).start().awaitTermination()
        place = f"{place}/out/{last[0] if last else 0}"
        return df.sparkSession.read.schema(df.schema).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(f"{place}/out")


def deduplicated(events: DataFrame, delay: str = "365 days") -> DataFrame:
    """The first delivery of each event id within the watermark's delay."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["source_event_id"])


def windowed(events: DataFrame, every: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Counts per window of event time, corrected by late events until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy("event_type", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))


def ingest_batch(path: str, known_columns: tuple[str, ...] = ("tenant_id", "idempotency_key")) -> object:
    """A foreachBatch function that inserts what is new. A batch that is run again replaces its own files, so nothing doubles."""

    def put(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.option("basePath", path).parquet(f"{path}").where(F.col("batch") < k).select(*known_columns)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.select(*known_columns).limit(0)
        new_arrivals(batch, known).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return put


def chained(path: str, candidates: DataFrame, versions: DataFrame) -> object:
    """A foreachBatch function of three stages: what is new of the events, the candidates drawn from it, and the search rows of their versions.

    Each stage writes its own folder by batch and the next reads what the one before wrote for this batch, so a batch that fails
    anywhere is run again as a whole and replaces its own files. ``candidates``: candidate_id, source_event_id and more; ``versions``:
    version_id, candidate_id and more.
    """
    ingest = ingest_batch(f"{path}/events")

    def put(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        ingest(batch, k)
        events = spark.read.schema(batch.schema).parquet(f"{path}/events/batch={k}")
        drawn = candidates.join(events.select("source_event_id").distinct(), "source_event_id", "left_semi")
        drawn.write.mode("overwrite").parquet(f"{path}/candidates/batch={k}")
        kept = spark.read.schema(candidates.schema).parquet(f"{path}/candidates/batch={k}")
        sources = kept.where(F.col("candidate_id").isNotNull()).groupBy("candidate_id").agg(F.array_sort(F.collect_set("source_event_id")).alias("source_event_ids"))
        versions.join(sources, "candidate_id").write.mode("overwrite").parquet(f"{path}/projection/batch={k}")

    return put


_FOLD_OUT = "memory_id string, version_id string, operation string, new_status string"
_FOLD_STATE = "ids array<string>, contents array<string>, vals array<string>, starts array<bigint>, ends array<bigint>, certain array<boolean>, statuses array<string>"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = [Kept(i, v, c, s, e, bool(k), t) for i, c, v, s, e, k, t in zip(*state.get, strict=True)] if state.exists else []
    rows = pd.concat(list(frames)).sort_values(["version_number", "version_id"])
    fold, out, seen = Fold(bool(rows["single"].iloc[0]), kept), [], {k.version_id for k in kept}
    number = lambda x: None if pd.isna(x) else int(x)
    for r in rows.itertuples():
        if r.version_id in seen:
            continue
        seen.add(r.version_id)
        new = Kept(r.version_id, r.value_json, " ".join((r.content or "").lower().split()), number(r.s), number(r.e), bool(r.k), "")
        operation, _, _ = fold.plan(new)
        out.append((key[0], r.version_id, operation, new.status or None))
    k = list(fold.kept.values())
    state.update(([x.version_id for x in k], [x.content for x in k], [x.value for x in k], [x.start for x in k], [x.end for x in k], [x.certain for x in k], [x.status for x in k]))
    yield pd.DataFrame(out, columns=["memory_id", "version_id", "operation", "new_status"])


def folded(versions: DataFrame) -> DataFrame:
    """The lineage fold with its retained versions as state; rows need memory_id, version_number, version_id, single, value_json, content, s, e, k."""
    return versions.groupBy("memory_id").applyInPandasWithState(_fold, _FOLD_OUT, _FOLD_STATE, "append", GroupStateTimeout.NoTimeout)
