"""Watching a folder with Structured Streaming. The checkpoint knows the files that are done, also after a restart.

Without ``settle`` files should be moved into the folder when they are complete, as a file is read when it is first seen.
With it, a file is read when its size and time have stood still for so long.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import key_digest
from ..plans.pipeline import Pipeline
from ..sources.documents import BINARY, DocumentSource, decoded, numbered_files, with_found_tables
from ..sources.pages import file_system
from ..sources.shared import materialize


def file_stream(spark: SparkSession, source: DocumentSource) -> DataFrame:
    """Files as they appear; one that is gone before it is read is passed over."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", str(source.recursive).lower())
    return reader.option("pathGlobFilter", source.pattern).option("ignoreMissingFiles", "true").load(source.path)


def _stat(path: str) -> tuple[int, int]:
    """A file's size and time of change, in microseconds; -1 where there is none."""
    store, name = file_system(path)
    info = store.get_file_info(name)
    return (info.size or 0, info.mtime_ns // 1000) if info.is_file else (-1, -1)


def settled(stream: DataFrame, delay: float) -> DataFrame:
    """path of each file of a file stream, once its size and time have stood still for ``delay`` seconds. A file that goes before that never comes.

    The state of a path is its last size and time and whether it has passed; a timer looks at the file again. Files must be
    in a store that Arrow knows.
    """

    def watch(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass  # that the file is there is all that a row says
        (path,), passed = key, False
        size, at, done = state.get if state.exists else (-2, -2, False)
        if not done:
            now = _stat(path)
            passed = state.hasTimedOut and now == (size, at)
            if now == (-1, -1):
                state.remove()
                return
            state.update((*now, passed))
            if not passed:
                state.setTimeoutDuration(max(1, int(delay * 1000)))
        yield pd.DataFrame({"path": [path] if passed else []}, dtype=object)

    seen = stream.select("path", "length").groupBy("path")
    return seen.applyInPandasWithState(watch, "path string", "size long, at long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_content(paths: DataFrame) -> DataFrame:
    """path, content: the files' bytes, read in the tasks; null of a file that can't be read, so that it has an error later."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:  # one file at a time
                store, name = file_system(path)
                try:
                    with store.open_input_file(name) as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": [content]})

    return paths.select("path").mapInPandas(read, "path string, content binary")


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, interval: str = "2 seconds") -> StreamingQuery:
    """Hand each micro-batch and its number to ``write``, which must make a repeated batch take its own place. ``once``: what is there, then end."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def into(output: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch as a partition of a Parquet table."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")


def earlier_keys(spark: SparkSession, folder: str, number: int, days: float) -> DataFrame | None:
    """Keys of the records of batches before ``number``, as far as they are no older than ``days``; None if there are none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return None
    since = datetime.datetime.now() - datetime.timedelta(days=days)
    return spark.read.schema("key binary, seen timestamp, batch long").parquet(folder).where((F.col("batch") < number) & (F.col("seen") >= F.lit(since)))


def watch_folder(
    spark: SparkSession, source: DocumentSource, output: str, checkpoint: str, pipeline: Pipeline | None = None, once: bool = False, interval: str = "2 seconds",
    settle: float | None = None, keep_days: float = 30.0,
) -> StreamingQuery:
    """Append each new file's records to a Parquet table; files that fail are in ``<output>-errors``. A file is decoded once.

    ``settle``: seconds for which a file must stand still before it is read; with ``once``, files are read as they are.
    Where the pipeline removes duplicates, a record whose key an earlier batch had, within ``keep_days``, goes too. The keys,
    16 bytes each, are a table in ``<output>-keys``; a batch reads those of the batches before it, so that it gives the same
    records if it is run again.
    """
    pipeline = pipeline or Pipeline(lineage=True)
    base = output.rstrip("/")
    waits = settle is not None and not once

    def one(batch: DataFrame, number: int) -> None:
        if waits:
            batch = materialize(batch, "settled")  # the only time that the state is asked
            if batch.isEmpty():
                return
        found = with_content(batch) if waits else batch.select("path", "content")
        docs = numbered_files(with_found_tables(materialize(decoded(found, source.decode), "decoded")))
        records = pipeline.records(docs)
        if pipeline.config.deduplicate:
            key = key_digest(pipeline.config.key_columns)
            known = earlier_keys(spark, f"{base}-keys", number, keep_days)
            if known is not None:
                records = records.withColumn("__key", key).join(known.select(F.col("key").alias("__key")), "__key", "left_anti").drop("__key")
            into(output)(records, number)
            written = spark.read.schema(records.schema).parquet(f"{base}/batch={number}")
            into(f"{base}-keys")(written.select(key.alias("key"), F.current_timestamp().alias("seen")), number)
        else:
            into(output)(records, number)
        into(f"{base}-errors")(docs.where("error IS NOT NULL").select("path", "error"), number)

    stream = file_stream(spark, source)
    return ingest(settled(stream, settle) if waits else stream, one, checkpoint, once, interval)
