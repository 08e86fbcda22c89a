"""Streams run over what has arrived, from where the checkpoint left off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STORE, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
#: Only what changed is written with each batch, not a snapshot of the whole state.
_CHANGES, _WIDTH = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(rows: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", store: str | None = None, partitions: int | None = None) -> None:
    """Run a stream over all that its sources hold now, in as many micro-batches as they make of it, into Parquet at ``path`` (each row once) or ``each`` batch; then stop.

    A later call with the same ``checkpoint`` goes on where this one stopped, with the state it left. State whose time is up goes with the next batch that
    has rows: batches without any, which a stream that waits for timeouts makes for ever, aren't run. ``store`` is the class
    that keeps the state, such as ROCKSDB, in so many ``partitions`` (the session's number of shuffle partitions, if not said; a
    checkpoint keeps the number with which it began). The session's own settings are left as they were.
    """
    spark = rows.sparkSession
    wanted = {_IDLE: "false"} | ({_STORE: store, _CHANGES: "true"} if store else {}) | ({_WIDTH: str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()


def arrivals(spark: SparkSession, path: str, schema: str, batches: int, files: int) -> DataFrame:
    """A stream of the Parquet files at ``path``, of which there are about ``files``, in about ``batches`` micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // batches)).parquet(path)
