"""Registered streaming queries: ``events`` arrives slice by slice, and SQL sees the whole table.

Every slice is appended to a folder and taken in by a run that goes on from the last one's checkpoint, as
after a restart. Sinks are written in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.catalog import _EVENTS, _tag_events
from tesserae.session import scratch, table
from tesserae.streaming import live
from tesserae.streaming import tags as tg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SLICES = 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def fed(rows: DataFrame, time: str, work: Callable[[DataFrame], DataFrame], mode: str = "append", slices: int = SLICES) -> DataFrame:
    """``work`` on a stream of ``rows``, in ``slices`` of equal spans of time; what was put out, with ``_batch`` in update mode."""
    spark = rows.sparkSession
    source, sink, checkpoint = (scratch(spark, n) for n in ("arriving", "arrived", "progress"))
    ends = rows.agg(F.min(F.col(time).cast("double")).alias("a"), F.max(F.col(time).cast("double")).alias("b")).first()
    low, step = ends.a or 0.0, ((ends.b or 0.0) - (ends.a or 0.0)) / slices or 1.0
    at = F.least(F.floor((F.col(time).cast("double") - low) / step), F.lit(slices - 1))
    for i in range(slices):
        rows.where(at == i).write.mode("append").parquet(source)
        out = work(live.read(spark, source, rows.schema, 1_000))
        if mode == "append":
            live.run_once(out, sink, checkpoint)
        else:
            kept = lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(sink)
            out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(kept).start().awaitTermination()
    return spark.read.parquet(sink)


def _timed(spark: SparkSession, d: str) -> DataFrame:
    log = _tag_events(spark, d)
    times = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return log.join(times, "seq")


def _tags(rows: DataFrame) -> DataFrame:
    """The tags that stand after ``rows`` have streamed by; state is kept by RocksDB, which custom state needs."""
    spark, name = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return tg.latest(fed(rows, "ts", tg.tag_changes)).select("_row_idx", "cat_id", "coder", "seq")
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_STAND = """s AS (SELECT * FROM e{} QUALIFY row_number() OVER (PARTITION BY _row_idx, coder, cat_id ORDER BY seq DESC) = 1),
 t AS (SELECT * FROM s WHERE action = 'tag' QUALIFY row_number() OVER (PARTITION BY _row_idx, coder, coalesce('g:' || grp, 'c:' || cat_id) ORDER BY seq DESC) = 1)
SELECT _row_idx, cat_id, coder, seq FROM t"""


@query(f"WITH {_EVENTS}, " + _STAND.format(""))
def tag_state_stream(spark, d):
    return _tags(_timed(spark, d))


@query(f"WITH {_EVENTS}, " + _STAND.format(" WHERE NOT (batch % 7 = 0 AND batch % 14 <> 0)"))
def tag_undo_stream(spark, d):
    """Every seventh batch is undone, and every fourteenth done again."""
    log = _timed(spark, d)
    undo = log.where("batch % 7 = 0").withColumns({"action": F.lit("undo"), "seq": F.col("seq") + 10**9})
    redo = log.where("batch % 14 = 0").withColumns({"action": F.lit("redo"), "seq": F.col("seq") + 2 * 10**9})
    return _tags(log.unionByName(undo).unionByName(redo))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, event_type AS platform, count(*) AS n FROM events GROUP BY ALL")
def bucket_counts_stream(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("platform"))
    out = fed(rows, "created_at", live.bucket_counts, "update")
    return out.groupBy("bucket", "platform").agg(F.max_by("n", "_batch").alias("n")).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "platform", "n")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS post_id FROM events")
def first_seen_stream(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").cast("string").alias("post_id"))
    return fed(rows, "created_at", lambda s: live.first_seen(s, late="20000 days")).select("post_id")
