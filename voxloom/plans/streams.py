"""Streams run to their end, compared with what a batch gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import index as store
from ..sources.fixtures import Corpus
from ..sources.shared import shared_dir
from ..streaming import jobs
from .records import versions
from .registry import query


def _folder(c: Corpus, name: str) -> str:
    return shared_dir(c.spark, name)


def _arrive(c: Corpus, frame: DataFrame, order: str, job: Callable[[DataFrame], None]) -> None:
    """Runs a job over a table that arrives in three parts, in order: after each the stream goes on from its checkpoint."""
    path, place = _folder(c, "stream"), F.col(order).cast("double")
    low, high = frame.select(place.alias("x")).approxQuantile("x", [1 / 3, 2 / 3], 0.01)
    for kept in (place <= low, (place > low) & (place <= high), place > high):
        frame.where(kept).write.mode("append").parquet(path)
        job(jobs.source(c.spark, path))


@query("st01_ingest", """with f as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bkayak form\\b', 'KYC form', 'gi'), '\\bpan\\b', 'PAN', 'gi'), '\\botp\\b', 'OTP', 'gi'), '\\bemi\\b', 'EMI', 'gi'), '\\blac\\b', 'lakh', 'gi') as fixed from segments)
    select call_id, segment_id, fixed as text, fixed <> text as corrected from f""", "segments")
def st01(c: Corpus) -> DataFrame:
    """Segments ingested as they arrive."""
    out, state = _folder(c, "ingested"), _folder(c, "checkpoint")
    _arrive(c, c.segments(), "call_id", lambda rows: jobs.ingest(rows, out, state))
    return c.spark.read.parquet(out).select("call_id", "segment_id", "text", "corrected")


@query("st02_upsert", "with i as (select o_orderkey as call_id, 1 as version, o_orderstatus as status from orders where o_orderkey % 3 > 0 and o_orderkey % 2 > 0 union all select o_orderkey, case when o_orderkey % 5 = 0 then 1 else 2 end, 'changed' from orders where o_orderkey % 2 = 0) select * from i")
def st02(c: Corpus) -> DataFrame:
    """Changes merged into the index as they arrive."""
    first, second = versions(c)
    changes = first.where("call_id % 2 > 0").unionByName(second).withColumn("part", F.pmod(F.hash("call_id"), F.lit(3)))
    index, state = _folder(c, "index"), _folder(c, "checkpoint")
    _arrive(c, changes, "part", lambda rows: jobs.upsert_index(rows.drop("part"), index, state, 2, 8))
    return store.read(c.spark, index)


@query("st03_once_per_call", "select distinct user_id as call_id from events")
def st03(c: Corpus) -> DataFrame:
    """One event of each call."""
    out, state = _folder(c, "once"), _folder(c, "checkpoint")
    events = c.table("events").select(F.col("user_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"))
    _arrive(c, events, "ts", lambda rows: jobs.once_per_call(rows, out, state, "1000 days"))
    return c.spark.read.parquet(out).select("call_id")


@query("st04_progress", """with e as (select user_id as call_id, epoch_us(ts) as moment, case event_type when 'purchase' then 'complete' when 'error' then 'error' else 'running' end as status from events),
    l as (select *, row_number() over (partition by call_id order by moment desc, status desc) as k from e)
    select call_id, case when status = 'running' and moment // 1000 + 3600000 < (select max(moment) // 1000 from e) then 'error' else status end as status from l where k = 1""")
def st04(c: Corpus) -> DataFrame:
    """States of calls as events arrive, orphans as errors."""
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("running")
    events = c.table("events").select(F.col("user_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    out, state = _folder(c, "progress"), _folder(c, "checkpoint")
    _arrive(c, events, "ts", lambda rows: jobs.progress(rows, out, state, delay="0 seconds"))
    return c.spark.read.parquet(out).groupBy("call_id").agg(F.max(F.struct("at", "status")).alias("x")).select("call_id", "x.status")


@query("st05_running_stats", "with h as (select date_trunc('hour', ts) as begun, event_type, count(*) as n, round(sum(value), 6) as total from events group by all), m as (select max(ts) as latest from events) select strftime(begun, '%Y-%m-%d %H:%M') as start, event_type, n, total from h, m where begun + interval 1 hour <= latest - interval 10 minute")
def st05(c: Corpus) -> DataFrame:
    """Hourly counts as events arrive; an hour is told when the watermark has passed it."""
    out, state = _folder(c, "stats"), _folder(c, "checkpoint")
    events = c.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    _arrive(c, events, "ts", lambda rows: jobs.running_stats(rows, out, state))
    return c.spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
