"""Queries over time series; events stand in for audio frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as a
from ..sources.fixtures import Corpus
from .registry import query

ACTIVE = "lim as (select series_id, median(energy) * 1.5 as lim from frames group by series_id), act as (select f.*, energy > lim as active from frames f join lim using (series_id))"
SPANS = f"""{ACTIVE}, ai as (select *, frame_idx - row_number() over (partition by series_id order by frame_idx) as g from act where active),
    spans as (select series_id, round(min(t), 3) as start, round(max(t) + 0.01, 3) as stop, count(*) as n from ai group by series_id, g)"""
DURATIONS = "durations as (select series_id, max(t) + 0.01 as duration from frames group by series_id)"
MERGED = """mo as (select series_id, start, stop, case when start - max(stop) over (partition by series_id order by start, stop rows between unbounded preceding and 1 preceding) < 0.03 then 0 else 1 end as new from spans),
    mi as (select *, sum(new) over (partition by series_id order by start, stop) as g from mo), merged as (select series_id, min(start) as start, max(stop) as stop from mi group by series_id, g)"""
GAPS = """gap as (select series_id, start, stop from (select series_id, lag(stop, 1, 0) over (partition by series_id order by start) as start, start as stop from merged
    union all select d.series_id, coalesce(m.start, 0), duration from durations d left join (select series_id, max(stop) as start from merged group by series_id) m using (series_id)) where round(stop - start, 6) >= 0.05)"""
WIDE = "wide as (select *, 1500 + (frame_idx * 37) % 1000 as centroid, ((frame_idx * 7) % 10) / 100.0 as zcr, 0.05 + ((frame_idx * 3) % 10) / 100.0 as rms, 100 as n, case when energy > 60 then 1 else 0 end as n_clipped, case when frame_idx % 97 = 5 then energy * 40 else energy end as flux from frames)"


def wide(c: Corpus) -> DataFrame:
    """Frames with made-up further features."""
    k = F.col("frame_idx")
    return c.frames().select("*", (1500 + (k * 37) % 1000).alias("centroid"), (((k * 7) % 10) / 100.0).alias("zcr"), (0.05 + ((k * 3) % 10) / 100.0).alias("rms"), F.lit(100).alias("n"), F.when(F.col("energy") > 60, 1).otherwise(0).alias("n_clipped"), F.when(k % 97 == 5, F.col("energy") * 40).otherwise(F.col("energy")).alias("flux"))


def durations(c: Corpus) -> DataFrame:
    """Length of each series."""
    return c.frames().groupBy("series_id").agg((F.max("t") + 0.01).alias("duration"))


def merged(c: Corpus) -> DataFrame:
    """Active spans, near ones merged."""
    return a.merge_spans(a.active_spans(c.frames()), 0.03)


@query("au01_active_spans", f"with {SPANS} select * from spans", "frames")
def au01(c: Corpus) -> DataFrame:
    """Active spans."""
    return a.active_spans(c.frames())


@query("au02_signal_to_noise", f"with {ACTIVE}, m as (select series_id, avg(energy) filter (active) as a, avg(energy) filter (not active) as b from act group by series_id), v as (select series_id, greatest(least(10 * log10(coalesce(a, 1e-10) / greatest(coalesce(b, 1e-10), 1e-10)), 40), 0) as v from m) select series_id, round(v, 6) as snr, round(least(v * 5, 100), 6) as score from v", "frames")
def au02(c: Corpus) -> DataFrame:
    """Signal to noise."""
    return a.signal_to_noise(c.frames())


@query("au03_clipping", f"with {WIDE}, p as (select series_id, round(100 * sum(n_clipped) / sum(n), 6) as percent from wide group by series_id) select series_id, percent, case when percent < 0.1 then 100 when percent < 0.5 then 80 when percent < 2 then 50 else 20 end as score from p", "frames")
def au03(c: Corpus) -> DataFrame:
    """Clipping."""
    return a.clipping(wide(c))


@query("au04_speech_ratio", f"with {SPANS}, {DURATIONS}, p as (select d.series_id, round(100 * coalesce(s, 0) / duration, 4) as percent from durations d left join (select series_id, sum(stop - start) as s from spans group by series_id) using (series_id)) select series_id, percent, case when percent >= 50 then 100 when percent >= 30 then 60 when percent >= 15 then 30 else 10 end as score from p", "frames")
def au04(c: Corpus) -> DataFrame:
    """Share of speech."""
    return a.speech_ratio(a.active_spans(c.frames()), durations(c))


@query("au05_harmonicity", "select user_id as series_id, case when avg(value) >= 15 then 100 when avg(value) >= 8 then 80 when avg(value) >= 3 then 60 when avg(value) >= 0 then 40 else 20 end as score from events group by user_id")
def au05(c: Corpus) -> DataFrame:
    """Score of harmonicity."""
    return a.harmonicity_score(c.frames().groupBy("series_id").agg(F.avg("energy").alias("hnr")))


@query("au06_quality", "with s as (select series_id, series_id % 101 as a, (series_id * 7) % 101 as b, (series_id * 11) % 101 as c, (series_id * 13) % 101 as d from (select distinct user_id as series_id from events)), q as (select series_id, floor(0.4 * a + 0.2 * b + 0.2 * c + 0.2 * d + 1e-9) as quality from s) select *, case when quality >= 70 then 'TRUSTWORTHY' when quality >= 40 then 'DEGRADED' else 'UNRELIABLE' end as flag from q")
def au06(c: Corpus) -> DataFrame:
    """Weighted quality."""
    s = F.col("series_id")
    return a.quality(c.frames().select("series_id").distinct().select("series_id", (s % 101).alias("snr_score"), (s * 7 % 101).alias("clip_score"), (s * 11 % 101).alias("ratio_score"), (s * 13 % 101).alias("hnr_score")))


@query("au07_merge_spans", f"with {SPANS}, {MERGED} select * from merged", "frames")
def au07(c: Corpus) -> DataFrame:
    """Near spans merged."""
    return merged(c)


@query("au08_gaps", f"with {SPANS}, {DURATIONS}, {MERGED}, {GAPS} select * from gap", "frames")
def au08(c: Corpus) -> DataFrame:
    """Gaps between spans."""
    return a.gaps(merged(c), durations(c), 0.05)


@query("au09_hold_music", f"""with {SPANS}, {DURATIONS}, {MERGED}, {GAPS}, {WIDE}, s as (select g.series_id, g.start, g.stop, avg(centroid) as c, var_pop(zcr) as z, avg(rms) as m, stddev_pop(rms) as sd from gap g join wide w on w.series_id = g.series_id and w.t >= g.start and w.t < g.stop group by all),
    v as (select series_id, start, stop, (c > 2000)::int + (z < 0.005)::int + (m > 0.01 and sd / nullif(m, 0) < 0.5)::int as votes from s) select *, votes >= 2 as music from v""", "frames")
def au09(c: Corpus) -> DataFrame:
    """Gaps that sound like music."""
    return a.hold_music(a.gaps(merged(c), durations(c), 0.05), wide(c))


HOLES = "holes as (select series_id, start + 0.01 as start, start + 0.02 as stop from merged where round(stop - start, 6) > 0.02)"
CUT = """pieces as (select m.series_id, m.start, coalesce(h.start, m.stop) as stop from merged m left join holes h on h.series_id = m.series_id and h.start < m.stop and h.stop > m.start
    union all select m.series_id, h.stop, m.stop from merged m join holes h on h.series_id = m.series_id and h.start < m.stop and h.stop > m.start),
    cut as (select * from pieces where round(stop - start, 6) > 0.015)"""


def cut(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Merged spans before and after taking out holes."""
    m = merged(c)
    holes = m.where("round(stop - start, 6) > 0.02").select("series_id", (F.col("start") + 0.01).alias("start"), (F.col("start") + 0.02).alias("stop"))
    return m, a.subtract(m, holes, 0.015)


@query("au10_subtract", f"with {SPANS}, {MERGED}, {HOLES}, {CUT} select series_id, round(start, 6) as start, round(stop, 6) as stop from cut", "frames")
def au10(c: Corpus) -> DataFrame:
    """Spans without holes."""
    return cut(c)[1].select("series_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query("au11_cleanup_summary", f"""with {SPANS}, {MERGED}, {HOLES}, {CUT}, b as (select series_id, round(sum(stop - start), 6) as before_s from merged group by series_id), a as (select series_id, round(sum(stop - start), 6) as after_s, count(*) as n from cut group by series_id),
    j as (select series_id, before_s, coalesce(after_s, 0) as after_s, coalesce(n, 0) as n from b left join a using (series_id)) select *, round(before_s - after_s, 6) as removed_s, round(before_s - after_s, 6) >= 1 as applied, round(after_s + 0.2 * greatest(n - 1, 0), 6) as stitched_s from j""", "frames")
def au11(c: Corpus) -> DataFrame:
    """What clean-up removed."""
    return a.cleanup_summary(*cut(c))


@query("au12_splices", f"""with {WIDE}, st as (select series_id, median(flux) as m, stddev_pop(flux) as sd, max(t) as last from wide group by series_id),
    h as (select * from wide join st using (series_id) where flux > m + 5 * sd and t >= 0.05 and t <= last - 0.05),
    g as (select *, case when t - lag(t) over (partition by series_id order by frame_idx) > 0.5 then 1 else 0 end as new from h), i as (select *, sum(new) over (partition by series_id order by frame_idx) as g from g),
    c as (select series_id, list(t order by t) as ts, (max(flux) - max(m)) / greatest(max(sd), 0.1 * max(m)) as d from i group by series_id, g)
    select series_id, round(ts[len(ts) // 2 + 1], 3) as t, round(d, 6) as deviation, case when d > 10 then 'high' else 'medium' end as severity, round(case when d > 10 then least(0.9, d / 15) else least(0.7, d / 15) end, 6) as confidence from c where d > 7""", "frames")
def au12(c: Corpus) -> DataFrame:
    """Splice points."""
    return a.splices(wide(c), edge=0.05)


@query("au13_silence", """with q as (select * from frames where energy <= 5), r as (select *, frame_idx - row_number() over (partition by series_id order by frame_idx) as g from q),
    u as (select series_id, min(t) as t, count(*) * 0.01 as length from r group by series_id, g), v as (select series_id, count(*) as n, stddev_pop(length) / avg(length) as cv from u group by series_id)
    select series_id, 'digital_zero' as kind, round(t, 3) as t, round(length, 3) as value from u where round(length, 6) > 0.02 union all select series_id, 'irregular', null, round(cv, 3) from v where n >= 3 and cv > 0.4""", "frames")
def au13(c: Corpus) -> DataFrame:
    """Silences that stand out."""
    return a.silence_anomalies(c.frames(), 5.0, 0.02, 0.4)


@query("au14_noise_floor", """with w as (select series_id, t, energy, unnest(range(greatest(ceil((t - 0.5) / 0.2 + 1e-9), 0)::bigint, floor(t / 0.2 + 1e-9)::bigint + 1)) as w from frames),
    f as (select series_id, w, quantile_cont(energy, 0.05) as floor from w group by series_id, w), s as (select series_id, median(floor) as m, stddev_pop(floor) as sd from f group by series_id),
    d as (select f.series_id, w, floor, abs(floor - m) / greatest(sd, 0.1 * m) as d from f join s using (series_id) where greatest(sd, 0.1 * m) > 0)
    select series_id, w, round(floor, 6) as floor, round(d, 6) as deviation from d where round(d, 6) > 1""", "frames")
def au14(c: Corpus) -> DataFrame:
    """Drift of the noise floor."""
    return a.noise_floor_drift(c.frames(), sigmas=1.0)


TAMPER = "tam as (select user_id as series_id, event_type as kind, case when value > 30 then 'high' else 'medium' end as severity from events where value > 10 and user_id % 3 > 0 union all select user_id, 'one', 'high' from events where user_id % 3 = 0)"


def tamper(c: Corpus) -> DataFrame:
    """Made-up signals of tampering."""
    e = c.table("events")
    s = F.col("user_id").alias("series_id")
    return e.where("value > 10 and user_id % 3 > 0").select(s, F.col("event_type").alias("kind"), F.when(F.col("value") > 30, "high").otherwise("medium").alias("severity")).unionByName(e.where("user_id % 3 = 0").select(s, F.lit("one").alias("kind"), F.lit("high").alias("severity")))


@query("au15_cap_lone_kind", f"with {TAMPER}, k as (select series_id, count(distinct kind) as k from tam group by series_id) select series_id, kind, case when k = 1 and severity = 'high' then 'medium' else severity end as severity from tam join k using (series_id)")
def au15(c: Corpus) -> DataFrame:
    """Severity of lone kinds capped."""
    return a.cap_lone_kind(tamper(c))


@query("au16_tamper_risk", f"with {TAMPER}, s as (select series_id, count(distinct kind) as k, count(*) filter (severity = 'high') as h, count(*) as n from tam group by series_id) select series_id, case when k >= 3 and h >= 2 then 'high' when k >= 2 and (h >= 1 or n >= 4) then 'medium' else 'low' end as risk from s")
def au16(c: Corpus) -> DataFrame:
    """Risk of tampering."""
    return a.tamper_risk(tamper(c))
