"""Streaming queries: run to the end of the input, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.plans import fixtures as X
from crossgrid.plans.registry import query, r
from crossgrid.session import Tables, attach_params, rounded, scratch_path
from crossgrid.streaming import event_time, jobs

#: Partitions of the state of these small streams.
STATE = 8


class _StreamTables(Tables):
    """The same tables as unbounded inputs."""

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return jobs.read_stream(self.spark, f"{self.sf_dir}/{name}.parquet*")


def _stream(t):
    return _StreamTables(t.spark, t.sf_dir)


@query("stream_accuracy", f"""
    SELECT state, year, quarter, count(*) AS n, {r("1 - avg((label - pred) * (label - pred)) / var_pop(label)")} AS r2,
           {r("covar_pop(label, pred) / sqrt(var_pop(label) * var_pop(pred))")} AS pearson_r, {r("avg(pred - label)", 2)} AS bias,
           {r("avg(abs(label - pred))", 2)} AS mae
    FROM ({X.PRED_SQL}) GROUP BY ALL""")
def stream_accuracy(t):
    """Accuracy over arriving prediction files equals the batch result."""
    out = jobs.stream_accuracy(X.predictions(_stream(t)), ["state", "year", "quarter"], "label", "pred", scratch_path(t.spark, "stream"))
    return out.select("state", "year", "quarter", "n", rounded("r2").alias("r2"), rounded("pearson_r").alias("pearson_r"),
                      rounded("bias", 2).alias("bias"), rounded("mae", 2).alias("mae"))


@query("stream_windows", f"""
    SELECT 'day' AS kind, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, {r("sum(value)", 4)} AS total FROM events GROUP BY ALL
    UNION ALL
    SELECT 'week', strftime(time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k, '%Y-%m-%d'), event_type, count(*), {r("sum(value)", 4)}
    FROM events, range(0, 7) t(k) GROUP BY ALL""")
def stream_windows(t):
    """Tumbling days and sliding weeks over the event stream."""
    def run(kind, width, slide=None):
        out = event_time.windows(_stream(t).events, "ts", ["event_type"], "value", scratch_path(t.spark, "stream"), width, slide, partitions=STATE)
        return out.rows.select(F.lit(kind).alias("kind"), F.date_format("window_start", "yyyy-MM-dd").alias("window_start"),
                          "event_type", "n", rounded("total", 4).alias("total"))

    return run("day", "1 day").unionByName(run("week", "7 days", "1 day"))


@query("stream_sessions", f"""
    WITH e AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, TRUE)::INTEGER AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k)
    SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end, n, {r("total", 4)} AS total,
           session_end > (SELECT max(ts) FROM events) AS is_open FROM g""")
def stream_sessions(t):
    """Sessions per user with a 30 minute gap, open ones too."""
    out = event_time.sessions(_stream(t).events, "ts", "user_id", "value", "30 minutes", scratch_path(t.spark, "stream"), partitions=STATE).rows
    return out.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")], "n", rounded("total", 4).alias("total"), "is_open")


# Events in three deliveries by thirds of their time; one in ten comes a delivery late, one in fifty two.
_ARRIVED = """
    b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
    a AS (SELECT events.*, least(3, 1 + least(2, 3 * (epoch_us(ts) - lo) // (hi - lo + 1)) + CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS part FROM events, b),
    w AS (SELECT p AS part, (SELECT max(ts) FROM a WHERE a.part < p) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT part AS p FROM a)),
    d AS (SELECT a.*, mark FROM a JOIN w USING (part))"""


def _deliveries(t):
    """The events as (delivery, rows), in the order of delivery."""
    span = t.events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_hi"))
    at = F.expr("3 * (unix_micros(cast(ts AS timestamp)) - _lo) div (_hi - _lo + 1)")
    behind = F.when(F.col("event_id") % 50 == 0, 2).when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    placed = attach_params(t.events, span).withColumn("part", F.least(F.lit(3), 1 + F.least(F.lit(2), at) + behind)).drop("_lo", "_hi")
    return [(k, placed.filter(F.col("part") == k).drop("part")) for k in (1, 2, 3)]


def _delivered(t, job):
    """Run ``job(stream)`` after each delivery, each time from where it stopped; the last result."""
    folder, out = scratch_path(t.spark, "deliveries"), None
    for k, rows in _deliveries(t):
        rows.write.parquet(f"{folder}/delivery{k}.parquet")
        out = job(jobs.read_stream(t.spark, f"{folder}/delivery*.parquet"))
    return out


@query("stream_windows_late", f"""
    WITH {_ARRIVED},
    x AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, event_type, value, coalesce(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark, FALSE) AS late FROM d)
    SELECT strftime(s, '%Y-%m-%d') AS window_start, event_type, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS n_late,
           {r("coalesce(sum(value) FILTER (WHERE NOT late), 0)", 4)} AS total, {r("coalesce(sum(value) FILTER (WHERE late), 0)", 4)} AS late_total FROM x GROUP BY 1, 2""")
def stream_windows_late(t):
    """Days over three deliveries out of order, with a delay of two days: in-time rows are summed, late ones counted apart."""
    work = scratch_path(t.spark, "stream")
    out = _delivered(t, lambda s: event_time.windows(s, "ts", ["event_type"], "value", work, "1 day", delay="2 days", partitions=STATE))
    late = out.late.groupBy("window_start", "event_type").agg(F.count(F.lit(1)).alias("n_late"), F.sum("value").alias("late_total"))
    both = out.rows.drop("window_end").join(late, ["window_start", "event_type"], "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_late", "total", "late_total")}
    return both.withColumns(zero).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", "n_late",
                                         rounded("total", 4).alias("total"), rounded("late_total", 4).alias("late_total"))


@query("stream_sessions_late", f"""
    WITH {_ARRIVED},
    i AS (SELECT * FROM d WHERE mark IS NULL OR ts >= mark),
    e AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR, TRUE)::INTEGER AS fresh FROM i),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    g AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, count(*) FILTER (WHERE n > 0) AS n_sessions, sum(n)::BIGINT AS n, max(n) AS longest, sum(late)::BIGINT AS n_late
    FROM (SELECT user_id, n, 0 AS late FROM g UNION ALL SELECT user_id, 0, count(*) FROM d WHERE ts < mark GROUP BY user_id) GROUP BY user_id""")
def stream_sessions_late(t):
    """Sessions over the same deliveries: closed ones leave the state, late rows are counted."""
    work = scratch_path(t.spark, "stream")
    out = _delivered(t, lambda s: event_time.sessions(s, "ts", "user_id", "value", "12 hours", work, delay="2 days", partitions=STATE))
    late = out.late.groupBy("user_id").agg(F.count(F.lit(1)).alias("late"))
    both = out.rows.select("user_id", "n", F.lit(0).cast("long").alias("late")).union(late.select("user_id", F.lit(0).cast("long"), "late"))
    return both.groupBy("user_id").agg(F.count_if(F.col("n") > 0).alias("n_sessions"), F.sum("n").alias("n"), F.max("n").alias("longest"), F.sum("late").alias("n_late"))


@query("stream_dedup", """SELECT event_id, user_id, event_type, value FROM events""")
def stream_dedup(t):
    """The same files delivered twice leave every event once in the sink."""
    table = scratch_path(t.spark, "sink")
    events = _stream(t).events.select("event_id", "user_id", "event_type", "value", "ts")
    out = None
    for _ in range(2):  # the second run starts without progress, like a lost checkpoint
        out = jobs.stream_append_once(events, ["event_id"], scratch_path(t.spark, "stream"), table)
    return out.select("event_id", "user_id", "event_type", "value")
