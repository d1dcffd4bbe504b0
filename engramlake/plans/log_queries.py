"""Queries over revision logs: events by user, in order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.operators import metrics
from engramlake.plans.registry import at, query, table
from engramlake.sources import log

NOW = "2024-01-20"
_TYPES = ("click", "error", "purchase", "refund", "signup", "view")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def log_latest(spark: SparkSession, d: str) -> DataFrame:
    return log.latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS revision FROM events WHERE user_id = 7")
def log_history(spark: SparkSession, d: str) -> DataFrame:
    return log.history(table(spark, d, "events"), "user_id", "event_id", 7).select("event_id", "event_type", "revision")


@query("""SELECT t.event_type, coalesce(e.n, 0) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) t(event_type)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e USING (event_type)""")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    return log.statistics(table(spark, d, "events"), "event_type", _TYPES)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 123")
def log_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_id = 123").select("event_id", "user_id", "event_type", "value")


_EXPIRY = """CASE event_type WHEN 'click' THEN ts + INTERVAL 1 HOUR WHEN 'view' THEN ts + INTERVAL 14 DAY WHEN 'purchase' THEN ts + INTERVAL 90 DAY WHEN 'error' THEN ts + INTERVAL 1 DAY END"""


@query(f"""SELECT event_id, user_id, event_type FROM (SELECT *, {_EXPIRY} AS expires_at FROM events)
WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20') AND event_type <> 'error'""")
def log_visible(spark: SparkSession, d: str) -> DataFrame:
    hours = {"click": 1, "view": 14 * 24, "purchase": 90 * 24, "error": 24}
    after = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv])[F.col("event_type")]
    e = table(spark, d, "events").withColumn("expires_at", F.when(after.isNotNull(), F.col("ts") + F.make_dt_interval(hours=after)))
    e = e.withColumn("memory_status", F.when(F.col("event_type") == "error", "superseded")).withColumn("task_status", F.lit(None).cast("string"))
    return e.filter(log.is_visible(at(NOW))).select("event_id", "user_id", "event_type")


@query("""SELECT l.user_id, l.event_id, len(s.kinds) AS n_kinds FROM
(SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) l
JOIN (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1) s USING (user_id) WHERE l.event_type = 'signup' OR list_contains(s.kinds, 'signup')""")
def log_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = e.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    last = log.latest(e, "user_id", "event_id").join(kinds, "user_id")
    return last.filter(log.in_session("signup", "event_type", "kinds")).select("user_id", "event_id", F.size("kinds").cast("bigint").alias("n_kinds"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def log_dedupe_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return log.without_repeats(table(spark, d, "events"), "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, ts AS known_from, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS known_to FROM events")
def known_interval(spark: SparkSession, d: str) -> DataFrame:
    return log.known_intervals(table(spark, d, "events"), "user_id", "event_id", "ts").select("event_id", "user_id", "known_from", "known_to")


@query("""SELECT user_id, max(episode) AS episodes, count(*) AS revisions FROM (
SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS episode FROM (
SELECT user_id, event_id, CASE WHEN (value > 50) = lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1""")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    found = log.islands(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 50)
    return found.groupBy("user_id").agg(F.max("episode").alias("episodes"), F.count("*").alias("revisions"))


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 25")
def list_newest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("ts").desc(), "event_id").limit(25).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events WHERE user_id <> 7")
def delete_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("string"))
    return log.without_user(e, "7").select("event_id", "event_type")


@query("""SELECT conv_id, turn, role, strftime(TIMESTAMP '2026-01-05 09:00:00' + INTERVAL 4 MINUTE * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1), '%Y-%m-%d %H:%M') AS said_at FROM conversations""")
def session_offsets(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    at = F.lit("2026-01-05 09:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=n * 4)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.date_format(at, "yyyy-MM-dd HH:mm").alias("said_at"))


@query("""SELECT coalesce(role, 'all') AS role, count(*) AS n, count(DISTINCT conv_id) AS n_sessions, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY ROLLUP (role)""")
def rollup_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").rollup("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_sessions"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))
    return c.withColumn("role", F.coalesce("role", F.lit("all")))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT a.event_type, count(*) AS n_a, max(b.n) AS n_b, count(*) - max(b.n) AS delta FROM events a FULL OUTER JOIN (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) b USING (event_type) GROUP BY 1""")
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.groupBy("event_type").agg(F.count("*").alias("n_a"))
    b = e.filter(F.col("ts") < at("2024-01-15")).groupBy("event_type").agg(F.count("*").alias("n_b"))
    return a.join(b, "event_type", "full_outer").select("event_type", "n_a", "n_b", (F.col("n_a") - F.col("n_b")).alias("delta"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT conv_id, count(*) AS turns, sum(CASE WHEN new THEN 1 ELSE 0 END) AS speaker_changes FROM
(SELECT conv_id, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations) GROUP BY 1""")
def speaker_changes(spark: SparkSession, d: str) -> DataFrame:
    found = log.islands(table(spark, d, "conversations"), "conv_id", "turn", F.col("role"))
    return found.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("episode").alias("speaker_changes"))
