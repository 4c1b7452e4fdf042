"""Queries over events and orders: telemetry operators with their SQL. A user is a worker, an event's value its measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import telemetry as T
from corpusloom.plans.catalogue import register
from corpusloom.streaming import leases


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


@register("ewma_by_user", """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * pow(0.8, k) * CASE WHEN k = n - 1 THEN 1.0 ELSE 0.2 END), 6) AS ewma FROM o GROUP BY user_id""")
def ewma_by_user(spark, sf):
    return T.ewma(events(spark, sf), "user_id", ["ts", "event_id"], "value", 0.2).select("user_id", F.round("ewma", 6).alias("ewma"))


@register("trailing_stats", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(var_pop(value) OVER w, 6) AS variance, count(value) OVER w AS samples FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def trailing_stats(spark, sf):
    return T.trailing(events(spark, sf), "user_id", ["ts", "event_id"], "value", 5).select("event_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "samples")


RATES = "r AS (SELECT event_type, sum(value) AS rate FROM events GROUP BY event_type)"


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("event_type").agg(F.sum("value").alias("rate"))


@register("throughput_weights", f"WITH {RATES} SELECT event_type, round(rate / sum(rate) OVER (), 9) AS weight FROM r")
def throughput_weights(spark, sf):
    return T.weights(by_type(spark, sf), "event_type", "rate").select("event_type", F.round("weight", 9).alias("weight"))


@register("weight_blend", f"""WITH {RATES}, c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), w AS (SELECT event_type, rate / sum(rate) OVER () AS a FROM r), v AS (SELECT event_type, n / sum(n) OVER () AS b FROM c)
SELECT event_type, round((a * 0.5 + b * 0.5) / sum(a * 0.5 + b * 0.5) OVER (), 9) AS weight FROM w JOIN v USING (event_type)""")
def weight_blend(spark, sf):
    e = events(spark, sf)
    old = T.weights(by_type(spark, sf), "event_type", "rate")
    new = T.weights(e.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n")), "event_type", "n")
    return T.blend(old, new, "event_type").select("event_type", F.round("weight", 9).alias("weight"))


MEASURES = "m AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS u, (event_id % 16 + 1)::INTEGER AS d FROM events)"


def measures(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select("event_id", (F.pmod("event_id", F.lit(101)) / F.lit(100.0)).alias("u"), (F.pmod("event_id", F.lit(16)) + 1).cast("int").alias("d"))


@register("backpressure_depth", f"""WITH {MEASURES}, x AS (SELECT event_id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE u END AS u FROM m)
SELECT event_id, CASE WHEN u IS NULL THEN 8 WHEN u >= 0.8 THEN 1 ELSE 1 + round_even((0.8::DOUBLE - u) / 0.8::DOUBLE * 7, 0)::INTEGER END AS depth FROM x""")
def backpressure_depth(spark, sf):
    known = F.when(F.col("event_id") % 37 != 0, F.col("u"))
    return measures(spark, sf).select("event_id", T.backpressure_depth(known).alias("depth"))


@register("prefetch_policy", f"""WITH {MEASURES} SELECT event_id, CASE
 WHEN event_id % 4 = 0 THEN greatest(1, d // 2)
 WHEN event_id % 4 = 1 THEN greatest(1, round_even(d * CASE WHEN u - 0.7::DOUBLE > 0.12::DOUBLE THEN 0.5 WHEN u - 0.7::DOUBLE > 0.05::DOUBLE THEN 0.65 ELSE 0.75 END::DOUBLE, 0))
 WHEN event_id % 4 = 2 AND d < 14 THEN d + 1 ELSE least(d, CASE WHEN event_id % 4 = 1 THEN 14 ELSE 16 END) END::INTEGER AS depth FROM m""")
def prefetch_policy(spark, sf):
    event = F.element_at(F.array(*[F.lit(x) for x in ("oom", "high_utilization", "low_utilization", "feedback")]), (F.col("event_id") % 4 + 1).cast("int"))
    return measures(spark, sf).select("event_id", T.prefetch(event, F.col("d"), F.col("u"), F.lit(0.7), 1, 14).alias("depth"))


@register("cadence", f"WITH {MEASURES} SELECT event_id, least(greatest(d + CASE WHEN u > 0.15 THEN 1 WHEN u < 0.08 THEN -1 ELSE 0 END, 1), 16)::INTEGER AS interval_steps FROM m")
def cadence(spark, sf):
    return measures(spark, sf).select("event_id", T.cadence(F.col("d"), F.col("u")).alias("interval_steps"))


@register("chunk_plan", f"WITH {MEASURES} SELECT event_id, greatest(round_even(u * 1000 * 250 / 1000, 0), 1)::BIGINT AS tokens FROM m")
def chunk_plan(spark, sf):
    return measures(spark, sf).select("event_id", T.chunk_tokens(F.col("u") * 1000, 250.0).alias("tokens"))


@register("lease_scale", f"""WITH {MEASURES}, s AS (SELECT event_id, u, CASE WHEN event_id % 5 = 0 THEN NULL ELSE d / 8.0::DOUBLE END AS s, d FROM m),
w AS (SELECT *, least(greatest(CASE WHEN u > 0 THEN u / 0.5::DOUBLE ELSE coalesce(s, 1.0) END, 0.25), 4.0) AS w FROM s),
n AS (SELECT event_id, d, CASE WHEN s IS NULL THEN w ELSE greatest(greatest(s * 0.5, 0.25), least(w, least(s * 1.5, 4.0))) END AS scale FROM w),
t AS (SELECT *, least(greatest(round_even(scale * 16, 0), 1), 16)::INTEGER AS t FROM n)
SELECT event_id, round(scale, 9)::DOUBLE AS scale, CASE WHEN event_id % 7 = 0 THEN t WHEN t > d THEN least(d + 1, 16) WHEN t < d THEN greatest(d - 1, 1) ELSE d END::INTEGER AS most_active FROM t""")
def lease_scale(spark, sf):
    m = measures(spark, sf).withColumn("s", F.when(F.col("event_id") % 5 != 0, F.col("d") / 8.0))
    m = m.withColumn("scale", T.lease_scale(F.col("s"), F.col("u"), F.lit(0.5)))
    limit = F.when(F.col("event_id") % 7 != 0, F.col("d"))
    return m.select("event_id", F.round("scale", 9).alias("scale"), T.lease_limit(limit, F.col("scale"), 16).alias("most_active"))


@register("per_rank_metrics", "SELECT user_id AS rank, arg_max(value, (ts, event_id)) AS last_tokens, round(sum(value), 6) AS total_tokens, count(*) AS steps FROM events GROUP BY user_id")
def per_rank_metrics(spark, sf):
    m = events(spark, sf).select(F.col("user_id").alias("rank"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("tokens"), F.lit(1.0).alias("seconds"))
    return T.per_rank(m).select("rank", "last_tokens", F.round("total_tokens", 6).alias("total_tokens"), "steps")


@register("scaling_efficiency", """WITH r AS (SELECT o_orderpriority AS name, round(sum(o_totalprice), 2) AS throughput FROM orders GROUP BY o_orderpriority), b AS (SELECT throughput AS base FROM r WHERE name = '1-URGENT')
SELECT name, round(base * 2, 4) AS expected, round(throughput / (base * 2), 9) AS efficiency FROM r, b""")
def scaling_efficiency(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    runs = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("throughput")).withColumn("reference", F.lit("1-URGENT")).withColumn("weight", F.lit(2.0))
    return T.scaling(runs).select("name", F.round("expected", 4).alias("expected"), F.round("efficiency", 9).alias("efficiency"))


@register("trend_latest_vs_baseline", """WITH d AS (SELECT date_trunc('day', ts) AS day, round(sum(value), 6) AS v FROM events GROUP BY 1) SELECT arg_max(v, day) AS latest, arg_min(v, day) AS baseline, round(arg_max(v, day) / arg_min(v, day), 9) AS ratio FROM d""")
def trend_latest(spark, sf):
    days = events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    return T.trend(days, "day", "v").select("latest", "baseline", F.round("ratio", 9).alias("ratio"))


@register("classification_metrics", """WITH s AS (SELECT toxic AS y, (n_chars % 97) / 97.0::DOUBLE AS a, (n_chars % 89) / 89.0::DOUBLE AS b FROM labels JOIN documents USING (doc_id)),
p AS (SELECT y, a, b, greatest(a, b) AS m FROM s)
SELECT count(*) AS samples, round(avg(CASE WHEN (CASE WHEN a >= b THEN 0 ELSE 1 END) = y THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(-ln(greatest(exp(CASE WHEN y = 0 THEN a ELSE b END - m) / (exp(a - m) + exp(b - m)), 1e-12))), 6) AS loss FROM p""")
def classification_metrics(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    x = spark.read.parquet(f"{sf}/labels.parquet").join(d, "doc_id")
    scored = x.select(F.array(F.col("n_chars") % 97 / F.lit(97.0), F.col("n_chars") % 89 / F.lit(89.0)).alias("logits"), F.col("toxic").alias("label"))
    return T.classification(scored, "logits", "label").select("samples", F.round("accuracy", 9).alias("accuracy"), F.round("loss", 6).alias("loss"))


@register("autoscale_step", """WITH w AS (SELECT user_id, count(*)::INTEGER AS n, avg((event_id % 101) / 100.0::DOUBLE) AS v, var_pop((event_id % 101) / 100.0::DOUBLE) AS x, (user_id % 10) / 20.0::DOUBLE AS f, user_id % 11 = 0 AS oom, (64 + user_id % 64)::INTEGER AS b, (4 + user_id % 8)::INTEGER AS k, 1024 AS h FROM events GROUP BY user_id),
y AS (SELECT *, CASE WHEN x > 0.01 THEN 0.3 WHEN x > 0.005 THEN 0.5 ELSE 1.0 END::DOUBLE AS damp FROM w),
z AS (SELECT *, CASE WHEN v < 0.75::DOUBLE THEN least(greatest((0.75::DOUBLE - v) * 0.6::DOUBLE, 0.05), 0.25) * damp WHEN v > 0.85::DOUBLE THEN -least(greatest((v - 0.85::DOUBLE) * 0.6::DOUBLE, 0.05), 0.25) * damp ELSE 0 END::DOUBLE AS g FROM y),
s AS (SELECT *, greatest(1, floor(b * (1 + g)))::INTEGER AS nb, CASE WHEN g > 0 THEN round_even(k * (1 + g * 0.5), 0) WHEN g < 0 THEN floor(k * (1 + g * 0.5)) ELSE k END::INTEGER AS nk, CASE WHEN g = 0 THEN h ELSE greatest(256, floor(h * (1 + sign(g) * greatest(abs(g) * 0.5::DOUBLE, 0.02::DOUBLE)))) END::INTEGER AS nh FROM z)
SELECT user_id, CASE WHEN oom THEN greatest(1, b // 2) WHEN n < 3 THEN b WHEN f > 0.25 THEN greatest(1, floor(nb * 0.9::DOUBLE)) ELSE nb END::INTEGER AS next_batch,
       CASE WHEN oom THEN greatest(1, k - 1) WHEN n < 3 THEN k WHEN f > 0.25 THEN greatest(nk, k + 1) WHEN f < 0.05 THEN greatest(nk, k) ELSE nk END::INTEGER AS next_workers, CASE WHEN oom OR n < 3 THEN h ELSE nh END::INTEGER AS next_transfer FROM s""")
def autoscale_step(spark, sf):
    share = F.pmod("event_id", F.lit(101)) / F.lit(100.0)
    e = events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("samples"), F.avg(share).alias("mean_vram"), F.var_pop(share).alias("var_vram"))
    u = F.col("user_id")
    rows = e.select("*", (u % 10 / F.lit(20.0)).alias("fallback"), (u % 11 == 0).alias("oom"), (64 + u % 64).cast("int").alias("batch"), (4 + u % 8).cast("int").alias("workers"), F.lit(1024).alias("transfer"))
    return T.tuned(rows, 0.75).select("user_id", "next_batch", "next_workers", "next_transfer")


@register("token_rate_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, round(sum(value), 6) AS tokens FROM events GROUP BY 1")
def token_rate_windows(spark, sf):
    e = events(spark, sf).select("ts", F.col("value").alias("tokens"))
    return T.rates(e, 3600).select("start", F.round("tokens", 6).alias("tokens"))


LEASES = """e AS (SELECT user_id AS chunk_id, event_id AS t, event_type AS rank, CASE event_id % 7 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'heartbeat' WHEN 3 THEN 'timeout' ELSE 'grant' END AS event FROM events WHERE user_id % 5 <> 0 OR event_id % 7 <> 0),
d AS (SELECT chunk_id, min(t) FILTER (WHERE event = 'complete') AS done FROM e GROUP BY chunk_id)"""


@register("lease_states", f"""WITH {LEASES} SELECT chunk_id, arg_max(rank, t) AS rank, CASE WHEN any_value(done) IS NOT NULL THEN 'done' WHEN arg_max(event, t) FILTER (WHERE event IN ('grant', 'fail', 'timeout')) = 'grant' THEN 'leased' ELSE 'free' END AS status,
count(*) FILTER (WHERE event = 'grant' AND t < coalesce(done, 9223372036854775807)) AS attempts FROM e JOIN d USING (chunk_id) GROUP BY chunk_id""")
def lease_states(spark, sf):
    """The state of each chunk after a stream of lease events, user by user."""
    e = events(spark, sf)
    names = F.element_at(F.array(*[F.lit(x) for x in ("complete", "fail", "heartbeat", "timeout", "grant", "grant", "grant")]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = e.where("user_id % 5 <> 0 OR event_id % 7 <> 0").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("at"), F.col("event_type").alias("rank"), names.alias("event"))
    return leases.final_states(spark, rows)


@register("chunk_slices", """WITH t AS (SELECT source AS key, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT key, total, unnest(generate_series(0, (total - 1) // 16)) AS chunk_id FROM t)
SELECT key, chunk_id, chunk_id * 16 AS start, least(chunk_id * 16 + 16, total) AS "end" FROM c""")
def chunk_slices(spark, sf):
    """The documents of each source in chunks of 16 places, half open."""
    totals = spark.read.parquet(f"{sf}/documents.parquet").where("source is not null").groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("total"))
    return leases.chunk_rows(totals, 16)
