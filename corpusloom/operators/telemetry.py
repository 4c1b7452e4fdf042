"""Measures over time: smoothed rates, trailing windows, weights, trends and the control formulas that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ewma(rows: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """(key, ewma): the exponentially weighted mean of a key's values in order; the first one starts it.

    The weights of a key's last values make the sum, so that it is one ordered window and no fold: value k from the end counts
    alpha * (1 - alpha)**k, and the first one (1 - alpha)**k."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    weight = F.pow(F.lit(1 - alpha), F.col("_k")) * F.when(F.col("_k") == F.col("_n") - 1, F.lit(1.0)).otherwise(F.lit(alpha))
    return rows.withColumn("_k", back).withColumn("_n", n).groupBy(key).agg(F.sum(F.col(value) * weight).alias("ewma"))


def trailing(rows: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """With mean, population variance and size of the last width values."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("variance", F.var_pop(value).over(w)).withColumn("samples", F.count(value).over(w))


def weights(rates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, weight): shares of the total; equal ones where it is 0. A row for each worker."""
    total, n = F.sum(value).over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    return rates.select(key, F.when(total > 0, F.col(value) / total).otherwise(1.0 / n).alias("weight"))


def blend(old: DataFrame, new: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """(key, weight) of both, a missing one counting 0, normalised."""
    both = old.select(key, F.col("weight").alias("o")).join(new.select(key, F.col("weight").alias("n")), key, "full")
    mixed = both.select(key, (F.coalesce("o", F.lit(0.0)) * (1 - share) + F.coalesce("n", F.lit(0.0)) * share).alias("mixed"))
    return weights(mixed, key, "mixed")


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(x).cast("int")


def backpressure_depth(utilisation: Column, target: float = 0.8, low: int = 1, high: int = 8) -> Column:
    """How many shards to hold ahead: low from the target utilisation on, below it in proportion to the headroom; high where it is unknown."""
    headroom = F.greatest(F.lit(target) - utilisation, F.lit(0.0)) / target
    depth = F.least(F.greatest(rounded(headroom * (high - low)) + low, F.lit(low)), F.lit(high))
    return F.when(utilisation.isNull(), high).when(utilisation >= target, low).otherwise(depth).cast("int")


def prefetch(event: Column, depth: Column, mean: Column, target: Column, low: int = 1, high: int = 32) -> Column:
    """The next depth after oom, high_utilization or low_utilization; other events leave it.

    Running out of memory halves it; utilisation above the target cuts it by severity; utilisation below adds a tenth of what is allowed."""
    severity = F.greatest(F.coalesce(mean, F.lit(0.0)) - F.coalesce(target, F.lit(0.0)), F.lit(0.0))
    scale = F.when(severity > 0.12, 0.5).when(severity > 0.05, 0.65).otherwise(0.75)
    within = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    more = F.least(depth + max(1, round(max(1, high) * 0.1)), F.lit(high))
    name = F.lower(event)
    out = F.when(name == "oom", F.greatest(F.floor(depth / 2), F.lit(1), F.lit(low))).when(name == "high_utilization", within(rounded(depth * scale)))
    return out.when((name == "low_utilization") & (depth < high), more).otherwise(depth).cast("int")


def cadence(interval: Column, share: Column, low: int = 1, high: int = 16) -> Column:
    """Steps between reductions: one more where they take over 15 % of the time, one less below 8 %."""
    return F.least(F.greatest(interval + F.when(share > 0.15, 1).when(share < 0.08, -1).otherwise(0), F.lit(low)), F.lit(high)).cast("int")


def chunk_tokens(rate: Column, target_ms: float, low: int = 1) -> Column:
    """Tokens that take about so many milliseconds at a rate a second."""
    return F.greatest(F.bround(rate * target_ms / 1000), F.lit(low)).cast("bigint")


def lease_scale(scale: Column, rate: Column, mean: Column) -> Column:
    """A worker's next scale: its rate over the mean, between a quarter and four, and from half to one and a half of its scale, if it has one."""
    usable = F.when((mean > 0) & (rate > 0), rate / mean).otherwise(F.coalesce(scale, F.lit(1.0)))
    wanted = F.least(F.greatest(usable, F.lit(0.25)), F.lit(4.0))
    low, high = F.greatest(scale * 0.5, F.lit(0.25)), F.least(scale * 1.5, F.lit(4.0))
    return F.when(F.coalesce(scale, F.lit(0.0)) > 0, F.greatest(low, F.least(wanted, high))).otherwise(wanted)


def lease_limit(limit: Column, scale: Column, most: int) -> Column:
    """How many leases a worker may hold next: one step towards its scale's share of the most."""
    target = F.least(F.greatest(rounded(scale * most), F.lit(1)), F.lit(most))
    step = F.when(target > limit, F.least(limit + 1, F.lit(most))).when(target < limit, F.greatest(limit - 1, F.lit(1))).otherwise(limit)
    return F.when(F.coalesce(limit, F.lit(0)) > 0, step).otherwise(target).cast("int")


def tuned(rows: DataFrame, target: float = 0.85, batch: tuple[int, int] = (1, 4096), workers: tuple[int, int] = (1, 64), transfer: tuple[int, int] = (256, 8192), least: int = 3) -> DataFrame:
    """The next state of each worker: (…, batch, workers, transfer, mean_vram, var_vram, fallback, oom, samples) with next_batch, next_workers
    and next_transfer, each within its bounds.

    Memory use below or above a band around the target changes the state in proportion to the gap, less where use varies; running out of
    memory halves the batch; much work that falls back to the processor takes a tenth of the batch and adds a worker. Fewer samples than
    least change nothing."""
    low, high = max(0.75, target - 0.05), min(0.95, target + 0.10)
    below, above = F.lit(low) - F.col("mean_vram"), F.col("mean_vram") - high
    damped = F.when(F.col("var_vram") > 0.01, 0.3).when(F.col("var_vram") > 0.005, 0.5).otherwise(1.0)
    size = lambda gap: F.least(F.greatest(gap * 0.6, F.lit(0.05)), F.lit(0.25)) * damped
    by = F.when(below > 0, size(below)).when(above > 0, -size(above)).otherwise(0.0)
    within = lambda x, bounds: F.least(F.greatest(x.cast("long"), F.lit(bounds[0])), F.lit(bounds[1])).cast("int")
    changed = rows.withColumn("_by", by).withColumn("_half", F.signum("_by") * F.greatest(F.abs(F.col("_by")) * 0.5, F.lit(0.02)))
    crew = F.col("workers") * (1 + F.col("_by") * 0.5)
    grown = F.when(F.col("_by") > 0, F.bround(crew)).otherwise(F.floor(crew))  # growth is rounded, the rest cut off
    fresh = {"_batch": within(F.floor(F.col("batch") * (1 + F.col("_by"))), batch), "_workers": within(grown, workers), "_transfer": within(F.floor(F.col("transfer") * (1 + F.col("_half"))), transfer)}
    fresh = {k: F.when(F.col("_by") == 0, F.col(k[1:])).otherwise(v) for k, v in fresh.items()}
    for name, value in fresh.items():
        changed = changed.withColumn(name, value)
    falls = F.col("fallback") > 0.25
    after = {
        "batch": F.when(falls, within(F.floor(F.col("_batch") * 0.9), (batch[0], 1 << 30))).otherwise(F.col("_batch")),
        "workers": F.when(falls, F.least(F.greatest("_workers", F.col("workers") + 1), F.lit(workers[1]))).when((F.col("fallback") < 0.05) & (F.col("_workers") < workers[1]), F.least(F.greatest("_workers", "workers"), F.lit(workers[1]))).otherwise(F.col("_workers")),
        "transfer": F.col("_transfer"),
    }
    short = {"batch": within(F.floor(F.col("batch") / 2), (batch[0], 1 << 30)), "workers": F.greatest(F.col("workers") - 1, F.lit(workers[0])), "transfer": F.col("transfer")}
    for name, value in after.items():
        changed = changed.withColumn(f"next_{name}", F.when(F.col("oom"), short[name]).when(F.col("samples") < least, F.col(name)).otherwise(value).cast("int"))
    return changed.drop("_by", "_half", *fresh)


def per_rank(metrics: DataFrame) -> DataFrame:
    """The last state of each rank and its totals: (rank, ts, tokens, seconds)."""
    return metrics.groupBy("rank").agg(F.max_by("tokens", "ts").alias("last_tokens"), F.sum("tokens").alias("total_tokens"), F.sum("seconds").alias("total_seconds"), F.count(F.lit(1)).alias("steps"))


def trend(points: DataFrame, order: str, value: str) -> DataFrame:
    """The latest point against the first: (latest, baseline, ratio), of a table of runs."""
    ends = points.agg(F.max_by(value, order).alias("latest"), F.min_by(value, order).alias("baseline"))
    return ends.select("latest", "baseline", F.coalesce(F.try_divide("latest", "baseline"), F.lit(0.0)).alias("ratio"))


def gate(points: DataFrame, order: str, value: str, tolerance: float = 0.1) -> bool:
    """True if the latest throughput is within the tolerance of the baseline or better."""
    row = trend(points, order, value).first()
    return row["baseline"] is None or row["latest"] >= row["baseline"] * (1 - tolerance)


def scaling(runs: DataFrame) -> DataFrame:
    """(name, reference, weight, throughput): throughput against what the reference run and the total weight let expect."""
    base = runs.select(F.col("name").alias("reference"), F.col("throughput").alias("base"))
    return runs.join(base, "reference", "left").select("name", "throughput", (F.col("base") * F.col("weight")).alias("expected"), F.coalesce(F.try_divide("throughput", F.col("base") * F.col("weight")), F.lit(0.0)).alias("efficiency"))


def classification(scored: DataFrame, logits: str, label: str) -> DataFrame:
    """Samples, accuracy and mean cross entropy of (logits array<double>, label)."""
    top = F.array_max(logits)
    z = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    p = F.exp(F.element_at(logits, F.col(label).cast("int") + 1) - top) / z
    right = (F.array_position(logits, top) - 1 == F.col(label)).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("samples"), F.avg(right.cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def rates(rows: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Tokens by tumbling windows of event time, with a watermark for late rows: (ts, tokens)."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg(F.sum("tokens").alias("tokens")).select("window.start", "window.end", "tokens")
