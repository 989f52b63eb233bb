"""Operational analytics over event tables: counters, histograms, cache and performance figures, windows over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions import lexicon as L
from quillmere.operators.ranking import age_days, safe_divide
from quillmere.shared import durable, partitions_of, quoted
from quillmere.streaming.machines import cache_entry, run_rows


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    """[AGG16, AGG21]"""
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, value: str, bounds: list[float], labels: list[str] | None = None) -> DataFrame:
    """(labels, le, n): cumulative buckets, the last without bound. One row in, one counter for each bound: nothing is multiplied before it is added up. [AGG17]"""
    labels = labels or []
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"_{len(bounds)}")]
    wide = events.groupBy(*labels).agg(*counts)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])])
    return wide.select(*labels, F.inline(rows).alias("le", "n"))


def summary(events: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """[AGG18]"""
    return events.groupBy(*labels).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def gauges(events: DataFrame, key: str, value: str, ts: str, tie: str = "event_id") -> DataFrame:
    """The last value of each key, of several at one time that of the largest ``tie``. [AGG19]"""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def in_parts(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events dealt in order to tasks, whatever the number of keys: ``_part`` rises with (key, order). Kept in the shared folder."""
    dealt = events.repartitionByRange(max(2, partitions_of(events.sparkSession)), key, *order)
    return durable(dealt.withColumn("_part", F.spark_partition_id()))


def running_mean(events: DataFrame, value: str, ts: str, key: str) -> DataFrame:
    """The mean so far at each event. [AGG14]

    Sums run within parts, and what the parts before hold (one row for each key and part) is added, so a key with most of the events is no one task's.
    """
    parts = in_parts(events.withColumn("_v", F.col(value).cast("double")), key, [ts, "event_id"])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(key, "_part").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    offsets = sums.select(key, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    own = Window.partitionBy(key, "_part").orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.withColumns({"_run": F.coalesce(F.sum("_v").over(own), F.lit(0.0)), "_count": F.count("_v").over(own)})
    mean = F.try_divide(F.col("_s") + F.col("_run"), F.col("_n") + F.col("_count"))
    joined = _with_offsets(run, offsets, key)
    return joined.withColumn("mean", mean).select(*[c for c in events.columns], "mean")


def _with_offsets(rows: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Rows with their part's offsets; rows without a key are a group too."""
    named = offsets.withColumnsRenamed({key: "_key2", "_part": "_part2"})
    return rows.join(named, rows[key].eqNullSafe(named["_key2"]) & (rows["_part"] == named["_part2"])).drop("_key2", "_part2")


def quantile(events: DataFrame, value: str, key: str, q: float) -> DataFrame:
    """(key, quantile): the exact quantile of each key, between two values where it falls between. Nulls do not count.

    Values are put in order over all tasks and ranked within parts; only the two rows on either side of the place are kept.
    """
    parts = in_parts(events.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("_v")), key, ["_v"])
    counts = parts.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), ((F.sum("_n").over(whole) - 1) * q).alias("_place"))
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_v")) - 1
    placed = _with_offsets(parts.withColumn("_own", rank), offsets, key).withColumn("_rank", F.col("_before") + F.col("_own"))
    near = placed.where((F.col("_rank") == F.floor("_place")) | (F.col("_rank") == F.ceil("_place")))
    low, high, share = F.min("_v"), F.max("_v"), F.max(F.col("_place") - F.floor("_place"))
    return near.groupBy(key).agg((low + (high - low) * share).alias("quantile"))


def cache_log(requests: DataFrame, key: str) -> DataFrame:
    """Requests (event_id, ts, key) with whether the cache had their key, row by row; see ``machines.cache_entry``. [AGG15, DT3]"""
    return run_rows(requests, key, cache_entry(), ok=F.lit(True)).withColumn("hit", F.col("result") == "hit").select(*[F.col(quoted(c)) for c in requests.columns], "hit")


def cache_stats(log: DataFrame, ms: str) -> DataFrame:
    """(hits, misses, hit_rate, saved_ms, saved_per_hit). [AGG15, MTH19]"""
    sums = log.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.sum(F.when(F.col("hit"), F.col(ms))), F.lit(0.0)).alias("saved_ms"))
    return sums.withColumns({"hit_rate": safe_divide(F.col("hits"), F.col("hits") + F.col("misses")), "saved_per_hit": safe_divide(F.col("saved_ms"), F.col("hits"))})


def evict(entries: DataFrame, last_access: str, capacity: int) -> DataFrame:
    """The ``capacity`` entries used last. A top-k, no global sort. [WIN11]"""
    return entries.orderBy(F.desc(last_access), F.asc("key")).limit(capacity)


def newest(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key; a window group limit is applied before the shuffle. [WIN6, WIN8]"""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc("event_id")))
    return df.withColumn("place", place.cast("int")).where(F.col("place") <= n)


def recent_errors(lines: DataFrame, n: int = 10) -> DataFrame:
    """Errors among each source's last ``n`` lines. [AGG24]"""
    return newest(lines, "source", "ts", n).groupBy("source").agg(F.count_if(F.col("level") == "ERROR").alias("errors"))


def performance(events: DataFrame, operation: str, ms: str, ok: Column, target: float = 500.0) -> DataFrame:
    """(operation, mean_ms, p95_ms, n, within_target): means over successes only, 0 without any. [AGG20, AGG22]"""
    mean = F.coalesce(F.avg(F.when(ok, F.col(ms))), F.lit(0.0))
    sums = events.groupBy(operation).agg(mean.alias("mean_ms"), F.count("*").alias("n"))
    p95 = quantile(events, ms, operation, 0.95).withColumnsRenamed({"quantile": "p95_ms", operation: "_operation"})
    return sums.join(p95, sums[operation].eqNullSafe(p95["_operation"]), "left").select(operation, "mean_ms", "p95_ms", "n", (F.col("mean_ms") < target).alias("within_target"))


def crawl_rollup(pages: DataFrame, as_of: Column) -> DataFrame:
    """(domains, pages, age_days, needs_update). [AGG23, DT7, SNK2]"""
    sums = pages.agg(F.count_distinct("domain").alias("domains"), F.count("*").alias("pages"), F.max("crawled_at").alias("newest"))
    return sums.withColumn("age_days", age_days(F.col("newest"), as_of)).withColumn("needs_update", F.col("age_days") > 30).drop("newest")


def crawl_progress(done: Column, total: Column, seconds: Column) -> Column:
    """(per_minute, percent, eta_seconds). [AGG25]"""
    rate = safe_divide(done * 60.0, seconds)
    return F.struct(rate.alias("per_minute"), safe_divide(done * 100.0, total).alias("percent"), safe_divide((total - done) * 60.0, rate).alias("eta_seconds"))


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Events within the last seconds at each event, refused ones too, and whether they are over the limit. [WIN2]"""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > limit)


def since(events: DataFrame, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """[FLT14]"""
    return events.where(F.col(ts) > as_of - F.make_dt_interval(hours=F.lit(hours)))


def retained(events: DataFrame, ts: str, as_of: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows go. [FLT15]"""
    old = F.col(ts) < as_of - F.make_dt_interval(days=F.lit(days))
    return events.where(~old), events.agg(F.count_if(old).alias("deleted"))


def due(last: Column, now: Column, seconds: int) -> Column:
    """Whether an update is due: the interval has passed, or there was none yet. [FLT20]"""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last) >= seconds * 1_000_000, F.lit(True))


def alert_payload(alerts: DataFrame) -> DataFrame:
    """A JSON payload by severity's colour. [PRJ15, SNK8]"""
    # Colours.
    colour = F.create_map(*[F.lit(x) for pair in L.ALERT_COLOURS.items() for x in pair])
    body = F.struct(colour[F.lower("severity")].alias("color"), "title", F.col("message").alias("text"), F.unix_seconds("ts").alias("ts"))
    return alerts.select("*", F.to_json(F.struct(F.array(body).alias("attachments"))).alias("payload"))


def exposition(metrics: DataFrame) -> DataFrame:
    """Metric rows (name, labels map, value) as text lines. [SNK7]"""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.lit("{"), pairs, F.lit("} "), F.col("value").cast("string")).alias("line"))
