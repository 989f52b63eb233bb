"""Small tables of accounts, apps, services and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions import text as T
from quillmere.shared import quoted, whole_row


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """The newest row of each key, of several at one time the largest in its columns' order. Adds up before the shuffle. [WIN7, SRC12, SNK11]"""
    rows = df.select(F.col(quoted(key)).alias("_key"), whole_row(df).alias("_row"))
    kept = rows.groupBy("_key").agg(F.max_by("_row", F.struct(F.col("_row")[by], F.col("_row"))).alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def active(rows: DataFrame) -> DataFrame:
    """[FLT6]"""
    return rows.where(F.col("status") == "active")


def sanitized(accounts: DataFrame) -> DataFrame:
    """[PRJ10]"""
    return accounts.drop("password_hash")


def login(accounts: DataFrame, username: str, password: str) -> DataFrame:
    """The active account with this name and password, if any. [FLT16]"""
    return active(accounts).where((F.col("username") == username) & (F.col("password_hash") == T.password_hash(F.lit(password))))


def known_apps(apps: Column, registry: list[str]) -> Column:
    """[FLT17]"""
    return F.filter(apps, lambda x: F.array_contains(T.words(registry), x))


def apps_of(accounts: DataFrame, registry: DataFrame) -> DataFrame:
    """(username, apps): records of an account's apps in their order; unknown ones dropped. [JN16]"""
    listed = accounts.select("username", F.posexplode("available_apps").alias("pos", "app_id")).join(registry, "app_id")
    record = F.struct("pos", F.struct(*registry.columns).alias("app"))
    found = listed.groupBy("username").agg(F.array_sort(F.collect_list(record)).alias("rows"))
    joined = accounts.select("username").join(found, "username", "left")
    return joined.select("username", F.coalesce(F.transform("rows", lambda r: r["app"]), F.array().cast(found.select(F.transform("rows", lambda r: r["app"])).dtypes[0][1])).alias("apps"))


def remove_app(accounts: DataFrame, app_id: str) -> DataFrame:
    """[COL3]"""
    return accounts.withColumn("available_apps", F.array_remove("available_apps", app_id))


def feed_documents(raw: DataFrame, id_column: str = "id") -> DataFrame:
    """Documents of feed answers with a nested list: (doc_id, title, url, date). Missing titles give subtitles. [SRC8, SRC9, COL4]"""
    rows = raw.select(F.explode("dokumentlista.dokument").alias("d"))
    return rows.select(F.col(f"d.{id_column}").alias("doc_id"), F.coalesce(F.nullif(F.col("d.titel"), F.lit("")), F.col("d.undertitel")).alias("title"), F.col("d.dokument_url_html").alias("url"), F.to_timestamp("d.datum").alias("last_modified"))


def date_range(today: Column, days: int = 7) -> Column:
    """(from, to) of the last days, as feeds want them. [DT5]"""
    return F.struct(F.date_format(F.date_sub(today.cast("date"), days), "yyyy-MM-dd").alias("from"), F.date_format(today, "yyyy-MM-dd").alias("to"))


def merge_feeds(feeds: list[DataFrame], limit: int) -> DataFrame:
    """[SET3, TOP6]"""
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed)
    return union.orderBy(F.desc("last_modified"), F.asc("doc_id")).limit(limit)


def union_until(hits: DataFrame, fallback: DataFrame, limit: int = 10) -> DataFrame:
    """Hits (query_id, variant, rank, title) of query variants in order, each title once, ``limit`` for each query; the fallback only where a query has none. [SET2, SRC11]"""
    spare = fallback.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    every = hits.unionByName(spare)
    first = every.groupBy("query_id", "title").agg(F.min(F.struct("variant", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at.variant", "at.rank", "title"))
    return first.withColumn("place", place.cast("int")).where(F.col("place") <= limit).select("query_id", "place", "title")


def service_status(services: DataFrame, now: Column) -> DataFrame:
    """Whole seconds since each start, and as hours and minutes. [PRJ12, DT6]"""
    up = (F.unix_seconds(now) - F.unix_seconds(F.col("started"))).cast("long")
    return services.withColumn("uptime_s", up).withColumn("uptime", F.format_string("%dh %dm", F.floor(F.col("uptime_s") / 3600), F.floor(F.col("uptime_s") % 3600 / 60)))


def log_line(moment: Column, level: Column, message: Column) -> Column:
    """[PRJ13]"""
    return F.format_string("[%s] %s: %s", F.date_format(moment, "HH:mm:ss"), level, message)


def decode_packet(data: Column) -> Column:
    """(version, type, flags, length, payload, error) of a packet: eight bytes of header in network order, then the payload."""
    digits = F.hex(data)
    number = lambda at, n: F.conv(F.substring(digits, at, n), 16, 10).cast("long")
    length = number(9, 8)
    error = F.when(F.length(data) < 8, "short").when(number(1, 2) != 1, "version").when(F.length(data) < 8 + length, "incomplete")
    return F.struct(number(1, 2).alias("version"), number(3, 2).alias("type"), number(5, 2).alias("flags"), length.alias("length"), F.unhex(F.substring(digits, F.lit(17), length * 2)).alias("payload"), error.alias("error"))


def encode_packet(kind: Column, flags: Column, payload: Column) -> Column:
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    return F.unhex(F.concat(F.lit("01"), byte(kind), byte(flags), F.lit("00"), F.lpad(F.hex(F.length(payload).cast("long")), 8, "0"), F.hex(payload)))


def page_offset(page: object, per_page: object, most: int = 100) -> tuple[int, int]:
    """(offset, limit) of a page. [FLT19]"""
    page, per_page = int(page or 1), int(per_page or 10)
    if page < 1 or not 1 <= per_page <= most:
        raise ValueError("page must be at least 1, per_page between 1 and %d" % most)
    return (page - 1) * per_page, per_page
