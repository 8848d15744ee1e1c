"""Audit log, counters, retention and reports as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def since(ts: Column, now: str, days: float) -> Column:
    """Strictly younger than days before now."""
    return micros(ts) > micros(F.lit(now)) - int(days * DAY * 1_000_000)


def logs(table: DataFrame, now: str, days: int = 30, limit: int = 1000, **equal: object) -> DataFrame:
    """The youngest rows with the given column values."""
    out = table.filter(since(F.col("ts"), now, days))
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    return out.orderBy(F.col("ts").desc(), "event_id").limit(limit)


def counters(asked: DataFrame) -> DataFrame:
    """query_hash, query, count, category, last_asked of (query, category, ts): category and wording of the first row."""
    first = F.min_by(F.struct("query", "category"), F.struct("ts", "query", "category"))
    out = asked.groupBy(F.md5(F.lower(F.trim("query"))).alias("query_hash")).agg(first.alias("f"), F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_asked"))
    return out.select("query_hash", "f.query", "count", F.coalesce("f.category", F.lit("general")).alias("category"), "last_asked")


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of counters: counts add up, the newest time wins, wording and category of the older stay."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    kept = F.min_by(F.struct("query", "category"), F.col("age"))
    return both.groupBy("query_hash").agg(kept.alias("f"), F.sum("count").alias("count"), F.max("last_asked").alias("last_asked")).select("query_hash", "f.query", "count", "f.category", "last_asked")


def trending(counts: DataFrame, now: str, days: int, limit: int) -> DataFrame:
    """Queries asked in the last days, by their count of all time."""
    return counts.filter(since(F.col("last_asked"), now, days)).orderBy(F.col("count").desc(), "query_hash").limit(limit)


def compliance(table: DataFrame, now: str, days: int) -> DataFrame:
    """One row of (user_id, ts, abstained, grounded_fraction, confidence): totals and shares; averages leave out abstained rows."""
    recent = table.filter(since(F.col("ts"), now, days))
    out = recent.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("abstained").alias("abstained"),
        F.avg(F.when(~F.col("abstained"), F.col("grounded_fraction"))).alias("avg_grounded"),
        F.avg(F.when(~F.col("abstained"), F.col("confidence"))).alias("avg_confidence"),
        F.countDistinct("user_id").alias("users"),
    )
    share = F.when(F.col("total") > 0, F.round(100.0 * F.col("abstained") / F.col("total"), 1)).otherwise(0.0)
    return out.select("total", "abstained", share.alias("abstained_pct"), F.round(F.coalesce("avg_grounded", F.lit(0.0)), 3).alias("avg_grounded"), F.round(F.coalesce("avg_confidence", F.lit(0.0)), 3).alias("avg_confidence"), "users")


def by_category(table: DataFrame, now: str, days: int) -> DataFrame:
    return table.filter(since(F.col("ts"), now, days)).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def purge(table: DataFrame, now: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and those that go: older than days before now."""
    old = micros(F.col("ts")) < micros(F.lit(now)) - days * DAY * 1_000_000
    return table.filter(~old), table.filter(old)


def trip_wire(events: DataFrame, minutes: int, least: int) -> DataFrame:
    """user_id, event_id, ts, n of high or critical events with at least ``least`` of them in the minutes before, itself included.

    The start of the window is open."""
    w = Window.partitionBy("user_id").orderBy(micros(F.col("ts"))).rangeBetween(-(minutes * 60_000_000) + 1, 0)
    high = events.filter(F.col("severity").isin("high", "critical"))
    return high.withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") >= least).select("user_id", "event_id", "ts", "n")


def latest_versions(versions: DataFrame, now: str) -> DataFrame:
    """For each path the version in force: the newest effective one that is not deprecated yet."""
    t = F.lit(now).cast("timestamp")
    live = versions.filter((F.col("effective_date") <= t) & (F.col("deprecated_date").isNull() | (F.col("deprecated_date") > t)))
    w = Window.partitionBy("path").orderBy(F.col("effective_date").desc(), F.col("version").desc())
    return live.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def deprecate(versions: DataFrame, path: str, at: str) -> DataFrame:
    hit = (F.col("path") == path) & F.col("deprecated_date").isNull()
    return versions.withColumn("deprecated_date", F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("deprecated_date")))


def resolve(unanswered: DataFrame, key: int, resolution: str = "resolved") -> DataFrame:
    return unanswered.withColumn("status", F.when(F.col("id") == key, resolution).otherwise(F.col("status")))


def clipped(table: DataFrame) -> DataFrame:
    """An audit row as it is appended: answers of at most 1000 characters, no null category."""
    return table.withColumn("answer", F.left("answer", F.lit(1000))).withColumn("category", F.coalesce("category", F.lit("general")))


def answer_logs(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an answered question (user_id, role, query, category, answer, grounded, abstained, sources, confidence, ts)
    leaves: its audit row with sources as JSON, counters of questions, and an open question where it abstained."""
    rows = clipped(answers.withColumn("answer", F.coalesce("answer", F.lit("")))).withColumn("abstained", F.coalesce("abstained", F.lit(False)))
    rows = rows.withColumn("grounded", F.coalesce("grounded", F.lit(0.0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    audit = rows.select("ts", "user_id", "role", "query", "category", "answer", "grounded", "abstained", F.coalesce(F.to_json("sources"), F.lit("[]")).alias("sources"), "confidence")
    return audit, counters(rows.select("query", "category", "ts")), rows.filter("abstained").select("ts", "user_id", "query", "category", "confidence", F.lit("open").alias("status"))


def violation_rows(screened: DataFrame) -> DataFrame:
    """One row for each violation of screened queries (username, role, ts, sanitised, violations), matches clipped to 200
    characters and queries to 500."""
    v = screened.select("ts", "username", "role", F.explode("violations").alias("v"), F.left(F.coalesce("sanitised", F.lit("")), F.lit(500)).alias("query"))
    return v.select("ts", "username", "role", "v.layer", "v.rule", "v.severity", F.left(F.coalesce("v.matched", F.lit("")), F.lit(200)).alias("matched"), "query")
