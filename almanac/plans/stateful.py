"""Stateful, windowed and textual queries on the star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import terms
from almanac.plans import ask
from almanac.plans.registry import query, shared_dir, table
from almanac.streaming import state, windows


@query(
    """
    WITH k AS (SELECT user_id || ':' || event_type AS key, ts, event_id, value FROM events),
    old AS (SELECT key, sum(event_id) AS f FROM k WHERE ts < TIMESTAMP '2024-01-05' GROUP BY key),
    new AS (SELECT key, CASE WHEN max(value) > 60 THEN NULL ELSE sum(event_id) END AS f FROM k WHERE ts < TIMESTAMP '2024-01-07' GROUP BY key)
    SELECT n.key, CASE WHEN n.f IS NULL THEN 'error' WHEN o.f IS NULL THEN 'new' WHEN o.f = n.f THEN 'same' ELSE 'changed' END AS status,
           n.f IS NULL OR o.f IS NULL OR o.f <> n.f AS changed
    FROM new n LEFT JOIN old o USING (key)"""
)
def change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a snapshot against those two days before; a broken reading counts as a failed fetch."""
    events = table(spark, sf_dir, "events").withColumn("key", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")))
    upto = lambda day: events.filter(F.col("ts") < F.lit(day).cast("timestamp_ntz")).groupBy("key")
    mark = F.sum("event_id").cast("string")
    old = upto("2024-01-05").agg(mark.alias("fingerprint"))
    new = upto("2024-01-07").agg(F.when(F.max("value") <= 60, mark).alias("fingerprint"))
    return state.change_gate(new, old).select("key", "status", "changed")


@query(
    """
    WITH n AS (SELECT url || '#' || page_id AS title, trim(html) AS content FROM pages),
    e AS (SELECT url || '#' || page_id AS title, CASE WHEN contains(html, 'lang="en"') THEN trim(html) ELSE trim(html) || 'x' END AS content FROM pages WHERE starts_with(url, 'https'))
    SELECT n.title, CASE WHEN e.title IS NULL THEN 'create' WHEN md5(e.content) = md5(n.content) THEN 'skip' ELSE 'update' END AS action FROM n LEFT JOIN e USING (title)"""
)
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, update or skip by MD5 of stripped text (K6, Q16)."""
    pages = table(spark, sf_dir, "pages").withColumn("title", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    new = pages.select("title", F.concat(F.lit(" \n"), F.trim("html"), F.lit("\t")).alias("content"))
    kept = F.when(F.contains("html", F.lit('lang="en"')), F.trim("html")).otherwise(F.concat(F.trim("html"), F.lit("x")))
    old = pages.filter(F.col("url").startswith("https")).select("title", kept.alias("content"))
    return state.publish_plan(new, old)


@query(
    """
    WITH w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, sum(value) AS total FROM events GROUP BY 1),
    b AS (SELECT start, total, epoch(start)::BIGINT // 300 AS slot FROM w WHERE total > 12),
    r AS (SELECT *, lag(slot, 2) OVER (ORDER BY slot) AS before FROM b)
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, round(total, 2) AS total FROM r WHERE slot - before = 2"""
)
def five_minute_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three breaching periods in a row."""
    sums = windows.tumbling(table(spark, sf_dir, "events"), "ts", "5 minutes", F.sum("value").alias("total"))
    bad = windows.alarms(sums, "start", "total", 12, 5)
    return bad.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("total", 2).alias("total"))


@query(
    """
    SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, n FROM (
      SELECT user_id, time_bucket(INTERVAL '1 hour', ts) - to_hours(k) AS start, count(*)::BIGINT AS n
      FROM events, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS u(k) GROUP BY 1, 2) WHERE n > 3"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding counts per key over a limit."""
    over = windows.rate_limited(table(spark, sf_dir, "events"), "ts", "user_id", "12 hours", "1 hour", 3)
    return over.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, strftime(max(ts) + INTERVAL '2 hours', '%Y-%m-%d %H:%M') AS stop, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by pause (an extension)."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "2 hours").select("user_id", at("start"), at("stop"), "n")


@query("SELECT cast(p_partkey AS VARCHAR) AS id, p_name AS name, cast(p_size AS VARCHAR) AS size FROM part WHERE p_brand = 'Brand#7' AND p_type = 'SMALL' ORDER BY p_partkey LIMIT 10")
def ask_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition language on parts."""
    parts = table(spark, sf_dir, "part")
    return ask.execute(parts, "[[Category:Brand#7]] [[p type::SMALL]] |?p partkey=id |?p name=name |?p size=size", ["p_partkey"], "p_brand")


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(translate(coalesce(text, ''), ',;|/', '    '), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')),
                   '[^\p{L}\p{N}\x00-\x7F]|_', ' . ', 'g'), '[^\x00-\x7F]', 'x', 'g') AS t FROM documents),
    f AS (SELECT doc_id, regexp_extract_all(t, '\b(the and|de la|and|der|les|the|de|la|le)\b') AS m FROM d)
    SELECT doc_id, len(m)::BIGINT AS n_terms,
           coalesce(array_to_string(list_transform(m, lambda x: CASE x WHEN 'the and' THEN 'A' WHEN 'the' THEN 'B' WHEN 'and' THEN 'C' WHEN 'le' THEN 'D' WHEN 'les' THEN 'E' WHEN 'der' THEN 'F' WHEN 'de la' THEN 'G' WHEN 'de' THEN 'H' ELSE 'I' END), ','), '') AS terms
    FROM f"""
)
def greedy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest terms first, without overlaps, over whole texts."""
    vocabulary = {"the and": "A", "the": "B", "and": "C", "le": "D", "les": "E", "der": "F", "de la": "G", "de": "H", "la": "I"}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("terms", terms.find(vocabulary)(F.col("text")))
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", ",").alias("terms"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row per key kept by a stream that runs to its end."""
    name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events.parquet}}").select("user_id", "ts", "event_id", "event_type")
    state.stream_merge(source, f"{name}/state", f"{name}/log", "user_id", ["ts", "event_id"])
    return state.read_state(spark, f"{name}/state").select("user_id", "event_id", "event_type")
