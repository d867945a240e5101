"""The archive's operators on the star-schema tables, each with the SQL that checks it.

Names follow the archive's own questions; the tables stand in for it: suppliers for players,
orders for matches, events for season rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import constants as C
from almanac.functions import scalars as S
from almanac.operators import joins, merges, ordered
from almanac.plans.registry import query, table


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# --- aggregates, sorts and limits ---------------------------------------------------------


@query(
    """
    SELECT rank, l_partkey, n_full FROM (
      SELECT row_number() OVER (ORDER BY n_full DESC, l_partkey) AS rank, l_partkey, n_full FROM (
        SELECT l_partkey, count(*) FILTER (WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount > 0.09)::BIGINT AS n_full
        FROM lineitem GROUP BY l_partkey ORDER BY n_full DESC, l_partkey LIMIT 10))
    WHERE n_full > 0"""
)
def top10_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit before the filter: may leave fewer than ten rows (O3)."""
    full = F.count_if((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(full.alias("n_full"))
    return ordered.top_k(sums, "n_full", 10, ["l_partkey"], positive="after").select("rank", "l_partkey", "n_full")


@query(
    """
    SELECT count(*)::BIGINT AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total, count(DISTINCT o_custkey)::BIGINT AS n_customers,
           coalesce(round(max(o_totalprice), 2), 0) AS largest, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS n_finished
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"""
)
def season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of one season, zero where it is empty (A1, P6); the season is a range, so it reaches the scan."""
    season = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
    zero = F.lit(0.0)
    return season.agg(
        F.count("*").alias("n_orders"), F.coalesce(F.round(F.sum("o_totalprice"), 2), zero).alias("total"), F.countDistinct("o_custkey").alias("n_customers"),
        F.coalesce(F.round(F.max("o_totalprice"), 2), zero).alias("largest"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
    )


@query(
    """
    SELECT year(l_shipdate)::BIGINT AS season, count(*)::BIGINT AS n, sum(q)::BIGINT AS total, (sum(q) // count(*))::BIGINT AS average, max(q)::BIGINT AS most, min(q)::BIGINT AS least
    FROM (SELECT l_shipdate, try_cast(regexp_replace(replace(cast(cast(l_quantity * 100 AS BIGINT) AS VARCHAR), '5', ',5'), '[^0-9]', '', 'g') AS BIGINT) AS q FROM lineitem)
    WHERE q IS NOT NULL GROUP BY 1"""
)
def attendance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, floor average and extremes of a number written with separators, per season (A3, F16)."""
    text = F.replace((F.col("l_quantity") * 100).cast("long").cast("string"), F.lit("5"), F.lit(",5"))
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("season"), S.attendance(text).alias("q")).filter("q IS NOT NULL")
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.expr("sum(q) div count(*)").alias("average"), F.max("q").alias("most"), F.min("q").alias("least"))


@query(
    """
    SELECT c_mktsegment AS segment, year(o_orderdate)::BIGINT AS season, count(*)::BIGINT AS n, count(DISTINCT year(o_orderdate))::BIGINT AS n_seasons
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    GROUP BY GROUPING SETS ((c_mktsegment, year(o_orderdate)), (c_mktsegment), ())"""
)
def campaign_two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per segment and season, per segment, and in all.

    The seasons of a segment are counted from the first level, so orders are grouped once.
    """
    who = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.col("c_mktsegment").alias("segment"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("season"))
    base = rows.join(who, "c_custkey").groupBy("segment", "season").agg(F.count("*").alias("n"))
    return _two_level(base)


def _two_level(base: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    per = base.groupBy("segment").agg(F.sum("n").alias("n"), F.count("*").alias("n_seasons"))
    whole = base.groupBy("season").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("n_seasons"))
    none = F.lit(None).cast("long").alias("season")
    return base.select("segment", "season", "n", one.alias("n_seasons")).unionByName(per.select("segment", none, "n", "n_seasons")).unionByName(whole.select(F.lit(None).cast("string").alias("segment"), none, "n", "n_seasons"))


@query(
    """
    SELECT p_brand AS brand, count(*)::BIGINT AS n, string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey) AS parts
    FROM part GROUP BY p_brand"""
)
def group_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group as a list in source order (A5)."""
    rows = table(spark, sf_dir, "part")
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    told = F.transform(items, lambda x: F.concat(x["p_partkey"].cast("string"), F.lit(":"), x["p_name"]))
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.array_join(told, ",").alias("parts"))


BUCKETS = {"SMALL": "GK", "MEDIUM": "DF", "LARGE": "MF", "PROMO": "FW"}


@query(
    """
    SELECT bucket, count(*)::BIGINT AS n, list_position(['GK', 'DF', 'MF', 'FW', 'OTHER'], bucket)::BIGINT AS place FROM (
      SELECT CASE p_type WHEN 'SMALL' THEN 'GK' WHEN 'MEDIUM' THEN 'DF' WHEN 'LARGE' THEN 'MF' WHEN 'PROMO' THEN 'FW' ELSE 'OTHER' END AS bucket FROM part)
    GROUP BY bucket"""
)
def position_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped groups in a fixed order, OTHER for the rest."""
    bucket = S.lookup("p_type", BUCKETS, F.lit("OTHER"))
    place = F.array_position(F.array(*(F.lit(x) for x in C.LINES)), F.col("bucket"))
    return table(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("place", place.cast("long"))


@query(
    """
    SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, max_by(value, (ts, event_id)) FILTER (WHERE value > 5) AS last_large,
           min_by(event_type, (ts, event_id)) AS first_type, bool_or(event_type = 'purchase') AS bought,
           string_agg(DISTINCT strftime(ts, '%Y-%m-%d'), ',' ORDER BY strftime(ts, '%Y-%m-%d')) AS days
    FROM events GROUP BY user_id"""
)
def merge_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several precedence rules in one pass: last, last non-empty, first, ever, distinct seasons."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", _day("ts").alias("season"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("last_type"),
        F.when(F.col("value") > 5, F.col("value")).alias("last_large"), F.col("event_type").alias("first_type"), (F.col("event_type") == "purchase").alias("bought"),
    )
    merged = merges.merge_seasons(rows, "user_id", last=["last_type"], last_truthy=["last_large"], any_of=["bought"])
    return merged.withColumn("days", F.array_join("seasons_active", ",")).drop("seasons_active")


@query(
    """
    SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM (
      SELECT l_suppkey, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 30
      UNION ALL SELECT l_suppkey, l_returnflag, l_linestatus FROM lineitem WHERE l_discount > 0.05)"""
)
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of overlapping frames, each whole row once."""
    rows = table(spark, sf_dir, "lineitem")
    columns = ["l_suppkey", "l_returnflag", "l_linestatus"]
    return merges.distinct_rows(rows.filter("l_quantity > 30").select(*columns), rows.filter("l_discount > 0.05").select(*columns))


@query(
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
)
def latest_of_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each history."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ordered.pick(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS n_errors FROM events GROUP BY user_id")
def exists_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a condition ever holds in a group."""
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(bad).alias("any_error"), F.count_if(bad).alias("n_errors"))


@query(
    """
    SELECT l_suppkey, count(*)::BIGINT AS played, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS won,
           count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*) AS win_pct
    FROM lineitem GROUP BY l_suppkey"""
)
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a group in percent, unrounded."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("played"), F.count_if(F.col("l_returnflag") == "R").alias("won"))
    return sums.withColumn("win_pct", S.win_rate("won", "played"))


@query(
    """
    SELECT coalesce(r_name, 'TOTAL') AS region, coalesce(n_name, 'TOTAL') AS nation, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)"""
)
def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with subtotals and a grand total (A13, A21); customers are summed by key before any join."""
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"), F.sum("c_acctbal").alias("b"))
    rows = sums.join(table(spark, sf_dir, "nation"), "n_nationkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    told = rows.rollup("r_name", "n_name").agg(F.sum("c").alias("n"), F.round(F.sum("b"), 2).alias("balance"))
    return told.select(F.coalesce("r_name", F.lit("TOTAL")).alias("region"), F.coalesce("n_name", F.lit("TOTAL")).alias("nation"), "n", "balance")


@query("SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'customer', count(*)::BIGINT FROM customer UNION ALL SELECT 'events', count(*)::BIGINT FROM events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table."""
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("orders", "customer", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """
    SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS items FROM (
      SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, event_type) AS r
      FROM (SELECT user_id, event_type, max(ts) AS latest FROM events GROUP BY ALL)) WHERE r <= 3 GROUP BY user_id"""
)
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most recently used distinct items, newest first, at most three."""
    return ordered.most_recent_used(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3).withColumn("items", F.array_join("items", ","))


@query(
    """
    SELECT o_orderpriority, rank::BIGINT AS rank, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20"""
)
def leaderboard_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top twenty of each group with their rank."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordered.top_k_per(rows, ["o_orderpriority"], "o_totalprice", 20, ["o_orderkey"]).withColumn("rank", F.col("rank").cast("long"))


# --- joins --------------------------------------------------------------------------------


@query(
    """
    SELECT dir, count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS n_names FROM (
      SELECT CASE WHEN contains(lower(p_name), 'ring') THEN 'in' WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'red') THEN 'out' END AS dir,
             coalesce(nullif(s_name, ''), cast(l_suppkey AS VARCHAR), 'Unknown') AS name
      FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
      WHERE strftime(l_shipdate, '%Y-%m-%d') LIKE '1996%') WHERE dir IS NOT NULL GROUP BY dir"""
)
def transfers_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching keyword decides the direction, others are dropped; names by left join."""
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01'").select("l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(S.club_is("p_name", ("ring",)), "in").when(S.club_is("p_name", ("bolt", "red")), "out").alias("dir")).filter("dir IS NOT NULL")
    named = joins.with_name(lines.join(parts, "l_partkey"), table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    return named.groupBy("dir").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query(
    """
    SELECT c_custkey, c_name, s.o_orderkey AS last_order, s.o_totalprice AS last_price FROM customer LEFT JOIN (
      SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
        FROM orders WHERE o_orderstatus = 'F') WHERE r = 1) s ON s.o_custkey = c_custkey"""
)
def squad_left_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to the last filtered row of each key."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    joined = joins.with_latest(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return joined.select("c_custkey", "c_name", F.col("stats.o_orderkey").alias("last_order"), F.col("stats.o_totalprice").alias("last_price"))


@query(
    """
    SELECT c_custkey, count(o_orderkey)::BIGINT AS n, coalesce(string_agg(o_orderkey || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'y' ELSE 's' END, ',' ORDER BY o_orderkey), '') AS orders
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def player_page_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a key nested under it, with a flag that splits them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("early"))
    page = joins.nested(table(spark, sf_dir, "customer").select("c_custkey"), rows, "c_custkey", ["o_orderkey", "early"], "rows", ["o_orderkey"])
    told = F.transform("rows", lambda x: F.concat(x["o_orderkey"].cast("string"), F.when(x["early"], "y").otherwise("s")))
    return page.select("c_custkey", F.size("rows").cast("long").alias("n"), F.array_join(told, ",").alias("orders"))


@query(
    """
    WITH prizes AS (SELECT 'Prize ' || (n_nationkey % 4) AS name, unnest([1995 + n_nationkey % 6, 1996 + n_nationkey % 5]) AS season FROM nation),
    tenure AS (SELECT o_custkey % 50 AS coach, year(o_orderdate) AS season, count(*) FILTER (WHERE o_orderstatus = 'F') AS w, count(*) FILTER (WHERE o_orderstatus = 'O') AS d, count(*) FILTER (WHERE o_orderstatus = 'P') AS l
               FROM orders GROUP BY 1, 2)
    SELECT coach, string_agg(DISTINCT cast(tenure.season AS VARCHAR), ',' ORDER BY cast(tenure.season AS VARCHAR)) AS seasons,
           coalesce(string_agg(DISTINCT name || ' ' || tenure.season, ',' ORDER BY name || ' ' || tenure.season), '') AS trophies,
           max(t.won)::BIGINT AS won, max(t.played)::BIGINT AS played
    FROM tenure LEFT JOIN prizes ON prizes.season = tenure.season
    JOIN (SELECT coach AS c, sum(w) AS won, sum(w + d + l) AS played FROM tenure GROUP BY coach) t ON t.c = coach
    GROUP BY coach"""
)
def coach_trophies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prize lists exploded to seasons, joined to tenures and collected by coach with their totals."""
    k = F.col("n_nationkey").cast("long")
    prizes = table(spark, sf_dir, "nation").select(F.concat(F.lit("Prize "), (k % 4).cast("string")).alias("name"), F.explode(F.array(1995 + k % 6, 1996 + k % 5)).alias("season"))
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    tenure = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("coach"), F.year("o_orderdate").cast("long").alias("season")).agg(status("F").alias("w"), status("O").alias("d"), status("P").alias("l"))
    by_season = prizes.groupBy("season").agg(F.collect_set("name").alias("names"))
    rows = tenure.join(by_season, "season", "left")
    prize = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(n, F.lit(" "), F.col("season").cast("string")))
    return rows.groupBy("coach").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("season").cast("string"))), ",").alias("seasons"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(prize)))), ",").alias("trophies"),
        F.sum("w").alias("won"), F.sum(F.col("w") + F.col("d") + F.col("l")).alias("played"),
    )


@query(
    """
    WITH base AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE c_mktsegment END AS role FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    staff AS (SELECT c_custkey AS id, 'S' || c_custkey AS name, CASE WHEN c_nationkey < 5 THEN '' ELSE 'staff' END AS role FROM customer WHERE c_nationkey < 14)
    SELECT coalesce(b.id, s.id) AS id, coalesce(b.name, CASE WHEN b.id IS NULL THEN s.name END) AS name, CASE WHEN b.id IS NULL THEN s.role ELSE coalesce(nullif(s.role, ''), b.role) END AS role
    FROM base b FULL JOIN staff s ON b.id = s.id"""
)
def overlay_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer overlay that grafts non-empty values."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_nationkey")
    base = people.filter("c_mktsegment <> 'MACHINERY'").select("id", F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").otherwise(F.col("c_mktsegment")).alias("role"))
    staff = people.filter("c_nationkey < 14").select("id", F.concat(F.lit("S"), F.col("id").cast("string")).alias("name"), F.when(F.col("c_nationkey") < 5, "").otherwise("staff").alias("role"))
    return joins.overlay(base, staff, "id", ["role"])


@query(
    """
    WITH m AS (SELECT n_name AS en, 'X-' || n_nationkey AS he FROM nation WHERE n_regionkey <> 2)
    SELECT coalesce(nullif(he, ''), n_name) AS place, count(*)::BIGINT AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON en = n_name GROUP BY 1"""
)
def dictionary_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by dictionary, unknown ones as they are."""
    nation = table(spark, sf_dir, "nation")
    mapping = nation.filter("n_regionkey <> 2").select(F.lit("places").alias("category"), F.col("n_name").alias("en"), F.concat(F.lit("X-"), F.col("n_nationkey").cast("string")).alias("he"))
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(nation, "n_nationkey").select(F.col("n_name").alias("place"), "n")
    return joins.translate(counts, mapping, {"place": "places"}).groupBy("place").agg(F.sum("n").alias("n"))


@query(
    """
    WITH wanted AS (SELECT s_suppkey AS display, unnest(['Supplier#' || (s_suppkey * 2), 'Supplier#' || lpad(cast(s_suppkey AS VARCHAR), 9, '0')]) AS name, unnest([0, 1]) AS i FROM supplier),
    hit AS (SELECT display, s.s_suppkey AS key, s_acctbal, row_number() OVER (PARTITION BY display ORDER BY i) AS r FROM wanted w JOIN supplier s ON s.s_name = w.name WHERE s.s_nationkey < 18)
    SELECT d.s_suppkey AS display, h.key, h.s_acctbal AS balance FROM supplier d LEFT JOIN (SELECT * FROM hit WHERE r = 1) h ON h.display = d.s_suppkey"""
)
def alias_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alias that has a row, nulls where none has."""
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    wanted = supplier.select(key.alias("display"), F.array(F.concat(F.lit("Supplier#"), (key * 2).cast("string")), F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))).alias("aliases"))
    rows = supplier.filter("s_nationkey < 18").select(F.col("s_name").alias("opponent"), key.alias("key"), F.col("s_acctbal").alias("balance"))
    return joins.alias_pick(wanted, rows, "opponent", ["key"]).select("display", "key", "balance")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25 AND l_partkey IS NOT NULL)")
def name_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that never occur."""
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return joins.unknown(table(spark, sf_dir, "part").select("p_partkey", "p_name"), seen, ["p_partkey"])


@query(
    """
    SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'update'
                           WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'moved' ELSE 'create' END AS action
    FROM customer"""
)
def route_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A routing label from existence probes (J14, T7); one grouped pass answers both probes."""
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("open"))
    action = F.when(F.col("open"), "update").when(F.col("open").isNotNull(), "moved").otherwise("create")
    return table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", action.alias("action"))


@query(
    """
    SELECT section, key, src, he FROM (
      SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY rank DESC, cycle) AS r FROM (
        SELECT p_type AS section, p_size AS key, ['manual', 'wikidata', 'auto-llm', 'other'][(p_partkey % 4 + 1)::INT] AS src, min(p_name) AS he, p_partkey % 11 AS cycle,
               [4, 3, 2, 0][(p_partkey % 4 + 1)::INT] AS rank
        FROM part GROUP BY p_type, p_size, p_partkey % 4, p_partkey % 11)) WHERE r = 1"""
)
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most trusted source of each entry; of equals the earlier stays."""
    four = (F.col("p_partkey") % 4).cast("int")
    src = F.element_at(F.array(*(F.lit(x) for x in ("manual", "wikidata", "auto-llm", "other"))), four + 1)
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("section"), F.col("p_size").alias("key"), src.alias("src"), (F.col("p_partkey") % 11).alias("cycle")).agg(F.min("p_name").alias("he"))
    ranks = F.create_map(*(F.lit(v) for kv in C.SOURCE_RANK.items() for v in kv))
    ranked = rows.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.col("src")), F.lit(0)))
    return ordered.priority_pick(ranked, ["section", "key"], "rank", "cycle").select("section", "key", "src", "he")


# --- windows ------------------------------------------------------------------------------


@query(
    """
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header
    FROM events"""
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header row carries forward over the rows below it."""
    rows = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ordered.forward_fill(rows, ["user_id"], ["ts", "event_id"], "mark", "header").select("event_id", "user_id", "header")


@query(
    """
    WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT avg(n) * 0.9 AS least FROM m)
    SELECT max(month) AS latest, count(*)::BIGINT AS n_months FROM m, t WHERE month < coalesce((SELECT min(month) FROM m, t WHERE n < least), '9999')"""
)
def populated_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of an unbroken run of well filled periods."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    scaled = months.withColumn("margin", F.col("n") - months.agg(F.avg("n") * 0.9).scalar())
    return ordered.populated_prefix(scaled, "month", "margin", 0).agg(F.max("month").alias("latest"), F.count("*").alias("n_months"))


# --- scalars ------------------------------------------------------------------------------


@query(
    """
    WITH r AS (SELECT o_orderkey, (o_orderkey % 4) || CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE ':' END || (o_custkey % 4) || CASE WHEN o_orderkey % 13 = 0 THEN ' (penalties)' ELSE '' END AS result,
                      CASE o_orderkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'A' WHEN 2 THEN ' h' WHEN 3 THEN 'N' END AS venue, o_orderkey % 4 AS h, o_custkey % 4 AS a FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR venue IS NULL OR venue = 'N' THEN ''
        WHEN h = a THEN 'draw' WHEN (venue = 'A') = (h < a) THEN 'win' ELSE 'loss' END AS outcome FROM r"""
)
def scalar_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win, loss or draw from a score and a side (F2)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    result = F.concat((k % 4).cast("string"), F.when(k % 11 == 0, "-").otherwise(":"), (c % 4).cast("string"), F.when(k % 13 == 0, " (penalties)").otherwise(""))
    venue = F.when(k % 5 == 0, "H").when(k % 5 == 1, "A").when(k % 5 == 2, " h").when(k % 5 == 3, "N")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.outcome(result, venue).alias("outcome"))


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'העברה חופשית' WHEN 1 THEN 'השאלה' WHEN 2 THEN '' WHEN 3 THEN 'דמי השאלה: €' || (o_custkey % 90) || 'k' WHEN 4 THEN '€' || (o_custkey % 90) || 'k' ELSE '' END AS fee,
           o_orderkey % 6 IN (1, 3) AS loan FROM orders"""
)
def scalar_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees in words (F3) and whether they are loans."""
    k, amount = F.col("o_orderkey") % 6, F.concat(F.lit("€"), (F.col("o_custkey") % 90).cast("string"), F.lit("k"))
    raw = F.when(k == 0, " Free Transfer").when(k == 1, "loan transfer").when(k == 2, "?").when(k == 3, F.concat(F.lit('Loan fee:<br /><i class="n">'), amount, F.lit("</i>"))).when(k == 4, amount)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.fee_text(raw).alias("fee"), S.is_loan(raw).alias("loan"))


@query(
    """
    SELECT o_orderkey, year(o_orderdate) || '/' || lpad(cast((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS display, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(year(o_orderdate) AS VARCHAR) END AS start
    FROM orders"""
)
def scalar_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season labels both ways."""
    year = F.year("o_orderdate")
    short = F.lpad((year % 100).cast("string"), 2, "0")
    label = F.when(F.col("o_orderkey") % 7 == 0, short).when(F.col("o_orderkey") % 2 == 0, F.concat(short, F.lit("/xx"))).otherwise(S.season_display(year))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.season_display(year).alias("display"), S.season_start(label).alias("start"))


@query("SELECT p_partkey, (CASE WHEN p_partkey % 120 >= 100 THEN p_partkey % 120 WHEN p_partkey % 120 >= 30 THEN 1900 + p_partkey % 120 ELSE 2000 + p_partkey % 120 END)::BIGINT AS y FROM part")
def scalar_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years in full."""
    return table(spark, sf_dir, "part").select("p_partkey", S.pivot_year(F.col("p_partkey") % 120).cast("long").alias("y"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five date shapes to one, others as they are (F8)."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    shape = lambda f: F.date_format(d, f)
    raw = F.when(k == 0, shape("yyyy-MM-dd")).when(k == 1, shape("dd.MM.yyyy")).when(k == 2, shape("dd/MM/yyyy")).when(k == 3, F.concat(F.lit("Thu "), shape("dd/MM/yy"))).when(k == 4, shape("MMM d, yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.il_date(raw).alias("day"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS tail, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def scalar_tail_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a url's last slash."""
    return table(spark, sf_dir, "pages").select("page_id", S.tail_id("url").alias("tail"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))


@query(
    r"""
    SELECT page_id, md5(regexp_replace(html, '^\s+|\s+$', '', 'g')) AS content, sha256(regexp_replace(regexp_replace(regexp_replace(html, '<meta[^>]+(?:csrf|nonce|token)[^>]*>', '', 'gi'), '\?[a-f0-9]{6,}\b', '?', 'g'), '\bv=\d{10,}', 'v=', 'g')) AS fingerprint
    FROM pages"""
)
def scalar_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and page fingerprints."""
    return table(spark, sf_dir, "pages").select("page_id", S.content_hash("html").alias("content"), S.page_fingerprint("html").alias("fingerprint"))


@query(
    r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1))::BIGINT AS n_links,
           coalesce(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)[1], '') AS first_link, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs
    FROM pages"""
)
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and links of pages by native patterns."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"),
        F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"),
    )


@query("SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text by schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    """
    WITH old AS (SELECT p_size AS page, p_brand AS section, min(p_partkey) AS ord, min(p_name) AS text FROM part WHERE p_type <> 'PROMO' GROUP BY ALL),
    new AS (SELECT p_size AS page, p_brand AS section, min(p_partkey) AS ord, max(p_name) AS text FROM part WHERE p_type <> 'SMALL' GROUP BY ALL)
    SELECT coalesce(o.page, n.page) AS page, coalesce(o.section, n.section) AS section, coalesce(n.text, o.text) AS text,
           row_number() OVER (PARTITION BY coalesce(o.page, n.page) ORDER BY o.ord IS NULL, coalesce(o.ord, n.ord))::BIGINT AS place
    FROM old o FULL JOIN new n ON o.page = n.page AND o.section = n.section"""
)
def section_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages overlaid by key, old order first."""
    part = table(spark, sf_dir, "part")
    keys = [F.col("p_size").alias("page"), F.col("p_brand").alias("section")]
    old = part.filter("p_type <> 'PROMO'").groupBy(*keys).agg(F.min("p_partkey").alias("ord"), F.min("p_name").alias("text"))
    new = part.filter("p_type <> 'SMALL'").groupBy(*keys).agg(F.min("p_partkey").alias("ord"), F.max("p_name").alias("text"))
    both = merges.keyed_overlay(old, new)
    return both.select("page", "section", "text", F.row_number().over(Window.partitionBy("page").orderBy("place")).cast("long").alias("place"))
