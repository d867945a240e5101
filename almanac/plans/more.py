"""Further operators on the star-schema tables: set operations, filters, wiki relations, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import scalars as S
from almanac.operators import joins, merges, wiki
from almanac.plans import ask
from almanac.plans.registry import query, shared_dir, table
from almanac.sources import files
from almanac.streaming import state


@query(
    """
    SELECT DISTINCT category, en FROM (
      SELECT 'clubs' AS category, s_name AS en FROM supplier UNION ALL SELECT 'clubs', c_name FROM customer
      UNION ALL SELECT 'names', p_name FROM part UNION ALL SELECT 'names', n_name FROM nation)
    WHERE NOT (category = 'names' AND en IN (SELECT p_name FROM part WHERE p_brand = 'Brand#3' AND p_size < 9))"""
)
def dictionary_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New words of several columns, without those that the dictionary has."""
    said = lambda t, c, category: table(spark, sf_dir, t).select(F.lit(category).alias("category"), F.col(c).alias("en"))
    seen = merges.distinct_rows(said("supplier", "s_name", "clubs"), said("customer", "c_name", "clubs"), said("part", "p_name", "names"), said("nation", "n_name", "names"))
    have = table(spark, sf_dir, "part").filter("p_brand = 'Brand#3' AND p_size < 9").select(F.lit("names").alias("category"), F.col("p_name").alias("en"))
    return joins.unknown(seen, have, ["category", "en"])


@query(
    """
    WITH a AS (SELECT DISTINCT p_name AS en, 'W' || length(p_name) AS he FROM part WHERE p_size = 7 AND p_type = 'SMALL'),
    b AS (SELECT DISTINCT p_name AS en, 'L' || length(p_name) AS he FROM part WHERE p_size = 8)
    SELECT k.en, coalesce(a.he, b.he) AS he, CASE WHEN a.he IS NOT NULL THEN 'wikidata' WHEN b.he IS NOT NULL THEN 'auto-llm' END AS src
    FROM (SELECT DISTINCT p_name AS en FROM part) k LEFT JOIN a USING (en) LEFT JOIN b USING (en)"""
)
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key from the first backend that has it."""
    part = table(spark, sf_dir, "part").select("p_size", "p_type", F.col("p_name").alias("en"))
    made = lambda test, letter: part.filter(test).select("en", F.concat(F.lit(letter), F.length("en").cast("string")).alias("he")).distinct()
    return joins.fallback_chain(part, [("wikidata", made("p_size = 7 AND p_type = 'SMALL'", "W")), ("auto-llm", made("p_size = 8", "L"))])


@query(
    """
    WITH l AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS name FROM orders),
    r AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, o_orderkey AS value FROM orders WHERE o_orderstatus <> 'P'),
    z AS (SELECT l.k, l.name, r.value, row_number() OVER (PARTITION BY l.k, l.name ORDER BY l.i DESC) AS q FROM l JOIN r ON l.k = r.k AND l.i = r.i)
    SELECT k, name, value FROM z WHERE q = 1"""
)
def zip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uneven lists paired by place, the last of equal names kept."""
    orders = table(spark, sf_dir, "orders")
    pick = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    rows = orders.groupBy(F.col("o_custkey").alias("k")).agg(pick(["o_orderkey"], "o_orderpriority").alias("names"), F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") != "P", F.struct("o_totalprice", "o_orderkey")))), lambda x: x["o_orderkey"]).alias("keys"))
    return joins.zip_lists(rows, ["k"], "names", "keys")


@query(
    """
    SELECT step, action, count(*)::BIGINT AS n FROM (
      SELECT o_orderstatus AS step, CASE WHEN o_totalprice > 300000 THEN 'created' WHEN o_totalprice > 100000 THEN 'updated' ELSE 'skipped' END AS action FROM orders)
    GROUP BY ROLLUP (step, action)"""
)
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of actions per step with totals."""
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("step"), F.when(price > 300000, "created").when(price > 100000, "updated").otherwise("skipped").alias("action"))
    return files.counters(rows)


@query(
    """
    SELECT c_custkey AS page_id, c_nationkey::BIGINT AS page_namespace, c_name AS page_title FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE c_nationkey = 7 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"""
)
def authored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined to their first revision by an actor."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").cast("long").alias("page_namespace"), F.col("c_name").alias("page_title"))
    first = F.col("o_orderstatus") == "F"
    revisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rev_page"), F.when(first, 0).otherwise(1).alias("rev_parent_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rev_actor"))
    return wiki.authored_pages(pages, revisions, 1, 7)


@query("SELECT count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '3-MEDIUM'")
def joined_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of an agent's events, counted over a join."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("event_agent_id"))
    return wiki.notifications_of(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notification_event")), events, 3)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def delete_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a joined delete leaves."""
    doomed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.delete_joined(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), doomed, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_nationkey <> 3")
def hidden_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate added to a query for readers without rights (P20)."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, wiki.DRAFT).otherwise(F.col("c_nationkey")).cast("long").alias("c_nationkey"))
    return wiki.hide_drafts(rows, "c_nationkey", may_read=False)


@query("SELECT DISTINCT o_custkey AS ug_user FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def users_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of some groups."""
    return wiki.users_in_groups(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ug_user"), F.col("o_orderpriority").alias("ug_group")), ("1-URGENT", "2-HIGH"))


@query("SELECT DISTINCT p_name AS value FROM part WHERE starts_with(lower(p_name), 're') ORDER BY 1 LIMIT 10")
def prefix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by prefix, ten at most."""
    return ask.suggest(table(spark, sf_dir, "part"), "p_name", "RE")


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'r#00000001') OR contains(cast(s_suppkey AS VARCHAR), '7')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment in one of several columns, or another in a second."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return ask.search(rows, "R#00000001", "s_name").union(ask.search(rows, "7", "s_suppkey")).distinct()


@query(
    """
    SELECT o_custkey, o_orderkey FROM orders WHERE year(o_orderdate) = 1999 AND o_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998)
    AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)"""
)
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key one set has and another lacks."""
    orders = table(spark, sf_dir, "orders")
    year = lambda y: orders.filter(f"o_orderdate >= TIMESTAMP_NTZ '{y}-01-01' AND o_orderdate < TIMESTAMP_NTZ '{y + 1}-01-01'")  # noqa: E731  a range reaches the scan
    of = lambda y: year(y).select("o_custkey")
    return joins.unknown(joins.known(year(1999).select("o_custkey", "o_orderkey"), of(1998), ["o_custkey"]), of(1997), ["o_custkey"]).select("o_custkey", "o_orderkey")


@query(
    """
    SELECT good, count(*)::BIGINT AS n FROM (
      SELECT trim(CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END) <> '' AND p_partkey % 11 <> 0 AS good FROM part) GROUP BY good"""
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without their required columns."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey")).alias("id"))
    good, bad = files.split_valid(rows, ["name", "id"])
    return good.agg(F.lit(True).alias("good"), F.count("*").alias("n")).unionByName(bad.agg(F.lit(False).alias("good"), F.count("*").alias("n")))


@query(
    """
    WITH c AS (SELECT s_suppkey AS en, p_partkey AS qid, p_partkey % 2 AS variant, p_partkey % 13 AS place FROM supplier JOIN part ON p_partkey % 100 = s_suppkey),
    f AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'S' || p_partkey ELSE 'L' || p_partkey END AS he FROM part WHERE p_partkey % 4 <> 0),
    v AS (SELECT en, variant, qid, he, row_number() OVER (PARTITION BY en, variant ORDER BY place, qid) AS r FROM c JOIN f USING (qid)),
    w AS (SELECT en, he, qid, row_number() OVER (PARTITION BY en ORDER BY variant) AS r FROM v WHERE r = 1 AND he IS NOT NULL)
    SELECT en, he, qid FROM w WHERE r = 1"""
)
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fitting candidate decides a search, even without a label."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    candidates = part.join(table(spark, sf_dir, "supplier"), k % 100 == F.col("s_suppkey")).select(F.col("s_suppkey").alias("en"), (k % 2).alias("variant"), (k % 13).alias("place"), k.alias("qid"))
    entities = part.select(
        k.alias("qid"), F.when(k % 4 == 0, F.array(F.lit("Q1"))).otherwise(F.array(F.lit("Q1"), F.lit("Q11410"))).alias("classes"), F.array().cast("array<string>").alias("sports"), F.lit("").alias("description"),
        F.when((k % 5 != 0) & (k % 3 == 0), F.concat(F.lit("S"), k.cast("string"))).alias("sitelink"), F.when(k % 5 != 0, F.concat(F.lit("L"), k.cast("string"))).alias("label"),
    )
    return wiki.resolve(candidates, entities, "club")


@query("SELECT page_id, md5(trim(url)) AS url_md5, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END::BIGINT AS secure FROM pages")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of pages by expression."""
    return table(spark, sf_dir, "pages").select("page_id", S.content_hash("url").alias("url_md5"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.col("url").startswith("https").cast("long").alias("secure"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows kept by a stream with a watermark, run to its end (an extension).

    Each batch tells the windows that it changed, which replace those kept; windows behind the
    watermark leave the stream's state.
    """
    name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/{{events.parquet}}")
    daily = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    told = daily.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 2).alias("total"))
    state.stream_merge(told, f"{name}/out", f"{name}/log", ["event_type", "day"], ["_batch"], mode="update")
    return state.read_state(spark, f"{name}/out").drop("_batch")
