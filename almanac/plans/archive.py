"""The archive's derived tables, state, scalars and page extractors on the star-schema tables, with SQL.

Each query shapes a table into the archive's own columns and calls the library function; none
repeats its rule.  Suppliers and customers stand in for players, orders for matches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import constants as C
from almanac.functions import scalars as S
from almanac.functions import sections
from almanac.operators import joins, merges, ordered, wiki
from almanac.plans import ask, marts
from almanac.plans.registry import query, shared_dir, table
from almanac.sources import files, pages
from almanac.streaming import state, windows


def _s(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _year(column: str) -> Column:
    return _s(F.year(column))


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(_s(k).alias("id"), F.col("s_name").alias("name_english"), F.when(k % 3 == 0, F.concat(F.lit("ש"), _s(k))).when(k % 3 == 1, "").alias("name_hebrew"), F.element_at(F.array(*(F.lit(x) for x in ("Goalkeeper", "Left-Back", "Striker", "Mascot"))), (k % 4 + 1).cast("int")).alias("main_position"))


PLAYERS = "p AS (SELECT cast(s_suppkey AS VARCHAR) AS id, s_name AS name_english, CASE s_suppkey % 3 WHEN 0 THEN 'ש' || s_suppkey WHEN 1 THEN '' END AS name_hebrew, ['Goalkeeper', 'Left-Back', 'Striker', 'Mascot'][s_suppkey % 4 + 1] AS main_position FROM supplier)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier, year and line number, with some measures absent."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(_s("l_suppkey").alias("player_id"), _year("l_shipdate").alias("season")).agg(F.count("*").alias("appearances"), F.count_if(F.col("l_returnflag") == "R").alias("goals"), F.when(F.count_if(F.col("l_returnflag") == "A") > 1, F.count_if(F.col("l_returnflag") == "A")).alias("assists"), F.sum("l_linenumber").alias("yellow_cards"))
    return marts.stats(sums)


STATS = """s AS (SELECT cast(l_suppkey AS VARCHAR) AS player_id, cast(year(l_shipdate) AS VARCHAR) AS season, count(*) AS appearances, count(*) FILTER (WHERE l_returnflag = 'R') AS goals,
    CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 1 THEN count(*) FILTER (WHERE l_returnflag = 'A') ELSE 0 END AS assists, sum(l_linenumber) AS yellow_cards, 0 AS red_cards FROM lineitem GROUP BY ALL)"""
NAMED = "coalesce(nullif(name_hebrew, ''), name_english)"


# --- answers ------------------------------------------------------------------------------


@query(f"WITH {STATS} SELECT sum(appearances)::BIGINT AS appearances, sum(goals)::BIGINT AS goals, sum(assists)::BIGINT AS assists, sum(yellow_cards)::BIGINT AS yellow_cards, sum(red_cards)::BIGINT AS red_cards FROM s WHERE season = '1997'")
def mart_season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of one season."""
    return marts.season_totals(_stats(spark, sf_dir), "1997")


@query(
    f"""WITH {PLAYERS}, {STATS},
    t AS (SELECT row_number() OVER (ORDER BY goals DESC, player_id) AS rank, player_id, goals FROM s WHERE season = '1997')
    SELECT rank::BIGINT AS rank, player_id, coalesce({NAMED}, player_id) AS name, goals::BIGINT AS goals FROM t LEFT JOIN p ON id = player_id WHERE rank <= 10 AND goals > 0"""
)
def mart_season_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of a season, then those above zero."""
    return marts.season_top(_stats(spark, sf_dir), _players(spark, sf_dir), "1997", "goals").withColumn("goals", F.col("goals").cast("long"))


@query(
    f"""WITH {PLAYERS}, {STATS}, t AS (SELECT player_id, sum(appearances) AS appearances, sum(goals) AS goals, sum(assists) AS assists FROM s GROUP BY player_id HAVING sum(goals) > 0)
    SELECT row_number() OVER (ORDER BY goals DESC, player_id)::BIGINT AS rank, player_id, coalesce({NAMED}, player_id) AS name, appearances::BIGINT AS appearances, goals::BIGINT AS goals, assists::BIGINT AS assists
    FROM (SELECT * FROM t ORDER BY goals DESC, player_id LIMIT 50) LEFT JOIN p ON id = player_id"""
)
def mart_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time sums, the top fifty above zero, named."""
    return marts.leaderboard(_stats(spark, sf_dir), _players(spark, sf_dir), "goals").select("rank", "player_id", "name", "appearances", "goals", "assists")


@query(
    """WITH f AS (SELECT cast(year(o_orderdate) AS VARCHAR) AS season, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '-' ELSE replace(cast(o_custkey * 1000 + o_orderkey % 1000 AS VARCHAR), '5', '.5') END AS attendance FROM orders),
    n AS (SELECT season, try_cast(regexp_replace(attendance, '[^0-9]', '', 'g') AS BIGINT) AS a FROM f)
    SELECT season, count(*)::BIGINT AS matches, sum(a)::BIGINT AS total, (sum(a) // count(*))::BIGINT AS average, max(a) AS most, min(a) AS least FROM n WHERE a IS NOT NULL GROUP BY season"""
)
def mart_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendance by season, unreadable ones left out (Q5, A3, F16)."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, None).when(k % 5 == 1, "-").otherwise(F.replace(_s(F.col("o_custkey") * 1000 + k % 1000), F.lit("5"), F.lit(".5")))
    return marts.attendance(table(spark, sf_dir, "orders").select(_year("o_orderdate").alias("season"), text.alias("attendance")))


def _competition() -> Column:
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", " UEFA Cup ").when(p == "2-HIGH", "Europa League").when(p == "3-MEDIUM", "Intertoto Cup").when(p == "5-LOW", "Unknown").otherwise("League")


COMPETITION = "CASE o_orderpriority WHEN '1-URGENT' THEN ' UEFA Cup ' WHEN '2-HIGH' THEN 'Europa League' WHEN '3-MEDIUM' THEN 'Intertoto Cup' WHEN '5-LOW' THEN 'Unknown' ELSE 'League' END"


@query(
    f"""WITH f AS (SELECT trim({COMPETITION}) AS competition, cast(year(o_orderdate) AS VARCHAR) AS season FROM orders),
    e AS (SELECT * FROM f WHERE competition IN ('UEFA Cup', 'Europa League', 'Intertoto Cup')),
    per AS (SELECT competition, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, competition) AS place FROM e GROUP BY competition)
    SELECT e.competition, season, count(*)::BIGINT AS n, count(DISTINCT season)::BIGINT AS n_seasons, CASE WHEN e.competition IS NOT NULL THEN max(place) END::BIGINT AS place
    FROM e JOIN per USING (competition) GROUP BY GROUPING SETS ((e.competition, season), (e.competition), ())"""
)
def mart_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European campaigns at three levels, competitions in order of their matches."""
    out = marts.ranked_campaigns(table(spark, sf_dir, "orders").select(_competition().alias("competition"), _year("o_orderdate").alias("season")))
    return out.withColumn("place", F.col("place").cast("long"))


OPPONENT = "CASE s_suppkey WHEN 1 THEN 'M. Tel Aviv' WHEN 2 THEN 'Maccabi Tel Aviv' WHEN 3 THEN 'H. Tel Aviv' WHEN 4 THEN 'Beitar Jerusalem' ELSE s_name END"


@query(
    f"""WITH h AS (SELECT {OPPONENT} AS opponent, s_nationkey AS played, s_nationkey // 3 AS wins, cast(s_suppkey AS VARCHAR) AS opponent_tm_id FROM supplier),
    a AS (SELECT * FROM (VALUES ('מכבי תל אביב', 'Maccabi Tel Aviv', 0), ('מכבי תל אביב', 'M. Tel Aviv', 1), ('הפועל תל אביב', 'Hapoel Tel Aviv', 0), ('הפועל תל אביב', 'H. Tel Aviv', 1),
                                  ('בית"ר ירושלים', 'Beitar Jerusalem', 0), ('בית"ר ירושלים', 'B. Jerusalem', 1), ('מכבי חיפה', 'Maccabi Haifa', 0), ('מכבי חיפה', 'M. Haifa', 1)) AS t(name, opponent, i)),
    best AS (SELECT name, arg_min(opponent_tm_id, i) AS id FROM a JOIN h USING (opponent) GROUP BY name),
    r AS (SELECT n.name, h.* FROM (SELECT DISTINCT name FROM a) n LEFT JOIN best USING (name) LEFT JOIN h ON opponent_tm_id = id),
    o AS (SELECT opponent AS name, *, row_number() OVER (ORDER BY played DESC, opponent) AS rank FROM h WHERE opponent NOT IN (SELECT opponent FROM a))
    SELECT name, opponent_tm_id, played::BIGINT AS played, wins * 100.0 / nullif(played, 0) AS win_pct, NULL::BIGINT AS rank FROM r
    UNION ALL SELECT name, opponent_tm_id, played::BIGINT, wins * 100.0 / nullif(played, 0), rank::BIGINT FROM o"""
)
def mart_derbies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivals by their first known name, all others ranked."""
    k = F.col("s_suppkey")
    name = F.when(k == 1, "M. Tel Aviv").when(k == 2, "Maccabi Tel Aviv").when(k == 3, "H. Tel Aviv").when(k == 4, "Beitar Jerusalem").otherwise(F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select(name.alias("opponent"), F.col("s_nationkey").alias("played"), F.expr("s_nationkey div 3").alias("wins"), _s(k).alias("opponent_tm_id"))
    rivals, others = marts.derbies(rows)
    told = lambda df, name, rank: df.select(F.col(name).alias("name"), "opponent_tm_id", F.col("played").cast("long").alias("played"), "win_pct", rank.cast("long").alias("rank"))
    return told(rivals, "display", F.lit(None)).unionByName(told(others, "opponent", F.col("rank")))


RESULT = "(o_orderkey % 4) || ':' || (o_custkey % 3)"
OUTCOME = "CASE WHEN o_orderkey % 4 = o_custkey % 3 THEN 'draw' WHEN (o_orderkey % 2 = 1) = (o_orderkey % 4 < o_custkey % 3) THEN 'win' ELSE 'loss' END"
TITLE = f"translate(strftime(o_orderdate, '%d/%m/%Y') || ' נגד Club ' || o_custkey || ' (' || {COMPETITION} || ')', '[]', '()')"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        _year("o_orderdate").alias("season"), k.alias("ord"), _competition().alias("competition"), _iso("o_orderdate").alias("date"), F.concat(F.lit("Club "), _s(c)).alias("opponent"),
        F.when(k % 2 == 1, "A").otherwise("H").alias("venue"), F.concat(_s(k % 4), F.lit(":"), _s(c % 3)).alias("result"),
    )


@query(
    f"""SELECT cast(year(o_orderdate) AS VARCHAR) AS season, {COMPETITION} AS competition, count(*)::BIGINT AS n,
           md5(string_agg(o_orderkey || '|' || {OUTCOME} || '|' || {TITLE}, ',' ORDER BY o_orderkey)) AS rows_md5
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL"""
)
def mart_competition_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a season's competitions as lists in order."""
    told = F.array_join(F.transform("rows", lambda x: F.concat_ws("|", _s(x["ord"]), x["outcome"], x["title"])), ",")
    return marts.competition_pages(_matches(spark, sf_dir)).select("season", "competition", "n", F.md5(told.cast("binary")).alias("rows_md5"))


@query(f"SELECT o_orderkey AS ord, {OUTCOME} AS outcome, {TITLE} AS title, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def mart_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with title and outcome."""
    return marts.match_rows(_matches(spark, sf_dir)).select("ord", "outcome", "title", "day")


@query(
    """WITH t AS (SELECT 'm' || (o_custkey % 50) AS id, CASE WHEN o_custkey % 50 = 7 THEN ' ' ELSE 'Coach ' || (o_custkey % 50) END AS name, year(o_orderdate) AS y,
                  count(*) FILTER (WHERE o_orderstatus = 'F') AS w, count(*) FILTER (WHERE o_orderstatus = 'O') AS d, count(*) FILTER (WHERE o_orderstatus = 'P') AS l FROM orders GROUP BY ALL),
    prizes AS (SELECT DISTINCT 'Prize ' || (n_nationkey % 4) AS c, unnest([1995 + n_nationkey % 6, 1996 + n_nationkey % 5]) AS y FROM nation),
    past AS (SELECT id, min(name) AS name, sum(w + d + l) AS played, sum(w) AS wins, string_agg(DISTINCT cast(t.y AS VARCHAR), ',' ORDER BY cast(t.y AS VARCHAR)) AS seasons FROM t WHERE name <> ' ' GROUP BY id),
    won AS (SELECT id, string_agg(DISTINCT c || ' ' || y || '/' || lpad(cast((y + 1) % 100 AS VARCHAR), 2, '0'), ',' ORDER BY c || ' ' || y || '/' || lpad(cast((y + 1) % 100 AS VARCHAR), 2, '0')) AS trophies FROM t JOIN prizes USING (y) WHERE name <> ' ' GROUP BY id),
    staff AS (SELECT 'm' || (n_nationkey * 4) AS id, 'Staff ' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Manager' ELSE '' END AS role FROM nation)
    SELECT coalesce(p.id, f.id) AS id, coalesce(p.name, CASE WHEN p.id IS NULL THEN f.name END) AS name, CASE WHEN p.id IS NULL THEN f.role ELSE nullif(f.role, '') END AS role, played::BIGINT AS played, wins::BIGINT AS wins, coalesce(seasons, '') AS seasons, coalesce(trophies, '') AS trophies
    FROM past p LEFT JOIN won USING (id) FULL JOIN staff f ON f.id = p.id"""
)
def mart_coaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coaches with totals, tenures and trophies, today's staff laid over them."""
    coach, status = _s(F.col("o_custkey") % 50), lambda s: _s(F.count_if(F.col("o_orderstatus") == s))
    name = F.when(F.col("o_custkey") % 50 == 7, " ").otherwise(F.concat(F.lit("Coach "), coach))
    standings = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("m"), coach).alias("manager_id"), name.alias("manager_name"), _year("o_orderdate").alias("season")).agg(status("F").alias("wins"), status("O").alias("draws"), status("P").alias("losses"))
    k, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    honours = nation.select(F.concat(F.lit("Prize "), _s(k % 4)).alias("competition"), F.array(S.season_display(1995 + k % 6), S.season_display(1996 + k % 5)).alias("seasons"))
    empty = F.lit(None).cast("string")
    staff = nation.select(F.concat(F.lit("m"), _s(k * 4)).alias("id"), F.concat(F.lit("Staff "), _s(k)).alias("name"), F.when(k % 2 == 0, "Manager").otherwise("").alias("role"), *(empty.alias(c) for c in ("tenure_start", "tenure_end", "ppm")))
    out = marts.coaches(standings, honours, staff)
    return out.select("id", "name", "role", F.col("played").cast("long").alias("played"), F.col("wins").cast("long").alias("wins"), F.array_join("tenure_seasons", ",").alias("seasons"), F.array_join("trophies", ",").alias("trophies"))


@query("SELECT p_type AS category, count(*)::BIGINT AS n, md5(string_agg(p_name || p_partkey, ',' ORDER BY p_partkey)) AS rows_md5 FROM part GROUP BY p_type")
def mart_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a category in their order."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("player_name"), _s("p_partkey").alias("player_id"), _s("p_size").alias("value"))
    told = F.array_join(F.transform("rows", lambda x: F.concat(x["player_name"], x["player_id"])), ",")
    return marts.grouped_records(rows).select("category", F.size("rows").cast("long").alias("n"), F.md5(told.cast("binary")).alias("rows_md5"))


@query(
    """SELECT r_regionkey::BIGINT AS ord, r_name AS competition, 'Winner' AS achievement, string_agg(n_name, ', ' ORDER BY n_nationkey) AS seasons, count(*)::BIGINT AS n
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL
    UNION ALL SELECT -1, 'Stadium', s_name, cast(s_nationkey AS VARCHAR), 1 FROM supplier WHERE s_suppkey = 0"""
)
def mart_honours_and_stadium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The honours list, and the stadium's first row."""
    lists = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("seasons"))
    honours = table(spark, sf_dir, "region").join(lists, "r_regionkey").select(F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("competition"), F.lit("Winner").alias("achievement"), "seasons")
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), _s("s_nationkey").alias("capacity"))
    stadium = marts.stadium_row(places).select(F.lit(-1).cast("long").alias("ord"), F.lit("Stadium").alias("competition"), F.col("title").alias("achievement"), F.col("capacity").alias("seasons"), F.lit(1).alias("n"))
    return marts.honours_list(honours).unionByName(stadium).withColumn("n", F.col("n").cast("long"))


@query(
    f"""WITH {PLAYERS}, {STATS},
    t AS (SELECT row_number() OVER (ORDER BY goals DESC, player_id) AS rank, player_id, goals FROM s WHERE season = '1997'),
    f AS (SELECT {COMPETITION} AS c, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
    SELECT '1997' AS season, '1997/98' AS display, (SELECT sum(goals) FROM s WHERE season = '1997')::BIGINT AS goals,
           (SELECT string_agg(coalesce({NAMED}, player_id), ',' ORDER BY rank) FROM t LEFT JOIN p ON id = player_id WHERE rank <= 10 AND goals > 0) AS scorers,
           (SELECT string_agg(c || ':' || n, ',' ORDER BY c) FROM f) AS fixtures, 'squad' AS missing, 3::BIGINT AS points"""
)
def mart_season_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's page: totals, best, standing, fixtures, and what is missing."""
    standings = spark.range(1, 5).select(F.lit("1997").alias("season"), _s("id").alias("competition"), (F.col("id") + 2).alias("points"))
    squad = table(spark, sf_dir, "supplier").select(F.lit("1901").alias("season"))
    row = marts.season_overview(_stats(spark, sf_dir), _players(spark, sf_dir), _matches(spark, sf_dir).select("season", "competition"), standings, squad, "1997")
    listed = F.array_join(F.transform("fixtures", lambda x: F.concat_ws(":", x["competition"], _s(x["n"]))), ",")
    return row.select("season", "display", F.col("goals").cast("long").alias("goals"), F.array_join(F.transform("top_goals", lambda x: x["name"]), ",").alias("scorers"), listed.alias("fixtures"), F.array_join("missing", ",").alias("missing"), F.col("standing.points").alias("points"))


@query(
    f"""WITH {PLAYERS}, {STATS}
    SELECT id, CASE main_position WHEN 'Goalkeeper' THEN 'GK' WHEN 'Left-Back' THEN 'DF' WHEN 'Striker' THEN 'FW' ELSE 'OTHER' END AS line, appearances::BIGINT AS appearances, goals::BIGINT AS goals
    FROM p LEFT JOIN s ON player_id = id AND season = '1997' WHERE cast(id AS INT) % 5 <> 0"""
)
def mart_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's players by line with their statistics."""
    active = F.when(F.col("id").cast("int") % 5 != 0, F.array(F.lit("1996"), F.lit("1997"))).otherwise(F.array(F.lit("1996")))
    out = marts.squad(_players(spark, sf_dir).withColumn("seasons_active", active), _stats(spark, sf_dir), "1997")
    return out.select("id", "line", F.col("stats.appearances").cast("long").alias("appearances"), F.col("stats.goals").cast("long").alias("goals"))


@query(
    f"""WITH {PLAYERS}, t AS (SELECT o_orderkey, cast(o_custkey % 40 AS VARCHAR) AS player_id, CASE WHEN o_orderkey % 2 = 0 THEN cast(year(o_orderdate) AS VARCHAR) ELSE right(cast(year(o_orderdate) AS VARCHAR), 2) || '/xx' END AS season,
              year(o_orderdate) AS y, o_orderkey % 3 AS k FROM orders)
    SELECT o_orderkey, player_id, CASE k WHEN 0 THEN 'in' WHEN 1 THEN 'out' END AS direction, coalesce({NAMED}, player_id) AS player_name FROM t LEFT JOIN p ON id = player_id WHERE y = 1997 AND k < 2"""
)
def mart_transfer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's transfers in and out, named."""
    k = F.col("o_orderkey")
    season = F.when(k % 2 == 0, _year("o_orderdate")).otherwise(F.concat(F.right(_year("o_orderdate"), F.lit(2)), F.lit("/xx")))
    rows = table(spark, sf_dir, "orders").select(
        k, _s(F.col("o_custkey") % 40).alias("player_id"), season.alias("season"),
        F.when(k % 3 == 1, "H. Beer Sheva").otherwise("Some FC").alias("from_club"), F.when(k % 3 == 0, "Hapoel Beer Sheva").otherwise("Other FC").alias("to_club"),
    )
    return marts.transfer_page(rows, _players(spark, sf_dir), "1997").select("o_orderkey", "player_id", "direction", "player_name")


@query(
    """WITH m AS (SELECT cast(o_custkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Club U19' ELSE 'Club' END AS f, o_orderstatus AS st FROM orders)
    SELECT cast(c_custkey AS VARCHAR) AS id, count(o_orderkey) FILTER (WHERE f = 'Club U19')::BIGINT AS n_youth, count(o_orderkey) FILTER (WHERE f = 'Club')::BIGINT AS n_senior,
           arg_min(strftime(cast(d AS DATE), '%d/%m/%Y'), d) FILTER (WHERE f = 'Club') AS first_senior, count(DISTINCT left(d, 4))::BIGINT AS n_stats, count(o_orderkey)::BIGINT AS appearances,
           coalesce(string_agg(o_orderkey, ',' ORDER BY d, o_orderkey) FILTER (WHERE st = 'P'), '') AS "values"
    FROM customer LEFT JOIN m ON id = cast(c_custkey AS VARCHAR) GROUP BY c_custkey"""
)
def mart_player_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with transfers split by youth, statistics with a total, and values."""
    orders = table(spark, sf_dir, "orders")
    player, day = _s("o_custkey").alias("player_id"), _iso("o_orderdate")
    moves = orders.select(player, day.alias("transfer_date"), _year("o_orderdate").alias("season"), F.when(F.col("o_orderkey") % 5 == 0, "Club U19").otherwise("Club").alias("from_club"), F.lit("Other").alias("to_club"), F.lit("loan transfer").alias("fee"), F.lit(True).alias("loan"))
    stats = marts.stats(orders.groupBy(player, _year("o_orderdate").alias("season")).agg(F.count("*").alias("appearances")))
    values = orders.filter("o_orderstatus = 'P'").select(player, F.concat(day, F.lpad(_s("o_orderkey"), 12, "0")).alias("value_date"), _s("o_orderkey").alias("value"), F.lit("T").alias("team"))
    out = marts.player_pages(table(spark, sf_dir, "customer").select(_s("c_custkey").alias("id")), moves, stats, values)
    return out.select(
        "id", F.size("youth_transfers").cast("long").alias("n_youth"), F.size("senior_transfers").cast("long").alias("n_senior"), F.get("senior_transfers", F.lit(0))["day"].alias("first_senior"),
        F.size("stats").cast("long").alias("n_stats"), F.col("total.appearances").cast("long").alias("appearances"), F.array_join(F.transform("values", lambda x: x["value"]), ",").alias("values"),
    )


@query(
    """WITH r AS (SELECT cast(o_custkey AS VARCHAR) AS id, cast(year(o_orderdate) AS VARCHAR) AS season, o_orderkey AS ord, 'N' || o_orderkey AS name_english, o_orderkey % 2 = 0 AS sq, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END AS num,
           CASE WHEN o_orderkey % 4 > 0 THEN 'P' || o_orderkey ELSE '' END AS place, o_orderkey % 11 = 0 AS hg FROM orders),
    o AS (SELECT id, array_agg(name_english ORDER BY season, ord)[1] AS name_english, array_agg(sq ORDER BY season, ord)[-1] AS current_squad, array_agg(num ORDER BY season, ord)[-1] AS num,
                 array_agg(place ORDER BY season, ord) FILTER (WHERE place <> '')[-1] AS good, array_agg(place ORDER BY season, ord)[1] AS first, bool_or(hg) AS homegrown, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons FROM r GROUP BY id)
    SELECT id, name_english, current_squad, num::BIGINT AS current_jersey_number, coalesce(good, first) AS birth_place, homegrown, false AS retired, seasons FROM o"""
)
def mart_merged_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of players merged by the archive's own rule."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        _s("o_custkey").alias("id"), _year("o_orderdate").alias("season"), k.alias("ord"), F.concat(F.lit("N"), _s(k)).alias("name_english"), (k % 2 == 0).alias("current_squad"), F.when(k % 3 > 0, k % 100).alias("current_jersey_number"),
        F.when(k % 4 > 0, F.concat(F.lit("P"), _s(k))).otherwise("").alias("birth_place"), (k % 11 == 0).alias("homegrown"), F.lit(False).alias("retired"),
    )
    return marts.merged_players(rows).withColumn("seasons", F.array_join("seasons_active", ",")).drop("seasons_active")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as raw players, before any rule."""
    k = F.col("s_suppkey")
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    facts = {"Name in home country": F.when(k % 2 == 0, "אב גד").otherwise("Latin"), "Date of birth/Age": F.concat(F.lit("Jan "), _s(k % 28 + 1), F.lit(", 1999 (25)")), "Foot": F.when(k % 3 == 0, "Right").otherwise("?"), "Height": F.concat(F.lit("1,"), _s(k % 10 + 70), F.lit(" m")), "Contract expires": F.lit("")}
    move = lambda season, day, a, b, fee: F.struct(F.lit(season).alias("season"), F.lit(day).alias("date"), text(a).alias("from"), text(b).alias("to"), F.lit(fee).alias("fee"))
    value = lambda day, v: F.struct(F.lit(day).alias("date"), v.alias("value"), F.lit("T").alias("team"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name_english"), F.concat(F.lit("/x/profil/spieler/"), _s(k)).alias("profile_url"), F.when(k % 4 == 0, "-").otherwise(_s(k % 99)).alias("number"), (k % 5 == 0).alias("loaned"), F.lit(False).alias("is_captain"),
        F.create_map(*(x for n, v in facts.items() for x in (F.lit(n), v))).alias("facts"), F.struct(F.lit("Striker").alias("main"), F.array(F.lit("Left-Back"), F.lit("")).alias("other")).alias("positions"),
        F.array(value("2019-01-01", F.lit("€1m")), value("2020-01-01", F.concat(F.lit("€"), _s(k), F.lit("k")))).alias("market_value_history"),
        F.array(move("24/25", "2024-01-01", F.when(k % 3 == 0, "H. B. Sheva U19").otherwise("FC"), "Hapoel Beer Sheva", "Loan transfer"), move("25/26", "2025-01-01", "Hapoel Beer Sheva", F.when(k % 7 == 0, "Retired").otherwise("FC"), "?")).alias("transfers"),
    )


@query(
    """SELECT cast(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'אב גד' END AS name_hebrew, '1999-01-' || lpad(cast(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS born, s_suppkey % 5 <> 0 AS current_squad,
           CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 99 END::BIGINT AS number, s_suppkey % 3 = 0 AS homegrown, s_suppkey % 7 = 0 AS retired, CASE WHEN s_suppkey % 3 = 0 THEN 'right' END AS foot, (170 + s_suppkey % 10)::BIGINT AS height,
           '€' || s_suppkey || 'k' AS worth, 'Left-Back' AS other FROM supplier"""
)
def mart_raw_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw players in typed columns."""
    out = marts.players(_raw(spark, sf_dir))
    return out.select("id", "name_hebrew", _s("birth_date").alias("born"), "current_squad", F.col("current_jersey_number").cast("long").alias("number"), "homegrown", "retired", F.col("preferred_foot").alias("foot"), F.col("height_cm").cast("long").alias("height"), F.col("current_market_value").alias("worth"), F.array_join("other_positions", ",").alias("other"))


@query(
    """SELECT cast(s_suppkey AS VARCHAR) AS player_id, season, fee, cast(loan AS VARCHAR) AS loan, NULL AS value FROM supplier, (VALUES ('24/25', 'Loan transfer', true), ('25/26', '?', false)) AS t(season, fee, loan)
    UNION ALL SELECT cast(s_suppkey AS VARCHAR), day, NULL, NULL, CASE day WHEN '2019-01-01' THEN '€1m' ELSE '€' || s_suppkey || 'k' END FROM supplier, (VALUES ('2019-01-01'), ('2020-01-01')) AS t(day)"""
)
def mart_raw_moves_and_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested transfers and market values as rows."""
    raw = _raw(spark, sf_dir)
    moves = marts.transfers(raw).select("player_id", "season", "fee", _s("loan").alias("loan"), F.lit(None).cast("string").alias("value"))
    return moves.unionByName(marts.market_values(raw).select("player_id", F.col("value_date").alias("season"), F.lit(None).cast("string").alias("fee"), F.lit(None).cast("string").alias("loan"), "value"))


@query(
    """WITH m AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
    names AS (SELECT 'G' || (c % 50) AS en FROM m UNION SELECT 'A' || (c % 30) FROM m WHERE c % 2 = 0 UNION SELECT 'S' || (c % 20) FROM m UNION SELECT 'C' || (k % 10) FROM m WHERE k % 3 = 0),
    seen AS (SELECT 'names' AS category, en FROM names UNION SELECT 'names', s_name FROM supplier UNION SELECT 'positions', x FROM (VALUES ('Striker'), ('Left-Back')) AS t(x)
             UNION SELECT 'clubs', x FROM (VALUES ('FC'), ('Hapoel Beer Sheva'), ('T'), ('H. B. Sheva U19'), ('Retired')) AS t(x) UNION SELECT 'clubs', 'Club ' || c FROM m
             UNION SELECT 'competitions', trim(x) FROM (SELECT CASE o_orderpriority WHEN '2-HIGH' THEN 'Europa League' ELSE 'League' END AS x FROM orders)),
    have AS (SELECT 'names' AS category, 'G' || n_nationkey AS en, 'ג' AS he FROM nation)
    SELECT category, en, he FROM have UNION ALL SELECT category, en, NULL FROM seen WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.category = seen.category AND h.en = seen.en)"""
)
def mart_dictionary_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New words of all tables and of matches' nested events, none overwritten."""
    raw = _raw(spark, sf_dir)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda mark, of: F.concat(F.lit(mark), _s(of))
    event = lambda **fields: F.array(F.struct(*(v.alias(n) for n, v in fields.items())))
    matches = table(spark, sf_dir, "orders").select(
        event(scorer=name("G", c % 50), assist=F.when(c % 2 == 0, name("A", c % 30))).alias("goals"), event(player_in=name("S", c % 20), player_out=F.lit("")).alias("substitutions"),
        F.when(k % 3 == 0, event(player=name("C", k % 10))).alias("cards"),
    )
    fixtures = table(spark, sf_dir, "orders").select(F.concat(F.lit("Club "), _s(c)).alias("opponent"), F.when(F.col("o_orderpriority") == "2-HIGH", "Europa League").when(F.col("o_orderpriority") == "5-LOW", "Unknown").otherwise("League").alias("competition"))
    blank = F.lit(None).cast("string")
    mapping = table(spark, sf_dir, "nation").select(F.lit("names").alias("category"), name("G", F.col("n_nationkey")).alias("en"), F.lit("ג").alias("he"), *(blank.alias(x) for x in ("src", "confidence", "wikidata_qid", "note")))
    return marts.dictionary_stub(marts.players(raw), marts.transfers(raw), marts.market_values(raw), fixtures, marts.match_names(matches), mapping).select("category", "en", "he")


SPELLED = "translate(" + "".join("replace(" for _ in C.PAIRS_HEBREW) + "lower(en)" + "".join(f", '{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in C.PAIRS_HEBREW.items()) + ", '{}', '{}')".format("".join(k for k, v in C.LETTERS_HEBREW.items() if len(v) == 1), "".join(v for v in C.LETTERS_HEBREW.values() if len(v) == 1))
SPELLED = f"replace(replace({SPELLED}, 'j', 'ג'''), 'x', 'קס')"


@query(
    f"""WITH d AS (SELECT DISTINCT p_name AS en, CASE WHEN length(p_name) % 5 = 0 THEN 'יש' END AS he, CASE WHEN length(p_name) % 10 = 0 THEN 'manual' END AS src FROM part),
    a AS (SELECT DISTINCT p_name AS en FROM part WHERE p_size = 7 AND p_type = 'SMALL'), b AS (SELECT DISTINCT p_name AS en FROM part WHERE p_size = 8 AND p_type = 'PROMO')
    SELECT en, CASE WHEN src IS NOT NULL THEN he WHEN a.en IS NOT NULL THEN 'W' || length(d.en) WHEN b.en IS NOT NULL THEN 'L' || length(d.en) ELSE {SPELLED} END AS he,
           CASE WHEN src IS NOT NULL THEN src WHEN a.en IS NOT NULL THEN 'wikidata' WHEN b.en IS NOT NULL THEN 'auto-llm' ELSE 'auto-translit' END AS src
    FROM d LEFT JOIN a USING (en) LEFT JOIN b USING (en)"""
)
def mart_filled_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty entries filled by backends in turn, the rest spelled out."""
    part = table(spark, sf_dir, "part")
    size = F.length("p_name")
    blank = F.lit(None).cast("string")
    mapping = part.select(F.lit("names").alias("category"), F.col("p_name").alias("en"), F.when(size % 5 == 0, "יש").alias("he"), F.when(size % 10 == 0, "manual").alias("src"), *(blank.alias(x) for x in ("confidence", "wikidata_qid", "note"))).distinct()
    made = lambda test, letter: part.filter(test).select(F.lit("names").alias("category"), F.col("p_name").alias("en"), F.concat(F.lit(letter), _s(size)).alias("he")).distinct()
    return marts.filled_dictionary(mapping, [("wikidata", made("p_size = 7 AND p_type = 'SMALL'", "W")), ("auto-llm", made("p_size = 8 AND p_type = 'PROMO'", "L"))]).select("en", "he", "src")


@query(
    """WITH x AS (SELECT p_type AS category, cast(p_size AS VARCHAR) AS en, ['manual', 'wikidata', 'auto-llm', 'other'][(p_partkey % 4 + 1)::INT] AS src, min(p_name) AS he, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE lpad(cast(p_partkey % 11 AS VARCHAR), 2, '0') END AS cycle,
                  [4, 3, 2, 0][(p_partkey % 4 + 1)::INT] AS rank FROM part GROUP BY ALL)
    SELECT category, en, src, he FROM (SELECT *, row_number() OVER (PARTITION BY category, en ORDER BY rank DESC, cycle) AS r FROM x) WHERE r = 1"""
)
def mart_merged_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of several files by trust in their source, then by the earliest file."""
    k = F.col("p_partkey")
    src = F.element_at(F.array(*(F.lit(x) for x in ("manual", "wikidata", "auto-llm", "other"))), (k % 4).cast("int") + 1)
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"), _s("p_size").alias("en"), src.alias("src"), F.lpad(_s(k % 11), 2, "0").alias("cycle")).agg(F.min("p_name").alias("he"))
    return marts.merged_dictionary(rows.filter("cycle = '00'").select("category", "en", "src", "he"), rows.filter("cycle <> '00'").select("category", "en", "src", "he", "cycle"))


@query("SELECT p_type AS category, count(*)::BIGINT AS n FROM part WHERE p_size % 3 = 0 GROUP BY ROLLUP (p_type)")
def mart_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of low confidence by category with a total."""
    return marts.flagged(table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") % 3 == 0, "low").otherwise("high").alias("confidence")))


@query(
    """SELECT o_orderkey AS k, 'home' AS side, NULL AS position, 'H' || o_custkey AS name, true AS captain FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, 'home', 'gk', 'K' || o_custkey, false FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'home', 'df', 'D' || o_custkey, false FROM orders WHERE o_orderkey % 2 = 1"""
)
def mart_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups of either shape as rows."""
    k, c = F.col("o_orderkey"), _s("o_custkey")
    listed = F.concat(F.lit('[{"name_english":"H'), c, F.lit('","captain":true}]'))
    keyed = F.concat(F.lit('{"gk":"K'), c, F.lit('","df":[{"name_english":"D'), c, F.lit('"}]}'))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.parse_json(F.when(k % 2 == 0, listed).otherwise(keyed)).alias("l"))
    return marts.lineup_entries(rows, ["k"], "l", "home").select("k", "side", "position", "name", "captain")


# --- state and streams --------------------------------------------------------------------


@query(
    """WITH e AS (SELECT cast(c_custkey AS VARCHAR) AS tm_id, 'T' || c_custkey AS t, CASE c_custkey % 3 WHEN 0 THEN 3000 ELSE 0 END AS want_ns, c_custkey AS k FROM customer),
    r AS (SELECT *, k % 4 AS kind FROM e)
    SELECT tm_id, CASE kind WHEN 0 THEN t WHEN 1 THEN 'Draft:Old' || k WHEN 2 THEN CASE want_ns WHEN 3000 THEN 'Draft:' || t ELSE t END ELSE CASE want_ns WHEN 3000 THEN 'Draft:' || t ELSE t END END AS title,
           CASE kind WHEN 0 THEN 'update' WHEN 1 THEN 'update' WHEN 2 THEN 'create' ELSE 'stranded' END AS action, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 3000 ELSE want_ns END::BIGINT AS namespace
    FROM (SELECT * FROM r WHERE kind <> 1) UNION ALL SELECT tm_id, 'Draft:' || t, 'moved', 3000 FROM r WHERE kind = 1"""
)
def state_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each entity's page is written: a page in the main space, a rename, a lost page, a new one."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k)
    entities = rows.select(_s(k).alias("tm_id"), F.concat(F.lit("T"), _s(k)).alias("want_title"), F.when(k % 3 == 0, 3000).otherwise(0).alias("want_namespace"))
    stored = rows.filter(k % 2 == 1).select(_s(k).alias("tm_id"), F.concat(F.lit("Old"), _s(k)).alias("he_title"), F.lit(3000).alias("namespace"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"))
    none = F.lit(None).cast("string")
    there = rows.filter(k % 4 == 0).select(F.concat(F.lit("T"), _s(k)).alias("title"), none.alias("redirect")).unionByName(rows.filter(k % 4 == 1).select(F.concat(F.lit("Draft:Old"), _s(k)).alias("title"), none.alias("redirect")))
    return state.route(entities, stored, there).withColumn("namespace", F.col("namespace").cast("long"))


@query(
    """WITH e AS (SELECT c_custkey AS k, cast(c_custkey AS VARCHAR) AS tm_id FROM customer)
    SELECT tm_id, 'T' || k AS title, CASE k % 4 WHEN 0 THEN 'create' ELSE 'update' END AS route,
           CASE k % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'skip' WHEN 2 THEN 'clean_rewrite' ELSE 'surgical_merge' END AS action FROM e"""
)
def state_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages routed, then created, skipped, rewritten or merged."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k)
    entities = rows.select(_s(k).alias("tm_id"), F.concat(F.lit("T"), _s(k)).alias("want_title"), F.lit(0).alias("want_namespace"), F.concat(F.lit("text "), _s(k)).alias("content"))
    empty = spark.createDataFrame([], "tm_id string, he_title string, namespace int, last_seen timestamp")
    old = F.when(k % 4 == 1, F.concat(F.lit(" text "), _s(k), F.lit("\n"))).otherwise(F.concat(F.lit("was "), _s(k)))
    there = rows.filter(k % 4 > 0).select(F.concat(F.lit("T"), _s(k)).alias("title"), F.lit(None).cast("string").alias("redirect"), old.alias("content"), F.when(k % 4 == 2, " Auto-import: x").otherwise("edited").alias("summary"))
    return state.publish(entities, empty, there)


@query(
    """WITH o AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
    SELECT cast(coalesce(o.k, n.k) AS VARCHAR) AS tm_id, CASE WHEN n.k IS NULL THEN 'T' || o.k WHEN n.k % 4 = 0 THEN 'T' || n.k ELSE 'N' || n.k END AS he_title,
           CASE WHEN n.k IS NULL OR (o.k IS NOT NULL AND n.k % 4 = 0) THEN '2024' ELSE '2025' END AS seen
    FROM o FULL JOIN n ON o.k = n.k"""
)
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replace the state's unless title and namespace are the same."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k)
    old = rows.filter(k % 2 == 0).select(_s(k).alias("tm_id"), F.concat(F.lit("T"), _s(k)).alias("he_title"), F.lit(3000).alias("namespace"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"))
    new = rows.filter(k % 3 == 0).select(_s(k).alias("tm_id"), F.concat(F.lit("Draft:"), F.when(k % 4 == 0, "T").otherwise("N"), _s(k)).alias("he_title"), F.lit(3000).alias("namespace"), F.lit(1).alias("ord"))
    return state.upsert(old, new, "2025-01-01").select("tm_id", "he_title", _s(F.year("last_seen")).alias("seen"))


@query(
    """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
    SELECT cast(coalesce(s.k, g.k) AS VARCHAR) AS key, CASE WHEN g.k IS NULL OR g.k % 5 = 0 THEN 'f' || s.k WHEN g.k % 4 = 0 THEN 'f' || g.k ELSE 'n' || g.k END AS fingerprint,
           CASE WHEN g.k IS NULL OR g.k % 5 = 0 THEN 2024 ELSE 2025 END::BIGINT AS checked, CASE WHEN g.k IS NULL OR g.k % 5 = 0 OR (s.k IS NOT NULL AND g.k % 4 = 0) THEN 2024 ELSE 2025 END::BIGINT AS changed
    FROM s FULL JOIN g ON s.k = g.k WHERE s.k IS NOT NULL OR g.k % 5 <> 0"""
)
def state_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a run: the check moves, the change only with the fingerprint, failures leave it."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k)
    then = F.lit("2024-01-01").cast("timestamp")
    old = rows.filter(k % 2 == 0).select(_s(k).alias("key"), F.concat(F.lit("f"), _s(k)).alias("fingerprint"), then.alias("last_checked"), then.alias("last_changed"))
    new = rows.filter(k % 3 == 0).select(_s(k).alias("key"), F.when(k % 5 == 0, None).when(k % 4 == 0, F.concat(F.lit("f"), _s(k))).otherwise(F.concat(F.lit("n"), _s(k))).alias("fingerprint"))
    out = state.next_state(state.change_gate(new, old.select("key", "fingerprint")), old, "2025-01-01")
    return out.select("key", "fingerprint", F.year("last_checked").cast("long").alias("checked"), F.year("last_changed").cast("long").alias("changed"))


@query("SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS start, count(*)::BIGINT AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1")
def log_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with one of some markers, counted by period."""
    lines = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("[x] "), F.col("event_type"), F.lit(": said")).alias("line"))
    return windows.marked(lines, "ts", "line", ("error", "purchase"), "5 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT title, CASE WHEN k % 2 = 1 THEN 'created' WHEN k % 4 = 0 THEN 'updated' ELSE 'preserved' END AS action FROM (SELECT 'P' || n_nationkey AS title, n_nationkey AS k FROM nation)")
def seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed pages after their digest has changed: new, own and edited ones."""
    k, title = F.col("n_nationkey"), F.concat(F.lit("P"), _s("n_nationkey")).alias("title")
    nation = table(spark, sf_dir, "nation")
    forced = files.seed_digest(nation.select(F.col("n_name").alias("text"))).first() != files.seed_digest(nation.select(F.lower("n_name").alias("text"))).first()
    there = nation.filter(k % 2 == 0).select(title, F.when(k % 4 == 0, "Auto-import: seed").otherwise("by hand").alias("summary"))
    return state.seed_plan(nation.select(title), there, forced)


@query("SELECT 'part' AS name, true AS there UNION ALL SELECT 'no part', false")
def expected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sources have rows; an empty critical one would be an error."""
    part = table(spark, sf_dir, "part")
    found = [("part", files.expect_rows(part, "part", True)), ("no part", files.expect_rows(part.filter("p_partkey < 0"), "no part", False))]
    return spark.createDataFrame(found, "name string, there boolean")


@query("SELECT max(month) AS latest FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) WHERE month < coalesce((SELECT min(m) FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1) WHERE n < 2), '9999')")
def newest_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of an unbroken run of filled periods; none would be an error."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(ordered.newest_populated(months, "month", "n", 2),)], "latest string")


# --- operators that only tests called -----------------------------------------------------


@query(
    """WITH m AS (SELECT 'n' || n_nationkey AS en, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'D' || n_nationkey END AS he FROM nation),
    p AS (SELECT 'n' || s_suppkey AS en, 'P' || s_suppkey AS he FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT coalesce(m.en, p.en) AS en, CASE WHEN m.en IS NULL THEN p.he ELSE m.he END AS he FROM m FULL JOIN p ON m.en = p.en WHERE CASE WHEN m.en IS NULL THEN p.he ELSE m.he END <> ''"""
)
def combined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the dictionary first, players' own fill the gaps."""
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    mapping = table(spark, sf_dir, "nation").select(F.lit("names").alias("category"), F.concat(F.lit("n"), _s(n)).alias("en"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("D"), _s(n))).alias("he"))
    players = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), _s(s)).alias("name_english"), F.when(s % 2 == 0, F.concat(F.lit("P"), _s(s))).alias("name_hebrew"))
    return joins.combined_names(mapping, players)


@query("SELECT p_partkey AS url, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_partkey IS NOT NULL)")
def not_in_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recents that aren't among the related."""
    related = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("url"))
    return joins.not_in_related(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), "p_name"), related)


@query("SELECT s_suppkey, string_agg(coalesce(he, x), ',' ORDER BY i) AS items FROM (SELECT s_suppkey, unnest(['N' || s_nationkey, 'N' || (s_nationkey + 20)]) AS x, unnest([0, 1]) AS i FROM supplier) LEFT JOIN (SELECT 'N' || n_nationkey AS en, 'H' || n_nationkey AS he FROM nation) ON en = x GROUP BY s_suppkey")
def translate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of lists by dictionary, in their order."""
    nation = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.concat(F.lit("N"), _s(nation)), F.concat(F.lit("N"), _s(nation + 20))).alias("items"))
    mapping = table(spark, sf_dir, "nation").select(F.lit("places").alias("category"), F.concat(F.lit("N"), _s("n_nationkey")).alias("en"), F.concat(F.lit("H"), _s("n_nationkey")).alias("he"))
    return joins.translate_array(rows, mapping, "items", "places", ["s_suppkey"]).withColumn("items", F.array_join("items", ","))


@query("SELECT c_mktsegment AS name, 'A' AS src FROM customer GROUP BY 1 UNION ALL SELECT n_name, 'B' FROM nation")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is new are added, none is overwritten."""
    have = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("A").alias("src")).distinct()
    return merges.fill_missing(have, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("B").alias("src")).unionByName(have.withColumn("src", F.lit("C"))), ["name"])


@query("SELECT n_name, row_number() OVER (ORDER BY lower(n_name))::BIGINT AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation)")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in a language's own order, in which case comes last."""
    names = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"))
    return ordered.total_rank(names, [F.collate("n_name", "he"), "n_name"], "place")


@query("SELECT cast(s_suppkey AS VARCHAR) AS value FROM supplier WHERE starts_with(cast(s_suppkey AS VARCHAR), '1') OR starts_with(cast(s_nationkey AS VARCHAR), '1') ORDER BY 1 LIMIT 10")
def prefix_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that begin with a fragment, or whose id does."""
    return ask.suggest(table(spark, sf_dir, "supplier"), "s_suppkey", "1", id_col="s_nationkey")


@query("SELECT 'P' || p_size AS title, arg_max('s' || p_partkey, p_partkey) AS summary FROM part GROUP BY 1")
def last_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision's summary of each page (K7)."""
    k = F.col("p_partkey")
    return wiki.last_summaries(table(spark, sf_dir, "part").select(F.concat(F.lit("P"), _s("p_size")).alias("title"), k.alias("rev_id"), F.concat(F.lit("s"), _s(k)).alias("summary")))


@query("SELECT p_partkey % 9 AS kind, p_partkey, p_partkey % 9 < 6 AS fits FROM part")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that count as towns: every class of the list, not others, not shells."""
    k = (F.col("p_partkey") % 9).cast("int")
    classes = F.element_at(F.array(*(F.array(F.lit(x)) for x in (*C.ENTITY_CLASSES["city"][-6:], "Q5", "Q11410")), F.array().cast("array<string>")), k + 1)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey"), (F.col("p_partkey") % 9).alias("kind"), classes.alias("c"))
    return rows.select("kind", "p_partkey", wiki.is_of_type(F.col("c"), F.array().cast("array<string>"), F.lit(""), "city").alias("fits"))


def _section(name: str, body: Column | str) -> list[Column]:
    begin, end = sections.marks(name)
    return [F.lit(begin), F.lit(body) if isinstance(body, str) else body, F.lit(end)]


@query(
    """WITH m AS (SELECT n_nationkey AS k, '<!-- managed-section start: ' AS s, '<!-- managed-section end: ' AS e FROM nation)
    SELECT 'P' || k AS title, CASE k % 4 WHEN 0 THEN 'clean_rewrite' WHEN 1 THEN 'clean_rewrite' WHEN 2 THEN 'surgical_merge' ELSE 'no_change' END AS action,
           CASE WHEN k % 4 < 2 THEN '' ELSE 'head ' END || CASE k % 4 WHEN 3 THEN s || 'a -->new ' || k || e || 'a --> tail' || chr(10) || s || 'b -->B' || e || 'b -->'
             WHEN 2 THEN s || 'a -->new ' || k || e || 'a --> tail' || chr(10) || s || 'b -->B' || e || 'b -->' ELSE s || 'a -->new ' || k || e || 'a -->' || s || 'b -->B' || e || 'b -->' END AS content
    FROM m"""
)
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose managed sections are replaced in place, rewritten, or found unchanged."""
    k = F.col("n_nationkey")
    new = _section("a", F.concat(F.lit("new "), _s(k)))
    extra = _section("b", "B")
    old = F.when(k % 4 == 0, " ").when(k % 4 == 2, F.concat(F.lit("head "), *_section("a", "old"), F.lit(" tail"))).when(k % 4 == 3, F.concat(F.lit("head "), *new, F.lit(" tail\n"), *extra)).otherwise("anything")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), _s(k)).alias("title"), old.alias("existing"), F.concat(*new, *extra).alias("new"), F.when(k % 4 == 1, "Auto-import: all").otherwise("by hand").alias("summary"))
    return sections.merge_pages(rows)


# --- scalars ------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, p_partkey % 4 IN (0, 1) AS youth, p_partkey % 3 = 0 AS hebrew, p_partkey % 3 <> 0 AS latin, ['שמעון', 'Robert', 'Xאב'][(p_partkey % 3 + 1)::INT] AS label,
           upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS capital, 'https://x/?api_key=REDACTED&q=' || p_size AS url,
           CASE WHEN p_partkey % 2 = 0 THEN 'A.B 1.C|A.B 1. C' ELSE 'a  b|a b' END AS variants
    FROM part"""
)
def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Youth markers, scripts, labels, capitals, redaction, search variants."""
    k = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs)).cast("int") + 1)
    names = pick("שמעון", "Robert", "Xאב")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.is_youth_club(pick("FC U19", "עירוני נוער ", "U19 FC", "FC")).alias("youth"), S.is_all_hebrew(names).alias("hebrew"), S.is_latin(pick("שמעון", "Robert", "Abא")).alias("latin"),
        S.clean_label(F.concat(F.lit("‏"), names, F.lit(" (כדורגל)"))).alias("label"), S.capitalized("p_name").alias("capital"), S.redact(F.concat(F.lit("https://x/?api_key=abc&q="), _s("p_size"))).alias("url"),
        F.array_join(S.search_variants(F.when(k % 2 == 0, "A.B 1.C").otherwise("a  b")), "|").alias("variants"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1 + p_partkey % 3 END::BIGINT AS tier, CASE WHEN p_partkey % 2 = 0 THEN p_size END::BIGINT AS goals_for, ['right', 'both', NULL][(p_partkey % 3 + 1)::INT] AS foot,
           CASE WHEN p_partkey % 2 = 0 THEN 150 + p_size % 50 END::BIGINT AS height, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END::BIGINT AS safe, p_size::BIGINT AS first, CASE WHEN p_partkey % 2 = 0 THEN '1,234,567' ELSE format('{:,}', p_partkey * 1000) END AS thousands,
           CASE WHEN p_partkey % 2 = 0 THEN '—%' ELSE '25.0%' END AS share, cast(1930 + p_size AS VARCHAR) AS year
    FROM part"""
)
def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers, goals, feet, heights, integers, formats, labels."""
    k, size = F.col("p_partkey"), _s("p_size")
    even = k % 2 == 0
    long = lambda c, name: c.cast("long").alias(name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", long(S.tier(F.element_at(F.array(F.lit("Cup"), F.lit("Second Tier"), F.lit("THIRD tier")), (k % 3).cast("int") + 1)), "tier"), long(S.split_goals(F.when(even, F.concat(size, F.lit(" : 3"))).otherwise("x:1"))[0], "goals_for"),
        S.foot(F.element_at(F.array(F.lit(" Right"), F.lit("both "), F.lit("none")), (k % 3).cast("int") + 1)).alias("foot"), long(S.height_cm(F.when(even, F.concat(F.lit("1,"), _s(F.col("p_size") % 50 + 50), F.lit(" m"))).otherwise("tall")), "height"),
        long(S.safe_int(F.when(even, F.concat(F.lit(" "), size)).otherwise("-"), -1), "safe"), long(S.first_int(F.concat(F.lit("a"), size, F.lit("b9"))), "first"), S.thousands(F.when(even, F.lit(1234567)).otherwise(k * 1000)).alias("thousands"),
        S.percent_text(F.when(even, 0).otherwise(k), F.when(even, 0).otherwise(k * 4)).alias("share"), S.season_start(F.concat(_s(F.col("p_size") + 30), F.lit("/xx")), four_digits=False).alias("year"),
    )


@query(
    """SELECT o_orderkey, ['1:0', NULL, NULL][(o_orderkey % 3 + 1)::INT] AS half, o_orderkey % 3 = 1 AS marker, o_orderkey % 3 = 1 OR o_orderkey % 5 = 0 OR o_orderkey % 130 > 90 AS extra,
           (o_custkey % 12 * 10 + o_orderkey % 10 + 1)::BIGINT AS minute, CASE o_orderkey % 2 WHEN 0 THEN 'draft' ELSE CASE WHEN o_custkey % 2 = 1 THEN 'update' END END AS kind
    FROM orders"""
)
def scalar_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-time, extra time, sprite minutes, kinds of revisions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    note = F.element_at(F.array(F.lit(" (1:0)"), F.lit("aet"), F.lit("?")), (k % 3).cast("int") + 1)
    goals = F.array(F.struct(_s(k % 130).alias("minute")))
    shot = F.struct(F.lit("x").alias("player"))
    penalties = F.when(k % 5 == 0, F.array(shot)).otherwise(F.filter(F.array(shot), lambda _: F.lit(False)))
    style = F.concat(F.lit("background-position: -"), _s(k % 10 * 36), F.lit("px -"), _s(c % 12 * 36), F.lit("px"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c, note.alias("note"), goals.alias("goals"), penalties.alias("penalties"), style.alias("style"))
    return rows.select(
        "o_orderkey", S.halftime("note").alias("half"), S.is_extra_time("note").alias("marker"), S.went_extra("note", "penalties", "goals").alias("extra"), S.sprite_minute("style").cast("long").alias("minute"),
        S.revision_kind(F.when(k % 2 == 0, 3000).otherwise(10), c % 2, F.lit(0)).alias("kind"),
    )


@query(
    """SELECT page_id, ['T', 'File:T', 'Template:T', 'Draft:T'][(page_id % 4 + 1)::INT] AS title, 'T' AS bare, '(a) (b) - ' AS safe, page_id % 2 = 0 AS own, 'a,b_2' AS sections, page_id % 3 <> 0 AS valid,
           CASE WHEN page_id % 2 = 0 THEN cast(page_id + 7 AS VARCHAR) END AS player, CASE WHEN page_id % 2 = 0 THEN 'Niv Eli' ELSE 'X' END AS name
    FROM pages"""
)
def scalar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with and without namespace, summaries, section ids, profile links."""
    k = F.col("page_id")
    space = F.element_at(F.array(F.lit(0), F.lit(6), F.lit(10), F.lit(3000)), (k % 4).cast("int") + 1)
    text = F.lit("<!-- managed-section start: a -->x<!-- managed-section end: a -->\n<!-- managed-section start: b_2 keep -->")
    player, name = S.player_link(F.when(k % 2 == 0, F.concat(F.lit("https://t.test/niv-eli/profil/spieler/"), _s(k + 7))).otherwise("/x/profil/"))
    rows = table(spark, sf_dir, "pages").select(k, S.page_title(F.lit("T"), space).alias("title"), player.alias("player"), name.alias("name"), text.alias("text"))
    return rows.select(
        k, "title", S.bare_title(F.concat(F.when(k % 2 == 0, "Draft:").otherwise("Category:"), F.lit("T"))).alias("bare"), S.safe_title(F.lit("[a] {b} |# ")).alias("safe"), S.own_edit(F.when(k % 2 == 0, " Auto-merge: x").otherwise("me")).alias("own"),
        F.array_join(S.section_ids("text"), ",").alias("sections"), S.valid_section_id(F.element_at(F.array(F.lit("9a"), F.lit("a-9"), F.lit("a_")), (k % 3).cast("int") + 1)).alias("valid"), "player", "name",
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS born, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS valued FROM orders")
def scalar_birth_and_value_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth before an age, and of values; null where unreadable."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    born = F.when(k == 0, F.concat(F.date_format(d, "MMM d, yyyy"), F.lit(" (25)"))).when(k == 1, F.date_format(d, "dd.MM.yyyy")).otherwise("Jan 1999")
    valued = F.when(k == 0, F.date_format(d, "MMM d, yyyy")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).otherwise("-")
    return table(spark, sf_dir, "orders").select("o_orderkey", _s(S.birth_date(born)).alias("born"), _s(S.value_date(valued)).alias("valued"))


# --- sources and sinks --------------------------------------------------------------------


def _place(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query("SELECT p_partkey AS id, p_name AS name, 'שם' AS he, CASE WHEN p_size % 2 = 0 THEN p_size END::BIGINT AS size FROM part")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines and read back."""
    path, size = _place(spark, "lines"), F.col("p_size").cast("long")
    files.write_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("שם").alias("he"), F.when(size % 2 == 0, size).alias("size")), path)
    return files.read_lines(spark, path, "id bigint, name string, he string, size bigint", missing="error")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, 'array' AS shape FROM nation UNION ALL SELECT n_nationkey, n_name, 'joined' FROM nation UNION ALL SELECT n_nationkey, n_name, 'joined' FROM nation WHERE n_nationkey < 5")
def json_documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pretty array, and several arrays in one file, read back; a missing file gives nothing."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    one, path = files.write_pretty(rows), _place(spark, "documents")
    joined = f"{one}\n{files.write_pretty(rows.filter('id < 5'))}"
    for name, text in (("array", one), ("joined", joined)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    read = files.read_document(spark, f"{path}/array", "id bigint, name string").withColumn("shape", F.lit("array"))
    none = files.read_document(spark, f"{path}/none", "id bigint, name string").withColumn("shape", F.lit("none"))
    return read.unionByName(files.read_concatenated(spark, f"{path}/joined", "id bigint, name string").withColumn("shape", F.lit("joined"))).unionByName(none)


@query("SELECT cast(year(o_orderdate) AS VARCHAR) AS season, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS total FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1")
def season_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season folders written, pruned to a list with one missing, preferred and purged."""
    base, orders = _place(spark, "seasons"), table(spark, sf_dir, "orders")
    for y in (1995, 1996, 1997):
        files.write_lines(orders.filter(F.year("o_orderdate") == y).select("o_custkey"), f"{base}/{y}/orders.he.jsonl")
    files.purge(spark, base, ["1995"])
    name = files.prefer(spark, f"{base}/1996/orders.he.jsonl", f"{base}/1996/orders.jsonl").rsplit("/", 1)[1]
    wanted = [s for s in files.season_list("1995-1998") if s not in files.missing_seasons(spark, base, name, files.season_list("1995-1998"))]
    rows = files.read_seasons(spark, base, f"{name}/*.json", "o_custkey bigint", [s for s in wanted if files.has_rows(spark, f"{base}/{s}/{name}")])
    season = F.regexp_extract("_path", r"/(\d{4})/", 1)
    return rows.withColumn("_path", F.col("_metadata.file_path")).groupBy(season.alias("season")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("SELECT 'clubs' AS category, n_name AS en, CASE WHEN n_nationkey % 2 = 0 THEN 'H' || n_nationkey END AS he, CASE WHEN n_nationkey % 2 = 0 THEN 'manual' END AS src FROM nation")
def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as YAML text, in the rows' order and by key, read back."""
    k, blank = F.col("n_nationkey"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "nation").select(k, F.lit("clubs").alias("category"), F.col("n_name").alias("en"), F.when(k % 2 == 0, F.concat(F.lit("H"), _s(k))).alias("he"), F.when(k % 2 == 0, "manual").alias("src"), *(blank.alias(x) for x in ("confidence", "wikidata_qid", "note")))
    again = files.dictionary(spark, files.dictionary_text(rows, order=["n_nationkey"]))
    return files.dictionary(spark, files.dictionary_text(again)).select("category", "en", "he", "src")


@query("SELECT 'kept' AS name, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'deleted', 0")
def cleared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables counted only, and cleared for sure (K8)."""
    names = [f"almanac_{uuid.uuid4().hex[:12]}" for _ in range(2)]
    for n in names:
        table(spark, sf_dir, "nation").write.saveAsTable(n)
    wiki.clear_tables(spark, names[:1])
    wiki.clear_tables(spark, names[1:], sure=True)
    out = [("kept", spark.table(names[0]).count()), ("deleted", spark.table(names[1]).count())]
    for n in names:
        spark.sql(f"DROP TABLE `{n}`")
    return spark.createDataFrame(out, "name string, n bigint")


# --- pages --------------------------------------------------------------------------------


def _html(spark: SparkSession, sf_dir: str, kind: str, *parts: Column | str) -> DataFrame:
    """Suppliers' pages of a kind, from pieces of text, extracted."""
    html = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html"), F.lit("2024").alias("season"), F.lit("https://x.test/").alias("url"))
    return pages.extract(df, kind, "html", "season", "url")


@query(
    """SELECT 'squad' AS kind, s_name AS a, 'https://x.test/p/spieler/' || s_suppkey AS b FROM supplier
    UNION ALL SELECT 'loans', s_name, 'https://x.test/p/spieler/' || s_suppkey FROM supplier
    UNION ALL SELECT 'profile', 'right', 'Striker' || s_suppkey FROM supplier
    UNION ALL SELECT 'market_values', '2020-12-01', '€' || s_suppkey FROM supplier
    UNION ALL SELECT 'transfer_history', '2024-01-01', s_name FROM supplier
    UNION ALL SELECT 'stats', cast(s_suppkey AS VARCHAR), cast(s_nationkey AS VARCHAR) FROM supplier
    UNION ALL SELECT 'fixtures', 'League', s_name FROM supplier
    UNION ALL SELECT 'club_transfers', cast(s_suppkey AS VARCHAR), 'in' FROM supplier
    UNION ALL SELECT 'coaches', cast(s_suppkey AS VARCHAR), 'Manager' FROM supplier
    UNION ALL SELECT 'honours', s_name, '19/20,75/76' FROM supplier
    UNION ALL SELECT 'stadium', s_name, cast(1000 + s_suppkey AS VARCHAR) FROM supplier
    UNION ALL SELECT 'records', 'Record arrivals', '€' || s_suppkey || 'm' FROM supplier
    UNION ALL SELECT 'standings', '2025', cast(s_suppkey AS VARCHAR) FROM supplier
    UNION ALL SELECT 'head_to_head', s_name, cast(s_nationkey AS VARCHAR) FROM supplier
    UNION ALL SELECT 'match', '1:0', cast(s_suppkey AS VARCHAR) FROM supplier"""
)
def page_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every kind through their extractors."""
    k, n, nation = _s("s_suppkey"), F.col("s_name"), _s("s_nationkey")
    link = lambda path: ("<td class=hauptlink><a href='", path, k, "'>", n, "</a></td>")
    cells = lambda *xs: "".join(f"<td>{x}</td>" for x in xs)
    of = lambda kind, *parts: _html(spark, sf_dir, kind, *parts)
    made = {
        "squad": (of("squad", "<table class=items><tbody><tr>", *link("/p/spieler/"), "</tr><tr><td>short</td></tr></tbody></table>"), "name_english", "profile_url"),
        "loans": (of("loans", "<table class=items><tbody><tr><td><table class=inline-table><tr>", *link("/p/spieler/"), "</tr></table></td></tr></tbody></table>"), "name_english", "profile_url"),
        "profile": (of("profile", "<div class='spielerdatenundfakten'><span class='info-table__content--regular'>Foot:</span><span class='info-table__content--bold'>right</span></div><div class='detail-position__box'><dl><dd class='detail-position__position'>Striker", k, "</dd></dl></div>"), F.col("facts")["Foot"], "positions.main"),
        "market_values": (of("market_values", '{"list": [{"datum_mw": "Dec 1, 2020", "mw": "€', k, '", "verein": "B"}, {"datum_mw": "?", "mw": "x"}]}'), "date", "value"),
        "transfer_history": (of("transfer_history", '{"transfers": [{"season": "24/25", "dateUnformatted": "2024-01-01", "from": {"clubName": "', n, '"}, "to": {"clubName": "B"}, "fee": "?"}]}'), "date", "from"),
        "stats": (of("stats", "<table class=items><thead><tr><th colspan=2>x</th><th title='Goals'></th></tr></thead><tbody><tr><td>1</td>", *link("/p/"), "<td>", nation, "</td></tr><tr><td>1</td><td class=hauptlink><a href='/p/6'>Q</a></td><td>Not used during this season</td></tr></tbody></table>"), "player_id", _s("goals")),
        "fixtures": (of("fixtures", "<div class=box><div class=responsive-table><table><tbody><tr><td class=extrarow><a>League</a></td></tr><tr>", cells("1", "Sun 25/08/24", "20:00", "H", "", ""), "<td><a href='/c'>", n, "</a></td>", cells("4-4-2", "13.000", "2:1"), "</tr><tr><td>short</td></tr></tbody></table></div></div>"), "competition", "opponent"),
        "club_transfers": (of("club_transfers", "<div class=box><h2>Arrivals 24/25</h2><table><tbody><tr>", *link("/p/profil/spieler/"), "<td class='no-border-rechts'><img title='From FC'></td><td class=rechts>loan transfer</td></tr></tbody></table></div>"), "player_id", "direction"),
        "coaches": (of("coaches", "<div class=responsive-table><table><tbody><tr><td><table><tr>", *link("/c/profil/trainer/"), "</tr><tr><td>Manager</td></tr></table></td><td class=zentriert>45</td><td class=zentriert>Jul 1, 2024</td></tr></tbody></table></div>"), "id", "role"),
        "honours": (of("honours", "<div class=erfolg_bild_box><img title='", n, "'></div><div class=erfolg_infotext_box>19/20,&nbsp; 75/76 ,</div>"), "competition", F.array_join("seasons", ",")),
        "stadium": (of("stadium", "<table class=profilheader><tr><th>Name of stadium:</th><td>", n, "</td></tr><tr><th>Total capacity:</th><td>", F.format_number(F.col("s_suppkey") + 1000, 0), " seats</td></tr></table>"), "name", _s("capacity")),
        "records": (of("records", "<title>Club - Record arrivals | X</title><table class=items><tbody><tr class=odd>", *link("/p/profil/spieler/"), "<td class=rechts>€", k, "m</td></tr></tbody></table>"), "category", "value"),
        "standings": (of("standings", "<table class=items><tbody><tr>", cells("25/26", "", "<a>Ligat</a>", "First Tier", "10", "5", "3", "30:12", "", "35", "<b>2</b>"), "<td><a href='/m/profil/trainer/", k, "'>Coach</a></td></tr></tbody></table>"), "season", "manager_id"),
        "head_to_head": (of("head_to_head", "<table class=items><tbody><tr><td><a title='", n, "' href='/o/verein/12'>O</a></td>", cells("", "<a>20</a>"), "<td>", nation, "</td>", cells("-", "5", "", "", "", "12.345"), "</tr></tbody></table>"), "opponent", _s("wins")),
        "match": (of("match", "<div class=sb-endstand><div class=sb-halbzeit>(1:0)</div></div><div id=sb-tore><ul><li class=sb-aktion-heim><div class=sb-aktion-spielstand><b>1:0</b></div><div class=sb-aktion-aktion><a href='/a-a/profil/spieler/", k, "'>Short</a>, Header</div></li></ul></div>"), "halftime_score", F.get("goals", F.lit(0))["scorer_tm_id"]),
    }
    out = [df.select(F.lit(kind).alias("kind"), (F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b")) for kind, (df, a, b) in made.items()]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
