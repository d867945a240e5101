"""The archive's derived tables (Q1-Q16) on its own schemas, each a function of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import constants as C
from almanac.functions import scalars as S
from almanac.functions.terms import countries
from almanac.operators import joins, merges, ordered

STATS = ("appearances", "goals", "assists", "yellow_cards", "second_yellow_cards", "red_cards", "minutes_played")


# --- normalizing --------------------------------------------------------------------------


def players(raw: DataFrame, country_names: dict[str, str] | None = None) -> DataFrame:
    """A raw player's seventeen columns; season and ord pass through where there are such."""
    fact = lambda name: F.try_element_at("facts", F.lit(name))
    home = fact("Name in home country")
    moves = F.coalesce("transfers", F.array().cast(raw.schema["transfers"].dataType))
    homegrown = F.exists(moves, lambda t: F.coalesce(F.contains(t["from"], F.lit(C.HOMEGROWN_FROM[0])) | F.contains(t["from"], F.lit(C.HOMEGROWN_FROM[1])), F.lit(False)))
    retired = F.exists(moves, lambda t: F.coalesce(F.contains(F.lower(t["to"]), F.lit("retired")), F.lit(False)))
    last = F.try_element_at("market_value_history", F.lit(-1))["value"]
    return raw.select(
        S.tail_id("profile_url").alias("id"), "name_english", F.when(S.is_all_hebrew(home), home).alias("name_hebrew"),
        S.birth_date(fact("Date of birth/Age")).alias("birth_date"), fact("Place of birth").alias("birth_place"),
        countries(country_names)(fact("Citizenship")).alias("nationality"), F.col("positions.main").alias("main_position"),
        (~F.coalesce("loaned", F.lit(False))).alias("current_squad"), S.safe_int("number").alias("current_jersey_number"),
        homegrown.alias("homegrown"), retired.alias("retired"), S.foot(fact("Foot")).alias("preferred_foot"), S.height_cm(fact("Height")).alias("height_cm"),
        S.nullif_empty(fact("Contract expires")).alias("contract_expires"), F.coalesce("is_captain", F.lit(False)).alias("is_captain"),
        S.nullif_empty(last).alias("current_market_value"),
        F.filter(F.coalesce("positions.other", F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")).alias("other_positions"),
        *(c for c in ("season", "ord") if c in raw.columns),
    )


def transfers(raw: DataFrame) -> DataFrame:
    """A row per transfer of raw players."""
    rows = raw.select(S.tail_id("profile_url").alias("player_id"), F.explode("transfers").alias("t"))
    return rows.select("player_id", "t.season", F.col("t.date").alias("transfer_date"), F.col("t.from").alias("from_club"), F.col("t.to").alias("to_club"), "t.fee", S.is_loan(F.col("t.fee")).alias("loan"))


def market_values(raw: DataFrame) -> DataFrame:
    """A row per market value of raw players."""
    rows = raw.select(S.tail_id("profile_url").alias("player_id"), F.explode("market_value_history").alias("v"))
    return rows.select("player_id", F.col("v.date").alias("value_date"), "v.value", "v.team")


def stats(raw: DataFrame) -> DataFrame:
    """Measures that are absent count as zero."""
    zero = lambda c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in raw.columns else F.lit(0)).alias(c)
    return raw.select("player_id", "season", *(zero(c) for c in STATS))


def merged_players(seasons: DataFrame) -> DataFrame:
    """Q13: one row per player over seasons."""
    return merges.merge_seasons(seasons)


# --- answers ------------------------------------------------------------------------------


def squad(players: DataFrame, stats: DataFrame, season: str) -> DataFrame:
    """Q1: players of a season by line, with that season's statistics as a struct, null without."""
    rows = players.filter(F.array_contains("seasons_active", season)) if "seasons_active" in players.columns else players
    numbered = stats.withColumnRenamed("player_id", "id")
    joined = joins.with_latest(rows, numbered, "id", [F.struct(*STATS)], F.col("season") == season)
    return joined.withColumn("line", S.position_line("main_position"))


def transfer_page(transfers: DataFrame, players: DataFrame, season: str) -> DataFrame:
    """Q2: a season's transfers with names and direction; those that don't touch the club are dropped."""
    rows = transfers.filter(F.col("season").startswith(season[:4]) | (S.season_start("season") == season[:4]))
    names = players.select(F.col("id").alias("player_id"), S.or_else("name_hebrew", "name_english").alias("player"))
    return joins.with_name(rows.withColumn("direction", S.direction("from_club", "to_club")).filter("direction IS NOT NULL"), names, "player_id", "player", "player_name")


def season_totals(stats: DataFrame, season: str) -> DataFrame:
    """Q3: a season's sums, zero where it has no rows."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("appearances", "goals", "assists", "yellow_cards", "red_cards"))
    return stats.filter(F.col("season") == season).agg(*sums)


def season_top(stats: DataFrame, players: DataFrame, season: str, measure: str, k: int = 10) -> DataFrame:
    """Q3: a season's ten best by a measure; those at zero are dropped after the limit."""
    rows = ordered.top_k(stats.filter(F.col("season") == season), measure, k, ["player_id"], positive="after")
    return joins.with_name(rows, players.select(F.col("id").alias("player_id"), S.or_else("name_hebrew", "name_english").alias("n")), "player_id", "n").select("rank", "player_id", "name", measure)


def leaderboard(stats: DataFrame, players: DataFrame, measure: str, k: int = 50) -> DataFrame:
    """Q4: all-time sums above zero, the top fifty with names."""
    sums = stats.groupBy("player_id").agg(*(F.sum(c).alias(c) for c in ("appearances", "goals", "assists")))
    best = ordered.top_k(sums, measure, k, ["player_id"])
    return joins.with_name(best, players.select(F.col("id").alias("player_id"), S.or_else("name_hebrew", "name_english").alias("n")), "player_id", "n")


#: What a season may lack, by the source that would tell it.
SOURCES = ("standings", "stats", "squad", "fixtures")


def season_overview(stats: DataFrame, players: DataFrame, fixtures: DataFrame, standings: DataFrame, squad: DataFrame, season: str, k: int = 10) -> DataFrame:
    """Q3: one row a season: totals, the best by three measures, standing, fixtures by competition, and the sources without it.

    The first standing by competition counts; lists of the best leave out zeros after their
    limit; a season that no source has still gets its row.
    """
    one = season_totals(stats, season).withColumn("season", F.lit(season))
    for measure in ("goals", "appearances", "assists"):
        best = season_top(stats, players, season, measure, k).agg(F.array_sort(F.collect_list(F.struct("rank", "player_id", "name", measure))).alias(f"top_{measure}"))
        one = one.crossJoin(best)  # one row each
    place = standings.filter(F.col("season") == season).agg(F.min_by(F.struct(*(c for c in standings.columns if c != "season")), "competition").alias("standing"))
    counts = fixtures.filter(F.col("season") == season).groupBy(F.coalesce("competition", F.lit("Unknown")).alias("competition")).agg(F.count("*").alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("competition", "n"))).alias("fixtures"))
    some = lambda df: df.filter(F.col("season") == season).limit(1).agg(F.count("*").alias("n"))
    there = some(stats).select(F.col("n").alias("_stats")).crossJoin(some(squad).select(F.col("n").alias("_squad")))
    row = one.crossJoin(place).crossJoin(listed).crossJoin(there)
    tests = {"standings": F.col("standing").isNull(), "stats": F.col("_stats") == 0, "squad": F.col("_squad") == 0, "fixtures": F.size("fixtures") == 0}
    missing = F.filter(F.array(*(F.when(tests[s], F.lit(s)) for s in SOURCES)), lambda x: x.isNotNull())
    return row.withColumns({"missing": missing, "display": S.season_display("season")}).drop("_stats", "_squad")


def attendance(fixtures: DataFrame) -> DataFrame:
    """Q5: matches with a readable attendance, by season; seasons without any have no row."""
    rows = fixtures.select("season", S.attendance("attendance").alias("a")).filter("a IS NOT NULL")
    return rows.groupBy("season").agg(F.count("*").alias("matches"), F.sum("a").alias("total"), F.expr("sum(a) div count(*)").alias("average"), F.max("a").alias("most"), F.min("a").alias("least"))


def derbies(head_to_head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q6: the rivals by their first known name, null rows where there is none; and all others ranked by matches played.

    Both are stored whole; a page shows the others up to rank twenty (O4).
    """
    spark = head_to_head.sparkSession
    wanted = spark.createDataFrame([(d, list(a)) for d, a in C.DERBIES.items()], "display string, aliases array<string>")
    rivals = joins.alias_pick(wanted, head_to_head, "opponent", ["played", "opponent_tm_id"]).withColumn("win_pct", S.win_rate("wins", "played"))
    aliases = wanted.select(F.explode("aliases").alias("opponent"))
    others = joins.unknown(head_to_head, aliases, ["opponent"]).withColumn("win_pct", S.win_rate("wins", "played"))
    return rivals, ordered.total_rank(others, [F.desc("played"), "opponent"])


def campaigns(fixtures: DataFrame) -> DataFrame:
    """Q7: European matches per season and competition, per competition with its seasons, and in all."""
    rows = fixtures.filter(F.trim("competition").isin(*C.EUROPEAN_COMPETITIONS)).withColumn("competition", F.trim("competition"))
    base = rows.groupBy("competition", "season").agg(F.count("*").alias("n"))
    per = base.groupBy("competition").agg(F.sum("n").alias("n"), F.count("*").alias("n_seasons"))
    whole = base.groupBy("season").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("n_seasons")).filter("n IS NOT NULL")
    null = F.lit(None).cast("string")
    return base.withColumn("n_seasons", F.lit(1).cast("long")).unionByName(per.withColumn("season", null)).unionByName(whole.withColumn("competition", null).withColumn("season", null))


def ranked_campaigns(fixtures: DataFrame) -> DataFrame:
    """Q7 with the competitions' places, by their matches and then by name (O5); the total has none."""
    rows = campaigns(fixtures)
    per = rows.filter("season IS NULL AND competition IS NOT NULL")
    places = per.select("competition", F.row_number().over(Window.orderBy(F.desc("n"), "competition")).alias("place"))  # one row a competition of the fixed list
    return rows.join(places, "competition", "left")


def competition_pages(fixtures: DataFrame) -> DataFrame:
    """Q8: (season, competition, rows): matches in order with outcome and title; unnamed and unknown competitions are left out."""
    rows = fixtures.filter(F.trim("competition").isNotNull() & ~F.trim("competition").isin("", "Unknown"))
    row = F.struct("ord", "date", "opponent", "venue", "result", S.outcome("result", "venue").alias("outcome"), S.match_title("date", "opponent", "competition").alias("title"))
    return rows.groupBy("season", "competition").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("n"))


def coaches(standings: DataFrame, honours: DataFrame, staff: DataFrame) -> DataFrame:
    """Q9: coaches of all seasons with their totals and trophies, current staff laid over them, by name.

    Standings rows without manager or season are dropped, as are staff without id; numbers that aren't whole are skipped;
    games played are wins, draws and losses together.
    """
    prizes = honours.select("competition", F.explode("seasons").alias("label")).select("competition", S.season_start("label").alias("season")).filter("season IS NOT NULL")
    by_season = prizes.groupBy("season").agg(F.collect_set(F.concat("competition", F.lit(" "), S.season_display("season"))).alias("won"))
    rows = standings.filter("trim(coalesce(manager_id, '')) <> '' AND trim(coalesce(manager_name, '')) <> '' AND trim(coalesce(season, '')) <> ''")
    number = lambda c: F.coalesce(F.sum(F.col(c).try_cast("int")), F.lit(0)).cast("int")
    past = rows.join(by_season, "season", "left").groupBy(F.col("manager_id").alias("id")).agg(
        F.min_by("manager_name", "season").alias("name"), number("wins").alias("wins"), number("draws").alias("draws"), number("losses").alias("losses"),
        F.array_sort(F.collect_set("season")).alias("tenure_seasons"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("won")))).alias("trophies"),
    )
    empty = F.lit(None).cast("string")
    past = past.select("id", "name", empty.alias("role"), empty.alias("tenure_start"), empty.alias("tenure_end"), empty.alias("ppm"), (F.col("wins") + F.col("draws") + F.col("losses")).alias("played"), "wins", "draws", "losses", "tenure_seasons", "trophies")
    both = joins.overlay(past, staff.filter("trim(coalesce(id, '')) <> ''"), "id", ["role", "tenure_start", "tenure_end", "ppm"])
    none = F.array().cast("array<string>")
    return both.withColumns({c: F.coalesce(c, none) for c in ("tenure_seasons", "trophies")}).orderBy("name", "id")


def grouped_records(records: DataFrame) -> DataFrame:
    """Q10: records of each category in their order."""
    return records.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", "player_name", "player_id", "value"))).alias("rows"))


def honours_list(honours: DataFrame) -> DataFrame:
    """Q10: honours in the order of their file, each with its seasons as displayed and their number."""
    seasons = F.coalesce("seasons", F.array().cast("array<string>"))
    return honours.select("ord", "competition", "achievement", F.array_join(seasons, ", ").alias("seasons"), F.size(seasons).alias("n"))


def stadium_row(stadium: DataFrame) -> DataFrame:
    """Q10: the stadium's page, of the first row, with the page's title where a name is missing."""
    first = stadium.orderBy("ord").limit(1)
    return first.select(S.or_else("name", F.lit("Stadium")).alias("title"), *(c for c in stadium.columns if c not in ("ord", "name")))


def match_names(matches: DataFrame) -> DataFrame:
    """(en) of all names in matches' events and line-ups, once each.

    Event lists may be null or lacking; line-ups are variants, as lineup_entries reads them.
    """
    fields = {"goals": ("scorer", "assist"), "substitutions": ("player_in", "player_out"), "cards": ("player",), "penalties": ("player",)}
    seen = [F.col(c)[f] for c, names in fields.items() if c in matches.columns for f in names]
    none = F.array().cast("array<string>")
    out = matches.select(F.explode(F.array_distinct(F.concat(*(F.coalesce(x, none) for x in seen)))).alias("en")) if seen else None
    for lineup in ("home_lineup", "away_lineup"):
        if lineup in matches.columns:
            rows = lineup_entries(matches, [], lineup, lineup).select(F.col("name").alias("en"))
            out = rows if out is None else out.unionByName(rows)
    return out.filter("en IS NOT NULL AND en <> ''").distinct()


def player_pages(players: DataFrame, transfers: DataFrame, stats: DataFrame, values: DataFrame) -> DataFrame:
    """Q11: players with their transfers, split into youth and senior, statistics with a total, and values."""
    moves = transfers.withColumnRenamed("player_id", "id").withColumn("youth", S.is_youth_club("from_club") | S.is_youth_club("to_club"))
    moves = moves.withColumn("fee", S.fee_text("fee")).withColumn("day", S.il_date("transfer_date"))
    out = joins.nested(players, moves, "id", ["transfer_date", "season", "from_club", "to_club", "fee", "day", "loan", "youth"], "moves", ["transfer_date"])
    out = out.withColumn("youth_transfers", F.filter("moves", lambda m: m["youth"])).withColumn("senior_transfers", F.filter("moves", lambda m: ~m["youth"])).drop("moves")
    out = joins.nested(out, stats.withColumnRenamed("player_id", "id"), "id", ["season", *STATS], "stats", ["season"])
    added = lambda c: F.aggregate("stats", F.lit(0), lambda a, s: a + F.coalesce(s[c], F.lit(0))).alias(c)
    total = F.struct(*(added(c) for c in STATS))
    return joins.nested(out.withColumn("total", total), values.withColumnRenamed("player_id", "id"), "id", ["value_date", "value", "team"], "values", ["value_date"])


def match_rows(matches: DataFrame) -> DataFrame:
    """Q12: reports with title and outcome, events left nested."""
    return matches.withColumns({"outcome": S.outcome("result", "venue"), "title": S.match_title("date", "opponent", "competition"), "day": S.il_date("date")})


def lineup_entries(matches: DataFrame, key: list[str], lineup: str, side: str) -> DataFrame:
    """(key, side, position, name, player_id, number, captain) of line-ups given as variants.

    A line-up is a list of players, or an object of lists, single players or bare names by position.
    """
    v = F.col(lineup)
    listed = matches.filter(F.schema_of_variant(v).startswith("ARRAY"))
    keyed = matches.filter(F.schema_of_variant(v).startswith("OBJECT"))
    entry = lambda path: F.try_variant_get("x", path, "string")
    flat = listed.select(*key, F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("x")).withColumn("position", F.lit(None).cast("string"))
    pairs = keyed.select(*key, F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("position", "y"))
    many = F.when(F.schema_of_variant("y").startswith("ARRAY"), F.try_variant_get("y", "$", "array<variant>")).otherwise(F.array("y"))
    rows = flat.unionByName(pairs.select(*key, F.explode(many).alias("x"), "position"))
    bare = F.schema_of_variant("x") == "STRING"
    name = F.when(bare, F.try_variant_get("x", "$", "string")).otherwise(S.or_else(entry("$.name_hebrew"), entry("$.name_english"), entry("$.name_short")))
    return rows.select(*key, F.lit(side).alias("side"), "position", name.alias("name"), F.when(~bare, entry("$.tm_player_id")).alias("player_id"), F.when(~bare, entry("$.number")).alias("number"), F.coalesce(F.when(~bare, F.try_variant_get("x", "$.captain", "boolean")), F.lit(False)).alias("captain")).filter("name IS NOT NULL AND name <> ''")


def dictionary_stub(players: DataFrame, transfers: DataFrame, values: DataFrame, fixtures: DataFrame, match_names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Q14: the dictionary with an empty entry for every new word of the tables; none is overwritten."""
    words = lambda df, category, *columns: [df.select(F.lit(category).alias("category"), F.col(c).alias("en")) for c in columns]
    known = players.select(F.col("name_english").alias("en"))
    seen = [
        *words(players, "positions", "main_position"), *words(players, "birth_places", "birth_place"), players.select(F.lit("positions").alias("category"), F.explode("other_positions").alias("en")),
        players.select(F.lit("nationalities").alias("category"), F.explode("nationality").alias("en")), *words(transfers, "clubs", "from_club", "to_club"), *words(values, "clubs", "team"),
        *words(fixtures, "clubs", "opponent"), *words(fixtures.filter("trim(competition) <> 'Unknown'"), "competitions", "competition"), *words(known, "names", "en"), *words(joins.unknown(match_names.select("en"), known, ["en"]), "names", "en"),
    ]
    new = merges.distinct_rows(*seen).filter("en IS NOT NULL AND trim(en) <> ''")
    blank = (F.lit(None).cast("string").alias(c) for c in ("he", "src", "confidence", "wikidata_qid", "note"))
    return mapping.unionByName(joins.unknown(new, mapping, ["category", "en"]).select("category", "en", *blank))


def filled_dictionary(mapping: DataFrame, backends: list[tuple[str, DataFrame]]) -> DataFrame:
    """Q14: empty entries, or ones without origin, filled by the first backend (category, en, he) that knows them; the last resort spells out."""
    needs = (F.coalesce("he", F.lit("")) == "") | F.col("src").isNull()
    for name, table in backends:
        side = table.filter("he <> ''").groupBy("category", "en").agg(F.max("he").alias("_he"))  # of repeated keys the greatest, as in a fallback chain
        hit = needs & F.col("_he").isNotNull()
        mapping = mapping.join(side, ["category", "en"], "left").withColumns({"he": F.when(hit, F.col("_he")).otherwise(F.col("he")), "src": F.when(hit, F.lit(name)).otherwise(F.col("src"))}).drop("_he")
    spell = needs & S.is_latin("en")
    return mapping.withColumns({"he": F.when(spell, S.transliterate("en")).otherwise(F.col("he")), "src": F.when(spell, F.lit("auto-translit")).otherwise(F.col("src"))})


def merged_dictionary(merged: DataFrame, cycles: DataFrame) -> DataFrame:
    """Q15: of each entry the most trusted source; of equals the merged file's, then the earliest season's."""
    both = merged.withColumn("cycle", F.lit("")).unionByName(cycles.select(*merged.columns, "cycle"))
    ranks = F.create_map(*(F.lit(v) for kv in C.SOURCE_RANK.items() for v in kv))
    ranked = both.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.coalesce("src", F.lit(""))), F.lit(0)))
    places = ranked.select("cycle").distinct().withColumn("place", F.row_number().over(Window.orderBy("cycle")))
    return ordered.priority_pick(ranked.join(places, "cycle"), ["category", "en"], "rank", "place").select(*merged.columns)


def flagged(mapping: DataFrame) -> DataFrame:
    """Entries of low confidence by category, with totals."""
    return mapping.filter("confidence = 'low'").rollup("category").agg(F.count("*").alias("n"))
