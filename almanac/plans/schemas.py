"""One registry of tables: columns, keys, checks of reserved names, and DDL from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.constants import RESERVED


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    key: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    def ddl(self, location: str | None = None) -> str:
        """CREATE TABLE text; a reserved name is an error rather than silently refused."""
        bad = [n for n in (self.name, *self.schema.names) if n.lower() in RESERVED]
        if bad:
            raise ValueError(f"reserved names: {bad}")
        body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return f"CREATE TABLE IF NOT EXISTS `{self.name}` ({body}) USING parquet" + (f" LOCATION '{location}'" if location else "")


_EVENT = "minute: string, player: string, team: string, reason: string"
TABLES = {
    t.name: t
    for t in (
        Table("players", "id string, name_english string, name_hebrew string, birth_date date, birth_place string, nationality array<string>, main_position string, current_squad boolean, current_jersey_number int, homegrown boolean, retired boolean, preferred_foot string, height_cm int, contract_expires string, is_captain boolean, current_market_value string, other_positions array<string>", ("id",)),
        Table("transfers", "player_id string, season string, transfer_date string, from_club string, to_club string, fee string, loan boolean, from_club_tm_id string, to_club_tm_id string"),
        Table("market_values", "player_id string, value_date string, value string, team string", ("player_id", "value_date")),
        Table("player_stats", "player_id string, season string, appearances int, goals int, assists int, yellow_cards int, second_yellow_cards int, red_cards int, minutes_played int", ("player_id", "season")),
        Table("match_reports", "competition string, matchday string, match_date string, match_time string, venue string, opponent string, result string, system_of_play string, attendance string, season string, halftime_score string, aet boolean, stadium string, referee string, assistant_referee_1 string, assistant_referee_2 string, fourth_official string, var_referee string, var_assistant string"),
        Table("coaches", "coach_id string, name string, tenure_start string, tenure_end string, played int, wins int, draws int, losses int, ppm string, is_caretaker boolean, tenure_seasons array<string>, hbs_trophies_won array<string>", ("coach_id",)),
        Table("honours", "competition string, achievement string, seasons array<string>", ("competition", "achievement")),
        Table("season_standings", "season string, competition string, tier int, final_position int, played int, wins int, draws int, losses int, goals_for int, goals_against int, points int", ("season", "competition")),
        Table("head_to_head", "opponent string, opponent_tm_id string, played int, wins int, draws int, losses int, goals_for int, goals_against int, avg_attendance int", ("opponent",)),
        Table("club_transfers", "season string, player_name string, player_id string, age string, position string, from_club string, to_club string, fee string, loan boolean, direction string", ("season", "player_id", "direction")),
        Table("fixtures", "season string, ord int, competition string, matchday string, date string, time string, venue string, opponent string, system_of_play string, attendance string, result string, match_report_url string"),
        Table("season_managers", "season string, coach_id string, coach_name string, is_caretaker boolean, played int, wins int, draws int, losses int, ppm string", ("season", "coach_id")),
        Table("mappings", "category string, en string, he string, src string, confidence string, wikidata_qid string, note string", ("category", "en")),
        Table("page_index", "tm_id string, he_title string, namespace int, last_seen timestamp", ("tm_id",)),
        Table("scrape_hashes", "key string, fingerprint string, last_checked timestamp, last_changed timestamp", ("key",)),
    )
}
#: A raw player as scraped, before any rule.
RAW_PLAYER = "name_english string, profile_url string, number string, season string, loaned boolean, is_captain boolean, facts map<string,string>, positions struct<main:string,other:array<string>>, market_value_history array<struct<date:string,value:string,team:string>>, transfers array<struct<season:string,date:string,`from`:string,`to`:string,fee:string>>"


def create_all(spark: SparkSession) -> None:
    """Declares every table (§1.4)."""
    for t in TABLES.values():
        spark.sql(t.ddl())


def visible(df: DataFrame, namespace: str = "namespace") -> DataFrame:
    """Rows that are stored: those of pages in the main space (P20)."""
    return df.filter(F.col(namespace) == 0)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, cast; missing ones are null, others are dropped."""
    schema = TABLES[table].schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
