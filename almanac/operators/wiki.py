"""Relations over wiki pages and looked-up entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import constants as C
from almanac.functions import scalars as S
from almanac.operators.ordered import pick

DRAFT = 3000


def hide_drafts(df: DataFrame, namespace: str, may_read: bool) -> DataFrame:
    """P20: the rows, without those of drafts unless the reader may see them; the predicate reaches the scan."""
    return df if may_read else df.filter(F.col(namespace) != DRAFT)


def authored_pages(pages: DataFrame, revisions: DataFrame, actor: int, namespace: int) -> DataFrame:
    """Pages of a namespace whose first revision is the actor's."""
    first = revisions.filter((F.col("rev_parent_id") == 0) & (F.col("rev_actor") == actor)).select(F.col("rev_page").alias("page_id"))
    return pages.filter(F.col("page_namespace") == namespace).join(first, "page_id").select("page_id", "page_namespace", "page_title")


def notifications_of(notifications: DataFrame, events: DataFrame, agent: int) -> DataFrame:
    """How many notifications belong to an agent's events."""
    own = events.filter(F.col("event_agent_id") == agent).select(F.col("event_id").alias("notification_event"))
    return notifications.join(own, "notification_event").agg(F.count("*").alias("n"))


def users_in_groups(memberships: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """The users in any of the groups, once each."""
    return memberships.filter(F.col("ug_group").isin(*groups)).select("ug_user").distinct()


def last_summaries(revisions: DataFrame) -> DataFrame:
    """(title, summary): the latest revision's summary of each page (K7's input)."""
    return pick(revisions.select("title", "rev_id", "summary"), ["title"], ["rev_id"]).select("title", "summary")


def clear_tables(spark: SparkSession, tables: list[str], sure: bool = False) -> dict[str, int]:
    """K8: rows of each table; they are deleted only if `sure`."""
    counts = {t: spark.table(t).count() for t in tables}
    if sure:
        for t in tables:
            spark.sql(f"TRUNCATE TABLE `{t}`")
    return counts


def is_of_type(classes: Column, sports: Column, description: Column, kind: str) -> Column:
    """An entity's classes meet the type's; players must play football or be described so.

    Entities without classes are shells and of no type.
    """
    said = F.lower(F.coalesce(description, F.lit("")))
    words = lambda ws: reduce(lambda a, b: a | b, (said.contains(w) for w in ws))
    known = F.coalesce(F.size(classes) > 0, F.lit(False))
    meets = F.coalesce(F.arrays_overlap(classes, F.array(*(F.lit(c) for c in C.ENTITY_CLASSES[kind]))), F.lit(False))
    if kind == "player":
        return known & meets & (F.coalesce(F.array_contains(sports, C.FOOTBALL), F.lit(False)) | words(C.PLAYER_WORDS))
    return known & (meets | words(C.COMPETITION_WORDS)) if kind == "competition" else known & meets


def resolve(candidates: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """(en, he, qid): the label of each query's first fitting candidate.

    `candidates` has en, variant and place (its order in the search) with qid; `entities` has
    qid, classes, sports, description, sitelink and label.  Of each variant the first candidate
    that fits decides, and ends it even without a label; the first variant that gives one wins.
    """
    fit = entities.filter(is_of_type(F.col("classes"), F.col("sports"), F.col("description"), kind))
    named = fit.select("qid", S.or_else(S.clean_label("sitelink"), S.clean_label("label")).alias("he"))
    firsts = pick(candidates.join(named, "qid").select("en", "variant", "place", "qid", "he"), ["en", "variant"], ["place", "qid"], last=False)
    return pick(firsts.filter("he IS NOT NULL").select("en", "variant", "qid", "he"), ["en"], ["variant"], last=False).select("en", "he", "qid")
