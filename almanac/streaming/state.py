"""Keyed state between runs: change gates, upserts, page routing and publish plans.

State is a table; a run joins its snapshot to it and gives both the decisions and the new
state.  The streaming form applies the same function to each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import scalars as S
from almanac.operators.ordered import pick
from almanac.streaming.runs import exists, listed


def change_gate(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """(key, fingerprint, status, changed) for a snapshot (key, fingerprint) against the stored state.

    A null fingerprint stands for a failed fetch: it counts as changed, and must not be stored.
    """
    old = state.select("key", F.col("fingerprint").alias("_old"))
    status = F.when(F.col("fingerprint").isNull(), "error").when(F.col("_old").isNull(), "new").when(F.col("fingerprint") == F.col("_old"), "same").otherwise("changed")
    return snapshot.join(old, "key", "left").select("key", "fingerprint", status.alias("status"), (status != "same").alias("changed"))


def next_state(gate: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """The state after a successful run: last_checked always moves, last_changed only with the fingerprint."""
    seen = gate.filter("status <> 'error'").select("key", F.col("fingerprint").alias("_f"), "changed")
    at = F.lit(now).cast("timestamp")
    return state.join(seen, "key", "full").select(
        "key", F.coalesce("_f", "fingerprint").alias("fingerprint"),
        F.when(F.col("_f").isNotNull(), at).otherwise(F.col("last_checked")).alias("last_checked"),
        F.when(F.col("changed"), at).otherwise(F.col("last_changed")).alias("last_changed"),
    )


def upsert(state: DataFrame, rows: DataFrame, now: str, key: str = "tm_id") -> DataFrame:
    """(key, he_title, namespace, last_seen): rows replace the state's; an equal title and namespace leave it untouched.

    Titles lose their namespace's prefix; of repeated keys the greatest ordinal wins.
    """
    new = pick(rows.select(key, S.bare_title("he_title").alias("_t"), F.col("namespace").cast("int").alias("_n"), "ord"), [key], ["ord"]).drop("ord")
    same = F.col("he_title").eqNullSafe(F.col("_t")) & F.col("namespace").eqNullSafe(F.col("_n"))
    both = state.join(new, key, "full")
    kept = F.col("_t").isNull() | same
    return both.select(key, F.when(kept, F.col("he_title")).otherwise(F.col("_t")).alias("he_title"), F.when(kept, F.col("namespace")).otherwise(F.col("_n")).alias("namespace"), F.when(kept, F.col("last_seen")).otherwise(F.lit(now).cast("timestamp")).alias("last_seen"))


def route(entities: DataFrame, state: DataFrame, pages: DataFrame, key: str = "tm_id") -> DataFrame:
    """(key, title, action, namespace) where each entity's page is to be written.

    `entities` has want_title and want_namespace, `pages` the full titles that exist with the
    target of redirects.  A page in the main space always wins; renames stay within the
    stored namespace; a stored page that is gone is written afresh ('stranded').
    """
    p = pages.groupBy(F.col("title").alias("_title")).agg(F.min("redirect").alias("_redirect"))  # of several redirects the least

    def probed(df: DataFrame, title: str, name: str) -> DataFrame:
        side = p.select(F.col("_title").alias(title), F.lit(True).alias(f"{name}_there"), F.coalesce("_redirect", "_title").alias(f"{name}_final"))
        return df.join(side, title, "left").withColumn(f"{name}_there", F.coalesce(f"{name}_there", F.lit(False)))

    rows = entities.join(state.select(key, F.col("he_title").alias("old_title"), F.col("namespace").alias("old_ns")), key, "left")
    rows = rows.withColumns({
        "main": S.page_title("want_title", F.lit(0)), "want": S.page_title("want_title", "want_namespace"),
        "old": F.when(F.col("old_ns").isNotNull(), S.page_title("old_title", "old_ns")), "moved": F.when(F.col("old_ns").isNotNull(), S.page_title("want_title", "old_ns")),
    })
    for title in ("main", "want", "old", "moved"):
        rows = probed(rows, title, title[0] + "_p" if title != "moved" else "v_p")
    stored, same = F.col("old_ns").isNotNull(), F.col("old_title") == F.col("want_title")
    case = F.struct  # (title, action, namespace)
    want = lambda action: case(F.col("want").alias("title"), F.lit(action).alias("action"), F.col("want_namespace").cast("int").alias("namespace"))
    at = lambda title, action: case(F.col(title).alias("title"), F.lit(action).alias("action"), F.col("old_ns").cast("int").alias("namespace"))
    decided = (
        F.when(F.col("m_p_there"), case(F.col("m_p_final").alias("title"), F.lit("update").alias("action"), F.lit(0).alias("namespace")))
        .when(~stored & F.col("w_p_there"), want("update")).when(~stored, want("create"))
        .when(~F.col("o_p_there"), want("stranded"))
        .when(same, at("o_p_final", "update"))
        .when(F.col("v_p_there"), at("moved", "update"))
        .otherwise(at("moved", "moved"))
    )
    return rows.select(key, decided.alias("x")).select(key, "x.title", "x.action", "x.namespace")


def publish_plan(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(title, action) of each page: create, update, or skip where the stripped texts' MD5 are equal (K6).

    Only titles and hashes are joined; page texts are read once on each side and not shuffled.
    """
    a = new.select("title", S.content_hash("content").alias("_new"))
    b = existing.select("title", S.content_hash("content").alias("_old"))
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_old") == F.col("_new"), "skip").otherwise("update")
    return a.join(b, "title", "left").select("title", action.alias("action"))


def merge_action(existing_content, new_content, summary, merged_content=None):
    """K7: clean_rewrite, surgical_merge or no_change, as a Column of an existing page, its last summary and the merge's result."""
    empty = F.coalesce(S.strip(existing_content) == "", F.lit(True))
    merged = new_content if merged_content is None else merged_content
    return F.when(empty | S.own_edit(summary, merged=False), "clean_rewrite").when(merged == existing_content, "no_change").otherwise("surgical_merge")


def seed_plan(seeds: DataFrame, existing: DataFrame, forced: bool, key: str = "title") -> DataFrame:
    """(title, action) of seed pages (K9): existing ones are touched only if the seeds' digest has changed, and not if people edited them since.

    `existing` has the key and the summary of its last revision.  Where titles aren't unique, another
    `key` tells pages apart.  Every seed gives one row: of a key that exists repeatedly, one row
    edited by people counts; a null key exists nowhere.
    """
    side = existing.groupBy(F.col(key).alias("_key")).agg(F.lit(True).alias("_there"), F.bool_and(S.own_edit("summary", merged=False)).alias("_own"))
    action = F.when(F.col("_there").isNull(), "created").when(~F.lit(forced), "skipped").when(F.col("_own"), "updated").otherwise("preserved")
    return seeds.select("title", F.col(key).alias("_key")).join(side, "_key", "left").select("title", action.alias("action"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a state, oldest first."""
    numbers = sorted(int(n[8:]) for n in listed(spark, path) if n.startswith("version="))
    return [n for n in numbers if exists(spark, f"{path}/version={n}/_SUCCESS")]


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version of a state, None where there is none yet."""
    complete = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={complete[-1]}") if complete else None


def write_state(df: DataFrame, path: str) -> None:
    """Writes a state's next version; it counts once it is complete, so stopping anywhere leaves the one before (K5).

    The version before the new one stays for those who are reading it, earlier ones go.
    """
    spark = df.sparkSession
    complete = _versions(spark, path)
    number = complete[-1] + 1 if complete else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for n in listed(spark, path):
        if n.startswith("version=") and int(n[8:]) < number - 1:
            old = fs_path(f"{path}/{n}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def stream_merge(source: DataFrame, path: str, checkpoint: str, key: str | list[str], order: list[str], mode: str = "append") -> None:
    """Runs a stream to its present end, keeping at `path` the latest row of each key by an order that must be total.

    Streams of updated aggregates (mode 'update') may order by _batch, the batch's number.
    Each batch writes the whole state anew, so it is for states that are small beside a batch;
    `keyed.upserts` holds larger ones.  Batches are idempotent: merging one again changes nothing.
    """
    keys = [key] if isinstance(key, str) else key

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("_batch", F.lit(number).cast("long")) if "_batch" in order else batch
        old = read_state(batch.sparkSession, path)
        write_state(pick(new if old is None else old.unionByName(new), keys, [F.col(c) for c in order]), path)

    source.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish(entities: DataFrame, state: DataFrame, pages: DataFrame, key: str = "tm_id") -> DataFrame:
    """(key, title, route, action) of entities with their content: routed, then written, merged or skipped (Q16, K6, K7).

    `pages` are (title, redirect, content, summary), the summary being that of the last revision.
    Pages that aren't there are created; equal ones are skipped; those a person has edited since
    the last import are merged, all others rewritten.
    """
    routed = route(entities.select(key, "want_title", "want_namespace"), state, pages, key).withColumnRenamed("action", "route")
    new = entities.select(key, F.col("content").alias("_content"), S.content_hash("content").alias("_new"))
    there = pages.select("title", F.col("content").alias("_old"), F.col("summary").alias("_summary"), S.content_hash("content").alias("_hash"))
    rows = routed.join(new, key).join(there, "title", "left")
    action = F.when(F.col("_hash").isNull(), "create").when(F.col("_hash") == F.col("_new"), "skip").otherwise(merge_action(F.col("_old"), F.col("_content"), F.col("_summary")))
    return rows.select(key, "title", "route", action.alias("action"))
