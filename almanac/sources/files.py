"""Readers and writers of the archive's layers; any path that Spark reaches will do."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType, missing: str = "empty") -> DataFrame:
    """JSON lines (S2, S3): blank lines are skipped; a missing file is 'empty' or an 'error'."""
    if missing == "empty" and not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(_schema(schema)).json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole-file JSON array or object (S1, S4): rows of the array, or one row; missing and empty files give none."""
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path)


def read_concatenated(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that hold several JSON arrays or objects one after another (S5), any number of them."""

    def split(rows: Iterator) -> Iterator:
        import pandas as pd

        decoder = json.JSONDecoder()
        for pdf in rows:
            found = []
            for text in pdf["value"]:
                at = 0
                while at < len(text):
                    if text[at].isspace():
                        at += 1
                        continue
                    value, at = decoder.raw_decode(text, at)
                    found += value if isinstance(value, list) else [value]
            yield pd.DataFrame({"json": [json.dumps(x) for x in found]})

    texts = spark.read.text(path, wholetext=True).mapInPandas(split, "json string")
    return texts.select(F.from_json("json", _schema(schema)).alias("x")).select("x.*")


def read_seasons(spark: SparkSession, base: str, filename: str, schema: str | T.StructType, seasons: Sequence[str] | None = None) -> DataFrame:
    """One file per season folder (S7, S8), season and file order as columns.

    Only the requested folders are listed and read.  The season is the folder's name.  Missing
    ones are passed over with a warning; none at all is an error.
    """
    wanted = [s for s in seasons if exists(spark, f"{base}/{s}/{filename}")] if seasons is not None else None
    if lost := sorted(set(seasons or ()) - set(wanted or ())):
        log.warning("no %s for seasons %s under %s", filename, lost, base)
    paths = [f"{base}/{s}/{filename}" for s in wanted] if wanted is not None else [f"{base}/*/{filename}"]
    if not paths or not exists(spark, paths[0]):
        raise FileNotFoundError(f"no season of {seasons or 'any'} under {base}")
    full = T.StructType([f for f in _schema(schema) if f.name != "season"])
    rows = spark.read.schema(full).json(paths)
    place = F.col("_metadata.file_path")
    return rows.select("*", F.element_at(F.split(place, "/"), -2).alias("season"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))


def missing_seasons(spark: SparkSession, base: str, filename: str, seasons: Sequence[str]) -> list[str]:
    """The requested seasons that have no such file, sorted."""
    return sorted(s for s in set(seasons) if not exists(spark, f"{base}/{s}/{filename}"))


def season_list(text: str) -> list[str]:
    """'2019-2022' or '2019,2021' as start years."""
    out: list[str] = []
    for part in (p.strip() for p in text.split(",") if p.strip()):
        m = re.fullmatch(r"(\d+)-(\d+)", part)
        out += [str(y) for y in range(int(m[1]), int(m[2]) + 1)] if m else [part]
    return out


def prefer(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, as of translated files before raw ones (S9); the last if none does."""
    return next((p for p in paths if exists(spark, p)), paths[-1])


def dictionary(spark: SparkSession, text: str) -> DataFrame:
    """Dictionary rows from YAML text (S6, F30): entries are plain words, or give he, src and more."""
    import yaml

    rows = []
    for category, entries in (yaml.safe_load(text) or {}).items():
        for en, x in (entries or {}).items() if isinstance(entries, dict) else ():
            x = x if isinstance(x, dict) else {"he": x}
            rows.append((str(category), str(en), *(None if x.get(k) is None else str(x[k]) for k in ("he", "src", "confidence", "wikidata_qid", "note"))))
    return spark.createDataFrame(rows, "category string, en string, he string, src string, confidence string, wikidata_qid string, note string")


def dictionary_text(df: DataFrame, order: Sequence[str] | None = None, limit: int = 1_000_000) -> str:
    """YAML of a dictionary (K4): keys sorted, or entries as `order` puts them; over `limit` entries are an error, not cut."""
    import yaml

    out: dict = {}
    rows = (df.orderBy(*order) if order else df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} entries; write them as lines")
    for r in rows:
        entry = {k: r[k] for k in ("he", "src", "confidence", "wikidata_qid", "note")}
        out.setdefault(r["category"], {})[r["en"]] = entry
    return yaml.safe_dump(out, allow_unicode=True, sort_keys=order is None, default_flow_style=False)


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows: all required columns non-empty, or not."""
    ok = F.lit(True)
    for c in required:
        ok = ok & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return df.filter(ok), df.filter(~ok)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, overwriting (K1, K2); an empty frame leaves an empty folder with its marker."""
    df.write.mode("overwrite").json(path)


def write_pretty(df: DataFrame, limit: int = 100_000) -> str:
    """A pretty JSON array of a bounded result (K3); more rows than the limit are an error, not cut."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them as lines")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2)


def purge(spark: SparkSession, base: str, seasons: Sequence[str]) -> int:
    """Deletes the folders of seasons that are to be read anew (T4); how many there were."""
    n = 0
    for s in seasons:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", s):
            raise ValueError(f"not a season: {s!r}")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{s}")
        n += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def has_rows(spark: SparkSession, path: str) -> bool:
    """T5: an output exists, reads, and holds something; one row decides."""
    try:
        return exists(spark, path) and not spark.read.text(path).filter(F.length(F.trim("value")) > 2).isEmpty()
    except AnalysisException:
        return False


def expect_rows(df: DataFrame, name: str, critical: bool) -> bool:
    """An empty critical source is an error, another one is reported as False."""
    empty = df.isEmpty()
    if empty and critical:
        raise ValueError(f"{name} is empty")
    return not empty


def counters(actions: DataFrame, step: str = "step", action: str = "action") -> DataFrame:
    """(step, action, n) with totals per step and in all."""
    return actions.rollup(step, action).agg(F.count("*").alias("n"))


def seed_digest(parts: DataFrame, column: str = "text") -> DataFrame:
    """K9: one digest of all parts, whatever their order: SHA-256 over the digests of 65,536 buckets of sorted hashes."""
    each = parts.select(F.sha2(F.col(column).cast("binary"), 256).alias("h")).withColumn("b", F.left("h", F.lit(4)))
    told = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    return each.groupBy("b").agg(told("h").alias("d")).select(F.concat("b", "d").alias("d")).agg(told("d").alias("digest"))
