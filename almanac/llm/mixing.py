"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by cell of source, language and topic.  Raking scales the cells in turn
until each marginal meets its target; a cell's scaled tokens over its own are its factor.
Documents are then sampled with probabilities in proportion to their cell's factor, so the
expected sample has the target shares.  Its size is the budget, or less where a larger sample
with these shares would ask for some cell's tokens more than once.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

log = logging.getLogger(__name__)

DIMS = ("source", "lang", "topic")
#: Topics by the first condition that holds, over text and its n_tokens words.
TOPICS: tuple[tuple[str, str], ...] = (
    ("empty", "n_tokens = 0"),
    ("table", "5 * (length(text) - length(replace(text, '|', ''))) > n_tokens"),
    ("legal", "contains(lower(text), 'license') OR contains(lower(text), 'copyright')"),
    ("note", "n_tokens < 100"),
    ("article", "n_tokens < 1000"),
)
ELSE = "book"
#: A marginal's target is its share of tokens to this power, made to sum to one.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Up to so many cells one task rakes them, and they are broadcast; beyond, both are shuffled joins.
FEW = 100_000
NONE = "(none)"


def _described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(doc, source, lang, topic, n_tokens, u): each document as a struct; u is uniform in [0, 1), a hash of the id, of the text for null ids."""
    rows = docs.select(F.struct("*").alias("doc"))
    text = F.coalesce(F.col("doc")[text_col].cast("string"), F.lit(""))
    seed = F.concat(F.lit("mix:"), F.coalesce(F.col("doc")[id_col].cast("string"), text)).cast("binary")
    rows = rows.select(
        "doc",
        F.coalesce(F.col("doc")[source_col].cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("doc")[lang_col].cast("string"), F.lit(NONE)).alias("lang"),
        text.alias("text"),
        F.size(F.filter(F.split(text, SPACE, -1), lambda x: x != "")).cast("long").alias("n_tokens"),
        (F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("u"),
    )
    topic = F.expr("CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in TOPICS) + f" ELSE '{ELSE}' END")
    return rows.withColumn("topic", topic).drop("text")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, u) of every document."""
    return _described(docs, id_col, text_col, source_col, lang_col).select(F.col("doc")[id_col].cast("long").alias("doc_id"), *DIMS, "n_tokens", "u")


def targets(cells: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """(dim, value, share): default target of every value of every dimension, from the cells' own tokens."""
    out = None
    for dim in DIMS:
        sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow("t", F.lit(float(powers[dim]))))
        total = sums.agg(F.sum("p")).first()[0] or 1.0
        part = sums.select(F.lit(dim).alias("dim"), "value", (F.col("p") / F.lit(total)).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


class Contradiction(ValueError):
    """Targets that no weights on the cells at hand can meet."""


def rake(cells: DataFrame, wanted: DataFrame, sweeps: int = 4, most: int = 400, tolerance: float = 1e-10) -> DataFrame:
    """The cells with w, their tokens' share after raking to the wanted shares.

    Targets of values without tokens are left out and the others made to sum to one.  Cells
    without tokens, or of values without a target, weigh nothing.  Ends when no marginal
    is off by more than the tolerance, relatively; raises Contradiction where that isn't
    reached in `most` sweeps, or the sweeps bring no marginal nearer.  Each few sweeps are cut into the shared folder.
    """
    for dim in DIMS:
        present = cells.filter("tokens > 0").select(dim).distinct()
        share = wanted.filter(F.col("dim") == dim).select(F.col("value").alias(dim), F.col("share").alias(f"t_{dim}")).join(present, dim, "left_semi")
        total = share.agg(F.sum(f"t_{dim}")).first()[0] or 1.0
        cells = cells.join(share.withColumn(f"t_{dim}", F.col(f"t_{dim}") / F.lit(float(total))), dim, "left")
    cells = cells.na.fill(0.0, [f"t_{d}" for d in DIMS]).withColumn("w", F.col("tokens").cast("double"))
    cells = cut(cells)
    few = cells.count() <= FEW
    if few:
        cells = cut(cells.coalesce(1))  # one partition meets every grouping: no shuffle below
    offs: list[float] = []
    while len(offs) * sweeps < most and (len(offs) < 4 or offs[-1] <= 0.9 * offs[-4]):  # beyond that they don't settle
        for dim in DIMS * sweeps:
            if few:
                cells = cells.withColumn("s", F.sum("w").over(Window.partitionBy(dim)))
            else:  # sums combine before their shuffle; lineage is cut each time, as it is used twice
                cells = cut(cells)
                cells = cells.join(cells.groupBy(dim).agg(F.sum("w").alias("s")), dim)
            cells = cells.withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col(f"t_{dim}") / F.col("s")).otherwise(0.0)).drop("s")
        cells = cut(cells)
        sums = (cells.groupBy(dim).agg(F.sum("w").alias("s"), F.first(f"t_{dim}").alias("t"), F.sum("tokens").alias("n")).drop(dim) for dim in DIMS)
        off = reduce(DataFrame.union, sums).filter("n > 0 AND t > 0").agg(F.max(F.abs(F.col("s") / F.col("t") - 1))).first()[0] or 0.0
        if off <= tolerance:
            return cells
        offs.append(off)
    raise Contradiction(f"after {len(offs) * sweeps} sweeps a marginal is off its target by {off:.2g} of it: the targets contradict each other")


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """The cells with their factor and p = scale * factor, one scale for all, so that shares stay as raked.

    The expected tokens are the budgeted share of all; where that would put a p above one, the
    scale is the largest that doesn't.
    """
    cells = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    total, weight, top = cells.agg(F.sum("tokens"), F.sum("w"), F.max("factor")).first()
    scale = min(budget * total / weight, 1 / top) if top else 0.0
    # Cells without tokens hold empty documents only, which cost nothing: they stay.
    return cells.withColumn("p", F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("factor") * float(scale))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", budget: float = 0.8, wanted: DataFrame | None = None, powers: dict[str, float] = POWERS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, p, kept) of every document.

    `wanted` may give (dim, value, share) targets of one's own, which raise Contradiction where
    nothing can meet them; by default they are the powers of the present shares, drawn halfway
    to the present shares as often as they contradict each other.  Defined cases: a null source
    or language is a value of its own; a null text counts as empty; documents without words
    cost nothing and stay; repeated rows share their fate; values without a target are not
    drawn; an empty table gives no rows; other columns may have any names.
    """
    rows = described(docs, id_col, text_col, source_col, lang_col)
    done = plan(rows, budget, wanted, powers)
    return rows.join(done, list(DIMS)).select("doc_id", *DIMS, "n_tokens", "p", (F.col("u") < F.col("p")).alias("kept"))


def _raked(cells: DataFrame, powers: dict[str, float], halvings: int = 4) -> DataFrame:
    """The cells raked to the default targets, or to what lies between these and the present shares."""
    wanted, present = targets(cells, powers), targets(cells, dict.fromkeys(DIMS, 1.0)).withColumnRenamed("share", "now")
    both = cut(wanted.join(present, ["dim", "value"]))
    for i in range(halvings):
        part = 0.5**i
        try:
            return rake(cells, both.select("dim", "value", (F.col("share") * part + F.col("now") * (1 - part)).alias("share")))
        except Contradiction as e:
            log.warning("default targets at %g of their way: %s", part, e)
    return rake(cells, both.select("dim", "value", F.col("now").alias("share")))


def plan(rows: DataFrame, budget: float, wanted: DataFrame | None = None, powers: dict[str, float] = POWERS) -> DataFrame:
    """(source, lang, topic, p) for described documents; marked for broadcast where the cells are few."""
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    done = cut(probabilities(_raked(cells, powers) if wanted is None else rake(cells, wanted), budget)).select(*DIMS, "p")
    return F.broadcast(done) if done.count() <= FEW else done


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", budget: float = 0.8, wanted: DataFrame | None = None, powers: dict[str, float] = POWERS) -> DataFrame:
    """The documents that the mixture keeps, all columns kept; documents meet their cell's probability in place.

    Defined cases are those of mix: documents without words stay, null ids are drawn by their
    text, repeated rows stay or go together, an empty table gives no rows.
    """
    done = plan(described(docs, id_col, text_col, source_col, lang_col), budget, wanted, powers)
    hits = _described(docs, id_col, text_col, source_col, lang_col).join(done, list(DIMS))
    return hits.filter("u < p").select("doc.*")


def _sql(budget: float = 0.8, sweeps: int = 40) -> str:
    """The same in DuckDB: sweeps written out."""
    topic = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t in TOPICS) + f" ELSE '{ELSE}' END"
    steps, last = [], "r0"
    for i in range(sweeps * len(DIMS)):
        d = DIMS[i % len(DIMS)]
        rest = ", ".join(f"t_{x}" for x in DIMS)
        steps.append(f"r{i + 1} AS (SELECT {', '.join(DIMS)}, tokens, {rest}, CASE WHEN s > 0 THEN w * t_{d} / s ELSE 0 END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {d}) AS s FROM {last}))")
        last = f"r{i + 1}"
    shares = ", ".join(f"m_{d} AS (SELECT {d}, pow(sum(tokens), {POWERS[d]}) / sum(pow(sum(tokens), {POWERS[d]})) OVER () AS t_{d} FROM cells GROUP BY {d} HAVING sum(tokens) > 0)" for d in DIMS)
    return rf"""
WITH d0 AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, n_tokens,
            CAST('0x' || substr(md5('mix:' || cast(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM d0),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
{shares},
r0 AS (SELECT cells.*, coalesce(t_source, 0) AS t_source, coalesce(t_lang, 0) AS t_lang, coalesce(t_topic, 0) AS t_topic, tokens AS w
       FROM cells LEFT JOIN m_source USING (source) LEFT JOIN m_lang USING (lang) LEFT JOIN m_topic USING (topic)),
{", ".join(steps)},
f AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS factor FROM {last}),
z AS (SELECT least({budget} * sum(tokens) / sum(tokens * factor), 1 / max(factor)) AS scale FROM f)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS p, u < p AS kept
FROM d JOIN (SELECT *, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, factor * scale) END AS p FROM f, z) c
  ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic"""


SQL = _sql()
