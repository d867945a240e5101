"""Quality rules as a ledger of failure bits and measurements, in DataFrame operations only.

Every rule is evaluated once; its outcome is one bit of a mask kept beside the measurements.
Policies are versioned masks: applying one, or asking what leaving out a rule would change, is
bit arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Rule names by bit, with the SQL condition over the measurements under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "2 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 9 * n_lines"),
    ("shouting", "10 * n_shouted > 6 * n_words AND n_words > 0"),
    ("too_many_words", "n_words > 200000"),
)
BASE = ("too_few_words", "repeated_windows")
#: Versions of what a document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "short_words", "long_words", "repeated_lines"),
    "v2": (*BASE, "many_symbols", "short_words", "long_words", "repeated_lines", "shouting"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted")


def bits(names: tuple[str, ...]) -> int:
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements) of every whole text.

    Repeated windows are first sought among 64-bit hashes; only texts with a repeated hash
    have their windows sorted, as strings, so the count is exact.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("w", F.filter(F.split("text", SPACE, -1), lambda x: x != ""))
    rows = rows.withColumn("h", F.expr("CASE WHEN size(w) > 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE cast(array() as array<bigint>) END"))
    rows = rows.withColumn("s", F.expr("""CASE WHEN size(h) > size(array_distinct(h))
        THEN array_sort(transform(sequence(0, size(w) - 3), i -> named_struct('s', concat(w[i], ' ', w[i + 1], ' ', w[i + 2]), 'i', i)))
        ELSE cast(array() as array<struct<s:string,i:int>>) END"""))
    rows = rows.withColumn("r", F.expr("""filter(transform(s, (x, k) -> CASE WHEN (k > 0 AND s[greatest(k - 1, 0)].s = x.s) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].s = x.s) THEN x.i END), x -> x IS NOT NULL)"""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    kept = "text"
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate(kept, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(kept) - F.char_length(F.translate(kept, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(array_distinct(flatten(transform(r, x -> array(x, x + 1, x + 2)))))").cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: (F.char_length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x)))).cast("long").alias("n_shouted"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failed): the mask of failed rules of every document.

    Defined cases: a null text has no words, so it fails too_few_words only; repeated rows come
    back as often as given; an empty table gives no rows.
    """
    mask = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failed", mask)


def judge(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept, under a version of the policy."""
    return rows.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(F.lit(bits(BASE))) != 0,
            "kept": F.col("failed").bitwiseAND(F.lit(bits(POLICIES[policy]) | bits(BASE))) == 0,
        }
    )


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept_without): per rule, who fails it, who fails nothing else, and what a policy without it would keep.

    Masks are counted first: at most 2^rules rows go on from there, however large the ledger.
    """
    mask = bits(POLICIES[policy])
    seen = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1))
    each = seen.select("failed", "n", F.explode(rules).alias("x")).select("failed", "n", "x.rule", "x.bit")
    hit = lambda test: F.sum(F.when(F.expr(test), F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("rule").agg(
        hit("failed & bit != 0").alias("n_failed"), hit("failed = bit").alias("n_only"), hit("failed & ~bit = 0").alias("n_kept_without")
    ).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only", "n_kept_without")


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
          SELECT doc_id, unnest([p, p + 1, p + 2]) AS q
          FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1)
        GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))::BIGINT AS n_shouted
  FROM d LEFT JOIN rep USING (doc_id)),
l AS (SELECT *, (""" + " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES)) + rf""")::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {bits(BASE)}) <> 0 AS base_failed,
       (failed & {bits(POLICIES["v1"])}) = 0 AS kept, failed, n_lines, n_shouted
FROM l"""

#: Ablations of a policy in DuckDB: each of its rules in turn over the ledger's masks.
ABLATIONS = f"WITH ledger AS ({SQL}), m AS (SELECT failed & {bits(POLICIES['v1'])} AS f FROM ledger)" + " UNION ALL ".join(
    f" SELECT 'v1' AS policy, '{name}' AS rule, count(*) FILTER (f & {1 << i} <> 0) AS n_failed, count(*) FILTER (f = {1 << i}) AS n_only, count(*) FILTER (f & ~{1 << i} = 0) AS n_kept_without FROM m"
    for i, (name, _) in enumerate(RULES)
    if bits(POLICIES["v1"]) >> i & 1
)
