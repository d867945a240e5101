"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans come from three patterns.  Weak candidates (short values, plain account names) are
no secrets by themselves; an interval join over positions reports one only where the other
two parts of a credential, of identifier, secret and endpoint, begin within its scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

#: Base patterns (fixed by the query contract): value is group 1 of assign.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run is maximal, so asking for 16 drops just the shorter runs
#: Parts that only count in company.
ACCOUNT = r"""(?i:user_?name|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[^\s\"'<>]{4,}|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret")
SPAN = "struct<start:int,kind:int,stop:int>"


@dataclass(frozen=True)
class Rules:
    """min_value and min_access are the contract's lengths; weak secrets have weak_value characters at least; scope is in code points."""

    min_value: int = 12
    min_access: int = 18
    weak_value: int = 6
    scope: int = 256


def _found(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def _between(text: str, found: str, pattern: str) -> Column:
    """What stands before, between and after the matches; split only where there are any."""
    return F.when(F.size(found) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>"))


def _places(found: str, between: str, block: int = 256) -> Column:
    """Array of (start, stop, hit) of all matches: running lengths, in blocks so that long lists don't cost their square."""
    step = f"""(a, k) -> named_struct(
        'pos', a.pos + char_length({between}[k]) + char_length({found}[k]),
        'out', array_append(a.out, named_struct('start', a.pos + char_length({between}[k]), 'stop', a.pos + char_length({between}[k]) + char_length({found}[k]), 'hit', {found}[k])))"""
    inner = f"""aggregate(sequence(b * {block}, least(size({found}), b * {block} + {block}) - 1),
        named_struct('pos', coalesce(try_element_at(done, -1).pos, 0), 'out', cast(array() as array<struct<start:int,stop:int,hit:string>>)), {step})"""
    return F.expr(f"""CASE WHEN size({found}) > 0 THEN flatten(transform(
        aggregate(sequence(0, (size({found}) - 1) div {block}), cast(array() as array<struct<pos:int,out:array<struct<start:int,stop:int,hit:string>>>>),
                  (done, b) -> array_append(done, {inner})), x -> x.out)) ELSE array() END""")


def _spans(places: str, kind: int, keep: str = "true") -> Column:
    return F.expr(f"transform(filter({places}, x -> {keep}), x -> named_struct('start', x.start, 'kind', {kind}, 'stop', x.stop))").cast(f"array<{SPAN}>")


#: Length of the value of an assign match `x.hit`.
SIZE = f"char_length(regexp_extract(x.hit, r'{ASSIGN.replace(chr(39), chr(92) + 'x27')}', 1))"


def _base(assign: str, access: str, hexes: str, rules: Rules) -> Column:
    """Base spans of the places of the three patterns, in order."""
    return F.array_sort(F.concat(_spans(assign, 0, f"{SIZE} >= {rules.min_value}"), _spans(access, 1, f"char_length(x.hit) >= {rules.min_access}"), _spans(hexes, 2)))


def _key(id_: Column, text: Column) -> Column:
    """Names a document by its id and text; rows of equal id and text share it and its spans."""
    return F.concat(F.coalesce(id_.cast("string"), F.lit("-")), F.lit(":"), F.md5(text.cast("binary")), F.lit(":"), F.length(text).cast("string"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, base, added) of every document: arrays of (start, kind, stop), kinds by their place in KINDS.

    Positions count code points and stops are exclusive.  Defined cases: null texts count as
    empty and have no spans; repeated rows come back as often as given, with the same spans;
    an empty table gives no rows.
    """
    return _scan(docs, id_col, text_col, rules).drop("key")


def _scan(docs: DataFrame, id_col: str, text_col: str, rules: Rules) -> DataFrame:
    """As scan, with the key of documents that hold all parts of a credential somewhere, null for others."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"m0": _found("text", ASSIGN), "m1": _found("text", ACCESS), "m2": _found("text", HEX)})
    some = F.size("m0") + F.size("m2") > 0  # no credential without a secret part
    none = F.array().cast("array<string>")
    rows = rows.withColumn("m3", F.when(some, _found("text", ACCOUNT)).otherwise(none))
    whole = some & (F.size("m1") + F.size("m3") > 0)
    rows = rows.withColumn("m4", F.when(whole, _found("text", ENDPOINT)).otherwise(none))
    patterns = [ASSIGN, ACCESS, HEX, ACCOUNT, ENDPOINT]
    rows = rows.withColumns({f"b{i}": _between("text", f"m{i}", p) for i, p in enumerate(patterns)})
    rows = rows.withColumns({f"p{i}": _places(f"m{i}", f"b{i}") for i in range(5)})
    rows = rows.withColumns(
        {
            "base": _base("p0", "p1", "p2", rules),
            "weak": F.concat(_spans("p3", 3), _spans("p0", 4, f"{SIZE} between {rules.weak_value} and {rules.min_value - 1}")),
            "ends": F.when(F.size("p4") > 0, F.expr("transform(p4, x -> x.start)")).otherwise(F.array().cast("array<int>")),
        }
    )
    open_ = (F.size("weak") > 0) & (F.size("ends") > 0)
    key = F.when(open_, _key(F.col("doc_id"), F.col("text")))
    kept = cut(rows.select("doc_id", "base", F.when(open_, F.col("weak")).alias("weak"), F.when(open_, F.col("ends")).alias("ends"), key.alias("key")))
    plain = kept.filter("key is null").select("doc_id", "key", "base", F.array().cast(f"array<{SPAN}>").alias("added"))
    linked = kept.filter("key is not null")
    added = _linked(linked.dropDuplicates(["key"]), rules)
    joined = linked.join(added, "key", "left").select("doc_id", "key", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))
    return plain.unionByName(joined)


def _linked(rows: DataFrame, rules: Rules) -> DataFrame:
    """(key, added): weak candidates with both complementary parts beginning within the scope.

    Positions are dealt into buckets as wide as the scope.  Of each bucket only its first and
    last position by role are kept, which decides the join exactly: all of a candidate's own
    bucket is in scope, of the bucket before the last position decides, of the next the first.
    """
    w = rules.scope
    role = F.expr("CASE WHEN x.kind IN (1, 3) THEN 'id' ELSE 'secret' END")
    parts = rows.select("key", F.explode(F.concat("base", "weak")).alias("x")).select("key", role.alias("role"), "x.start")
    parts = parts.unionByName(rows.select("key", F.lit("endpoint").alias("role"), F.explode("ends").alias("start")))
    edges = parts.groupBy("key", "role", F.floor(F.col("start") / w).alias("bucket")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    asked = rows.select("key", F.explode("weak").alias("x")).select("key", "x", role.alias("own"), F.explode(F.expr(f"transform(array(-1, 0, 1), d -> named_struct('d', d, 'bucket', cast(floor(x.start / {w}) as bigint) + d))")).alias("y"))
    asked = asked.select("key", "x", "own", "y.d", "y.bucket")
    near = asked.join(edges, ["key", "bucket"]).filter(f"role <> own AND CASE d WHEN -1 THEN high >= x.start - {w} WHEN 1 THEN low <= x.start + {w} ELSE true END")
    both = near.groupBy("key", "x").agg(F.max(F.col("role") == "endpoint").alias("end"), F.max(F.col("role") != "endpoint").alias("part")).filter("end AND part")
    return both.groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("added"))


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak_id, n_weak_secret) of every document."""
    found = scan(docs, **how)
    count = lambda column, kind: F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
        *(count("added", i).alias(f"n_{k}") for i, k in enumerate(KINDS) if i > 2),
    )


def _masked(text: str, spans: str, mark: str, block: int = 2048) -> Column:
    """The text with each maximal interval of its spans' union replaced by a mark.

    Of sorted starts and stops an interval ends at the i-th stop if the next start isn't before
    it.  Pieces are taken from blocks, so long texts with many spans don't cost their square.
    """
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    ends = f"named_struct('a', array_sort(transform({spans}, x -> x.start)), 'o', array_sort(transform({spans}, x -> x.stop)))"
    gaps = "filter(zip_with(slice(u.o, 1, size(u.o) - 1), slice(u.a, 2, size(u.a) - 1), (o, a) -> IF(o <= a, named_struct('low', o, 'high', a), NULL)), x -> x IS NOT NULL)"
    kept = f"concat(array(named_struct('low', 0, 'high', element_at(u.a, 1))), g, array(named_struct('low', element_at(u.o, -1), 'high', char_length({text}))))"
    piece = f"substring(array_join(slice(bl, cast(z.low div {block} as int) + 1, cast(z.high div {block} - z.low div {block} as int) + 1), ''), z.low % {block} + 1, z.high - z.low)"
    whole = let("bl", f"regexp_extract_all({text}, '(?s).{{1,{block}}}', 0)", f"array_join(transform({kept}, z -> {piece}), '{mark}')")
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {let('u', ends, let('g', gaps, whole))} ELSE {text} END")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns kept, with each base and linked weak span of a text replaced by a mark; null texts stay null.

    All spans are those that scan finds in the untouched text; spans that overlap become one
    mark.  Texts stay where they are while the documents with weak spans are few enough to be
    broadcast.  Repeated rows are masked alike; an empty table gives no rows; other columns may
    have any names.
    """
    weak = cut(_scan(docs, id_col, text_col, rules).filter(F.size("added") > 0).select(F.col("key").alias("_sec_key"), F.col("added").alias("_sec_added")).dropDuplicates(["_sec_key"]))
    doc = lambda c: F.col("_sec_doc")[c]
    rows = docs.select(F.struct("*").alias("_sec_doc")).withColumn("_sec_t", F.coalesce(doc(text_col).cast("string"), F.lit("")))
    out = rows.withColumn("_sec_key", _key(doc(id_col).cast("long"), F.col("_sec_t"))).join(small_side(weak), "_sec_key", "left")
    for i, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        out = out.withColumn(f"_sec_m{i}", _found("_sec_t", pattern))
        out = out.withColumn(f"_sec_b{i}", _between("_sec_t", f"_sec_m{i}", pattern))
        out = out.withColumn(f"_sec_p{i}", _places(f"_sec_m{i}", f"_sec_b{i}"))
    none = F.array().cast(f"array<{SPAN}>")
    out = out.withColumn("_sec_spans", F.concat(_base("_sec_p0", "_sec_p1", "_sec_p2", rules), F.coalesce("_sec_added", none)))
    masked = F.when(doc(text_col).isNotNull(), _masked("_sec_t", "_sec_spans", mark))
    return out.select(*((masked if c == text_col else doc(c)).alias(c) for c in docs.columns))


def _sql(rules: Rules = Rules()) -> str:
    """The same in DuckDB: matches and the pieces between them give places, a plain join on positions links parts."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = []
    for i, p in enumerate((ASSIGN, ACCESS, HEX, ACCOUNT, ENDPOINT)):
        kinds.append(f"SELECT k, {i} AS part, regexp_extract_all(t, {quoted(p)}) AS m, regexp_split_to_array(t, {quoted(p)}) AS b FROM d")
    told = lambda where: f"string_agg(['assign', 'access', 'hex', 'weak_id', 'weak_secret'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) {where}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
placed AS (SELECT k, part, m[i] AS hit, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
           FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0)),
sized AS (SELECT *, start + length(hit) AS stop, CASE WHEN part = 0 THEN length(regexp_extract(hit, {quoted(ASSIGN)}, 1)) ELSE length(hit) END AS size FROM placed),
spans AS (SELECT k, start, stop, CASE WHEN part = 3 THEN 3 WHEN part = 0 AND size < {rules.min_value} THEN 4 ELSE part END AS kind,
                 CASE part WHEN 4 THEN 'endpoint' WHEN 1 THEN 'id' WHEN 3 THEN 'id' ELSE 'secret' END AS role
          FROM sized WHERE (part = 0 AND size >= {rules.weak_value}) OR (part = 1 AND size >= {rules.min_access}) OR part = 2 OR part = 3 OR part = 4),
parts AS (SELECT k, start, stop, CASE WHEN role = 'endpoint' THEN 9 ELSE kind END AS kind, role FROM spans),
linked AS (SELECT a.k, a.start, a.stop, a.kind FROM parts a WHERE a.kind IN (3, 4)
           AND EXISTS (SELECT 1 FROM parts e WHERE e.k = a.k AND e.role = 'endpoint' AND abs(e.start - a.start) <= {rules.scope})
           AND EXISTS (SELECT 1 FROM parts o WHERE o.k = a.k AND o.role <> 'endpoint' AND o.role <> a.role AND abs(o.start - a.start) <= {rules.scope})),
whole AS (SELECT k, start, stop, kind FROM parts WHERE kind < 3 UNION ALL SELECT * FROM linked),
sums AS (SELECT k, {told("FILTER (WHERE kind < 3)")} AS base, {told("")} AS spans, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n{i}" for i in range(5))} FROM whole GROUP BY k)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n3, 0)::BIGINT AS n_weak_id, coalesce(n4, 0)::BIGINT AS n_weak_secret
FROM d LEFT JOIN sums USING (k)"""


SQL = _sql()
