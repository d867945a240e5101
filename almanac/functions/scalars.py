"""Scalar rules as Column expressions; all are null-safe and run inside Spark's own engine.

Python's strip and \\s treat more characters as space than Spark's trim does, so trimming
here is by regular expression with Unicode classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def nullif_empty(x: Column | str) -> Column:
    return F.when(_c(x) != "", _c(x))


def or_else(*xs: Column | str) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*(nullif_empty(x) for x in xs))


def lookup(x: Column | str, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed table; the default, or null, for other keys."""
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    found = F.try_element_at(pairs, _c(x))
    return found if default is None else F.coalesce(found, default)


# --- names and text -----------------------------------------------------------------------


def is_youth_club(name: Column | str) -> Column:
    """a trailing youth marker, in Latin or Hebrew script; null and empty are not youth."""
    return F.coalesce(_c(name).rlike(C.YOUTH_LATIN) | _c(name).rlike(C.YOUTH_HEBREW), F.lit(False))


def fee_text(raw: Column | str) -> Column:
    """fee words in Hebrew, loan fees with their amount, all else as it is; null is empty."""
    s = strip(raw)
    amount = F.regexp_extract(s, r"(?i)^Loan fee:.*?<i[^>]*>(€[^<]+)</i>", 1)
    return F.when(s.isNull() | (s == ""), F.lit("")).when(amount != "", F.concat(F.lit(f"{C.LOAN_FEE_WORDS}: "), amount)).otherwise(lookup(F.lower(s), C.FEE_WORDS, s))


def is_loan(fee: Column | str) -> Column:
    """The fee mentions a loan, in any case; a null fee does not."""
    return F.coalesce(F.lower(_c(fee)).contains("loan"), F.lit(False))


def is_all_hebrew(text: Column | str) -> Column:
    """Hebrew block and white space only; null and empty are not."""
    return F.coalesce(_c(text).rlike(r"(?U)^[֐-׿\s]+\z"), F.lit(False))


def is_latin(text: Column | str) -> Column:
    """over half of the letters stand below U+0250."""
    letters = F.length(F.regexp_replace(_c(text), r"\P{L}", ""))
    low = F.length(F.regexp_replace(_c(text), r"[^A-ɏ]|\P{L}", ""))
    return F.coalesce((letters > 0) & (low * 2 > letters), F.lit(False))


def transliterate(text: Column | str) -> Column:
    """Latin letters to Hebrew, pairs first; words joined by single spaces, other characters kept."""
    s = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    # Private-use stand-ins keep a replacement from being read again.
    for i, (pair, _) in enumerate(C.PAIRS_HEBREW.items()):
        s = F.regexp_replace(s, f"(?i){pair}", chr(0xE000 + i))
    for i, (_, he) in enumerate(C.PAIRS_HEBREW.items()):
        s = F.regexp_replace(s, chr(0xE000 + i), he)
    single = {k: v for k, v in C.LETTERS_HEBREW.items() if len(v) == 1}
    s = F.translate(s, "".join(single) + "".join(single).upper(), "".join(single.values()) * 2)
    for k, v in C.LETTERS_HEBREW.items():
        if k not in single:
            s = F.regexp_replace(s, f"(?i){k}", v)
    return s


def clean_label(raw: Column | str) -> Column:
    """bidi marks and a trailing football note go."""
    return strip(F.regexp_replace(F.regexp_replace(_c(raw), r"[‎‏‪-‮⁦-⁩]", ""), r"(?U)\s*\(כדורגל[^)]*\)\s*$", ""))


def search_variants(query: Column | str) -> Column:
    """the query, the query with spaces after digit-dot, and that with spaces collapsed; each once, in order."""
    spaced = F.regexp_replace(_c(query), r"(\d\.)([A-Z])", "$1 $2")
    collapsed = strip(F.regexp_replace(_c(query), r"(?U)\s+", " "))
    return F.filter(F.array_distinct(F.array(_c(query), spaced, collapsed)), lambda x: x.isNotNull() & ((x != "") | (x == _c(query))))


def club_is(name: Column | str, keywords: tuple[str, ...] = C.OWN_CLUB) -> Column:
    """The name holds one of the keywords, in any case."""
    low = F.lower(_c(name))
    return F.coalesce(reduce(lambda a, b: a | b, (low.contains(k) for k in keywords)), F.lit(False))


def direction(source: Column | str, target: Column | str, keywords: tuple[str, ...] = C.OWN_CLUB) -> Column:
    """P8: 'in' if the target is the own club, else 'out' if the source is, else null."""
    return F.when(club_is(target, keywords), F.lit("in")).when(club_is(source, keywords), F.lit("out"))


def position_line(position: Column | str) -> Column:
    """Line of a position, OTHER for unknown and null ones."""
    return lookup(F.coalesce(_c(position), F.lit("")), C.POSITION_LINE, F.lit("OTHER"))


def redact(text: Column | str, names: tuple[str, ...] = ("api_key", "apikey", "token", "key")) -> Column:
    """values of secret parameters in urls and messages."""
    return F.regexp_replace(_c(text), rf"(?i)\b({'|'.join(names)})=[^&\s]+", "$1=REDACTED")


def capitalized(text: Column | str) -> Column:
    """first letter raised, the rest lowered."""
    low = F.lower(_c(text))
    return F.concat(F.upper(F.left(low, F.lit(1))), F.right(low, F.greatest(F.length(low) - 1, F.lit(0))))


# --- scores and matches -------------------------------------------------------------------


def outcome(result: Column | str, venue: Column | str) -> Column:
    """win, loss or draw of the own club from 'home:away' and H or A; empty where either can't be read."""
    s = strip(result)
    at = F.instr(s, ":")
    number = lambda x: F.when(strip(x).rlike(r"^[+-]?\d+$"), strip(x).try_cast("int"))
    home = number(F.substring_index(s, ":", 1))
    away = number(F.regexp_replace(s, r"(?s)^[^:]*:", ""))
    side = F.upper(strip(venue))
    own, other = F.when(side == "H", home).when(side == "A", away), F.when(side == "H", away).when(side == "A", home)
    return F.when((at == 0) | home.isNull() | away.isNull() | own.isNull(), F.lit("")).when(own > other, "win").when(own < other, "loss").when(own == other, "draw").otherwise("")


def split_goals(raw: Column | str) -> tuple[Column, Column]:
    """'for:against' as two integers, nulls otherwise."""
    pattern = r"^\s*(\d+)\s*:\s*(\d+)\s*$"
    return tuple(F.regexp_extract(_c(raw), pattern, i).try_cast("int") for i in (1, 2))


def is_extra_time(note: Column | str) -> Column:
    """the scoreboard's note is a marker of extra time or penalties."""
    return F.coalesce(F.upper(strip(note)).isin(*C.EXTRA_TIME), F.lit(False))


def halftime(note: Column | str) -> Column:
    """a half-time score without its brackets; null for markers and all else."""
    s = strip(F.translate(_c(note), "()", ""))
    return F.when(~is_extra_time(note) & s.rlike(r"^\s*\d+\s*:\s*\d+\s*$"), s)


def went_extra(note: Column | str, penalties: Column | str, goals: Column | str) -> Column:
    """a marker, or penalties, or a goal after minute 90."""
    late = F.exists(_c(goals), lambda g: g["minute"].try_cast("int") > 90)
    return is_extra_time(note) | F.coalesce(F.size(_c(penalties)) > 0, F.lit(False)) | F.coalesce(late, F.lit(False))


def sprite_minute(style: Column | str) -> Column:
    """minute from a sprite's offsets in pixels; null unless there are two within the sheet."""
    both = F.transform(F.regexp_extract_all(_c(style), F.lit(r"-?\d+"), F.lit(0)), lambda x: F.abs(x.try_cast("int")))
    x, y = F.get(both, F.lit(0)), F.get(both, F.lit(1))
    return F.when((F.size(both) == 2) & (x < 360) & (y < 432), F.floor(y / 36) * 10 + F.floor(x / 36) + 1).cast("int")


def safe_title(title: Column | str) -> Column:
    """brackets and braces become parentheses, bars dashes; hashes go."""
    return F.translate(_c(title), "[]{}|#", "()()-")


def match_title(date: Column | str, opponent: Column | str, competition: Column | str) -> Column:
    """page title of a match; the competition in brackets where there is one."""
    day = or_else(il_date(date), date, F.lit(C.UNKNOWN_DATE))
    tail = F.when(F.coalesce(_c(competition), F.lit("")) != "", F.concat(F.lit(" ("), _c(competition), F.lit(")"))).otherwise("")
    return safe_title(F.concat(day, F.lit(f" {C.VERSUS} "), or_else(opponent, F.lit(C.UNKNOWN_OPPONENT)), tail))


# --- dates and seasons --------------------------------------------------------------------


def pivot_year(yy: Column | str, cutoff: int = C.PIVOT) -> Column:
    """a year of two digits in full; 100 and above as they are."""
    y = _c(yy)
    return F.when(y >= 100, y).when(y >= cutoff, y + 1900).otherwise(y + 2000)


#: What a text of each form looks like; a text is parsed by its own form only, since a failed attempt is dear.
_SHAPES = {
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMMM d, yyyy": r"^[A-Za-z]{4,} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,} \d{4}$",
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
}


def _parsed(s: Column, formats: tuple[str, ...]) -> Column:
    found = F.lit(None).cast("date")
    for f in reversed(formats):
        found = F.when(s.rlike(_SHAPES[f]), F.to_date(F.try_to_timestamp(s, F.lit(f)))).otherwise(found)
    return found


DATES = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")


def birth_date(raw: Column | str) -> Column:
    """date before an age in brackets; null unless a full date of a known form (none is guessed)."""
    return _parsed(strip(F.substring_index(_c(raw), " (", 1)), DATES)


def value_date(raw: Column | str) -> Column:
    """date of a market value, null where unreadable."""
    return _parsed(strip(raw), ("MMM d, yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"))


def il_date(raw: Column | str) -> Column:
    """F8: DD/MM/YYYY from ISO, dotted, slashed and weekday-prefixed dates; other texts as they are, null as empty."""
    s = F.regexp_replace(strip(raw), r"(?i)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+", "")
    short = r"^(\d{2})/(\d{2})/(\d{2})$"
    year = pivot_year(F.regexp_extract(s, short, 3).try_cast("int")).cast("string")
    return (
        F.when(s.isNull() | s.isin("", "?", "-"), F.lit(""))
        .when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), s)
        .when(s.rlike(short), F.concat(F.substring(s, 1, 6), year))
        .when(s.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.translate(s, ".", "/"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.regexp_replace(s, r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1"))
        .otherwise(F.coalesce(F.date_format(_parsed(s, ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")), "dd/MM/yyyy"), s))
    )


def season_display(season: Column | str) -> Column:
    """2024 as 2024/25; slashed and malformed labels as they are, null as empty."""
    s = strip(_c(season).cast("string"))
    return F.when(s.isNull() | (s == ""), F.lit("")).when(s.rlike(r"^\d+$"), F.concat(s.try_cast("long").cast("string"), F.lit("/"), F.right((s.try_cast("long") + 1).cast("string"), F.lit(2)))).otherwise(s)


def season_start(label: Column | str, four_digits: bool = True) -> Column:
    """'24/25', and '2024/25' if four digits are allowed, as the start year; null if malformed."""
    head = strip(F.substring_index(_c(label), "/", 1))
    ok = _c(label).contains("/") & head.rlike(r"^\d{4}$|^\d{1,2}$" if four_digits else r"^\d+$")
    return F.when(ok, pivot_year(head.try_cast("int")).cast("string"))


# --- numbers and ids ----------------------------------------------------------------------


def foot(raw: Column | str) -> Column:
    """right, left or both; null for all else."""
    s = F.lower(strip(raw))
    return F.when(s.isin("right", "left", "both"), s)


def height_cm(raw: Column | str) -> Column:
    """'1,78 m' in centimetres, rounded half to even; null if malformed."""
    s = strip(F.regexp_replace(F.translate(strip(raw), ", ", ". "), r"\s?m$", ""))
    return F.bround(s.try_cast("double") * 100).try_cast("int")


def attendance(raw: Column | str) -> Column:
    """F16: the digits as a number; null where there are none."""
    return F.regexp_replace(_c(raw), r"[^0-9]", "").try_cast("long")


def safe_int(raw: Column | str, default: int | None = None) -> Column:
    """whole text as an integer; dashes, empty and other texts give null or the default."""
    found = F.when(strip(raw).rlike(r"^[+-]?\d+$"), strip(raw).try_cast("int"))
    return found if default is None else F.coalesce(found, F.lit(default))


def first_int(raw: Column | str) -> Column:
    """the first run of digits."""
    return F.regexp_extract(_c(raw), r"(\d+)", 1).try_cast("int")


def tier(label: Column | str) -> Column:
    """tier of a league by its ordinal word."""
    s = F.lower(_c(label))
    return F.when(s.contains("first"), 1).when(s.contains("second"), 2).when(s.contains("third"), 3)


def tail_id(url: Column | str) -> Column:
    """what follows the last slash."""
    return F.element_at(F.split(_c(url), "/"), -1)


def player_link(url: Column | str) -> tuple[Column, Column]:
    """(id, name) from a profile link; the name from its slug."""
    player = nullif_empty(F.regexp_extract(_c(url), r"/spieler/(\d+)", 1))
    slug = nullif_empty(F.regexp_extract(_c(url), r"^(?:https?://[^/]+)?/([^/]+)/", 1))
    return player, F.initcap(F.translate(slug, "-", " "))


def win_rate(won: Column | str, played: Column | str) -> Column:
    """Share in percent, null with nothing played."""
    return F.when(_c(played) > 0, _c(won) * 100.0 / _c(played))


def percent_text(won: Column | str, played: Column | str) -> Column:
    """The share with one decimal, a dash with nothing played; halves go to the even digit."""
    return F.when(_c(played) > 0, F.format_string("%.1f%%", F.bround(win_rate(won, played), 1))).otherwise("—%")


def thousands(number: Column | str) -> Column:
    """a whole number in groups of three digits."""
    return F.format_number(_c(number).cast("long"), 0)


def listed(items: Column | str, separator: str = ", ") -> Column:
    """the non-null items of a list as one text."""
    return F.array_join(_c(items), separator)


# --- pages --------------------------------------------------------------------------------


def page_title(title: Column | str, namespace: Column | str) -> Column:
    """title with its namespace's prefix; an unknown namespace is an error."""
    prefix = F.try_element_at(F.create_map(*(F.lit(v) for kv in C.NAMESPACES.items() for v in kv)), _c(namespace).cast("int"))
    return F.when(prefix.isNotNull(), F.concat(prefix, _c(title))).otherwise(F.raise_error(F.concat(F.lit("unknown namespace "), F.coalesce(_c(namespace).cast("string"), F.lit("null")))).cast("string"))


def bare_title(title: Column | str) -> Column:
    """title without its namespace's prefix."""
    return F.regexp_replace(_c(title), r"^(Draft|Template|User|File|Category):", "")


def content_hash(text: Column | str) -> Column:
    """MD5 of the stripped text."""
    return F.md5(strip(text).cast("binary"))


def clean_html(html: Column | str) -> Column:
    """without token meta tags, cache-busting queries and time stamps."""
    s = F.regexp_replace(_c(html), r"(?i)<meta[^>]+(?:csrf|nonce|token)[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(s, r"\?[a-f0-9]{6,}\b", "?"), r"\bv=\d{10,}", "v=")


def page_fingerprint(html: Column | str) -> Column:
    """SHA-256 of the cleaned page."""
    return F.sha2(clean_html(html).cast("binary"), 256)


def own_edit(summary: Column | str, merged: bool = True) -> Column:
    """the summary's prefix is an import's or, if `merged`, a merge's."""
    s = F.regexp_replace(_c(summary), r"(?U)^\s+", "")
    found = s.startswith(C.IMPORT_SUMMARY) | s.startswith(C.MERGE_SUMMARY) if merged else s.startswith(C.IMPORT_SUMMARY)
    return F.coalesce(found, F.lit(False))


def section_ids(text: Column | str, marker: str = "managed-section") -> Column:
    """F32: ids of the sections that a page's start markers name, in order."""
    return F.regexp_extract_all(_c(text), F.lit(rf"(?is)<!--\s*{marker}\s+start:\s*([A-Za-z][A-Za-z0-9_-]*).*?-->"), F.lit(1))


def valid_section_id(x: Column | str) -> Column:
    """F32: a letter, then letters, digits, dashes and underscores."""
    return F.coalesce(_c(x).rlike(r"^[A-Za-z][A-Za-z0-9_-]*\z"), F.lit(False))


def revision_kind(namespace: Column | str, revision: Column | str, approved: Column | str) -> Column:
    """P25: any save of a draft is 'draft'; one of a main or template page newer than its approved revision 'update'; else null."""
    return F.when(_c(namespace) == 3000, "draft").when(_c(namespace).isin(0, 10) & (_c(revision) > _c(approved)), "update")
