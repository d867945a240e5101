"""Scalar rules on their boundary cases."""

import datetime
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanac.functions import scalars as S
from almanac.functions.terms import Matcher, countries


def over(spark, column, values, schema="a string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in df.select(column.alias("x")).collect()]


CASES = {
    "youth": (lambda: S.is_youth_club("a"), ["Benfica U17", "Sporting Yth.", "Sporting Sub-15", "x JUNIOR", "בנפיקה תחת 17", "ספורטינג נוער", "Benfica B", "Youthful", None, ""], [True] * 6 + [False] * 4),
    "fee": (lambda: S.fee_text("a"), ["free transfer", " End of loan ", "?", "-", "€350k", 'Loan fee:<br /><i class="x">€500k</i>', None, " "], ["העברה חופשית", "סוף השאלה", "", "", "€350k", "דמי השאלה: €500k", "", ""]),
    "loan": (lambda: S.is_loan("a"), ["End of LOAN", "free", None], [True, False, False]),
    "date": (lambda: S.il_date("a"), ["2024-07-25", "25/07/2024", "25.07.2024", "Thu 25/07/24", "25/07/87", "Aug 25, 2024", "?", None, "soon", ""], ["25/07/2024"] * 4 + ["25/07/1987", "25/08/2024", "", "", "soon", ""]),
    "display": (lambda: S.season_display("a"), ["2024", "1999", "2024/25", "", None, "abc"], ["2024/25", "1999/00", "2024/25", "", "", "abc"]),
    "start": (lambda: S.season_start("a"), ["49/50", "29/30", "30/31", "2024/25", "24", "x/y", None], ["1949", "2029", "1930", "2024", None, None, None]),
    "height": (lambda: S.height_cm("a"), ["1,78 m", "1.78m", "1,785 m", "abc", None], [178, 178, 178, None, None]),
    "birth": (lambda: S.birth_date("a"), ["Jan 5, 1999 (25)", "1999-01-05", "January", None], [datetime.date(1999, 1, 5)] * 2 + [None] * 2),
    "attendance": (lambda: S.attendance("a"), ["13,000", "0", "-", "", None], [13000, 0, None, None, None]),
    "foot": (lambda: S.foot("a"), [" Right", "both", "none", None], ["right", "both", None, None]),
    "int": (lambda: S.safe_int("a"), ["7", "-", "", " 12 ", "x1", None], [7, None, None, 12, None, None]),
    "tier": (lambda: S.tier("a"), ["First Tier", "second", "x"], [1, 2, None]),
    "hebrew": (lambda: S.is_all_hebrew("a"), ["שלום עולם", "abc", "", None], [True, False, False, False]),
    "latin": (lambda: S.is_latin("a"), ["abc", "שלום", "ab ש", "ab שש", "", None], [True, False, True, False, False, False]),
    "spelling": (lambda: S.transliterate("a"), ["Shalom  Max", "chen 7"], ["שאלומ מאקס", "צ'אנ 7"]),
    "label": (lambda: S.clean_label("a"), ["אליאל פרץ‎‎", "דני (כדורגלן)", "דני (דובאי)"], ["אליאל פרץ", "דני", "דני (דובאי)"]),
    "variants": (lambda: S.search_variants("a"), ["1.FC Nuremberg", "a  b", "x"], [["1.FC Nuremberg", "1. FC Nuremberg"], ["a  b", "a b"], ["x"]]),
    "sprite": (lambda: S.sprite_minute("a"), ["background-position: -36px -72px;", "x", "-360px 0px", None], [22, None, None, None]),
    "half": (lambda: S.halftime("a"), ["(0:1)", "aet", "n.V.", "x", None], ["0:1", None, None, None, None]),
    "line": (lambda: S.position_line("a"), ["Left-Back", "Goalkeeper", "x", None], ["DF", "GK", "OTHER", "OTHER"]),
    "tail": (lambda: S.tail_id("a"), ["/a/spieler/12", "12"], ["12", "12"]),
    "bare": (lambda: S.bare_title("a"), ["Draft:X", "X:Y", "File:Z"], ["X", "X:Y", "Z"]),
    "hash": (lambda: S.content_hash("a"), [" abc\n", "abc"], ["900150983cd24fb0d6963f7d28e17f72"] * 2),
    "html": (lambda: S.clean_html("a"), ['<META name="csrf-token" content="1">a?abcdef12 v=1234567890', None], ["a? v=", None]),
    "own": (lambda: S.own_edit("a"), [" Auto-import: x", "Auto-merge: y", "fix", None], [True, True, False, False]),
    "clean": (lambda: S.own_edit("a", merged=False), ["Auto-import: x", "Auto-merge: y"], [True, False]),
    "sections": (lambda: S.section_ids("a"), ["<!-- managed-section start: abc v1 -->x<!-- managed-section end: abc --><!-- Managed-Section start: d -->"], [["abc", "d"]]),
    "ids": (lambda: S.valid_section_id("a"), ["a-b_1", "1a", "a b", None], [True, False, False, False]),
    "capital": (lambda: S.capitalized("a"), ["hELLO wORLD", "", None], ["Hello world", "", None]),
    "redact": (lambda: S.redact("a"), ["http://x?api_key=abc&b=1"], ["http://x?api_key=REDACTED&b=1"]),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    column, values, want = CASES[name]
    assert over(spark, column(), values) == want


def test_outcome(spark):
    values = [("2:1", "H"), ("2:1", "A"), ("1:1", "h"), ("2:1 (penalties)", "H"), ("2-1", "H"), (None, "H"), ("0:3", " A "), ("1:0", None), ("1:0", "N")]
    assert over(spark, S.outcome("a", "b"), values, "a string, b string") == ["win", "loss", "draw", "", "", "", "win", "", ""]


def test_direction_prefers_the_target(spark):
    values = [("x", "Hapoel Beer Sheva"), ("H. Beer Sheva", "y"), ("beer sheva", "beer sheva"), ("x", "y"), (None, None)]
    assert over(spark, S.direction("a", "b"), values, "a string, b string") == ["in", "out", "in", None, None]


def test_titles(spark):
    assert over(spark, S.match_title("a", "b", "c"), [("2024-08-25", "A[b]#", "Cup|x"), (None, None, None)], "a string, b string, c string") == ["25/08/2024 נגד A(b) (Cup-x)", "תאריך לא ידוע נגד לא ידוע"]
    assert over(spark, S.page_title("a", "n"), [("X", 0), ("X", 3000), ("X", 6)], "a string, n int") == ["X", "Draft:X", "File:X"]
    with pytest.raises(PySparkException):
        over(spark, S.page_title("a", "n"), [("X", 7)], "a string, n int")


def test_links_goals_and_pivot(spark):
    assert spark.createDataFrame([("https://a.b/eden-ben/profil/spieler/77",)], "u string").select(*S.player_link("u")).first()[:] == ("77", "Eden Ben")
    assert spark.createDataFrame([("54:23",), ("x",)], "g string").select(*S.split_goals("g")).collect() == [(54, 23), (None, None)]
    assert over(spark, S.pivot_year("a"), [24, 29, 30, 99, 2024], "a int") == [2024, 2029, 1930, 1999, 2024]


def test_revisions(spark):
    rows = [(3000, 5, None), (0, 5, 4), (10, 5, 4), (0, 4, 4), (0, 5, None), (6, 5, 4)]
    assert over(spark, S.revision_kind("n", "r", "p"), rows, "n int, r int, p int") == ["draft", "update", "update", None, None, None]


def test_countries(spark):
    names = {"israel": "Israel", "niger": "Niger", "nigeria": "Nigeria"}
    found = over(spark, countries(names)(F.col("a")), ["Israel  Cote d'Ivoire", "Nigeria/Niger", "usa", "Nigerian", "", None])
    assert found == [["Israel", "Côte d'Ivoire"], ["Nigeria", "Niger"], ["United States"], [], [], []]


def slow_terms(text, vocabulary):
    """Each term searched by itself: longer ones first, then in order, from left to right."""
    low = " ".join(text.translate(str.maketrans(",;|/", "    ")).split()).lower()
    taken, found = [False] * len(low), []
    for term in sorted(vocabulary, key=lambda t: (-len(t), t)):
        for at in range(len(low) - len(term) + 1):
            end = at + len(term)
            whole = not (at and low[at - 1].isalnum()) and not (end < len(low) and low[end].isalnum())
            if low[at:end] == term and whole and not any(taken[at:end]):
                taken[at:end] = [True] * len(term)
                found.append((at, vocabulary[term]))
    return [n for _, n in sorted(found)]


def test_greedy_takes_the_longer_term():
    assert Matcher({"United States of America": "A", "united states": "B", "america": "C"}).find("the United States of America") == ["A"]
    assert Matcher({"aa aa": "P", "aa": "S"}).find("aa aa aa") == ["P", "S"]
    assert Matcher({}).find("aa") == Matcher({"": "x", "aa": "S"}).find(None) == []
    rng = random.Random(4)
    for _ in range(300):
        terms = {"".join(rng.choice("ab é-") for _ in range(rng.randrange(1, 5))).strip() or "a": str(i) for i in range(rng.randrange(1, 12))}
        text = "".join(rng.choice("aabB é,-  /") for _ in range(rng.randrange(0, 40)))
        assert Matcher(terms).find(text) == slow_terms(text, terms)


def test_many_terms_cost_no_more_than_few():
    text = " ".join(f"word{i % 97} other" for i in range(3000))
    few, many = Matcher({"word1": "x"}), Matcher({f"word{i}x{j}": "x" for i in range(100) for j in range(200)} | {"word1": "x"})
    took = []
    for m in (few, many, few, many):
        began = time.process_time()
        for _ in range(20):
            assert len(m.find(text)) == 31
        took.append(time.process_time() - began)
    assert min(took[1::2]) < 5 * min(took[::2])  # twenty thousand terms
