"""Rows from archived pages: one extractor per kind of page, run over a table of pages.

Extraction needs document structure, which built-in functions lack, so it runs in Arrow
batches; everything after it is native.  Order within a page is kept in `ord`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import islice
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tree import Node, parse

Rows = Iterator[dict]
KINDS: dict[str, PageKind] = {}


@dataclass(frozen=True)
class PageKind:
    """A page's extractor, f(html, season, base url), and the schema of its rows."""

    name: str
    schema: str
    extract: Callable[[str, str, str], Rows]


def kind(name: str, schema: str):
    def put(f):
        KINDS[name] = PageKind(name, schema, f)
        return f

    return put


def extract(pages: DataFrame, name: str, html: str = "html", season: str | None = None, base: str | None = None) -> DataFrame:
    """(ord, columns of the kind) of every page; `season` and `base` name columns where there are such.

    Null pages give no rows.
    """
    it = KINDS[name]
    schema = StructType.fromDDL(f"ord int, {it.schema}")
    arrow, names = to_arrow_schema(schema), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for text, when, url in zip(*batch.columns, strict=True):
                    for i, r in enumerate(it.extract(text.as_py() or "", when.as_py() or "", url.as_py() or "")):
                        yield {"ord": i, **{n: r.get(n) for n in names if n != "ord"}}

        found = rows()
        while some := list(islice(found, 4096)):  # one page's rows at a time, whatever a batch holds
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    blank = "cast(null as string)"
    return pages.selectExpr(f"`{html}`", f"`{season}`" if season else blank, f"`{base}`" if base else blank).mapInArrow(work, schema)


# --- pieces -------------------------------------------------------------------------------


def _int(text: str) -> int | None:
    s = text.strip()
    return int(s) if re.fullmatch(r"[+-]?\d+", s) else None


def _digits(text: str) -> int | None:
    s = re.sub(r"\D", "", text)
    return int(s) if s else None


def _tail(url: str) -> str:
    return url.strip().rstrip("/").rsplit("/", 1)[-1] if url else ""


def _start_year(two: str) -> str:
    yy = int(two)
    return str(yy if yy >= 100 else 1900 + yy if yy >= 30 else 2000 + yy)


def _player(a: Node | None) -> tuple[str | None, str | None]:
    """(name from the slug, id) of a profile link."""
    m = re.search(r"/([^/]+)/profil/[^/]+/(\d+)", a.attrs.get("href", "") if a else "")
    return (m[1].replace("-", " ").title(), m[2]) if m else (None, None)


def _rows(page: Node, table: str = "table.items") -> list[Node]:
    return page.all(f"{table} > tbody > tr")


def _cells(row: Node) -> list[Node]:
    return row.all("> td")


def _first_text(node: Node) -> str:
    return next((t.strip() for t in node.texts() if t.strip()), "")


# --- kinds of pages -----------------------------------------------------------------------

_SQUAD = "name_english string, profile_url string, number string, season string, loaned boolean, is_captain boolean"


@kind("squad", _SQUAD)
def squad(html: str, season: str, base: str) -> Rows:
    for row in _rows(parse(html)):
        name, link = row.text_at("td.hauptlink a"), row.attr_at("td.hauptlink a", "href")
        if name and link:
            yield {"name_english": name, "profile_url": urljoin(base, link), "number": row.text_at("div.rn_nummer") or "-", "season": season, "loaned": False, "is_captain": False}


@kind("loans", _SQUAD)
def loans(html: str, season: str, base: str) -> Rows:
    for row in _rows(parse(html)):
        name, link = row.text_at("table.inline-table td.hauptlink a"), row.attr_at("table.inline-table td.hauptlink a", "href")
        if name and link:
            yield {"name_english": name, "profile_url": urljoin(base, link), "number": "-", "season": season, "loaned": True, "is_captain": False}


@kind("profile", "facts map<string,string>, positions struct<main:string,other:array<string>>")
def profile(html: str, season: str, base: str) -> Rows:
    page = parse(html)
    box = page.first("div.spielerdatenundfakten")
    keys = [k.text for k in box.all("span.info-table__content--regular")] if box else []
    values = [v.text for v in box.all("span.info-table__content--bold")] if box else []
    facts = {k.strip().rstrip(":"): v.strip().replace("\xa0", " ") for k, v in zip(keys, values, strict=False) if v}
    places = page.first("div.detail-position__box")
    main = places.text_at("dd.detail-position__position") if places else ""
    other = [d.clean for x in (places.all("div.detail-position__position") if places else []) for d in x.all("dd.detail-position__position") if d.clean]
    yield {"facts": facts, "positions": {"main": main or None, "other": other}}


@kind("market_values", "date string, value string, team string")
def market_values(text: str, season: str, base: str) -> Rows:
    """JSON of a player's values; undated entries are left out, the rest stands by date."""
    found = []
    for x in _json(text).get("list") or []:
        for form in ("%b %d, %Y", "%d/%m/%Y"):
            try:
                day = datetime.strptime(x.get("datum_mw") or "", form).strftime("%Y-%m-%d")
            except ValueError:
                continue
            found.append({"date": day, "value": x.get("mw"), "team": x.get("verein")})
            break
    yield from sorted(found, key=lambda r: r["date"])


@kind("transfer_history", "season string, date string, `from` string, `to` string, fee string")
def transfer_history(text: str, season: str, base: str) -> Rows:
    """JSON of a player's transfers by date, undated ones first."""
    rows = [{"season": t.get("season"), "date": t.get("dateUnformatted"), "from": (t.get("from") or {}).get("clubName"), "to": (t.get("to") or {}).get("clubName"), "fee": t.get("fee")} for t in _json(text).get("transfers") or []]
    yield from sorted(rows, key=lambda r: r["date"] or "")


def _json(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


#: Column titles of statistics tables (fixed values); and where columns stand without a header.
STAT_TITLES = {"appearances": "appearances", "goals": "goals", "assists": "assists", "yellow cards": "yellow_cards", "second yellow cards": "second_yellow_cards", "red cards": "red_cards", "minutes played": "minutes_played"}
STAT_PLACES = {"appearances": 5, "goals": 6, "assists": 7, "yellow_cards": 8, "second_yellow_cards": 9, "red_cards": 10, "minutes_played": 14}


@kind("stats", "player_id string, season string, appearances int, goals int, assists int, yellow_cards int, second_yellow_cards int, red_cards int, minutes_played int")
def stats(html: str, season: str, base: str) -> Rows:
    page, places, at = parse(html), {}, 0
    for th in page.all("table.items > thead > tr > th"):
        titles = [th.attrs.get("title", ""), *(x.attrs.get("title", "") for x in th.walk()), _first_text(th)]
        field = next((STAT_TITLES[t.strip().lower()] for t in titles if t.strip().lower() in STAT_TITLES), None)
        if field:
            places[field] = at
        at += int(th.attrs.get("colspan") or 1)
    for row in _rows(page):
        link = row.attr_at("td.hauptlink a", "href")
        if not link or "not used" in row.text.lower():
            continue
        cells = _cells(row)

        def number(field: str, cells: list[Node] = cells) -> int:
            i = (places or STAT_PLACES).get(field)
            return (_digits(cells[i].clean) or 0) if i is not None and i < len(cells) else 0

        yield {"player_id": _tail(link), "season": season, **{f: number(f) for f in STAT_PLACES}}


@kind("fixtures", "competition string, matchday string, date string, time string, venue string, opponent string, system_of_play string, attendance string, result string, match_report_url string")
def fixtures(html: str, season: str, base: str) -> Rows:
    """Rows of fewer than ten cells are dropped; a header row's competition holds for those below."""
    competition = None
    for row in parse(html).all("div.box div.responsive-table table tbody tr"):
        if head := row.text_at("td.extrarow a"):
            competition = head
            continue
        cells = row.all("td")
        if len(cells) < 10:
            continue
        spans = [t for s in cells[9].all("a span") for t in s.own if t.strip()]
        result = spans[0].strip() + (" (penalties)" if len(spans) > 1 else "") if spans else cells[9].clean
        report = cells[9].attr_at("a", "href")
        yield {
            "competition": competition, "matchday": cells[0].clean, "date": cells[1].clean, "time": cells[2].clean, "venue": cells[3].clean, "opponent": cells[6].text_at("a") or None,
            "system_of_play": cells[7].clean, "attendance": cells[8].clean, "result": result, "match_report_url": urljoin(base, report) if report else None,
        }


@kind("club_transfers", "season string, player_name string, player_id string, from_club string, to_club string, fee string, loan boolean, direction string")
def club_transfers(html: str, season: str, base: str, club: str = "Hapoel Beer Sheva") -> Rows:
    for box in parse(html).all("div.box"):
        m = re.match(r"\s*(arrivals|departures)\s+(\d{2})/\d{2}", box.text_at("h2"), re.I)
        if not m or (season and _start_year(m[2]) != season):
            continue
        inward = m[1].lower() == "arrivals"
        for row in box.all("tbody > tr"):
            name, player = row.text_at("td.hauptlink a"), _tail(row.attr_at("td.hauptlink a", "href"))
            if not name or not player:
                continue
            other = row.attr_at("td.no-border-rechts img", "title") or row.text_at("td.no-border-links a")
            fee = row.text_at("td.rechts") or "-"
            yield {"season": _start_year(m[2]), "player_name": name, "player_id": player, "from_club": other if inward else club, "to_club": club if inward else other, "fee": fee, "loan": "loan" in fee.lower(), "direction": "in" if inward else "out"}


@kind("coaches", "id string, name string, role string, tenure_start string, tenure_end string, played int, wins int, draws int, losses int, ppm string")
def coaches(html: str, season: str, base: str) -> Rows:
    for row in parse(html).all("div.responsive-table table > tbody > tr"):
        name, coach = row.text_at("td.hauptlink a"), _tail(row.attr_at("td.hauptlink a", "href"))
        if not name or not coach:
            continue
        inner = row.all("td table tr")
        when = [t.strip() for td in row.all("td.zentriert") for t in td.own if t.strip()]
        yield {"id": coach, "name": name, "role": inner[1].text_at("td") if len(inner) > 1 else "", "tenure_start": when[1] if len(when) > 1 else "", "tenure_end": when[2] if len(when) > 2 and when[2] != "-" else "", "played": 0, "wins": 0, "draws": 0, "losses": 0, "ppm": ""}


@kind("honours", "competition string, achievement string, seasons array<string>")
def honours(html: str, season: str, base: str) -> Rows:
    """Pictures and season lists, paired by place as far as the shorter goes."""
    page = parse(html)
    for picture, info in zip(page.all("div.erfolg_bild_box"), page.all("div.erfolg_infotext_box"), strict=False):
        name = picture.attr_at("img", "title") or picture.attr_at("img", "alt")
        seasons = [x.strip() for x in info.text.replace("\xa0", " ").split(",") if x.strip()]
        if name and seasons:
            yield {"competition": name, "achievement": "Winner", "seasons": seasons}


@kind("stadium", "name string, capacity int, surface string, opening_year string, address string, city string")
def stadium(html: str, season: str, base: str) -> Rows:
    page = parse(html)
    pairs = [(r.text_at("th").rstrip(":").lower(), r.text_at("td")) for r in page.all("table.profilheader tr")]
    full = [(k, v) for k, v in pairs if k and v]
    last = lambda test: next((v for k, v in reversed(full) if test(k)), "")
    name = last(lambda k: "name of stadium" in k)
    capacity = _digits(last(lambda k: "total capacity" in k or k == "capacity"))
    address = next((v for k, v in reversed(full) if "address" in k and v != name), "")
    if not address:
        for i, (k, _) in enumerate(pairs):
            if "address" in k:
                lines = []
                for label, v in pairs[i + 1 :]:
                    if label:
                        break
                    lines += [v] if v else []
                address = ", ".join(lines)
                break
    if not name:
        skip = {"Info", "Contact", "Pricing information", "Home ground for...:"}
        name = next((h.clean for h in page.all("h2.content-box-headline") if h.clean and h.clean not in skip), "")
    if name:
        yield {"name": name, "capacity": capacity if capacity is not None else _digits(last(lambda k: k == "seats")), "surface": last(lambda k: "surface" in k), "opening_year": last(lambda k: "built" in k or "opening" in k), "address": address, "city": ""}


@kind("records", "category string, direction string, player_name string, player_id string, value string")
def records(html: str, season: str, base: str) -> Rows:
    page = parse(html)
    title = page.text_at("title").split("|")[0].strip()
    category = title.split(" - ", 1)[-1].strip() or "Record arrivals"
    for row in _rows(page):
        if not {"odd", "even"} & row.classes:
            continue
        links = row.all("td.hauptlink a")
        link = next((a for a in links if "/profil/" in a.attrs.get("href", "")), links[0] if links else None)
        name = _first_text(link) if link else ""
        if not name:
            continue
        url = link.attrs.get("href", "")
        value = row.text_at("td.rechts") or next((t for td in reversed(row.all("td.zentriert")) for t in [td.clean] if t), "")
        yield {"category": category, "direction": "in", "player_name": name, "player_id": _tail(url) if "/profil/" in url else "", "value": value}


@kind("standings", "season string, competition string, tier int, final_position int, played int, wins int, draws int, losses int, goals_for int, goals_against int, points int, manager_name string, manager_id string")
def standings(html: str, season: str, base: str) -> Rows:
    for row in _rows(parse(html)):
        c = _cells(row)
        label = re.match(r"\s*(\d+)\s*/", c[0].text if c else "")
        if len(c) < 12 or not label:
            continue
        text = [_first_text(x) for x in c]
        tier = next((n for n, w in ((1, "first"), (2, "second"), (3, "third")) if w in text[3].lower()), None)
        won, drawn, lost = (_int(text[i]) for i in (4, 5, 6))
        goals = re.fullmatch(r"(\d+)\s*:\s*(\d+)", text[7])
        played = (won or 0) + (drawn or 0) + (lost or 0)
        yield {
            "season": _start_year(label[1]), "competition": c[2].text_at("a") or c[2].attr_at("a", "title") or None, "tier": tier, "final_position": _int(c[10].text_at("b") or text[10]), "played": played or None,
            "wins": won, "draws": drawn, "losses": lost, "goals_for": int(goals[1]) if goals else None, "goals_against": int(goals[2]) if goals else None, "points": _int(text[9]),
            "manager_name": c[11].text_at("a") or None, "manager_id": _tail(c[11].attr_at("a", "href")) or None,
        }


@kind("head_to_head", "opponent string, opponent_tm_id string, played int, wins int, draws int, losses int, goals_for int, goals_against int, avg_attendance int")
def head_to_head(html: str, season: str, base: str) -> Rows:
    for row in _rows(parse(html)):
        c = _cells(row)
        if len(c) < 10:
            continue
        club = next((a for a in c[0].all("a") if a.attrs.get("title", "").strip() and "/verein/" in a.attrs.get("href", "")), None)
        played = _int(c[2].text_at("a") or _first_text(c[2]))
        if club is None or played is None:
            continue
        m = re.search(r"/verein/(\d+)", club.attrs["href"])
        won, drawn, lost = (_int(_first_text(c[i])) or 0 for i in (3, 4, 5))
        yield {"opponent": club.attrs["title"].strip(), "opponent_tm_id": m[1] if m else None, "played": played, "wins": won, "draws": drawn, "losses": lost, "goals_for": 0, "goals_against": 0, "avg_attendance": _digits(_first_text(c[9]))}


_PLAYER = "struct<name_english:string,name_short:string,tm_player_id:string,number:string,captain:boolean,position:string>"
_WHEN = "minute:int,extra_time:int,sprite_position:string"


@kind(
    "match",
    f"home_lineup array<{_PLAYER}>, away_lineup array<{_PLAYER}>, "
    f"goals array<struct<{_WHEN},score:string,scorer:string,scorer_tm_id:string,assist:string,assist_tm_id:string,team:string,details:string>>, "
    f"substitutions array<struct<{_WHEN},team:string,player_in:string,player_in_tm_id:string,player_out:string,player_out_tm_id:string,reason:string>>, "
    f"cards array<struct<{_WHEN},team:string,player:string,player_tm_id:string,card:string,reason:string>>, "
    "penalties array<struct<team:string,result:string,score:string,player:string,player_tm_id:string,club:string>>, "
    f"manager_sanctions array<struct<{_WHEN},team:string,manager:string,sanction:string>>, "
    "halftime_score string, aet boolean, stadium string, referee string",
)
def match(html: str, season: str, base: str) -> Rows:
    """One row per report; the formation's line-up if there is one, else the table's, per side."""
    page = parse(html)
    drawn, listed = _formation(page), _line_table(page)
    note = (page.first(".sb-endstand .sb-halbzeit") or Node("", {})).clean
    marker = note.upper() in ("AET", "AP", "N.V.", "I.E.")
    half = re.fullmatch(r"\(?\s*(\d+\s*:\s*\d+)\s*\)?", note)
    goals = [_goal(li) for li in page.all("#sb-tore li")]
    shots = [_penalty(li) for li in page.all("#sb-elfmeterscheissen li")]
    extra = page.first(".sb-zusatzinfos") or Node("", {})
    ground = next((a for a in extra.all("a") if "/stadion/" in a.attrs.get("href", "")), None)
    judge = next((a for a in extra.all("a") if "/schiedsrichter/" in a.attrs.get("href", "")), None)
    yield {
        "home_lineup": drawn.get("home") or listed.get("home"), "away_lineup": drawn.get("away") or listed.get("away"), "goals": goals,
        "substitutions": [_change(li) for li in page.all("#sb-wechsel li")], "cards": [_card(li) for li in page.all("#sb-karten li")], "penalties": shots or None,
        "manager_sanctions": [_sanction(li) for li in page.all("#sb-sanktionen li")], "halftime_score": half[1] if half and not marker else None,
        "aet": marker or bool(shots) or any((g["minute"] or 0) > 90 for g in goals), "stadium": (_first_text(ground) or None) if ground else None,
        "referee": (_first_text(judge) or judge.attrs.get("title", "").strip() or None) if judge else None,
    }


def _side(li: Node) -> str:
    return "home" if "sb-aktion-heim" in li.attrs.get("class", "") else "away"


def _when(li: Node) -> dict:
    style = li.attr_at(".sb-aktion-uhr span", "style")
    at = [int(x) for x in re.findall(r"-?\d+", style)]
    x, y = (abs(at[0]), abs(at[1])) if len(at) == 2 else (None, None)
    added = re.search(r"\+(\d+)", " ".join(s.text for s in li.all(".sb-aktion-uhr span")))
    inside = x is not None and x < 360 and y < 432
    return {"minute": y // 36 * 10 + x // 36 + 1 if inside else None, "extra_time": int(added[1]) if added else None, "sprite_position": f"{at[0]}x{at[1]}" if len(at) == 2 else None}


def _who(li: Node, path: str, i: int = 0) -> tuple[str | None, str | None]:
    links = li.all(path)
    return (_first_text(links[i]) or None, _player(links[i])[1]) if len(links) > i else (None, None)


def _goal(li: Node) -> dict:
    scorer, assist = _who(li, ".sb-aktion-aktion a"), _who(li, ".sb-aktion-aktion a", 1)
    details = " ".join(t for x in li.all(".sb-aktion-aktion") for t in x.own).strip()
    return {**_when(li), "score": li.text_at(".sb-aktion-spielstand b") or None, "scorer": scorer[0], "scorer_tm_id": scorer[1], "assist": assist[0], "assist_tm_id": assist[1], "team": li.attr_at(".sb-aktion-wappen img", "alt") or None, "details": details}


def _penalty(li: Node) -> dict:
    player = _who(li, ".sb-aktion-aktion a")
    return {"team": _side(li), "result": li.attr_at(".sb-aktion-uhr span", "title") or None, "score": li.text_at(".sb-aktion-spielstand b") or None, "player": player[0], "player_tm_id": player[1], "club": li.attr_at(".sb-aktion-wappen a", "title") or None}


def _change(li: Node) -> dict:
    on, off = _who(li, ".sb-aktion-wechsel-ein a"), _who(li, ".sb-aktion-wechsel-aus a")
    why = re.search(r"[A-Za-z]+", li.text_at(".sb-aktion-wechsel-aus span.hide-for-small"))
    return {**_when(li), "team": _side(li), "player_in": on[0], "player_in_tm_id": on[1], "player_out": off[0], "player_out_tm_id": off[1], "reason": why[0] if why else None}


def _card(li: Node) -> dict:
    mark, player = li.attr_at(".sb-aktion-spielstand span", "class"), _who(li, ".sb-aktion-aktion a")
    card = next((name for part, name in (("sb-gelbrot", "second_yellow"), ("sb-rot", "red"), ("sb-gelb", "yellow")) if part in mark), None)
    why = next((m[1].strip() for x in li.all(".sb-aktion-aktion") for t in x.own if (m := re.search(r",\s*(.+)", t))), None)
    return {**_when(li), "team": _side(li), "player": player[0], "player_tm_id": player[1], "card": card, "reason": why}


def _sanction(li: Node) -> dict:
    mark = li.attr_at(".sb-aktion-spielstand span", "class")
    return {**_when(li), "team": _side(li), "manager": li.text_at(".sb-aktion-aktion a") or None, "sanction": next((n for p, n in (("sb-rot", "red"), ("sb-gelb", "yellow")) if p in mark), None)}


def _teams(boxes: list[Node]) -> Iterator[tuple[str, Node]]:
    named = [b for b in boxes if b.text_at(".aufstellung-unterueberschrift-mannschaft a")]
    return ((("home" if i == 0 else "away"), b) for i, b in enumerate(named))


def _formation(page: Node) -> dict[str, list[dict]]:
    out = {}
    for team, box in _teams(page.all("div.box > div.large-6.columns")):
        players = []
        for p in box.all(".formation-player-container"):
            if a := p.first(".formation-number-name a"):
                name, ident = _player(a)
                short = _first_text(a)
                players.append({"name_english": name or short, "name_short": short or None, "tm_player_id": ident, "number": p.text_at(".tm-shirt-number"), "captain": bool(p.all(".kapitaenicon-formation")), "position": None})
        if players:
            out[team] = players
    return out


def _line_table(page: Node) -> dict[str, list[dict]]:
    boxes = [n for n in page.walk() if n.fits("div.aufstellung-box") or n.fits("div.large-6.columns")]
    out = {}
    for team, box in _teams(boxes):
        players = []
        for row in box.all("table tr"):
            cells = _cells(row)
            line = row.text_at("td b").lower() or ("manager" if cells and "manager" in cells[0].text.lower() else "")
            for a in cells[1].all("a") if line and len(cells) > 1 else []:
                name, ident = _player(a)
                short = _first_text(a)
                players.append({"name_english": name or short, "name_short": short or None, "tm_player_id": ident, "number": None, "captain": None, "position": line})
        out[team] = players
    return out
