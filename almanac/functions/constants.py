"""Word lists, tables and patterns that results depend on (fixed values)."""

from __future__ import annotations

#: Transfer fees in words, by lower-case source text.
FEE_WORDS = {
    "free transfer": "העברה חופשית",
    "loan transfer": "השאלה",
    "end of loan": "סוף השאלה",
    "loan fee": "דמי השאלה",
    "?": "",
    "-": "",
}
LOAN_FEE_WORDS = "דמי השאלה"
#: Names that mark the archive's own club in transfer rows.
OWN_CLUB = ("hapoel beer sheva", "beer sheva", "h. beer sheva", "hapoel be'er sheva")
#: Clubs of origin that make a player homegrown.
HOMEGROWN_FROM = ("H. B. Sheva U19", "Hapoel Beer Sheva U19")
#: Position to line, and the order of lines.
POSITION_LINE = {
    "Goalkeeper": "GK",
    "Centre-Back": "DF", "Left-Back": "DF", "Right-Back": "DF", "Defender": "DF",
    "Central Midfield": "MF", "Defensive Midfield": "MF", "Attacking Midfield": "MF",
    "Left Midfield": "MF", "Right Midfield": "MF", "Midfielder": "MF",
    "Left Winger": "FW", "Right Winger": "FW", "Centre-Forward": "FW",
    "Second Striker": "FW", "Forward": "FW", "Striker": "FW",
}
LINES = ("GK", "DF", "MF", "FW", "OTHER")
#: Rivals by display name, with the names they go by in tables, in order of preference.
DERBIES = {
    "מכבי תל אביב": ("Maccabi Tel Aviv", "M. Tel Aviv"),
    "הפועל תל אביב": ("Hapoel Tel Aviv", "H. Tel Aviv"),
    'בית"ר ירושלים': ("Beitar Jerusalem", "B. Jerusalem"),
    "מכבי חיפה": ("Maccabi Haifa", "M. Haifa"),
}
EUROPEAN_COMPETITIONS = (
    "UEFA Champions League",
    "Champions League",
    "Champions League qualifying",
    "Champions League Qualifying",
    "UEFA Champions League Qualifying",
    "UEFA Europa League",
    "Europa League",
    "Europa League qualifying",
    "Europa League Qualifying",
    "UEFA Europa League Qualifying",
    "UEFA Conference League",
    "Conference League",
    "UEFA Conference League Qualifying",
    "Conference League qualifying",
    "Conference League Qualifying",
    "UEFA Europa Conference League",
    "UEFA Cup",
    "Cup Winners' Cup",
    "Intertoto Cup",
)
#: Trailing words of youth teams, before and after translation.
YOUTH_LATIN = r"(?i)\b(?:U\d{2}|Sub-?\d{2}|Yth|Youth|Juvenil|Junior|Cadete)\.?\s*$"
YOUTH_HEBREW = r"(?:תחת\s+\d{2}|נוער)\s*$"
#: Years of two digits from this on belong to the twentieth century.
PIVOT = 30
#: Table names that the wiki's table layer rejects.
RESERVED = ("holds", "matches", "near", "within")
#: Namespaces by number, with their titles' prefix.
NAMESPACES = {0: "", 6: "File:", 10: "Template:", 3000: "Draft:"}
#: Trust in a translation's origin; unknown ones rank 0.
SOURCE_RANK = {"manual": 4, "wikidata": 3, "auto-llm": 2, "auto-google": 1, "auto-phonetic": 1}
#: Latin letters and letter pairs in Hebrew script.
LETTERS_HEBREW = {
    "a": "א", "b": "ב", "c": "ק", "d": "ד", "e": "א", "f": "פ",
    "g": "ג", "h": "ה", "i": "י", "j": "ג'", "k": "ק", "l": "ל",
    "m": "מ", "n": "נ", "o": "ו", "p": "פ", "q": "ק", "r": "ר",
    "s": "ס", "t": "ט", "u": "ו", "v": "ו", "w": "ו", "x": "קס",
    "y": "י", "z": "ז",
}
PAIRS_HEBREW = {"sh": "ש", "ch": "צ'", "th": "ת", "tz": "צ", "zh": "ז'", "ph": "פ", "kh": "ח"}
#: Scoreboard notes of matches that went past ninety minutes.
EXTRA_TIME = ("AET", "AP", "N.V.", "I.E.")
UNKNOWN_DATE = "תאריך לא ידוע"
UNKNOWN_OPPONENT = "לא ידוע"
VERSUS = "נגד"
#: Edit summaries of pages that the pipeline wrote, whole or in part.
IMPORT_SUMMARY = "Auto-import:"
MERGE_SUMMARY = "Auto-merge:"
#: Country names by which sources differ from the standard.
COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom", "great britain": "United Kingdom", "britain": "United Kingdom",
    "bosnia": "Bosnia and Herzegovina", "russia": "Russian Federation",
    "south korea": "Korea, Republic of", "north korea": "Korea, Democratic People's Republic of",
    "iran": "Iran, Islamic Republic of", "venezuela": "Venezuela, Bolivarian Republic of",
    "syria": "Syrian Arab Republic", "cote d'ivoire": "Côte d'Ivoire",
    "ivory coast": "Côte d'Ivoire",
}
#: Classes of entities that count as of a type; and words of descriptions that do where classes don't.
ENTITY_CLASSES = {
    "player": ("Q5",),
    "club": ("Q476028", "Q22687", "Q15942466", "Q15944511", "Q11410", "Q103229495"),
    "competition": ("Q500834", "Q27020041", "Q1478437", "Q623109", "Q13406554", "Q170645"),
    "country": ("Q6256", "Q3624078", "Q7275", "Q185086"),
    "city": ("Q515", "Q3957", "Q486972", "Q1549591", "Q1093829", "Q15284", "Q532", "Q5084", "Q15078955", "Q1907114"),
}
FOOTBALL = "Q2736"
PLAYER_WORDS = ("football", "footballer", "soccer", "manager", "coach", "midfielder", "defender", "forward", "striker", "goalkeeper")
COMPETITION_WORDS = ("football", "soccer", "association football")
