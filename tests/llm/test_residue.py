import pytest

from vellumgrid.llm import residue as R

CASES = [
    "It has ${population} inhabitants.", "the {{{district|}}} district", "an area of {{ row.area }} km", "in the {district} district", "in @@year@@ it", "It has %s inhabitants", "near %population%",
    "$1 inhabitants", "an area of ??? square", "recorded in NULL.", "It has undefined inhabitants", "an area of nan km", "has #N/A people", "[object Object] here", "an area of None square", "<%= year %>",
    "the XXXX district", "[INSERT area] km", "has [population goes here] people", "((year)) it", "__type__ wood", "in the #district# district", "route du <area> près",
    "Your text goes here.", "Sample paragraph number 4, to be replaced.", "TODO: describe the geography", "''slanted text here''", "<nowiki>Put raw text here</nowiki>", "[[File:Sample picture.jpg|thumb|Describe the picture]]",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Risus libero lorem lorem magna nibh.", "Beispieltext, wird noch ersetzt.", "Напишите здесь введение к статье.", "Texte provisoire, à remplacer.",
    "404 Not Found\nThe page you asked for does not exist on this server.", "Error 502: bad gateway.", "Service unavailable (433)", "Access denied. You do not have permission to view this revision.", "Erreur 404 : la page demandée est introuvable.",
    "Сервер временно недоступен, повторите попытку через 5 минут.", "Session Mordale expired. Log in again to continue reading.",
    "JavaScript is disabled in your browser. Turn it on to read this article.", "<noscript>You need to enable scripts to run this app.</noscript>", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Checking your browser before you continue. Scripts and cookies must be allowed.",
]
NO_CASES = [
    "{{Infobox place\n| population = \n| area = 12\n}}\n\nA village.", "#REDIRECT [[Old Mill]] {{R from spelling}}", "{{cite book|title=A|year=1904}} <ref name=\"a\">x</ref> <br> __NOTOC__ {{stub}}", "It was first recorded in 1404.",
    "In network engineering, a 404 status tells a client that nothing was found.", "The phrase “service unavailable” became a running joke.", "In the printed style guide, a placeholder is any mark, such as XXXX, that an author must replace.",
    "Typesetters long used filler such as “lorem ipsum” to judge a page.", "The manual explains: writing <nowiki>{{{population}}}</nowiki> prints the value.", "<syntaxhighlight lang=\"sh\">\necho \"Hello ${name}, you have $1 messages\"\n</syntaxhighlight>",
    "A blank form reading [name of parish] survives.", "Browsers without scripts were common then, and many sites printed a notice asking readers to enable them.", "The play’s script is required reading in the schools.",
    "!?!?!?!?!?", "HAHAHA HAHAHA", "It cost $5 million and $3.50 more. None of them stayed.", "Se dice que todo el método usado aquí es lo mismo.", "| [[404]] || 500 || 502", "<!-- TODO: check --> text", "== Sources of error ==", "wszystkie znane próbki", "50% of them, 20%sure",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "h", i) for i, t in enumerate(CASES)] + [(1000 + i, t, "h", 1000 + i) for i, t in enumerate(NO_CASES)]
    df = spark.createDataFrame(rows, "k long, t string, s string, p long")
    return {r["id"] for r in R.residue(df, "k", "t", "s", "p").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert i in found, CASES[i]


@pytest.mark.parametrize("i", range(len(NO_CASES)))
def test_no_case(found, i):
    assert 1000 + i not in found, NO_CASES[i]


def test_recurrent_lines_are_subtracted(spark):
    """A footer with a slot's mark on every page of a host is boilerplate; on one page of many copies it is residue."""
    rows = [(i, f"A text of its own, {'x' * (i + 1)}.\nBuilt with {{engine}} for readers.", "h", i) for i in range(20)] + [(100 + i, "in the {district} district", "g", 7) for i in range(20)] + [(200 + i, f"page {i}", "g", 100 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, t string, s string, p long")
    assert {r["id"] for r in R.residue(df, "k", "t", "s", "p").collect()} == set(range(100, 120))


def test_notices_recur_and_stay_found(spark):
    rows = [(i, "Service unavailable (12)", "h", i) for i in range(20)]
    assert R.residue(spark.createDataFrame(rows, "k long, t string, s string, p long"), "k", "t", "s", "p").count() == 20


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "h"), (3, "Error 404: gone", None), (3, "Error 404: gone", None), (None, "Error 404: gone", "h"), (4, "plain text. " * 80_000, "h"), (5, "plain text. " * 80_000 + "\nTODO: write", "h"), (6, "İİİ {district} İ", "h")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "k long, t string, s string, evidence string, id int")
    assert sorted(r["id"] for r in R.residue(df, "k", "t", "s").collect()) == [3, 5, 6]
    kept = R.exclude(df, "k", "t", "s")
    assert kept.columns == df.columns and sorted(str(r["k"]) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert R.residue(df.where("false"), "k", "t", "s").count() == 0


def test_every_notice_pattern_has_a_stem():
    """The automaton must not hide what the patterns would find."""
    for t in CASES:
        assert R.judged_lines(t), t


def test_signs_never_seen_in_the_tables():
    """General pairs, not messages learnt by heart."""
    for t, kind in (
        ("The requested service is temporarily unavailable.", "error"), ("429 Too Many Requests", "error"), ("Connection refused by the database.", "error"), ("Die Verbindung wurde verweigert.", "error"), ("Le serveur est indisponible.", "error"),
        ("Please enable cookies to use this site.", "script"), ("Votre navigateur n'accepte pas JavaScript, activez-le.", "script"), ("Headline text", None), ("Insert your own caption here", "filler"), ("Dummy text for the layout.", "filler"),
        ("Total of {{{TOTAL_AREA}}} hectares near %CITY_NAME%", "slot"), ("The committee denied that the mill had failed.", None), ("Access to the valley was never denied to the carters, and the wardens wrote in the year of the flood that no man, cart or beast had been turned back from the old gate by them in living memory.", None),
    ):
        assert [k for _, k in R.judged_lines(t) if k] == ([kind] if kind else []), t


def test_linear_on_unclosed_marks():
    import time

    for t in ("<!-- ", "<code>", "<code ", "“", "<nowiki>Put text here</nowiki>", "“a” text here ", "{{{a", "<%", "error ", "((", "__a", "#a"):
        began = time.time()
        R.judged_lines(t * 100_000)
        assert time.time() - began < 5, t


def test_subtraction_needs_many_pages_and_leaves_whole_notices(spark):
    """A line of {slot} under every text is subtracted; a host all of whose pages are one notice keeps them."""
    rows = [(i, f"own words {'x' * (i + 1)}\nMade with {{engine}}", "h", i) for i in range(30)] + [(100 + i, "Error 404: gone\nThe page was not found", "g", i) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, t string, s string, p long")
    assert {r["id"] for r in R.residue(df, "k", "t", "s", "p").collect()} == set(range(100, 130))
    left = {r["id"]: (r["lines"], r["subtracted"]) for r in R.residual(df, "k", "t", "s", "p").collect()}
    assert left == {i: (2, 1) for i in range(30)} | {100 + i: (2, 2) for i in range(30)}
    often = R.recurrent_lines(df, "k", "t", "s", "p").collect()
    assert sorted((r["n"], r["pages"]) for r in often) == [(30, 30)] * 3


def test_shuffled_recurrent_lines_give_the_same(spark, monkeypatch):
    rows = [(i, f"own words {'x' * (i + 1)}\nMade with {{engine}}" + ("\nTODO: write" if i % 5 == 0 else ""), "h", i) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, t string, s string, p long")
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(R, "LEAST_SHARE", 0.3)
    assert {r["id"] for r in R.residue(df, "k", "t", "s", "p", least_share=0.3).collect()} == {0, 5, 10, 15, 20, 25}


LATIN = [
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Sapien felis orci.\nPorta felis nulla, orci, massa.", "Massa felis porta “with a quotation of words that are not Latin at all” quam.",
]


def test_filler_latin_by_all_its_words(spark):
    """No two of its words are needed that an automaton knows: every word of the list counts."""
    other = ["Felis is a genus of cats, and porta, quam and massa are words of another kind.", "Il est de la commune, et non de la ville, qui est au nord."]
    df = spark.createDataFrame([(i, t, "h", i) for i, t in enumerate(LATIN + other)], "k long, t string, s string, p long")
    assert {r["id"] for r in R.residue(df, "k", "t", "s", "p").collect()} == set(range(len(LATIN)))
