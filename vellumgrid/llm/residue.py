"""Problem 9: unfilled template slots, filler, error pages and script notices.

All lines are normalised (case, digits, spaces) and counted by host and page in
the JVM.  A line that stands on a given share of a host's pages is boilerplate
and is subtracted; where that leaves nothing, the text itself is the notice and
stays.  A document is residue when what is left of it holds slot, filler, error
or script-required evidence.

Slots are recognised by their syntax.  The other kinds are recognised by pairs of
general words close to one another (what fails and how, what is needed and that
it is, what is filled in and that it is a sample), never by whole messages.  One
multi-pattern automaton finds the rarer word of each pair; only around it is the
other sought.

Defined cases: a null or empty text is no case; a null host counts as a host of
its own; repeated rows of an id give it once; null ids are kept apart and never
reported; extra columns pass through exclude(); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.runtime import stash

#: boilerplate: at least so many pages of a host, and so large a share of them
LEAST_PAGES, LEAST_SHARE = 10, 0.02
#: recurrent lines of at most so many rows are broadcast; a larger table is shuffled
BROADCAST_ROWS = 200_000
#: the two words of a pair have at most so many characters between them
NEAR = 44
#: an error or script notice has a pair for so many words at least; a long paragraph that holds one in passing is an article
WORDS_A_PAIR = 30

# Element names of HTML and wiki markup, which are no slots.
TAGS = (
    "a abbr article aside audio b bdi bdo big blockquote body br caption center ce chem cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form gallery h1 h2 h3 h4 h5 h6 head header hiero hr html i imagemap img includeonly indicator inputbox ins "
    "kbd li link main map mapframe maplink mark math meta nav noinclude noscript nowiki object ol onlyinclude p page poem pre q ref references rb rp rt rtc "
    "ruby s samp score script section small source span strike strong style sub summary sup svg syntaxhighlight table tbody td templatestyles "
    "tfoot th thead time timeline title tr translate tt u ul var video wbr"
)
# The usual words of Latin filler text.
FILLER_LATIN = (
    "ac accumsan adipiscing aenean aliqua aliquam aliquip amet anim ante aptent arcu auctor augue aute bibendum blandit cillum class commodo condimentum "
    "congue consectetur consequat convallis cras culpa cupidatat curabitur cursus dapibus deserunt dictum dignissim do dolor dolore donec duis ea efficitur "
    "egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu euismod ex excepteur exercitation facilisis fames faucibus felis "
    "fermentum feugiat finibus fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo "
    "labore laboris laborum lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris maximus metus "
    "mi minim molestie mollis mollit morbi nam nec neque netus nibh nisi nisl non nostrud nulla nullam nunc occaecat odio officia orci ornare pariatur "
    "pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proident proin pulvinar purus quam qui quis quisque reprehenderit "
    "rhoncus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt suscipit suspendisse tellus tempor tempus "
    "tincidunt tortor tristique turpis ullamco ultrices ultricies urna ut varius vehicula vel velit veniam venenatis vestibulum vitae vivamus viverra volutpat voluptate vulputate"
)

# Behaviour switches of wiki markup, written between double underscores.
SWITCHES = (
    "NOTOC FORCETOC TOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY EXPECTUNUSEDTEMPLATE NOCONTENTCONVERT NOCC "
    "NOTITLECONVERT NOTC START END INDEX NOINDEX STATICREDIRECT EXPECTWITHOUTSCANS NOGLOBAL DISAMBIG ARCHIVEDTALK NOTALK"
)
#: the name of a slot, in small letters or in capitals
_NAME = "(?:[a-z][a-z_]*|[A-Z][A-Z_]+)"
#: what a page shows where a value should stand; read as stored, case counts
SLOT = "|".join(
    (
        r"\$\{\s*[\w.]+\s*\}",
        r"\{\{\{\s*[\w ]+(?:\|[^{}]*)?\}\}\}",
        r"\{\{\s*\w+(?:\.\w+)+\s*\}\}",
        r"(?<![\w\\{}$])\{[a-z][a-z_]*\}(?!\})",
        r"@@\w+@@",
        r"(?<![\w%])%(?:[sd]|[A-Za-z]\w*%)(?!\w)",
        r"(?<![\w$])\$[0-9](?![\w.,%]*[\d%]|\s*(?:million|billion|thousand))",
        r"(?<=\s)\?{3}(?=[\s.,;]|$)",
        r"(?<!\w)(?:NULL|undefined|nan|NaN|#N/A|#REF!|#VALUE!)(?!\w)",
        r"\[object Object\]",
        r"(?<=[\p{Ll},] )None(?! of\b)(?=[.,]|\s\p{L})",
        r"<%.{0,80}?%>",
        r"(?<![\w/])X{4}(?!\w)",
        r"\[(?:INSERT|ENTER|YOUR) [^\]]{1,60}\]|\[[\p{L}_ ]{1,40} goes here\]",
        r"(?<!\()\(\([A-Za-z]\w*\)\)(?!\))",
        rf"(?<!\w)__(?!(?:{SWITCHES.replace(' ', '|')})__)[A-Za-z]\w*?__(?!\w)",
        rf"(?<![\w&#])#{_NAME}#(?!\w)",
        rf"<(?!/)(?!(?i:{TAGS.replace(' ', '|')})\b){_NAME}>",
    )
)
#: a slot's mark that is only spoken of
MENTION = rf"(?:\b(?:such as|like|called|named|writing|written|the (?:mark|string|word|token|placeholder)|e\.g\.)\s+)(?:{SLOT})"

# The reason phrases of HTTP for failed requests.
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|conflict|gone|length required|"
    "precondition failed|payload too large|content too large|uri too long|unsupported media type|range not satisfiable|expectation failed|misdirected request|unprocessable entity|locked|"
    "upgrade required|too many requests|unavailable for legal reasons|internal server error|internal error|server error|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out"
)
ERROR_WORD = "error|errore|erreur|erro|fout|fehler|błąd|ошибка"

#: what fails, by language: en, de, fr, es, it, pt, nl, pl, ru
SITE = (
    "server|service|site|website|wiki|page|database|gateway|request|connection|session|access|address|backend|upstream|memory|host|application|permission|"
    "seite|dienst|datenbank|anfrage|verbindung|sitzung|zugriff|serveur|connexion|accès|requête|página|servicio|servidor|sitio|conexión|sesión|acceso|pagina|servizio|sito|connessione|sessione|accesso|"
    "serviço|sítio|ligação|sessão|acesso|verbinding|sessie|toegang|stron|usług|serwer|połączeni|sesj|dostęp|страниц|сервер|сервис|служб|соединени|сайт|доступ|сеанс"
)
#: how it fails; no word but these starts a search
FAIL = (
    "not found|not be found|unavailable|not available|unreachable|not reachable|has failed|query failed|request failed|login failed|denied|expired|timed out|does not exist|do not have permission|"
    "technical trouble|technical difficult|technical problem|been blocked|refused|used up|exhausted|cannot reach|could not reach|cannot connect|could not connect|too many|is down|overloaded|under maintenance|internal error|database error|server error|"
    "nicht gefunden|nicht erreichbar|nicht verfügbar|abgelaufen|verweigert|überlastet|introuvable|indisponible|inaccessible|a expiré|refusé|n'existe pas|n’existe pas|no está disponible|no disponible|no se ha encontrado|no se encontró|no encontrada|"
    "no existe|ha caducado|denegado|non raggiungibile|non disponibile|non è stata trovata|non trovata|non esiste|scaduta|negato|indisponível|não foi encontrada|não encontrada|não existe|expirou|negado|"
    "niet bereikbaar|niet beschikbaar|niet gevonden|bestaat niet|verlopen|geweigerd|niedostępn|nie znaleziono|nie istnieje|wygasł|odmowa|недоступ|не найден|не существует|истёк|истек|отказано"
)
#: what a page may need of a browser; no word but these starts a search
TECH = "javascript|java script|scripts|scripting|cookies|noscript|your browser|this browser|ihr browser|votre navigateur|su navegador|seu navegador|tuo browser|uw browser|twoja przeglądark|ваш браузер"
#: that it is needed
NEED = (
    "enable|disabled|turned off|turn it on|turn on|switched off|switch on|switched on|is required|are required|requires|must be|needs|need to|have to be|allowed|allow|activate|does not support|not supported|unsupported|outdated|checking|"
    "aktivier|deaktiviert|einschalten|activer|activez|désactivé|active|activar|desactivado|habilit|ative|ativar|desativado|attiva|attivare|disattivat|abilit|schakel|inschakel|uitgeschakeld|włącz|wyłączon|включ|отключ"
)
#: what an author fills in
UNIT = (
    "text|paragraph|heading|headline|title|caption|picture|image|photo|content|section|introduction|description|words|beschreibung|überschrift|absatz|einleitung|bild|texte|titre|paragraphe|légende|texto|título|párrafo|introducción|"
    "testo|titolo|paragrafo|introduzione|parágrafo|introdução|tekst|tytuł|akapit|wstęp|alinea|inleiding|текст|заголов|абзац|введени"
)
#: that it is only a sample; no word but these and the next starts a search
DUMMY = (
    "sample |placeholder |dummy |filler |example |slanted |strong |bold |italic |raw |your |to be replaced|to be added|to be written|to be filled|coming soon|replace this|replace with|describe the|beispiel|platzhalter|mustertext|blindtext|wird noch|provisoire|"
    "à remplacer|d'exemple|d’exemple|de ejemplo|provisional|pendiente de|provisório|a substituir|de exemplo|segnaposto|da sostituire|di esempio|voorbeeld|plaatshouder|te vervangen|zastępcz|do uzupełnienia|przykładow|заполнител|подлежит замене|пример текста"
)
#: the place that waits for it, and the request to fill it
HERE = " here|hier |hier eintragen|eintragen| ici| aquí| qui | aqui| hier|tutaj|здесь"
WRITE = "write|insert|enter|type|put|goes|go |add |text|eintragen|einfügen|schreiben|écrivez|saisissez|insérez|escriba|escribe|inserte|scrivere|scrivi|inserire|escreva|insira|schrijf|voer |wpisz|napisz|wstaw|напишите|введите|вставьте"

#: complete signs of their own: what a failing page-making program or an author's mark begins a line with
LINE_ERROR = regex.compile(
    rf"^\W*(?:http(?:/[\d.]+)?\s*)?(?:(?:{ERROR_WORD})\s*)?(?:[1-9]\d\d)?\s*[:–—-]?\s*(?:{REASONS})\W*(?:\(?\d*\)?)?\W*$|^\W*(?:{REASONS})[.!:]|^\W*(?:http )?[45]\d\d\W+(?:{REASONS})\b"
    rf"|^\W*(?:{ERROR_WORD})\s?[45]\d\d\s?[:.–—-]|^\W*fatal(?: error)?\s?:|^\W*(?:unhandled|uncaught) (?:exception|error)|^\W*traceback \("
)
LINE_FILLER = regex.compile(r"^\W*(?:todo|tbd|fixme)\b\W|(?<!\w)lorem ipsum dolor|\[\[(?:name|title) of (?:the )?(?:target|linked) (?:page|article)|\[(?:https?://\S+ )?link title\]")


def _slot_triggers() -> dict[str, re.Pattern[str]]:
    """literal in lower case -> what has to follow at its place for a line to be judged."""
    tags = TAGS.replace(" ", "|")
    return {
        k: re.compile(v)
        for k, v in {
            "$": r"\$\{|\$[0-9](?![0-9])", "{": r"\{\{\{|(?<![\w\\{$])\{[a-z][a-z_]*\}|\{\{\s*\w+\.", "@@": r"@@\w", "%": r"(?<![\w%])%(?:[sd](?!\w)|[a-z]\w*%)",
            "???": r"(?<=\s)\?{3}(?![?!])", "null": r"(?<!\w)null(?!\w)", "undefined": r"", "nan": r"(?<!\w)nan(?!\w)", "#": r"(?<![\w&#])#(?:[a-z][a-z_]*#|n/a|ref!|value!)", "[": r"\[(?:object object|insert |enter |your )|\[[^\]\n]{1,40} goes here\]",
            "none": r"(?<!\w)none(?!\w)", "xxxx": r"(?<![\w/])x{4}(?!\w)", "((": r"(?<!\()\(\([a-z]\w*\)\)", "__": r"(?<!\w)__[a-z]\w*?__(?!\w)", "<": rf"<%|<(?!/)(?!(?:{tags})\b)[a-z][a-z_]*>",
        }.items()
    }


def _near(words: str) -> re.Pattern[str]:
    return re.compile("|".join(rf"(?<!\w){re.escape(w)}" if w[0] != " " else re.escape(w) for w in words.split("|")))


#: kind -> (words that start a search, words that must be near)
PAIRS = {"error": ((FAIL, SITE),), "script": ((TECH, NEED),), "filler": ((DUMMY, UNIT), (HERE, WRITE))}
#: literals that start the search for a whole sign
SIGNS = {"error": f"{REASONS}|{ERROR_WORD}|fatal|exception|traceback (", "filler": "todo|tbd|fixme|lorem ipsum dolor|[name of|[title of|link title]"}

_FINDER: list = []


def _finder() -> ahocorasick.Automaton:
    """literal -> (length, [(kind, pattern of the partner, or None for a whole sign or a slot's mark)])."""
    if not _FINDER:
        known: dict[str, list] = {}
        for kind, pairs in PAIRS.items():
            for anchors, partners in pairs:
                near = _near(partners)
                for word in anchors.split("|"):
                    known.setdefault(word, []).append((kind, near))
        for kind, words in SIGNS.items():
            for word in words.split("|"):
                known.setdefault(word, []).append((f"{kind} sign", None))
        for literal, pattern in _slot_triggers().items():
            known.setdefault(literal, []).append(("slot", pattern))
        a = ahocorasick.Automaton()
        for literal, uses in known.items():
            a.add_word(literal, (len(literal), uses))
        a.make_automaton()
        _FINDER.append(a)
    return _FINDER[0]


#: where comments and code begin, which show what they hold instead of using it
_OPENS = re.compile(r"<(!--|(?:nowiki|syntaxhighlight|source|code|pre)\b)")


def visible(text: str) -> str:
    """The text without comments and code, in one forward pass.

    Code that is itself filler (what an editor's button leaves behind) stays visible.
    """
    out, at = [], 0
    ends: dict[str, int] = {}  # sign -> its next place, -1 if there is none any more

    def next_at(sign: str, start: int) -> int:
        if sign not in ends or -1 < ends[sign] < start:
            ends[sign] = text.find(sign, start)
        return ends[sign]

    for m in _OPENS.finditer(text):
        if m.start() < at:
            continue
        body, close = m.end(), "-->"
        if m.group(1) != "!--":
            body, close = next_at(">", m.end()) + 1, f"</{m.group(1)}>"
            if not body:
                continue
        end = next_at(close, body)
        if end < 0 or (close != "-->" and end - body <= 80 and any(k == "filler" for _, k in evidence(text[body:end]))):
            continue
        out += [text[at : m.start()], " "]
        at = end + len(close)
    return "".join([*out, text[at:]]) if out else text


#: quotations, which speak of what they hold; each mark ends the search from the one before, so it is linear
_QUOTED = re.compile(r"“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|(?<!\w)\"[^\"\n]{1,120}\"(?!\w)")
_LATIN = frozenset(FILLER_LATIN.split())
_ASCII_WORD = re.compile(r"[a-z0-9_]+")
_WORD = regex.compile(r"[\p{L}0-9]+")
_SLOT, _MENTION = regex.compile(SLOT), regex.compile(MENTION)
#: filler Latin: at least so many of its words, and at least half of the line's
LEAST_LATIN = 4


def filler_latin(line: str) -> bool:
    """The rule of filler Latin on a line in lower case, by all its words."""
    if sum(map(_LATIN.__contains__, _ASCII_WORD.findall(line))) < LEAST_LATIN:
        return False
    said = _QUOTED.sub(" ", line)
    latin = sum(map(_LATIN.__contains__, _ASCII_WORD.findall(said)))
    return latin >= LEAST_LATIN and latin * 2 >= len(_WORD.findall(said))


def _kind(line: str, low: str, hits: list) -> str | None:
    """The kind of evidence of a line; hits: (kind, partner, start, end) of the words that start a search."""
    quoted = [m.span() for m in _QUOTED.finditer(low)]
    begins = [x for x, _ in quoted]

    def said(at: int) -> bool:
        k = bisect_right(begins, at) - 1
        return k < 0 or at >= quoted[k][1]

    pairs = {"error": 0, "script": 0, "filler": 0, "slot": 0}
    tried = set()
    for kind, near, a, b in hits:
        if not said(a):
            continue
        if kind == "slot":
            if kind not in tried:
                bare = _QUOTED.sub(" ", line)
                pairs[kind] = bool(_SLOT.search(bare) and _SLOT.search(_MENTION.sub(" ", bare)))
            tried.add(kind)
        elif near is None:
            if kind not in tried and (LINE_ERROR if kind == "error sign" else LINE_FILLER).search(low):
                pairs[kind.split()[0]] = len(line)
            tried.add(kind)
        elif not (low[a].isalnum() and low[a - 1 : a].isalnum()):  # a word begins here
            left = max(0, a - NEAR)
            pairs[kind] += any(said(m.start() + at) for at, part in ((left, low[left:a]), (b, low[b : b + NEAR])) for m in near.finditer(part))
    for kind in ("error", "script"):
        if pairs[kind] and pairs[kind] * WORDS_A_PAIR >= low.count(" "):
            return kind
    return "filler" if pairs["filler"] else "slot" if pairs["slot"] else None


def evidence(text: str) -> list[tuple[int, str]]:
    """(line, kind) of the lines that hold evidence."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    lows: list[str] = low.split("\n")
    found = {k: "filler" for k, line in enumerate(lows) if filler_latin(line)}
    starts: list[int] | None = None
    hits: dict[int, list] = {}
    for end, (n, uses) in _finder().iter(low):
        at = end + 1 - n
        own = [(kind, near) for kind, near in uses if kind != "slot" or near.match(low, at)]
        if own:
            if starts is None:
                starts = [0] + [m.end() for m in re.finditer("\n", low)]
            k = bisect_right(starts, at) - 1
            hits.setdefault(k, []).extend((kind, near, at - starts[k], end + 1 - starts[k]) for kind, near in own)
    if hits:
        lines = text.split("\n")
        for k, own in hits.items():
            if k not in found and (kind := _kind(lines[k], lows[k], own)):
                found[k] = kind
    return sorted(found.items())


def judged_lines(text: str) -> list[tuple[str, str | None]]:
    """(line, kind or None) of every line of a text with evidence; no line of another."""
    if "<" in text:
        text = visible(text)
    found = dict(evidence(text))
    return [(line, found.get(k)) for k, line in enumerate(text.split("\n")) if line.strip()] if found else []


def normal(line: Column) -> Column:
    """Lower case, digits to 0, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), "\\s+", " ")))


def _rows(df: DataFrame, key: str, text: str, host: str, page: str | None) -> DataFrame:
    place = F.col(page if page else key).cast("string")
    return df.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("host"), F.xxhash64(place).alias("page"), F.col(text).cast("string").alias("t")).where("id IS NOT NULL AND t <> ''")


def _hashes() -> Column:
    """The hashes of the normalised lines of a text, null for blank ones."""
    return F.transform(F.split("t", "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(normal(x))))


def recurrent_lines(df: DataFrame, key: str, text: str, host: str, page: str | None = None, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, line, n, pages): hashes of the lines that stand on least_pages and least_share of a host's pages.

    Every line of every text is counted, once for each page of the host however
    many copies the page has.  A host has at most 1 / least_share times the mean
    number of lines of its pages of such lines.
    """
    every = F.concat(_hashes(), F.array(F.lit(0).cast("long")))
    lines = _rows(df, key, text, host, page).select("host", "page", F.explode(F.array_distinct(every)).alias("line")).where("line IS NOT NULL")
    counts = lines.groupBy("host", "line", "page").agg(F.lit(1)).groupBy("host", "line").agg(F.count("*").alias("n")).where((F.col("n") >= least_pages) | (F.col("line") == 0))
    counts = stash(counts, "lines")
    hosts = counts.where("line = 0").select("host", F.col("n").alias("pages"))  # 0 stands for the page itself
    return counts.where((F.col("line") != 0) & (F.col("n") >= least_pages)).join(hosts, "host").where(F.col("n") >= F.col("pages") * least_share)


def evidence_lines(df: DataFrame, key: str, text: str, host: str, page: str | None = None) -> DataFrame:
    """(id, host, line, evidence): hashed lines of every text with evidence; a null evidence for its other lines."""
    rows = _rows(df, key, text, host, page).select("id", "host", "t")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, h, line, kind) for k, h, t in zip(b["id"], b["host"], b["t"]) for line, kind in judged_lines(t)]
            if got:  # an empty frame has no types
                yield pd.DataFrame(got, columns=["id", "host", "line", "evidence"])

    kind_of_id = rows.schema["id"].dataType.simpleString()
    lines = rows.mapInPandas(find, f"id {kind_of_id}, host long, line string, evidence string")
    return lines.select("id", "host", F.xxhash64(normal(F.col("line"))).alias("line"), "evidence")


def _often(df: DataFrame, key: str, text: str, host: str, page: str | None, least_pages: int, least_share: float) -> DataFrame:
    """(host, line, often = true), broadcast if it is small."""
    often = stash(recurrent_lines(df, key, text, host, page, least_pages, least_share).select("host", "line", F.lit(True).alias("often")), "often")
    return F.broadcast(often) if often.count() <= BROADCAST_ROWS else often


def residual(df: DataFrame, key: str, text: str, host: str, page: str | None = None, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, lines, subtracted): how many lines of each text are not blank, and how many of these are boilerplate of its host.
    Repeated rows of an id add up; texts without such a line are left out."""
    often = _often(df, key, text, host, page, least_pages, least_share)
    lines = _rows(df, key, text, host, page).select("id", "host", F.explode(_hashes()).alias("line")).where("line IS NOT NULL")
    return lines.join(often, ["host", "line"], "left").groupBy("id").agg(F.count("*").alias("lines"), F.count_if("often").alias("subtracted"))


def residue(df: DataFrame, key: str, text: str, host: str, page: str | None = None, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, evidence): documents that are residue, one row each, with the kinds of evidence found.

    page: the column of which a host's copies of one page share the value; a
    line is boilerplate by the number of pages that hold it, not of their copies.
    """
    found = stash(evidence_lines(df, key, text, host, page), "residue")
    left = found.join(_often(df, key, text, host, page, least_pages, least_share), ["host", "line"], "left")
    rest = F.col("often").isNull()
    by = left.groupBy("id").agg(F.count_if(rest).alias("rest"), F.collect_set(F.when(rest, F.col("evidence"))).alias("of_rest"), F.collect_set("evidence").alias("of_all"))
    whole = F.when(F.col("rest") == 0, F.col("of_all")).otherwise(F.col("of_rest"))
    return by.select("id", F.array_sort(whole).alias("evidence")).where(F.size("evidence") > 0)


def exclude(df: DataFrame, key: str, text: str, host: str, page: str | None = None) -> DataFrame:
    """df without the documents that are residue; rows of a null id stay."""
    bad = residue(df, key, text, host, page).select(F.col("id").alias("_residue_id"))
    return df.join(bad, df[key] == F.col("_residue_id"), "left_anti")
