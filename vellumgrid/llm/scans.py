"""Problem 6: text from scanned pages repaired to continuous, readable paragraphs.

Words are grouped by their confusable-glyph skeleton; a rare form of a group is
a misread one of its frequent form where the neighbours support that form.
Running headers are lines that, with digits masked, repeat a page header of the
same document; page numbers stand on lines of their own.  Reflow joins what is
left with SQL windows over the lines.

Defined cases: null and empty texts give no finding and come back unchanged;
null document ids match no header; repeated rows of an id count once; ties
between frequent forms go to the greater string; extra columns are ignored; an
empty table gives empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumgrid.runtime import stash

# Glyphs that scanners take for one another, each drawn with the same strokes.
STROKES = (("m", "rri"), ("n", "ri"), ("w", "vv"), ("u", "ii"), ("d", "ci"), ("h", "ii"), ("ы", "ьi"))
CLASSES = {"e": "c", "0": "o", "о": "o", "@": "a", "!": "i", "1": "i", "l": "i", "|": "i", "+": "t", "5": "s", "6": "b", "б": "b", "9": "g", "8": "в", "3": "з", "и": "н", "п": "л", "ш": "т", "~": ""}
#: a frequent form: so often in clean text, and so many times as often there as the rare form
LEAST_COUNT, LEAST_RATIO = 3, 20
#: where the rare forms are too many to broadcast, sound words of at least this part of all occurrences (so at most
#: as many words) are, to spare theirs the join
SOUND_WORDS = 20_000
#: distinct grams a Python worker holds before it hands them to the JVM, which counts on before the shuffle
HELD_GRAMS = 100_000
#: a table of candidates of at most so many bytes is broadcast; a larger one is shuffled
BROADCAST_BYTES = 32 << 20
#: parts that the rows of one key are dealt over where a table is shuffled
SALTS = 32

HYPHENS = "-‐‑¬=~\xad"
BROKEN = regex.compile(rf"(?<=\p{{L}})[{HYPHENS}][ \t]*\n[ \t]*(?=\p{{L}})")
#: a hyphenated word that a page number or header line interrupts
INTERRUPTED = regex.compile(rf"\p{{L}}[{HYPHENS}][ \t]*(?:\n|$)")
_FRAME = r"[\s\-–—\[\]().|•*·~_=:]*"
PAGE_NUMBER = regex.compile(
    rf"^{_FRAME}(?:(?:p|pp|pg|page|s|seite|str|strona|pag|pág|página|pagina|blz|с|стр)\.?\s*)?\d{{1,4}}{_FRAME}$"
    rf"|^{_FRAME}(?=[ivxlc])(?:c{{0,3}})(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}}){_FRAME}$|^\d{{1,4}}\s?(?:/|of|von|de|sur|van|z|из)\s?\d{{1,4}}$",
    regex.I,
)
#: a number that ends a sentence or a bracket begun on the line before
SENTENCE_NUMBER = regex.compile(r"^[^(\[]*\p{N}+\s?[)\]]|^.*[\p{L}\p{N})\]]\s?[.,;:!?]+$")
TOKEN = re.compile(r"[^\s.,;:()\[\]“”„«»‘’'\"…/?{}<>]+")
_EDGE = regex.compile(r"^[^\p{L}\p{N}@!+|~]+|[^\p{L}\p{N}@!+|~]+$")


def skeleton(word: Column) -> Column:
    """The strokes of a word: the same for a word and its misread forms."""
    out = word
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    kept = [(a, b) for a, b in CLASSES.items() if b] + [(a, b) for a, b in CLASSES.items() if not b]
    return F.translate(out, "".join(a for a, _ in kept), "".join(b for _, b in kept))


def masked(line: Column) -> Column:
    """A line as headers are compared: lower case, without digits, marks and spaces."""
    return F.lower(F.regexp_replace(line, "[^\\p{L}]+", ""))


def mask(line: str) -> str:
    return regex.sub(r"[^\p{L}]+", "", line).lower()


def tail(line: str) -> str:
    """A line's mask without its first word: the title of a section, where the first word names the document."""
    return "".join(regex.findall(r"\p{L}+", line)[1:]).lower()


def tokens(text: str) -> list[str]:
    """Lower-case words, hyphenation undone."""
    if "\n" in text:
        text = BROKEN.sub("", text)
    words = TOKEN.findall(text.lower())
    # nearly every word begins and ends with a letter or digit; only the others are trimmed
    return words if all(map(str.isalnum, words)) else [t for w in words if (t := w if w[0].isalnum() and w[-1].isalnum() else _EDGE.sub("", w))]


def grams(df: DataFrame, text: str, scanned: str) -> DataFrame:
    """(gram, clean, n): words and pairs of neighbours over all rows, counted in clean texts and in all.

    Counted within each batch first; the shuffle carries distinct grams only.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean: Counter[str] = Counter()
        scan: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            keys = list(clean.keys() | scan.keys())
            got = pd.DataFrame({"gram": keys, "clean": [clean[k] for k in keys], "n": [clean[k] + scan[k] for k in keys]})
            clean.clear()
            scan.clear()
            return got

        for b in batches:
            for t, s in zip(b["t"], b["s"]):
                words = tokens(t)
                to = scan if s else clean
                to.update(words)
                to.update(map(" ".join, zip(words, words[1:])))
            if len(clean) + len(scan) > HELD_GRAMS:
                yield out()
        if clean or scan:  # an empty frame has no types
            yield out()

    rows = df.select(F.col(text).alias("t"), F.coalesce(F.col(scanned), F.lit(False)).alias("s")).where("t <> ''")
    return rows.mapInPandas(count, "gram string, clean long, n long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("n").alias("n"))


def confusions(counts: DataFrame) -> DataFrame:
    """(rare, form, rare_clean, form_clean): each rare form with every frequent form of its skeleton."""
    words = counts.where(~F.col("gram").contains(" ")).select(F.col("gram").alias("word"), "clean", "n").withColumn("skeleton", skeleton(F.col("word")))
    words = words.where((F.length("skeleton") > 1) & F.col("word").rlike("\\p{L}"))
    forms = words.where((F.col("clean") >= LEAST_COUNT) & F.col("word").rlike("^\\p{L}+$")).select("skeleton", F.col("word").alias("form"), F.col("clean").alias("form_clean"))
    pairs = words.join(forms, "skeleton").where(f"word <> form AND clean * {LEAST_RATIO} <= form_clean")
    return pairs.select(F.col("word").alias("rare"), "form", F.col("clean").alias("rare_clean"), "form_clean")


def _bytes(small: DataFrame) -> int:
    """About how much memory a table takes."""
    size = sum([F.octet_length(F.col(f.name).cast("string")) if f.dataType.simpleString() == "string" else F.lit(16) for f in small.schema.fields], F.lit(32))
    return small.agg(F.sum(size)).first()[0] or 0


def _meet(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """big joined with a table of candidates, kept in the shared folder, whose size decides how.

    Up to BROADCAST_BYTES it is broadcast.  A larger one is repeated for each of
    SALTS parts and big is dealt over them, since one word or line may be that of
    a third of all rows.
    """
    if _bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def misreads(df: DataFrame, key: str, text: str, counts: DataFrame) -> DataFrame:
    """(id, rare, form): the misread words of scanned texts, with the form to put in their place."""
    pairs = stash(confusions(counts), "confusions")
    rare = stash(pairs.select(F.col("rare").alias("gram")).distinct(), "rare")
    few = _bytes(rare) <= BROADCAST_BYTES // 4
    if few:  # only words that can be a misreading leave the workers
        told = {r[0] for r in rare.collect()}
    else:
        words = counts.where(~F.col("gram").contains(" "))
        total = words.agg(F.sum("n")).first()[0] or 0
        # at most SOUND_WORDS words can each have that share of all occurrences: the set is bounded whatever the corpus
        often = words.where(F.col("n") * SOUND_WORDS >= total).select("gram")
        told = {r[0] for r in often.join(rare, "gram", "left_anti").collect()}
    known = df.sparkSession.sparkContext.broadcast(told)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_told = known.value
        for b in batches:
            ids, before, rare, after = [], [], [], []
            for k, t in zip(b["id"], b["t"]):
                words = tokens(t)
                odd = [i for i, w in enumerate(words) if (w in words_told) == few]
                if odd:
                    words.append(None)  # stands after the last word, and as [-1] before the first
                    ids += [k] * len(odd)
                    before += [words[i - 1] for i in odd]
                    rare += [words[i] for i in odd]
                    after += [words[i + 1] for i in odd]
            if ids:
                yield pd.DataFrame({"id": ids, "before": before, "rare": rare, "after": after})

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t <> ''")
    id_type = rows.schema["id"].dataType.simpleString()
    odd = rows.mapInPandas(emit, f"id {id_type}, before string, rare string, after string")
    hits = stash(_meet(odd, pairs, ["rare"]).select("id", "before", "rare", "after", "form", "form_clean"), "hits")
    left, right = F.when(F.col("before").isNotNull(), F.concat_ws(" ", "before", "form")), F.when(F.col("after").isNotNull(), F.concat_ws(" ", "form", "after"))
    asked = stash(hits.select(F.explode(F.array(left, right)).alias("gram")).where("gram IS NOT NULL").distinct(), "asked")
    seen = stash(_meet(counts.where("clean > 0"), asked, ["gram"], "left_semi").select("gram", "clean"), "seen")
    got = hits.withColumns({"lg": left, "rg": right})
    for gram, n in (("lg", "ln"), ("rg", "rn")):
        got = _meet(got, seen.select(F.col("gram").alias(gram), F.col("clean").alias(n)), [gram], "left")
    support = F.coalesce("ln", F.lit(0)) + F.coalesce("rn", F.lit(0))
    both = F.col("ln").isNotNull() & F.col("rn").isNotNull()
    edge = F.col("before").isNull() | F.col("after").isNull()
    glyph = F.col("rare").rlike("[@!+|~0-9]")
    sure = F.when(F.length("rare") <= 2, both | (edge & (support > 0) & glyph)).otherwise(support > 0)
    # of the forms that the neighbours support the one they support most, then the most frequent
    judged = got.where(sure).select("id", "rare", F.struct(support.alias("support"), "form_clean", "form").alias("best"))
    return judged.groupBy("id", "rare").agg(F.max("best").alias("best")).select("id", "rare", F.col("best.form").alias("form"))


def noise_lines(lines: list[str]) -> tuple[list[int], list[int]]:
    """(page-number lines, the other lines that are not blank) of a text of several lines."""
    numbers, others = [], []
    for i, line in enumerate(lines):
        s = line.strip()
        if s:
            (numbers if PAGE_NUMBER.match(s) and not SENTENCE_NUMBER.match(s) else others).append(i)
    return numbers, others


def line_findings(df: DataFrame, key: str, text: str, document: str, headers: DataFrame) -> DataFrame:
    """(id, finding, line_no): 'broken' words at line ends, 'page_number' and 'header' lines.

    headers: (document, masked, tail) of the page headers.  A line is a header
    if it repeats one of its document, or if it stands in two texts of its
    document at least and its tail is that of a header of any document.
    Lines of any length are compared, by the digests of their masks.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, doc, t in zip(b["id"], b["doc"], b["t"]):
                if BROKEN.search(t):
                    rows.append((k, doc, "broken", -1, None, None))
                if "\n" in t:
                    lines = t.split("\n")
                    numbers, others = noise_lines(lines)
                    rows += [(k, doc, "page_number", i, None, None) for i in numbers]
                    rows += [(k, doc, "line", i, m, tail(lines[i]) or None) for i in others if (m := mask(lines[i]))]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "doc", "finding", "line_no", "masked", "tail"])

    digest = lambda c: F.unhex(F.md5(c)).alias(c)
    rows = df.select(F.col(key).alias("id"), F.col(document).cast("string").alias("doc"), F.col(text).alias("t")).where("id IS NOT NULL AND contains(t, '\n')")
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(find, f"id {id_type}, doc string, finding string, line_no int, masked string, tail string")
    found = stash(found.select("id", "doc", "finding", "line_no", digest("masked"), digest("tail")), "lines")
    heads = headers.select(F.col("document").cast("string").alias("doc"), digest("masked")).where("masked IS NOT NULL").distinct()
    tails = stash(headers.where("length(tail) >= 4").select(digest("tail")).distinct(), "tails")
    lines = found.where("finding = 'line'")
    again = _meet(lines, tails, ["tail"], "left_semi")
    often = again.groupBy("doc", "masked").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("doc", "masked")
    matched = _meet(lines, stash(heads.unionByName(often).distinct(), "heads"), ["doc", "masked"], "left_semi").select("id", F.lit("header").alias("finding"), "line_no")
    return found.where("finding <> 'line'").select("id", "finding", "line_no").unionByName(matched).distinct()


def header_lines(pages: DataFrame, document: str, text: str) -> DataFrame:
    """(document, masked, tail) of the elements that are page headers."""
    rest = F.regexp_extract(F.regexp_replace(F.col(text), "^[^\\p{L}]+", ""), "^\\p{L}+([\\s\\S]*)$", 1)
    return pages.select(F.col(document).cast("string").alias("document"), masked(F.col(text)).alias("masked"), masked(rest).alias("tail")).where("document IS NOT NULL AND length(masked) >= 3").distinct()


def reflow(df: DataFrame, key: str, text: str, findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """(id, text, repaired): noise lines dropped, broken words joined, lines run on, misread words replaced.

    Windows over the lines of a text see the line before; blank lines separate paragraphs.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL").groupBy("id").agg(F.min("t").alias("t"))
    lines = rows.select("id", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    drop = findings.where("finding IN ('page_number', 'header')").select("id", "line_no").distinct()
    kept = lines.join(drop, ["id", "line_no"], "left_anti")
    order = W.partitionBy("id").orderBy("line_no")
    before = F.lag("line").over(order)
    hyphen = f"\\p{{L}}[{HYPHENS}][ \\t]*$"
    glue = (
        F.when(before.isNull(), "")
        .when((F.trim("line") == "") | (F.trim(before) == ""), "\n")
        .when(before.rlike(hyphen) & F.col("line").rlike("^[ \\t]*\\p{L}"), "")
        .otherwise(" ")
    )
    after = F.lead("line").over(order)
    body = F.when(F.col("line").rlike(hyphen) & F.coalesce(after.rlike("^[ \\t]*\\p{L}"), F.lit(False)), F.regexp_replace("line", f"[{HYPHENS}][ \\t]*$", "")).otherwise(F.rtrim("line"))
    parts = kept.select("id", "line_no", F.concat(glue, F.when(before.isNull(), body).otherwise(F.ltrim(body))).alias("part"))
    joined = parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("joined"))
    per_text = fixes.groupBy("id").agg(F.collect_set(F.struct("rare", "form")).alias("fixes"))

    @F.pandas_udf("string")
    def apply(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else replace(t, {x["rare"]: x["form"] for x in f}) for t, f in zip(texts, fixes)], dtype=object)

    return rows.join(joined, "id", "left").join(per_text, "id", "left").select("id", F.col("t").alias("text"), apply(F.coalesce("joined", F.lit("")), "fixes").alias("repaired"))


def replace(text: str, fixes: dict[str, str]) -> str:
    """Misread words replaced, capitals of the first letter and of whole words kept."""

    def one(m: "re.Match[str]") -> str:
        whole = m.group()
        core = _EDGE.sub("", whole)
        form = fixes.get(core.lower())
        if form is None:
            return whole
        if core.upper() == core and core.lower() != core and len(core) > 1:
            form = form.upper()
        elif core[:1].isupper():
            form = form[:1].upper() + form[1:]
        return whole.replace(core, form, 1)

    return TOKEN.sub(one, text)
