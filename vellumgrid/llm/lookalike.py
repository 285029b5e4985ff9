"""Problem 1: texts that look the same but are stored with different characters.

Look-alike classes are built by union-find over strings and code points, each
class gets its most frequent member in the corpus as representative, and texts
are rewritten greedily (leftmost, longest) with an Aho-Corasick automaton.

Defined cases: a null text stays null and is in no pair; an empty text stays
empty; repeated rows of one id count once; columns other than the id and text
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumgrid.runtime import stash

# Letters of other scripts drawn like Latin ones, in code-point order of the letter.
GREEK_LIKE_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX νv οo ρp ϲc ϳj"
CYRILLIC_LIKE_LATIN = "ЅS ІI ЈJ АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj ѴV ѵv ҮY һh Ӏl ӏl ԁd ԛq ԜW ԝw"
OTHER_LIKE = "ɑa ɡg µμ ΩΩ"
PUNCTUATION_LIKE = "‐- ‑- ＇' ʹ' ‚‚ ·· ⋅· ∙·"
# Letters and ligatures whose compatibility form is a visibly different letter.
NOT_ALIKE = "ſﬅ"
# Format characters that are drawn although their category is Cf.
DRAWN_FORMAT = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
# Ignorable code points outside category Cf, as ranges.
IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]


class UnionFind:
    """Disjoint sets over strings; find() compresses paths."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def invisible(cp: int) -> bool:
    return (unicodedata.category(chr(cp)) == "Cf" and cp not in DRAWN_FORMAT) or any(a <= cp <= b for a, b in IGNORABLE)


def drawn_as(ch: str) -> str | None:
    """What a single code point looks like, by the character database; None if only like itself."""
    cp, cat = ord(ch), unicodedata.category(ch)
    if invisible(cp):
        return ""
    if cat == "Zs":
        return " " if cp != 0x1680 else None
    kind, _, rest = unicodedata.decomposition(ch).rpartition(">")
    if not rest or ch in NOT_ALIKE:
        return None
    to = "".join(chr(int(x, 16)) for x in rest.split())
    if not kind:  # canonical
        return to
    kind = kind.strip("<")
    if kind in ("wide", "narrow", "font", "noBreak") or (kind == "compat" and cat in ("Ll", "Lu", "Lt", "Lo", "Nl")):
        return to
    return None


def ligature_strings() -> list[str]:
    """ASCII strings that a single letter can stand for (fi, fl, ij ...): their counts need a search."""
    found = {drawn_as(chr(c)) for c in range(0x80, 0xFB07)}
    return sorted(x for x in found if x and len(x) > 1 and x.isascii() and x.isalpha())


def look_alike_pairs(observed: Iterable[str]) -> list[tuple[str, str]]:
    """Pairs for the characters that occur, and for what those expand to."""
    pairs: list[tuple[str, str]] = []
    for group in (GREEK_LIKE_LATIN, CYRILLIC_LIKE_LATIN, OTHER_LIKE, PUNCTUATION_LIKE):
        pairs += [(x[0], x[1]) for x in group.split(" ") if len(x) == 2 and x[0] != x[1]]
    todo, seen = list(observed), set()
    marks = {c for c in todo if unicodedata.combining(c)}
    if marks:  # a composed letter may occur only as base and mark
        todo += [chr(c) for c in range(0xC0, 0x2000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and chr(int(d.split()[-1], 16)) in marks]
    while todo:
        ch = todo.pop()
        if ch in seen:
            continue
        seen.add(ch)
        to = drawn_as(ch)
        if to is not None and to != ch:
            pairs.append((ch, to))
            todo += list(to)
            full = unicodedata.normalize("NFD", ch)
            if not unicodedata.decomposition(ch).startswith("<") and full not in (ch, to):
                pairs.append((ch, full))
    return pairs


def classes(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Transitive classes.  Strings whose parts are alike are alike too, so unions repeat until stable."""
    sets = UnionFind()
    for a, b in pairs:
        sets.union(a, b)
    while True:
        by_parts: dict[tuple[str, ...], str] = {}
        before = {x: sets.find(x) for x in list(sets.up)}
        for x in before:
            if len(x) > 1:
                parts = tuple(sets.find(c) for c in x)
                if parts in by_parts:
                    sets.union(by_parts[parts], x)
                else:
                    by_parts[parts] = x
        if all(sets.find(x) == r for x, r in before.items()):
            break
    groups: dict[str, list[str]] = {}
    for x in list(sets.up):
        groups.setdefault(sets.find(x), []).append(x)
    # mixed spellings of a composed letter: every base of a look-alike class with the same mark
    for members in groups.values():
        for x in [m for m in members if len(m) == 2 and unicodedata.combining(m[1])]:
            for base in groups.get(sets.find(x[0]), []):
                if len(base) == 1 and base + x[1] not in members:
                    members.append(base + x[1])
    return groups


def rewrite_table(counts: dict[str, int]) -> dict[str, str]:
    """pattern -> representative: the member most frequent in the corpus (ties: shorter, then smaller)
    among those that hold no pattern themselves, so that rewriting ends."""
    groups = [m for m in classes(look_alike_pairs([c for c in counts if len(c) == 1])).values() if len(m) > 1]
    order = [[""] if "" in m else sorted(m, key=lambda x: (-counts.get(x, 0), len(x), x)) for m in groups]
    barred: set[str] = set()
    while True:
        best = [next((x for x in o if x not in barred), o[0]) for o in order]
        table = {x: b for m, b in zip(groups, best) for x in m if x != b}
        odd = {b for b in best if b not in barred and any(b[i:j] in table for i in range(len(b)) for j in range(i + 1, len(b) + 1))}
        if not odd:
            return table
        barred |= odd


def count_characters(df: DataFrame, text: str) -> dict[str, int]:
    """Occurrences over all rows of every code point and of every string a ligature stands for.

    The result is bounded by the number of Unicode code points and of pairs of a
    base letter and a mark, whatever the corpus.
    """
    strings = ligature_strings()

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, dtype=np.int64)
        found: Counter[str] = Counter()
        for b in batches:
            rows = b["t"].tolist()
            for k in range(0, len(rows), 2000):
                joined = "\x00".join(rows[k : k + 2000])
                if not joined:
                    continue
                units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                got = np.bincount(units)
                total[: len(got)] += got
                for s in strings:
                    found[s] += joined.count(s)
                if any(unicodedata.combining(chr(c)) for c in np.flatnonzero(got[0x300:0x370]) + 0x300):
                    marks = np.flatnonzero((units[1:] >= 0x300) & (units[1:] < 0x370))
                    found.update(chr(a) + chr(m) for a, m in zip(units[marks].tolist(), units[marks + 1].tolist()))
        seen = [int(i) for i in np.flatnonzero(total) if i and not 0xD800 <= i < 0xE000]
        if seen:  # an empty frame has no types
            yield pd.DataFrame({"m": [chr(i) for i in seen] + list(found), "n": [int(total[i]) for i in seen] + list(found.values())})

    part = df.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL AND t <> ''").mapInPandas(per_batch, "m string, n long")
    return {r["m"]: r["n"] for r in part.groupBy("m").agg(F.sum("n").alias("n")).where("n > 0").collect()}


_AUTOMATA: dict[frozenset, ahocorasick.Automaton] = {}


def _automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    key = frozenset(table.items())
    if key not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for pattern, to in table.items():
            a.add_word(pattern, (len(pattern), to))
        a.make_automaton()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def rewrite(text: str, automaton: ahocorasick.Automaton) -> str:
    """Greedy leftmost-longest rewriting, repeated until nothing matches (a deleted
    invisible character may bring a base and its mark together).

    It ends: no representative holds a pattern, and every form a text passes
    through looks the same, of which there are finitely many; should two patterns
    that overlap turn one form into the other and back, the least of them stands.
    """
    seen: dict[str, None] = {}
    while text not in seen:
        seen[text] = None
        out, at = [], 0
        for end, (n, to) in automaton.iter_long(text):
            out.append(text[at : end + 1 - n])
            out.append(to)
            at = end + 1
        if not at:
            return text
        out.append(text[at:])
        text = "".join(out)
    forms = list(seen)
    return min(forms[forms.index(text) :])


def rewriter(spark: SparkSession, table: dict[str, str]) -> "Callable[[Column], Column]":
    """A pandas UDF that rewrites with the table, which has at most one pattern for a code point that occurs or a spelling of one."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        a = _automaton(shared.value)
        return texts.map(lambda t: t if t is None else rewrite(t, a))

    return run


def may_change(text: Column, table: dict[str, str]) -> Column:
    """A cheap JVM test for texts that can hold a pattern: any character beyond ASCII
    (more bytes than characters), or one of the ASCII patterns, if there are any."""
    test = F.octet_length(text) > F.length(text)
    for p in sorted(p for p in table if p.isascii()):
        test = test | text.contains(p)
    return test


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical_text", counts: dict[str, int] | None = None) -> DataFrame:
    """df with the consistent form of its text column.

    Two passes: code-point frequencies over all rows choose the representatives;
    then only texts that hold a non-representative travel to Python.
    """
    counts = count_characters(df, text) if counts is None else counts
    table = rewrite_table(counts)
    if not table:
        return df.withColumn(out, F.col(text))
    need = F.when(may_change(F.col(text), table), F.col(text))
    return df.withColumn(out, F.coalesce(rewriter(df.sparkSession, table)(need), F.col(text)))


#: rows of one spelling, or spellings of one class, that one side of a join task holds
HOT_ROWS = 2_000
#: classes of several spellings of at most so many bytes are broadcast; of more only those of HOT_CLASS rows and above
BROADCAST_BYTES, HOT_CLASS = 32 << 20, 1_000_000


def hashed_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, raw, cls): each key with the digests of its text as stored and of its canonical form, once."""
    keyed = with_canonical(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL AND t <> ''"), "t", "c")
    return stash(keyed.select("k", F.unhex(F.md5("t")).alias("raw"), F.unhex(F.md5("c")).alias("cls")), "lookalike")


def of_several_spellings(hashed: DataFrame) -> DataFrame:
    """The rows of hashed whose class has two spellings at least, each once.

    The classes are found by a map-side combined test.  They are broadcast if
    they are small.  Else the rows of the hottest, which are as few as their
    size says, are taken by a broadcast, and only the others are shuffled by class.
    """
    mixed = hashed.groupBy("cls").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("cls", "n")
    mixed = stash(mixed, "classes")
    if mixed.count() * 64 <= BROADCAST_BYTES:
        kept = hashed.join(F.broadcast(mixed.select("cls")), "cls", "left_semi")
    else:
        hot = F.broadcast(mixed.where(F.col("n") >= HOT_CLASS).select("cls"))
        cold = hashed.join(hot, "cls", "left_anti").join(mixed.where(F.col("n") < HOT_CLASS), "cls", "left_semi")
        kept = hashed.join(hot, "cls", "left_semi").unionByName(cold)
    return stash(kept.distinct(), "members")


def spellings(members: DataFrame) -> DataFrame:
    """(cls, raw, n, m): the spellings of the members; n rows of the spelling, m spellings of the class."""
    spelt = members.groupBy("cls", "raw").agg(F.count("*").alias("n"))
    return spelt.join(spelt.groupBy("cls").agg(F.count("*").alias("m")), "cls")


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class_id, spellings): the members of every class of several spellings; class_id is the least key of the class.

    This is the form to use at scale: one row a member, where pairs grow with the square of a class.
    """
    members = of_several_spellings(hashed_classes(df, key, text))
    by = members.groupBy("cls", "raw").agg(F.min("k").alias("k")).groupBy("cls").agg(F.min("k").alias("class_id"), F.count("*").alias("spellings"))
    return members.select("k", "cls").distinct().join(by, "cls").select(F.col("k").alias("id"), "class_id", "spellings")


def look_alike_pairs_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): pairs of different keys whose texts differ as strings but share a canonical form.

    Spellings meet before rows do, so rows of one spelling never meet each other.
    Spellings of a class, and rows of a spelling, are dealt over buckets of about
    HOT_ROWS; each pair of buckets is a join key of its own.  Rows are repeated
    once for each bucket that they meet, which is less often than they are in the result.
    """
    return _pairs(hashed_classes(df, key, text))


def _buckets(n: str) -> Column:
    return F.ceil(F.col(n) / HOT_ROWS).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _pairs(hashed: DataFrame) -> DataFrame:
    members = of_several_spellings(hashed)
    spelt = stash(spellings(members).withColumns({"rows": _buckets("n"), "kinds": _buckets("m")}).drop("n", "m"), "spellings")
    own = F.pmod(F.xxhash64("raw"), F.col("kinds")).cast("int")
    left = spelt.withColumn("x", own).withColumn("y", _each(F.col("kinds"))).select("cls", "x", "y", "raw", "rows")
    right = spelt.withColumn("y", own).withColumn("x", _each(F.col("kinds"))).select("cls", "x", "y", F.col("raw").alias("raw2"), F.col("rows").alias("rows2"))
    met = left.join(right, ["cls", "x", "y"]).where("raw < raw2").select("raw", "raw2", "rows", "rows2")
    cells = met.withColumn("x", _each(F.col("rows"))).withColumn("y", _each(F.col("rows2"))).select("raw", "raw2", "x", "y")
    dealt = stash(members.join(spelt.select("raw", "rows"), "raw").select("k", "raw", F.pmod(F.xxhash64("k"), F.col("rows")).cast("int").alias("bucket")), "dealt")
    a = dealt.select(F.col("k").alias("ka"), "raw", F.col("bucket").alias("x")).join(cells, ["raw", "x"])
    b = dealt.select(F.col("k").alias("kb"), F.col("raw").alias("raw2"), F.col("bucket").alias("y")).join(cells, ["raw2", "y"])
    both = a.join(b, ["raw", "raw2", "x", "y"]).where("ka <> kb")
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
