"""Problem 3: text decoded with the wrong character encoding.

A multinomial classifier over hashed byte bigrams is trained on synthetically
garbled records and predicts the exact chain of encodings of a record: the chain
of the greatest likelihood over all its runs beyond ASCII.  It is inverted
strictly: every character must have a byte in the wrong encoding and the bytes
must decode in the right one.  Runs that the chain cannot have made are judged
again by themselves, so a text put together from two sources names both.
Chains that lose characters are classes of their own: found, not restored.

Defined cases: null and empty texts are clean (null chain, text unchanged); of a
chain that lost characters the name begins with 'lost'; repeated rows are judged alike; other columns pass through, clashing output names are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 8192
#: (bytes of, read as) pairs, applied one after the other
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8>cp1252": (("utf-8", "cp1252"),),
    "utf-8>latin-1": (("utf-8", "latin-1"),),
    "utf-8>mac_roman": (("utf-8", "mac_roman"),),
    "utf-8>cp437": (("utf-8", "cp437"),),
    "utf-8>cp850": (("utf-8", "cp850"),),
    "utf-8>cp1250": (("utf-8", "cp1250"),),
    "utf-8>cp1251": (("utf-8", "cp1251"),),
    "utf-8>koi8_r": (("utf-8", "koi8_r"),),
    "utf-8>cp866": (("utf-8", "cp866"),),
    "utf-8>cp1252>utf-8>cp1252": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf-8>latin-1>utf-8>latin-1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf-8>latin-1>utf-8>cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    "utf-8>cp1251>utf-8>cp1251": (("utf-8", "cp1251"), ("utf-8", "cp1251")),
    "cp1251>cp1252": (("cp1251", "cp1252"),),
    "koi8_r>cp1252": (("koi8_r", "cp1252"),),
    "koi8_r>cp1251": (("koi8_r", "cp1251"),),
    "cp1251>koi8_r": (("cp1251", "koi8_r"),),
    "cp866>cp1252": (("cp866", "cp1252"),),
    "cp1250>cp1252": (("cp1250", "cp1252"),),
    "iso8859_2>latin-1": (("iso8859_2", "latin-1"),),
    "cp1252>latin-1": (("cp1252", "latin-1"),),
}
#: chains that leave a proof in every run: valid UTF-8, or controls where marks should be; the others are judged by words
STRICT = [c for c, steps in CHAINS.items() if steps[0][0] == "utf-8" or c == "cp1252>latin-1"]
LOOSE = [c for c in CHAINS if c not in STRICT]
CLEAN = "clean"
CYRILLIC_READ = ("utf-8>koi8_r", "utf-8>cp866")
#: so many different runs prove by their number what none of them proves alone
LEAST_DOUBTFUL = 3
#: chains that lose characters: UTF-8 read as Latin-1 without controls, as ASCII, and 8-bit text read as UTF-8
DROPPED, TO_ASCII, FROM_8_BIT = LOST = ("lost utf-8>latin-1", "lost utf-8>ascii", "lost 8-bit>utf-8")
#: what UTF-8 lead bytes look like in Latin-1
LEADS = re.compile("[ÂÃÄÅâÐÑ]")
CONTROLS = re.compile("[\x80-\x9f]")
RUN = re.compile(r"[^\x00-\x7f]{2,}|[\x80-\x9f]")
#: replacement characters, each stretch with the characters beside it
BEYOND = re.compile(r"[^\x00-\x7f]+")
REPLACED = re.compile(r"\S?\ufffd+\S?")


def _table(name: str) -> tuple[list[str], dict[str, int]]:
    """byte -> character and back; bytes without a character stand for the control of that number."""
    to = []
    for b in range(256):
        try:
            to.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            to.append(chr(b))
    return to, {c: b for b, c in reversed(list(enumerate(to)))}


TABLES = {n: _table(n) for n in sorted({e for steps in CHAINS.values() for pair in steps for e in pair} - {"utf-8"})}


def garble(text: str, chain: str) -> str | None:
    """The text as the chain spoils it; None where a character has no byte."""
    for right, wrong in CHAINS[chain]:
        try:
            raw = text.encode("utf-8") if right == "utf-8" else bytes(TABLES[right][1][c] for c in text)
        except (KeyError, UnicodeEncodeError):
            return None
        to = TABLES[wrong][0]
        text = "".join(to[b] for b in raw)
    return text


def restore(text: str, chain: str) -> str | None:
    """The chain inverted, or None unless every step is strictly decodable."""
    for right, wrong in reversed(CHAINS[chain]):
        back = TABLES[wrong][1]
        try:
            raw = bytes([back[c] for c in text])
            text = raw.decode("utf-8") if right == "utf-8" else "".join(TABLES[right][0][b] for b in raw)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def bigrams(run: str) -> np.ndarray:
    raw = np.frombuffer(b"\x02" + run.encode("utf-8", "surrogatepass") + b"\x03", dtype=np.uint8).astype(np.uint32)
    return ((raw[:-1] * 0x9E3779B1 + raw[1:] * 0x85EBCA6B) >> 7) % BINS


def grams(word: str) -> np.ndarray:
    """Hashed byte bigrams, and four-byte grams that span two letters of two bytes."""
    raw = np.frombuffer(b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03", dtype=np.uint8).astype(np.uint32)
    two = ((raw[:-1] * 0x9E3779B1 + raw[1:] * 0x85EBCA6B) >> 7) % BINS
    if len(raw) < 4:
        return two
    four = ((raw[:-3] * 0x27D4EB2F + raw[1:-2] * 0x9E3779B1 + raw[2:-1] * 0x85EBCA6B + raw[3:] * 0xC2B2AE35) >> 7) % BINS
    return np.concatenate([two, four])


@dataclass
class Bayes:
    """Multinomial naive Bayes, classes by bins of hashed byte bigrams; of fixed size."""

    names: list[str]
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[:, features].sum(axis=1)


#: verdicts on runs and words of at most so many characters are remembered, 200,000 of them: longer ones hardly recur and would fill the memory
REMEMBERED = 64


@dataclass
class ChainModel:
    """runs: clean and the strict chains, over runs beyond ASCII; words: clean, the 8-bit chains and the lossy ones."""

    runs: Bayes
    words: Bayes
    _runs: dict[str, dict[str, tuple[float, str, bool]]] = field(default_factory=dict, repr=False)
    _words: dict[str, dict[str, float]] = field(default_factory=dict, repr=False)

    def options(self, run: str) -> dict[str, tuple[float, str, bool]]:
        """chain -> (how much likelier than clean, natural log; the run inverted; whether that is proof by itself),
        of the strict chains that can have made the run.

        A run that none can have made is judged without its outer clean marks.
        """
        hit = self._runs.get(run)
        if hit is None:
            if len(self._runs) > 200_000:
                self._runs.clear()
            hit = self._options(run)
            for cut in (1, 2) if not hit and len(run) > 2 else ():
                for a, b in ((cut, 0), (0, cut), (cut, cut)):
                    inner, end = run[a : len(run) - b], run[len(run) - b :] if b else ""
                    if not hit and len(inner) >= 2 and all(c in _OUTER for c in run[:a] + end):
                        hit = {name: (gain, run[:a] + fixed + end, sure) for name, (gain, fixed, sure) in self._options(inner).items()}
            if len(run) <= REMEMBERED:
                self._runs[run] = hit
        return hit

    def _options(self, run: str) -> dict[str, tuple[float, str, bool]]:
        if run == "\x85" or (len(run) == 2 and run[1] == "\xa0" and run[0] >= "Ѐ"):
            return {}  # a line end; a letter before a hard space
        scores = self.runs.scores(bigrams(run))
        out = {}
        for k in np.flatnonzero(scores > scores[0]):
            name = self.runs.names[k]
            fixed = restore(run, name)
            if fixed is not None and fixed != run and (sure := plausible(fixed)):
                # a letter beside a line or letter is also what Cyrillic texts hold by chance
                out[name] = float(scores[k] - scores[0]), fixed, sure > 1 and (name not in CYRILLIC_READ or len(run) > 3)
        return out

    def leanings(self, word: str) -> dict[str, float]:
        """8-bit chain -> how much likelier (natural log) the inverted word is as clean text;
        lossy chain -> how much likelier the word is by it than clean."""
        hit = self._words.get(word)
        if hit is None:
            if len(self._words) > 200_000:
                self._words.clear()
            hit = {}
            scores = self.words.scores(grams(word))
            if "\ufffd" in word or LEADS.search(word):
                hit = {n: float(scores[k] - scores[0]) for k, n in enumerate(self.words.names) if n in LOST and (n == DROPPED) != ("\ufffd" in word)}
            for k in np.flatnonzero(scores > scores[0]) if len(word) > 1 else ():
                name = self.words.names[k]
                fixed = restore(word, name) if name in CHAINS else None
                if fixed is not None and _one_alphabet(fixed):
                    gain = float(self.words.weights[0, grams(fixed)].mean() - self.words.weights[0, grams(word)].mean()) * len(grams(word))
                    gain += CONTROL_GAIN if CONTROLS.search(word) else 0.0
                    if gain > 0:
                        hit[name] = gain
            if len(word) <= REMEMBERED:
                self._words[word] = hit
        return hit


def _one_alphabet(word: str) -> bool:
    if not all((c.isalpha() and known(c)) or c in "'’-" for c in word):
        return False
    return not (any(c >= "Ѐ" for c in word) and any("A" <= c <= "ſ" and c.isalpha() for c in word))


# Marks that texts of any language hold beside letters.
MARKS = "• – — “ ” ‘ ’ „ ‚ « » ‹ › … ± ½ ¼ ¾ × ÷ ° § ¶ € £ ¥ ™ © ® µ ¿ ¡ · № ² ³ ¹ ≤ ≥ ≠ ≈ − ‐ ‑ † ‡ ‰".split()
_KNOWN = set(MARKS) | {"\xa0", "\xad", "\u2009", "\u202f"}


def known(c: str) -> bool:
    """A Latin or Cyrillic letter of the languages of the samples, or a usual mark."""
    return c < "\x7f" or (("À" <= c <= "ſ" or "Ѐ" <= c <= "џ") and c not in "×÷") or c in _KNOWN


def _script(c: str) -> str:
    """The script of a letter or mark by its name, one for all that Japanese mixes; '' for what is neither."""
    if unicodedata.category(c)[0] not in "LM" and not "\u3001" <= c <= "\u30ff":
        return ""
    name = unicodedata.name(c, " ").split(" ")[0].split("-")[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "IDEOGRAPHIC": "CJK", "LEFT": "CJK", "RIGHT": "CJK"}.get(name, name)


def plausible(text: str) -> int:
    """What a right inversion may bring forth: 2 for known characters, Latin letters and words of one
    other script; 1 for a single letter of one, which needs other runs of the record to agree; else 0."""
    other = [c for c in text if not known(c)]
    if all("\u0180" <= c <= "\u024f" or "\u1e00" <= c <= "\u1eff" for c in other):
        return 2
    scripts = {_script(c) for c in other}
    return 0 if len(scripts) > 1 or scripts & {"", "LATIN", "MODIFIER"} else min(len(other), 2)


# Letters of other scripts, as ranges of code points; Latin ones first.
OTHER_LETTERS = (
    (0x0100, 0x0233), (0x1E00, 0x1EF9), (0x0391, 0x03C9), (0x0400, 0x045F), (0x0561, 0x0586), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939),
    (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)


def other_words(each: int = 60, seed: int = 5) -> list[str]:
    """Made-up words of other scripts, each Latin letter also alone: chains are learnt for languages without samples."""
    rng = random.Random(seed)
    out = []
    for k, (a, b) in enumerate(OTHER_LETTERS):
        letters = [c for i in range(a, b + 1) if (c := chr(i)).isalpha()]
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(each)]
        out += letters if k < 2 else []
    return out


def training(texts: list[str]) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """(run, chain, weight) and (word, chain, weight): the clean words beyond ASCII and all their garbled forms."""
    words: dict[str, int] = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", str(t)):
            for form in (w, w.upper(), w.capitalize()):
                words[form] = words.get(form, 0) + 1
    beyond = [(w, min(n, 12)) for w, n in sorted(words.items()) if not w.isascii()]
    letters = sorted({c for w, _ in beyond for c in (w + w.upper()) if ord(c) > 127} | set("ñÑłŁżŻšŠåÅøØýÝêÊëËúÚçÇáÁöÖüÜéÉóÓ"))
    quoted = [f"{a}{w}{b}" for w, _ in beyond for a, b in (("“", "”"), ("«", "»"), ("(", "…"))]
    units = beyond + [(c, 6) for c in letters + MARKS] + [(q, 1) for q in quoted] + [(w, 1) for w in other_words()] + [("\x85", 6)]
    runs: list[tuple[str, str, int]] = []
    for unit, n in units:
        runs += [(run, CLEAN, n) for run in RUN.findall(unit)]
        for chain in STRICT:
            bad = garble(unit, chain)
            if bad is not None and bad != unit:
                runs += [(run, chain, n) for run in RUN.findall(bad) if restore(run, chain) is not None]
    by_word = [(w, CLEAN, min(n, 12)) for w, n in sorted(words.items())]
    for w, n in beyond:
        for chain in LOOSE:
            bad = garble(w, chain)
            if bad is not None and bad != w:
                by_word.append((bad, chain, n))
    for w, n in beyond + [(q, 2) for q in quoted] + [(m, 6) for m in MARKS]:
        bad = garble(w, "utf-8>latin-1") or w
        bare = CONTROLS.sub("", bad)
        if bare != bad:
            by_word += [(x, DROPPED, n) for x in WORDS.findall(bare)]
        lossy = [(TO_ASCII, w.encode().decode("ascii", "replace"))]
        lossy += [(FROM_8_BIT, bytes(back[c] for c in w).decode("utf-8", "replace")) for e in ("cp1252", "cp1250", "cp1251") if all(c in (back := TABLES[e][1]) for c in w)]
        by_word += [(x, name, n) for name, bad in lossy for x in REPLACED.findall(bad)]
    return runs, by_word


def _bayes(rows: list[tuple[str, str, int]], classes: list[str], features, unseen: float = 0.02) -> Bayes:
    """Interpolated with the uniform distribution: an unseen gram costs every class the same."""
    counts = np.zeros((len(classes), BINS))
    index = {c: k for k, c in enumerate(classes)}
    for run, name, n in rows:
        np.add.at(counts[index[name]], features(run), n)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return Bayes(classes, np.log((1 - unseen) * share + unseen / BINS).astype(np.float32))


def fit(texts: list[str]) -> ChainModel:
    """Train on clean texts (a fixed, small table; the caller bounds it)."""
    runs, words = training(texts)
    return ChainModel(_bayes(runs, [CLEAN, *STRICT], bigrams), _bayes(words, [CLEAN, *LOOSE, *LOST], grams))


Edits = list[tuple[int, int, int, int]]


def _edit(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, Edits]:
    """The text with the spans replaced, and (start, end, start before, end before) of each."""
    out, edits, at, size = [], [], 0, 0
    for a, b, to in sorted(spans):
        out += [text[at:a], to]
        size += a - at
        edits.append((size, size + len(to), a, b))
        at, size = b, size + len(to)
    return "".join([*out, text[at:]]), edits


def stored_place(place: int, stages: "list[Edits]") -> int:
    """The place in the stored text of a place in the repaired one: within a replaced span its start."""
    for edits in stages:
        k = bisect_right(edits, place, key=lambda e: e[0]) - 1
        if k >= 0:
            start, end, a, b = edits[k]
            place = b + place - end if place >= end else a
    return place


def repair(text: str, model: ChainModel, least_gain: float = 14.0) -> tuple[str | None, str]:
    """(chains found, joined by '+', or None; repaired text)."""
    return repair_placed(text, model, least_gain)[:2]


def repair_placed(text: str, model: ChainModel, least_gain: float = 14.0) -> "tuple[str | None, str, list[Edits]]":
    """(chains, repaired text, the edits for stored_place()).

    A strict chain is chosen for the record by the likelihoods of all its runs.
    An 8-bit chain has no strict proof: its words are inverted where a stretch of
    neighbouring words becomes likelier as clean text by least_gain (natural log) in all.
    """
    found: list[str] = []
    spans: list[tuple[int, int, str]] = []
    open_ = [(m.start(), m.end(), got) for m in RUN.finditer(text) if (got := model.options(m.group()))]
    while open_:
        total: dict[str, float] = {}
        sure = {name for _, _, got in open_ for name, x in got.items() if x[2]}
        doubtful = Counter(name for got in {text[a:b]: got for a, b, got in open_}.values() for name in got)
        sure |= {name for name, n in doubtful.items() if n >= LEAST_DOUBTFUL}
        for _, _, got in open_:
            for name in got.keys() & sure:
                total[name] = total.get(name, 0.0) + got[name][0]
        if not total:
            break
        best = min(total, key=lambda n: (-total[n], n))
        found.append(best)
        spans += [(a, b, got[best][1]) for a, b, got in open_ if best in got]
        open_ = [x for x in open_ if best not in x[2]]
    out, first = _edit(text, spans)
    stages = [first]
    loose = _loose_chain(out, model, least_gain)
    if loose:
        found.append(loose[0])
        out, second = _edit(out, [(a, b, fixed) for a, b in loose[1] if (fixed := restore(out[a:b], loose[0]))])
        stages.insert(0, second)
    words = REPLACED.findall(text) if "\ufffd" in text else []
    if LEADS.search(out):
        words += [w for w in WORDS.findall(UNSEEN.sub("", out)) if WIDE.search(w) is None]
    lost: dict[str, float] = {}
    for w in words:
        own = {n: g for n, g in model.leanings(w).items() if n in LOST and g > (LOST_GAIN if n == DROPPED else 0.0)}
        for n, g in own.items():
            lost[n] = lost.get(n, 0.0) + g
    if lost:
        found.append(min(lost, key=lambda n: (-lost[n], n)))
    return ("+".join(sorted(found)) or None), out, stages


def _loose_chain(text: str, model: ChainModel, least_gain: float) -> tuple[str, list[tuple[int, int]]] | None:
    """The best 8-bit chain of a stretch of words, and the spans of the words."""
    lean = model.leanings
    if not any(map(lean, WORDS.findall(text))):
        return None
    words = [(m.start(), m.end(), lean(m.group()), len(m.group())) for m in WORDS.finditer(text)]
    best: tuple[float, str, list[tuple[int, int]], int] | None = None
    for name in {n for _, _, own, _ in words for n in own} - set(LOST):
        latin = name.startswith(("cp1250", "iso8859"))
        total, spans, symbols = 0.0, [], False
        for a, b, own, size in words:
            if size == 1:  # no evidence
                continue
            gain = own.get(name, -12.0)
            if total + gain <= 0:
                total, spans, symbols = 0.0, [], False
                continue
            total += gain
            if gain > 0:
                spans.append((a, b))
                symbols = symbols or (latin and any(not c.isalpha() and c not in "'’-" for c in text[a:b]))
            # single words prove little: between Latin alphabets a symbol inside a word is needed too
            if (len(spans) > 1 or CONTROLS.search(text, *spans[0])) and total >= least_gain and (symbols or not latin) and (best is None or total > best[0]):
                best = (total, name, spans, len(spans))
    if not best:
        return None
    spans = best[2][: best[3]]
    return best[1], _of_chain(text, best[1], spans[0][0], spans[-1][1], model)


#: a word outside the stretch that proves a chain, and one within it where both encodings are Cyrillic and the
#: inverted word is of usual case, is inverted unless it becomes less likely as clean text by so much (natural log)
OUTSIDE, WITHIN = 3.0, 8.0
#: what a control character within a word adds to the evidence that the word is garbled
CONTROL_GAIN = 8.0


def _of_chain(text: str, name: str, start: int, end: int, model: ChainModel) -> list[tuple[int, int]]:
    """The words of a record that its chain has made: all that can be inverted from start to end and beside it,
    and those elsewhere whose inversion is as good a word.  Cyrillic was wholly beyond ASCII: there a run is a word."""
    cyrillic = name.startswith(("cp1251", "koi8", "cp866"))
    out: list[tuple[int, int, bool | None]] = []
    for m in (BEYOND if cyrillic else WORDS).finditer(text):
        word = m.group()
        fixed = restore(word, name)
        if fixed is None or fixed == word or (not cyrillic and not any(map(str.isalpha, word))) or (cyrillic and not all("Ѐ" <= c <= "џ" or c in _KNOWN for c in fixed)) or not (cyrillic or _one_alphabet(fixed)):
            continue
        near, alike = start - 10 <= m.start() <= end + 2, cyrillic and any("Ѐ" <= c <= "џ" for c in word)
        if near and (not alike or len(word) == 1):
            out.append((*m.span(), None if alike else True))  # a single letter goes with the word before, or after
            continue
        gain = float(model.words.weights[0, grams(fixed)].mean() - model.words.weights[0, grams(word)].mean()) * len(grams(word))
        usual = (fixed.islower() or fixed.istitle()) - (word.islower() or word.istitle())
        out.append((*m.span(), gain > ((0.0 if near else OUTSIDE) - WITHIN * usual if alike else -OUTSIDE)))
    after: list[bool] = [True] * (len(out) + 1)  # of each word the verdict on the next longer one
    for k in range(len(out) - 1, -1, -1):
        yes = out[k][2]
        after[k] = after[k + 1] if yes is None else yes
    got, before = [], None
    for k, (a, b, yes) in enumerate(out):
        before = yes if yes is not None else after[k] if before is None else before
        if before:
            got.append((a, b))
    return got


#: evidence (natural log) that a word without replacement characters is one whose controls were dropped
LOST_GAIN = 5.0
_OUTER = set(MARKS) | set("\xa0\u2002\u2005\u2007\u2009\u202f\u3000\u200b\u200c\u200d\u200e\u2060\ufeff\xad‐¬�")
#: words with a character beyond ASCII, symbols between letters included
WORDS = re.compile(r"(?<![^\s(\[“«„/])[A-Za-z\x80-\x84\x86-\x9f\xa1-\u04ff\uff01-\uff5e'’-]*[\x80-\x84\x86-\x9f\xa1-\u04ff][A-Za-z\x80-\x84\x86-\x9f\xa1-\u04ff\uff01-\uff5e'’-]*")
#: what a text may hold unseen within a word, and what no chain brings forth
UNSEEN = re.compile("[\xad\u200b-\u200f\u2060\ufeff]")
WIDE = re.compile("[\u0300-\u036f\uff01-\uff5e]")


def beyond_ascii(text: Column) -> Column:
    """JVM prefilter: only texts of more bytes than characters travel to Python."""
    return F.when(F.octet_length(text) > F.length(text), text)


def with_repair(df: DataFrame, text: str, model: ChainModel, chain: str = "chain", out: str = "repaired_text") -> DataFrame:
    """df with the chain (null if clean) and the restored text."""

    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf(T.StructType([T.StructField("c", T.StringType()), T.StructField("t", T.StringType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        got = [(None, None) if t is None else repair(t, model) for t in texts]
        return pd.DataFrame({"c": [g[0] for g in got], "t": [g[1] for g in got]}, dtype=object)

    got = df.withColumn("_g", run(beyond_ascii(F.col(text))))
    return got.withColumn(chain, F.col("_g.c")).withColumn(out, F.coalesce("_g.t", F.col(text))).drop("_g")
