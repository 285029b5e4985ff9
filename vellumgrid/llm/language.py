"""Problem 4: the language of a text, and of each passage of a mixed one.

Multinomial naive Bayes over hashed character n-grams of two to four letters.
The log-probability matrix (bins by languages, of fixed size) is broadcast; a
batch of texts becomes one array of code points, hashed, looked up and summed
by segment in numpy.

A background class of fixed likelihood a letter takes texts that look like none
of the languages (another script, noise): they are 'und'.  Passages are places in
the text as stored, also where it was repaired before scoring.

Defined cases: a null, empty or letterless text has a null language and no
passages; ties go to the language first in the alphabet; repeated rows are
judged alike; other columns pass through, clashing output names are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumgrid.llm import garble
from vellumgrid.llm.lookalike import CYRILLIC_LIKE_LATIN, GREEK_LIKE_LATIN, invisible

BITS = 17
ORDERS = (2, 3, 4)
#: a passage of another language has so many words and letters at least, outside brackets
LEAST_WORDS, LEAST_LETTERS = 7, 34
#: natural-log advantage of another language that makes a passage of its own
LEAST_GAIN = 14.0
#: likelihood (natural log) a letter of what is in none of the languages; unknown words of a known one reach about -36, other scripts and noise -39 and less
UNKNOWN, LEAST_LIKELIHOOD = "und", -37.5
CHUNK = 300_000
BLOCK = 100_000

# Codes of the languages of the samples, ISO 639-1 and both forms of 639-2.
ISO_THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru"}

_DROP, _SPACE = 0xFFFF, 32
_ENDS = np.array([ord(c) for c in ".!?…\n\r/;|。．！？"], dtype=np.uint32)


def _letter_table() -> np.ndarray:
    """Code point -> folded lower-case letter, a space for what is no letter, _DROP for what is not drawn."""
    like = {x[0]: x[1] for group in (GREEK_LIKE_LATIN, CYRILLIC_LIKE_LATIN) for x in group.split(" ")}
    table = np.full(0x110000, _SPACE, dtype=np.uint16)
    for cp in range(0x10000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat[0] == "L":
            c = unicodedata.normalize("NFKC", like.get(c, c)).lower()
            c = like.get(c[0], c[0])
            table[cp] = ord(c) if ord(c) < 0xFFFF else _SPACE
        elif cat == "Mn" or invisible(cp):
            table[cp] = _DROP
    return table


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    return _LETTERS


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the bin of the n-gram that ends at each position."""
    out = []
    h = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BITS)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            prev = np.zeros_like(codes, dtype=np.uint32)
            prev[n - 1 :] = codes[: len(codes) - n + 1]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + prev * np.uint32(0xC2B2AE35) + np.uint32(n)
        if n in ORDERS:
            out.append((h * np.uint32(0x27D4EB2F)) >> shift)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (2 ** BITS, languages) float32


def _stream(text: str) -> np.ndarray:
    codes = letters()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = codes[codes != _DROP]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    return codes[keep]


def fit(samples: list[tuple[str, str]], unseen: float = 0.05) -> LanguageModel:
    """Train on (language, clean text) pairs; the caller bounds their number.

    Interpolated with the uniform distribution, so an unseen n-gram favours no language.
    """
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        raise ValueError("no samples to learn a language from")
    counts = np.zeros((len(langs), 1 << BITS))
    for lang, text in samples:
        k = langs.index(lang)
        for h in _hashes(_stream(text)):
            np.add.at(counts[k], h, 1)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(langs, np.ascontiguousarray(np.log((1 - unseen) * share + unseen / (1 << BITS)).T.astype(np.float32)))


def judge(texts: list[str], model: LanguageModel) -> list[tuple[str | None, float | None, list[tuple[int, int, str, float]]]]:
    """(language, confidence, passages) of each text; passages (start, end, language, confidence), one if unmixed."""
    out: list = []
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        out += _judge_chunk(texts[at:end], model)
        at = end
    return out


def _judge_chunk(texts: list[str], model: LanguageModel) -> list:
    joined = " " + "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    # a segment ends at sentence and line ends, and at brackets
    depth = np.cumsum((raw == 40) | (raw == 0xFF08)) - np.cumsum((raw == 41) | (raw == 0xFF09))
    cut = np.isin(raw, _ENDS) | (raw == 40) | (raw == 41) | (raw == 0xFF08) | (raw == 0xFF09)
    cut[starts - 1] = True
    seg = np.cumsum(cut)  # the mark begins the next segment
    codes = letters()[raw]
    live = np.flatnonzero(codes != _DROP)
    codes, seg_of = codes[live], seg[live]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE) | (seg_of[1:] != seg_of[:-1])
    codes, seg_of, live = codes[keep], seg_of[keep], live[keep]
    is_letter = codes != _SPACE
    begin = np.flatnonzero(np.concatenate([[True], seg_of[1:] != seg_of[:-1]]))
    score = np.zeros((len(begin), len(model.langs)))
    for a in range(0, len(codes), BLOCK):  # a matrix of one block at a time, however long a text is
        b, lead = min(len(codes), a + BLOCK), min(a, max(ORDERS) - 1)
        total = np.zeros((b - a, len(model.langs)), dtype=np.float32)
        part = np.empty_like(total)
        for h in _hashes(codes[a - lead : b]):
            np.take(model.weights, h[lead:], axis=0, out=part, mode="clip")  # bins are in range: no check, no copy
            total += part
        total[~is_letter[a:b]] = 0.0
        first_seg = int(np.searchsorted(begin, a, side="right")) - 1
        inside = begin[(begin > a) & (begin < b)]
        score[first_seg : first_seg + 1 + len(inside)] += np.add.reduceat(total, np.concatenate([[0], inside - a]), axis=0)
    n_letters = np.add.reduceat(is_letter.astype(np.int64), begin)
    word_start = is_letter & np.concatenate([[True], ~is_letter[:-1]])
    n_words = np.add.reduceat(word_start.astype(np.int64), begin)
    first = live[begin]
    doc = np.searchsorted(starts - 1, first, side="right") - 1  # the mark before a text begins its first segment
    n = len(texts)
    whole = np.zeros((n, len(model.langs)))
    np.add.at(whole, doc, score)
    size = np.bincount(doc, weights=n_letters, minlength=n)
    best = whole.argmax(axis=1)
    seg_best = score.argmax(axis=1)
    gain = score[np.arange(len(score)), seg_best] - score[np.arange(len(score)), best[doc]]
    odd = (gain > LEAST_GAIN / 2) & (n_words >= 3)
    mixed_docs = set(doc[odd].tolist())
    order = np.concatenate([np.searchsorted(doc, np.arange(n)), [len(doc)]])
    out = []
    for k in range(n):
        if not size[k]:
            out.append((None, None, []))
            continue
        if k in mixed_docs:
            a, b = order[k], order[k + 1]
            inside = depth[first[a:b]] - depth[max(0, starts[k] - 1)] > 0
            passages = _passages(score[a:b], n_words[a:b], n_letters[a:b], first[a:b] - starts[k], inside, int(lengths[k]), model, int(best[k]))
        else:
            passages = []
        conf, name = _confidence(whole[k], size[k]), model.langs[best[k]]
        if whole[k, best[k]] < LEAST_LIKELIHOOD * size[k]:
            name, passages = UNKNOWN, []
        if not passages:
            passages = [(0, int(lengths[k]), name, conf)]
        out.append((name, conf, passages))
    return out


def _confidence(score: np.ndarray, n: float) -> float:
    """Posterior of the best class with a temperature: neighbouring n-grams overlap and are no independent proofs."""
    score = np.append(score, LEAST_LIKELIHOOD * n)
    z = (score - score.max()) / max(1.0, np.sqrt(n))
    return float(1 / np.exp(z).sum())


def _passages(score, words, lets, first, inside, length, model, main) -> list:
    """Merge segments to passages by dynamic programming: a change of language costs LEAST_GAIN;
    bracketed insertions count for nothing; short passages fall to their neighbours."""
    n, k = score.shape
    use = score * (~inside)[:, None]
    cost = np.zeros((n, k))
    back = np.zeros((n, k), dtype=int)
    cost[0] = use[0]
    for i in range(1, n):
        top = int(cost[i - 1].argmax())
        stay, move = cost[i - 1], cost[i - 1][top] - LEAST_GAIN
        back[i] = np.where(stay >= move, np.arange(k), top)
        cost[i] = np.maximum(stay, move) + use[i]
    path = [int(cost[-1].argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    runs: list[list[int]] = []  # language, from, to, words, letters
    for i, lang in enumerate(path):
        w, l = (0, 0) if inside[i] else (int(words[i]), int(lets[i]))
        if runs and runs[-1][0] == lang:
            runs[-1][2], runs[-1][3], runs[-1][4] = i, runs[-1][3] + w, runs[-1][4] + l
        else:
            runs.append([lang, i, i, w, l])
    strong = [r for r in runs if r[3] >= LEAST_WORDS and r[4] >= LEAST_LETTERS]
    if len({r[0] for r in strong}) < 2:
        return []
    merged: list[list[int]] = []
    for r in runs:
        if r in strong and (not merged or merged[-1][0] != r[0]):
            merged.append(list(r))
        elif merged:
            merged[-1][2] = r[2]
    merged[0][1] = 0
    out = []
    for j, r in enumerate(merged):
        a = 0 if j == 0 else max(0, int(first[r[1]]))
        b = length if j == len(merged) - 1 else max(0, int(first[merged[j + 1][1]]))
        part = use[r[1] : r[2] + 1].sum(axis=0)
        out.append((a, b, model.langs[r[0]], _confidence(part, max(1, int(lets[r[1] : r[2] + 1].sum())))))
    return out


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())]))
RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("passages", PASSAGE)])


def with_language(df: DataFrame, text: str, model: LanguageModel, repairs: "garble.ChainModel | None" = None, language: str = "language", confidence: str = "language_confidence", passages: str = "passages") -> DataFrame:
    """df with language, confidence and passages (start and end in the text as stored).

    With repairs, garbled records are restored before scoring.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, repairs))

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        model, repairs = shared.value
        some = [(i, t) for i, t in enumerate(texts) if t is not None]
        clean = [(t, []) if repairs is None or t.isascii() else garble.repair_placed(t, repairs)[1:] for _, t in some]
        got: list = [(None, None, None)] * len(texts)
        for (i, t), (fixed, edits), g in zip(some, clean, judge([c for c, _ in clean], model)):
            place = lambda p, n=len(fixed), m=len(t), e=edits: m if p == n else garble.stored_place(p, e)
            got[i] = (g[0], g[1], [{"start": place(a), "end": place(b), "language": c, "confidence": d} for a, b, c, d in g[2]])
        return pd.DataFrame(got, columns=["language", "confidence", "passages"]).astype({"language": object, "passages": object})

    got = df.drop(language, confidence, passages).withColumn("_l", run(F.col(text)))
    return got.withColumns({language: F.col("_l.language"), confidence: F.col("_l.confidence"), passages: F.col("_l.passages")}).drop("_l")


def named_language(lang: Column) -> Column:
    """The two-letter code that a label names in any spelling, or null: two or three letters, with region, any case."""
    head = F.lower(F.element_at(F.split(F.trim(lang), "[-_]"), 1))
    three = F.create_map(*[F.lit(x) for pair in sorted(ISO_THREE.items()) for x in pair])
    return F.when(head.isin(sorted(set(ISO_THREE.values()))), head).otherwise(F.element_at(three, head))
