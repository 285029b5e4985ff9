"""Problem 2: per-document text statistics, and prose told from lists, tables and junk.

The statistics are native columns.  An ordered rule list is induced by
incremental reduced-error pruning on labelled documents: for each class in turn
a rule grows on two thirds of the data by FOIL gain and is pruned on the rest.
Of several lists so made the best on documents held out from all of them is taken.
The learned thresholds are exported to one SQL CASE expression, so scoring is a
Catalyst projection.

Defined cases: a null, empty or blank text has null statistics and a null kind;
repeated rows are scored alike; other columns pass through, and a clashing one
named like a statistic is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "max_word_length", "symbol_share", "digit_share", "punct_line_share",
    "common_word_share", "sentence_ends", "sentences_per_word", "numeric_word_share", "letter_word_share", "distinct_word_share", "separators_per_word", "words_per_line", "marked_line_share",
)
#: statistics that do not grow with the length of a text; rules test only these
SCALE_FREE = tuple(s for s in STATS if s not in ("n_chars", "n_words", "n_lines", "sentence_ends"))
ORDER = ("junk", "table", "list")

#: full-width ASCII and the ideographic space, by the rule code point - 0xFEE0
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　      "
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " " * 7
SPACES = " \xa0\u2005\u2007\u2009\u202f\u3000"
INVISIBLE = "­​‌‍‎‏⁠﻿"


def with_statistics(df: DataFrame, text: str, common: list[str], only: "set[str] | None" = None) -> DataFrame:
    """df with the columns STATS (or only those named) for its text column.

    common: lower-case frequent words.  The statistics leave through one
    generated row, so that no later filter is pushed below them and computes
    each of them again for every place where it is named.
    """
    if text in STATS:
        raise ValueError(f"the text column must not be named like a statistic: {text}")
    raw = F.col(text)
    plain = F.when(F.octet_length(raw) > F.length(raw), F.translate(raw, WIDE + INVISIBLE, NARROW)).otherwise(raw)
    words = sorted({w.lower() for w in common if w})
    is_common = (lambda w: w.isin(words)) if words else (lambda w: F.lit(False))
    edge = "[\\p{P}\\p{S}]"
    out = df.drop(*[c for c in df.columns if c in STATS or c.startswith("__vg_")])
    # every pattern below runs in time linear in the text: no run is tried again from each of its places
    out = out.withColumn("__vg_p", plain).withColumn("__vg_s", F.trim(F.regexp_replace("__vg_p", "\\s+", " ")))
    out = out.withColumn("__vg_t", F.when(F.col("__vg_s") != "", F.col("__vg_p"))).withColumn("__vg_w", F.when(F.col("__vg_s") != "", F.split("__vg_s", " ")))
    bare = F.regexp_replace("__vg_t", "\\s+", "")
    out = out.withColumn("__vg_b", F.length(bare)).withColumn("__vg_n", F.size("__vg_w").cast("double"))
    out = out.withColumn("__vg_l", F.length(F.regexp_replace("__vg_t", "[^\\p{L}\\p{M}]+", ""))).withColumn("__vg_d", F.length(F.regexp_replace("__vg_t", "[^0-9]+", "")))
    out = out.withColumn("__vg_low", F.filter(F.split(F.lower("__vg_t"), "[^\\p{L}\\p{M}]+"), lambda w: w != ""))
    out = out.withColumn("__vg_lines", F.size(F.split("__vg_t", "\n")))
    known = F.col("__vg_t").isNotNull()
    stats: dict[str, Column] = {
        "n_chars": F.length("__vg_t"),
        "n_words": F.col("__vg_n").cast("int"),
        "n_lines": F.col("__vg_lines"),
        "mean_word_length": F.col("__vg_b") / F.col("__vg_n"),
        "max_word_length": F.array_max(F.transform("__vg_w", lambda w: F.length(w))),
        "symbol_share": (F.col("__vg_b") - F.col("__vg_l") - F.col("__vg_d")) / F.col("__vg_b"),
        "digit_share": F.col("__vg_d") / F.col("__vg_b"),
        "punct_line_share": F.regexp_count("__vg_t", F.lit("[.!?…][\"'”»«)\\]]*[ \\t]*(?=\\n|$)")) / F.col("__vg_lines"),
        "common_word_share": F.when(F.size("__vg_low") > 0, F.size(F.filter("__vg_low", is_common)) / F.size("__vg_low")).otherwise(0.0),
        "sentence_ends": F.regexp_count("__vg_t", F.lit("[^\\s.!?]{2}[.!?…](?=[\"'”»)\\]\\s]|$)")),
        "sentences_per_word": F.regexp_count("__vg_t", F.lit("[^\\s.!?]{2}[.!?…](?=[\"'”»)\\]\\s]|$)")) / F.col("__vg_n"),
        "numeric_word_share": F.regexp_count("__vg_t", F.lit("(?<!\\S)(?=[^\\s\\p{L}]++(?!\\S))[^\\s\\p{L}0-9]*+[0-9]")) / F.col("__vg_n"),
        "letter_word_share": F.size("__vg_low") / F.col("__vg_n"),
        "distinct_word_share": F.size(F.array_distinct("__vg_w")) / F.col("__vg_n"),
        "separators_per_word": F.regexp_count("__vg_t", F.lit("[,;|\\t*•]|^ *-|\\n *-")) / F.col("__vg_n"),
        "words_per_line": F.col("__vg_n") / F.col("__vg_lines"),
        "marked_line_share": F.regexp_count("__vg_t", F.lit("(?:^|\\n)[ \\t]{0,8}(?:[-*•–▪]|[(\\[]?(?:[0-9]{1,3}|[a-z])[.)\\]])[ \\t]")) / F.col("__vg_lines"),
    }
    kept = [c for c in out.columns if not c.startswith("__vg_") and c not in STATS]
    row = F.struct(*[F.when(known, v).alias(k) for k, v in stats.items() if only is None or k in only])
    return out.select(*kept, F.inline(F.array(row)))


@dataclass(frozen=True)
class Rule:
    """kind, if every (statistic, '<=' or '>=', threshold) holds."""

    kind: str
    tests: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"{s} {op} {float(v)!r}D" for s, op, v in self.tests) or "true"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        hit = np.ones(n, dtype=bool)
        for s, op, v in self.tests:
            hit &= (x[s] <= v) if op == "<=" else (x[s] >= v)
        return hit


@dataclass
class RuleList:
    rules: list[Rule] = field(default_factory=list)
    default: str = "prose"

    def case(self) -> str:
        """The SQL CASE expression over the statistics."""
        arms = "".join(f" WHEN {r.sql()} THEN '{r.kind}'" for r in self.rules)
        return f"CASE WHEN n_chars IS NULL THEN NULL{arms} ELSE '{self.default}' END"

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(x.values()))), self.default, dtype=object)
        open_ = np.ones(len(out), dtype=bool)
        for r in self.rules:
            hit = r.holds(x) & open_
            out[hit] = r.kind
            open_ &= ~hit
        return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray, kind: str) -> Rule:
    """Add the test of the highest FOIL gain until no negative row is covered."""
    tests: list[tuple[str, str, float]] = []
    cover = rows.copy()
    for _ in range(6):
        pos, neg = (cover & y).sum(), (cover & ~y).sum()
        if not neg or not pos:
            break
        base, best = np.log2(pos / (pos + neg)), (1e-9, None)
        for s in SCALE_FREE:
            v = x[s][cover]
            cuts = np.unique(v)
            if len(cuts) < 2:
                continue
            if len(cuts) > 64:
                cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
            middle = (cuts[1:] + cuts[:-1]) / 2
            t = y[cover]
            for op in ("<=", ">="):
                hit = (v[:, None] <= middle) if op == "<=" else (v[:, None] >= middle)
                p, n = (hit & t[:, None]).sum(0), (hit & ~t[:, None]).sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (s, op, float(middle[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        s, op, v = best[1]
        cover &= (x[s] <= v) if op == "<=" else (x[s] >= v)
    return Rule(kind, tuple(tests))


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> tuple[Rule, float]:
    """Drop final tests as long as (p - n) / (p + n) on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        hit = r.holds(x) & rows
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best, value = rule, worth(rule)
    for k in range(len(rule.tests) - 1, 0, -1):
        shorter = Rule(rule.kind, rule.tests[:k])
        if (w := worth(shorter)) >= value:
            best, value = shorter, w
    return best, value


#: rules of a kind that may fail on their pruning rows before its block ends
TRIES = 3


def induce(stats: pd.DataFrame, kinds: "np.ndarray | list[str]", seed: int = 7, order: tuple[str, ...] = ORDER, least_worth: float = 0.94) -> RuleList:
    """Incremental reduced-error pruning; one block of rules per kind, prose as default.

    stats: STATS columns.  A rule whose pruning worth falls below least_worth is dropped;
    as many of them as TRIES end the block.
    """
    x = {s: stats[s].to_numpy(dtype=float) for s in STATS}
    kinds = np.asarray(kinds, dtype=object)
    rng = np.random.default_rng(seed)
    left, out = np.ones(len(kinds), dtype=bool), RuleList()
    for kind in order:
        y, failed = kinds == kind, 0
        while (left & y).any() and failed < TRIES:
            grow = left & (rng.random(len(kinds)) < 2 / 3)
            rule = _grow(x, y, grow, kind)
            rule, value = _prune(rule, x, y, left & ~grow)
            if not rule.tests or value < least_worth:
                failed += 1  # another split may give a better rule
                continue
            out.rules.append(rule)
            left &= ~rule.holds(x)
    return out


def induce_best(stats: pd.DataFrame, kinds: np.ndarray, lists: int = 8) -> RuleList:
    """Of several rule lists, each from other splits, the one with the fewest errors (prose or not) on every fourth
    document, which none of them has seen; ties go to the shorter list, then to the earlier."""
    held = np.arange(len(stats)) % 4 == 0
    x, prose = {s: stats[s].to_numpy(dtype=float)[held] for s in STATS}, kinds[held] == "prose"
    made = [induce(stats[~held], kinds[~held], seed) for seed in range(lists)]
    return min(made, key=lambda r: (int(((r.predict(x) == "prose") != prose).sum()), len(r.rules)))


# --- labelled documents ---------------------------------------------------------------------------


def _wrap(text: str, width: int) -> str:
    lines, line = [], ""
    for w in text.split(" "):
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return "\n".join([*lines, line])


def _garble(text: str, rng: random.Random) -> str:
    raw = text.encode("utf-8")
    for _ in range(rng.choice((1, 1, 2))):
        raw = "".join(bytes([b]).decode(rng.choice(("cp1252",)), "ignore") or chr(b) for b in raw).encode("utf-8")
    return raw.decode("utf-8")


def _scan(text: str, rng: random.Random) -> str:
    swap = {"l": "1", "o": "0", "e": "c", "t": "+", "i": "!", "s": "5", "а": "@", "о": "0", "з": "3"}
    out = "".join(swap[c] if c in swap and rng.random() < 0.05 else c for c in text)
    lines = _wrap(out, rng.randint(36, 70)).split("\n")
    for _ in range(rng.choice((0, 0, 1, 1, 2))):
        n = rng.randint(1, 400)
        lines.insert(rng.randrange(len(lines) + 1), rng.choice((f"- {n} -", f"[{n}]", f"p. {n}", f"{n}", f".{n}", "iv", f"{rng.choice(lines)[:24].upper()} {n}", f"Results | {n}")))
    return "\n".join(lines)


def labelled_documents(samples: pd.DataFrame, per_kind: int = 2000, seed: int = 11) -> pd.DataFrame:
    """(text, kind): prose made of the samples' sentences, with the dirt that prose keeps,
    and lists, tables and junk made of their words and of random characters.

    samples: columns lang, text (clean prose).  per_kind bounds the training set.
    """
    rng = random.Random(seed)
    sentences: dict[str, list[str]] = {}
    words: dict[str, list[str]] = {}
    for lang, text in zip(samples["lang"], samples["text"]):
        if isinstance(text, str) and text.strip():
            own = [s.strip().rstrip(".") + "." for s in text.replace("? ", ". ").replace("! ", ". ").split(". ") if s.strip()]
            sentences.setdefault(str(lang), []).extend(own)
            words.setdefault(str(lang), []).extend(w.strip(".,;()") for w in text.split() if len(w) > 2)
    if not sentences:
        sentences, words = {"en": ["A plain sentence stands here."]}, {"en": ["plain", "sentence"]}
    langs = sorted(sentences)
    rows: list[tuple[str, str]] = []
    num = lambda: rng.choice((str(rng.randint(1, 3000)), f"{rng.uniform(1, 3000):.1f}", f"{rng.uniform(1, 900):.2f}", f"{rng.randint(1, 2999)}%", f"({rng.uniform(1, 2999):.1f})", f"{rng.randint(0, 3000):06d}"))
    for _ in range(per_kind):
        lang = rng.choice(langs)
        own, ws = sentences[lang], words[lang]
        name = lambda: rng.choice(ws).capitalize()
        # prose, three of it for each of the others: its dirt is more varied
        for _ in range(3):
            t = " ".join(rng.choice(own) for _ in range(rng.choice((1, 1, 1, 2, 3, 4, 6, 9, 15, 30, 50))))
            if rng.random() < 0.3:
                t = f"{t} ({', '.join(f'{rng.uniform(1, 90):.1f}' for _ in range(rng.randint(2, 9)))})"
            if rng.random() < 0.2:
                t = f"{t} (ref-{rng.randint(10**6, 10**9)})"
            dirt = rng.random()
            if dirt < 0.12:
                t = t.upper()
            elif dirt < 0.22:
                t = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
            elif dirt < 0.36:
                t = _garble(t, rng)
            elif dirt < 0.56:
                t = _scan(t, rng)
            elif dirt < 0.66:
                t = _wrap(t, rng.randint(36, 70))
            elif dirt < 0.74:
                other = sentences[rng.choice(langs)]
                more = " ".join(rng.choice(other) for _ in range(2))
                t = t + rng.choice((" ", "\n", " / ")) + (_garble(more, rng) if rng.random() < 0.5 else more)
            elif dirt < 0.80:
                t = "".join(rng.choice(SPACES) if c == " " and rng.random() < 0.4 else c for c in t)
            if rng.random() < 0.1:
                t = rng.choice(("• ", "- ", f"({rng.randint(1, 30)}) ", f"[{rng.randint(1, 60)}] ", "a) ")) + t
            if rng.random() < 0.1:
                t = "".join(c + rng.choice(INVISIBLE) if rng.random() < 0.02 else c for c in t)
            rows.append((t, "prose"))
        # list
        kind = rng.randrange(6)
        most = rng.choice((2, 4, 7))
        items = [" ".join(rng.choice(ws) for _ in range(rng.randint(1, most))) for _ in range(rng.randint(4, 14))]
        if kind == 0:
            mark = rng.choice(("* ", "- ", "• ", "– ", "▪ ", ""))
            t = "\n".join(mark + i for i in items)
        elif kind == 1:
            forms = rng.choice((("{}. ",), ("{}) ",), ("({}) ",), ("{}. ", "{}) ")))
            items += [" ".join(rng.choice(ws) for _ in range(rng.randint(1, most))) for _ in range(rng.choice((0, 0, 5, 15)))]
            t = "\n".join(rng.choice(forms).format(k + 1) + i for k, i in enumerate(items))
        elif kind == 2:
            t = rng.choice((", ", "; ", " | ", " / ", " · ")).join(rng.choice(items) if rng.random() < 0.5 else rng.choice(ws) for _ in range(rng.randint(4, 18)))
        elif kind == 3:
            t = "; ".join(f"{rng.choice(ws)}, {', '.join(str(rng.randint(1, 400)) for _ in range(rng.randint(1, 4)))}" for _ in items)
        elif kind == 4:
            t = "\n".join(f"{i} {'.' * rng.randint(3, 40)} {rng.randint(1, 400)}" for i in items)
        else:
            t = "\n".join(f"{rng.choice(ws)}: {i}" for i in items)
        rows.append((t, "list"))
        # table
        gap = rng.choice(("   ", "\t", " | ", ";", " ", ", "))
        width = rng.randint(2, 7)
        kind = rng.randrange(4)
        if kind < 3:
            body = [gap.join([name() if rng.random() < 0.6 else str(rng.randint(1, 99)), *(num() for _ in range(width))]) for _ in range(rng.randint(2, 12))]
            if rng.random() < 0.3:
                body.insert(0, gap.join(name() for _ in range(width + 1)))
            t = "\n".join(body)
        else:
            units = rng.sample(("kg", "g", "mm", "cm", "km", "t", "l", "ha", "m²", "%", "€", "$", "°C", "h", "No.", "max.", *(chr(rng.randint(0x391, 0x3A9)) for _ in range(3)), *(chr(rng.randint(0xC0, 0xFF)) for _ in range(3))), rng.randint(2, 6))
            t = " ".join(f"{rng.choice(units)} {rng.uniform(1, 900):.2f}" for _ in range(rng.randint(6, 40)))
        rows.append((t, "table"))
        # junk
        kind = rng.randrange(8)
        pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
        if kind == 0:
            t = " ".join(pick("bcdfghjklmnpqrstvwxz", 2, 11) for _ in range(rng.randint(6, 30)))
        elif kind == 1:
            t = " ".join(pick("abcdefghijklmnopqrstuvwxyz", 2, 12) for _ in range(rng.randint(6, 30)))
        elif kind == 2:
            t = pick("0123456789abcdef", 60, 300)
        elif kind == 3:
            t = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 60, 300)
        elif kind == 4:
            t = pick("0123456789!#$%&*+-/:;<=>?@[]^_{|}~\\", 60, 250)
        elif kind == 5:
            t = " ".join([rng.choice((pick("abcdefghijklmnopqrstuvwxyz", 1, 4), chr(rng.randint(0x25A0, 0x25FF)), pick(".-?*_~#", 1, 1) * rng.randint(1, 4), rng.choice(ws)))] * rng.randint(12, 60))
        elif kind == 6:
            t = "\n".join(rng.choice("_-=*.~#") * rng.randint(20, 70) for _ in range(rng.randint(1, 6)))
        else:
            t = " ".join(pick("!@#$%^&*<>?/|~+=§¤", 1, 8) for _ in range(rng.randint(8, 40)))
        rows.append((t, "junk"))
    return pd.DataFrame(rows, columns=["text", "kind"])


def common_words(words: DataFrame, limit: int = 5000) -> list[str]:
    """The words of a (lang, word) table of fixed size; more than limit is an error, not a cut."""
    got = [r[0] for r in words.select(F.lower("word")).where("word IS NOT NULL").distinct().limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"a list of more than {limit} common words belongs in a join, not in an expression")
    return sorted(got)


def fit(spark: SparkSession, samples: DataFrame, common: list[str], per_kind: int = 2000, seed: int = 11, max_samples: int = 20_000) -> RuleList:
    """Fit the rule list on documents made from at most max_samples clean prose samples."""
    rows = samples.select("lang", "text").orderBy("lang", "text").limit(max_samples).toPandas()
    docs = labelled_documents(rows, per_kind, seed)
    n = max(1, spark.sparkContext.defaultParallelism)
    stats = with_statistics(spark.createDataFrame(docs).repartition(n), "text", common).select("kind", *STATS).toPandas()
    stats = stats.sort_values(["kind", *STATS]).dropna().reset_index(drop=True)
    return induce_best(stats[list(STATS)], stats["kind"].to_numpy())


def with_kind(df: DataFrame, text: str, common: list[str], rules: RuleList, out: str = "text_kind", keep: bool = True) -> DataFrame:
    """df with the kind (prose, list, table or junk) and, if keep, the statistics."""
    used = None if keep else {"n_chars", *(t[0] for r in rules.rules for t in r.tests)}
    got = with_statistics(df.drop(out), text, common, used).withColumn(out, F.expr(rules.case()))
    return got if keep else got.drop(*STATS)
