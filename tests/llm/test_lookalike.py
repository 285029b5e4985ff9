import itertools
import unicodedata

import ahocorasick
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.llm import lookalike as L


def automaton(text):
    counts: dict = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    table = L.rewrite_table(counts)
    a = ahocorasick.Automaton()
    for p, to in table.items():
        a.add_word(p, (len(p), to))
    a.make_automaton()
    return a, table


def same(*texts):
    """All forms under the table of a corpus that holds them and plain text."""
    a, table = automaton("".join(texts) + "the quick brown fox jumps over lazy dogs, THE QUICK BROWN FOX 0123456789 éàü ффи" * 9)
    return [L.rewrite(t, a) if table else t for t in texts]


def test_forms_that_look_the_same():
    plain = "A final office (é) 12%"
    forms = [
        plain, "Ａ ｆｉｎａｌ ｏｆｆｉｃｅ （é） １２％", "A ﬁnal oﬃce (é) 12%", "A final office　(é) 12%", "А finаl оffiсе (é) 12%",
        "A fi​nal off­ice (﻿é) 12%", "A final office (é) 12%", "A final office (е‍́) 12%", "Α final οffice (é) 12%",
    ]
    assert len(set(same(*forms))) == 1


def test_forms_that_look_different():
    forms = ["x2", "x²", "x₂", "X2", "xé2", "xe2", "x\n2", "x 2", "x  2", "xl2", "x12", "xI2", "straße", "strasse", "n1", "n₁"]
    got = same(*forms)
    assert len(set(got)) == len(forms)


def test_alike_parts_make_alike_strings():
    got = same("ё", "ё", "ë", "ë", "й", "й")
    assert len(set(got[:4])) == 1 and got[4] == got[5] and got[0] != got[4]


def test_representative_is_the_most_frequent():
    counts = {"Х": 5, "X": 2, "a": 3, "а": 3}
    table = L.rewrite_table(counts)
    assert table["X"] == "Х" and "Х" not in table
    assert table["а"] == "a"  # a tie goes to the smaller code point


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aеeо оoхx́̈​  ｅéëfﬁﬂil⁠ÑñÑ"), max_size=12))
def test_rewriting_is_idempotent_and_keeps_equivalence(text):
    a, table = automaton(text + "eoxé")
    once = L.rewrite(text, a)
    assert L.rewrite(once, a) == once
    assert L.rewrite(unicodedata.normalize("NFC", once), a) == once


def brute_pairs(rows):
    a, table = automaton("".join(t for _, t in rows if t))
    canon = {(k, t): L.rewrite(t, a) if table else t for k, t in rows if t and k is not None}
    out = set()
    for (k1, t1), (k2, t2) in itertools.combinations(sorted(canon), 2):
        if k1 != k2 and t1 != t2 and canon[k1, t1] == canon[k2, t2]:
            out.add((min(k1, k2), max(k1, k2)))
    return out


def test_pairs_equal_brute_force(spark):
    rows = [(1, "one two"), (2, "one two"), (3, "one two"), (4, "ｏｎｅ two"), (5, "other"), (5, "other"), (6, "оther"), (7, None), (8, ""), (9, "​"), (None, "one two"), (10, "x" * 50_000), (11, "x" * 49_999 + "х")]
    df = spark.createDataFrame([(k, t, "extra", "extra") for k, t in rows], "k long, t string, c string, canonical_text string")
    got = {(r["a"], r["b"]) for r in L.look_alike_pairs_of(df, "k", "t").collect()}
    assert got == brute_pairs(rows) and (10, 11) in got


def test_hot_class_is_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_ROWS", 10)
    rows = [(i, "3") for i in range(60)] + [(100 + i, "３") for i in range(3)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(r["a"], r["b"]) for r in L.look_alike_pairs_of(df, "k", "t").collect()]
    assert len(got) == len(set(got)) == 180


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert L.look_alike_pairs_of(df, "k", "t").count() == 0
    assert L.with_canonical(df, "t").columns == ["k", "t", "canonical_text"]


def test_hot_spellings_meet_in_buckets(spark, monkeypatch):
    """Many rows of one spelling, many spellings of one class: each pair once, whatever the bucket size."""
    odd = ["".join(c) for c in itertools.product("aа", repeat=5)]
    rows = [(i, "aaaaa") for i in range(200)] + [(1000 + i, t) for i, t in enumerate(odd)] + [(1000, odd[0]), (5, "ааааа"), (2000, "other")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(4)
    want = brute_pairs(rows)
    for size, most, hot in ((3, 32 << 20, 10**6), (7, 0, 20), (2000, 0, 10**6)):
        monkeypatch.setattr(L, "HOT_ROWS", size)
        monkeypatch.setattr(L, "BROADCAST_BYTES", most)
        monkeypatch.setattr(L, "HOT_CLASS", hot)
        got = [(r["a"], r["b"]) for r in L.look_alike_pairs_of(df, "k", "t").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    members = {r["id"]: (r["class_id"], r["spellings"]) for r in L.look_alike_classes(df, "k", "t").collect()}
    assert set(members) == {k for k, t in rows if t != "other"} and set(members.values()) == {(0, len(odd))}


def test_rewriting_ends_where_a_frequent_spelling_holds_a_pattern():
    """The most frequent spelling of a composed letter may hold a base that is itself rewritten."""
    table = L.rewrite_table({"а": 50, "a": 1, "á": 2, "́": 90, "á": 70})
    assert not any(p in best for best in table.values() for p in table)
    a = L._automaton(table)
    assert len({L.rewrite(t, a) for t in ("á", "á", "á")}) == 1
