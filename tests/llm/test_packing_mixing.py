import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.llm import mixing as M
from vellumgrid.llm import packing as P


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12), st.integers(0, 60))
def test_subset_sum_is_the_best(left, room):
    got = P._best_subset(left, room, 64)
    assert all(n <= left[s] for s, n in got.items()) and sum(s * n for s, n in got.items()) <= room
    reach = {0}
    for s, n in left.items():
        reach |= {r + s * k for r in reach for k in range(n + 1) if r + s * k <= room}
    assert sum(s * n for s, n in got.items()) == max(reach)


@pytest.mark.parametrize("seed", range(6))
def test_subset_sum_is_the_best_beyond_the_window(seed):
    """Several hundred sizes, of which the window tries 64 first: the fullest filling all the same."""
    rng = random.Random(seed)
    left = {rng.randint(200, 2000): rng.randint(1, 3) for _ in range(300)}
    for room in (777, 1500, 2047, 3999):
        reach = 1
        for s, n in left.items():
            for _ in range(n):
                reach |= (reach << s) & ((1 << (room + 1)) - 1)
        got = P._best_subset(left, room, 64)
        assert all(n <= left[s] for s, n in got.items()) and sum(s * n for s, n in got.items()) == reach.bit_length() - 1


def test_kinds_together_equal_kinds_alone(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(1, 300)) for i in range(500)], "k long, n long")
    got = P.pack_kinds(df, {"small": 90, "large": 700}, "k", "n").collect()
    for kind, capacity in (("small", 90), ("large", 700)):
        own = {(r["id"], r["piece_no"], r["size"], r["container"]) for r in got if r["kind"] == kind}
        assert own == {(r["id"], r["piece_no"], r["size"], r["container"]) for r in P.pack(df, capacity, "k", "n").collect()}
    assert P.pack_kinds(df, {}, "k", "n").count() == 0
    assert P.pack_kinds(df, {f"k{i}": 100 + i for i in range(101)}, "k", "n").select("kind").distinct().count() == 101


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=15))
def test_fill_uses_everything_once(counts):
    used: dict = {}
    for times, pattern in P.fill(counts, 40):
        assert sum(s * n for s, n in pattern.items()) <= 40
        for s, n in pattern.items():
            used[s] = used.get(s, 0) + n * times
    assert used == counts


def test_fill_rejects_oversize():
    with pytest.raises(ValueError):
        P.fill({5: 1}, 4)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice((3, 7, 50, 64, 100, 101, 250, rng.randint(1, 300)))) for i in range(600)] + [(7, 64), (None, 5), (900, None), (901, 0)]
    rows += [(1000 + i, 33) for i in range(400)]
    first = {}
    for k, n in rows:
        first.setdefault(k, n)
    df = spark.createDataFrame([(k, n, 1) for k, n in rows if k != 7] + [(7, 64, 1), (7, 64, 2)], "k long, n long, container int")
    first[7] = 64
    got = P.pack(df, 100, "k", "n").collect()
    load: dict = {}
    pieces: dict = {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        pieces.setdefault(r["id"], []).append((r["piece_no"], r["size"], r["n_pieces"]))
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    want = {k: n for k, n in first.items() if k is not None and n}
    assert set(pieces) == set(want)
    for k, n in want.items():
        own = sorted(pieces[k])
        assert sum(s for _, s, _ in own) == n and len(own) == own[0][2] == -(-n // 100) and [p for p, _, _ in own] == list(range(1, len(own) + 1))
    assert sum(load.values()) / (len(load) * 100) > 0.97
    assert P.pack(df.where("false"), 100, "k", "n").count() == 0
    with pytest.raises(ValueError):
        P.pack(df, 0, "k", "n")


def test_tokens(spark):
    import os

    if not os.path.exists(P.VOCABULARY):
        pytest.skip("no tokenizer")
    rows = [("Hello world",), (None,), ("",), ("a" * 50_000,), ("Hello world",), ("wörd " * 30_000,)]
    got = [r["n_tokens"] for r in P.with_tokens(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got[0] == got[4] == 2 and got[1] is None and got[2] == 0 and got[3] > 1000 and got[5] > 30_000
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(P.VOCABULARY), "byte_bpe_50k.json"))
    for text in ("It's 12 o'clock,  isn't it?\n\n“Ja”", "Совет долины\tизмеряет"):
        assert P.count_tokens(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_schedule_is_even_over_every_stretch():
    weights = [("a", 0.46), ("b", 0.1), ("c", 0.24), ("d", 0.2)]
    plan = M.schedule(weights, 1000)
    assert sorted(k for v in plan.values() for k in v) == list(range(1000))
    for end in (50, 200, 500, 1000):
        for s, w in weights:
            assert abs(sum(k < end for k in plan[s]) - w * end) < 4


def test_budget_is_limited_by_the_scarcest():
    assert M.budget({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.0, 1)}) == {"a": 200, "b": 200}
    assert M.budget({}, {"a": (1.0, 1)}) == {}
    got = M.budget({"a": 100}, {"a": (0.5, 1), "b": (0.5, 1)})
    assert got == {"a": 100}


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaab"), rng.randint(1, 50)) for i in range(3000)] + [(5000 + i, "c", rng.randint(1, 50)) for i in range(60)]
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (None, "a", 5), (9000, "z", 5), (9001, "a", 0), (9002, None, 5)]
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "e": (0.0, 1)}
    df = spark.createDataFrame([(*r, 0) for r in rows], "k long, s string, n long, slot int")
    got = M.mix(df, "k", "s", "n", targets, slots=200)
    out = got.collect()
    uses: dict = {}
    tokens: dict = {}
    for r in out:
        assert r["slot"] is not None
        uses[r["id"]] = uses.get(r["id"], 0) + 1
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    assert len({(r["id"], r["use_no"]) for r in out}) == len(out) and not {9000, 9001, 9002, None} & set(uses)
    assert all(uses[r["id"]] <= targets[r["source"]][1] for r in out) and max(uses.values()) == 4
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - targets[s][0]) < 0.01 for s in "abc")
    shares = {r["source"]: r for r in M.shares(got, targets).collect()}
    assert shares["e"]["uses"] == 0 and shares["c"]["most_uses"] == 4 and abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9
    half = [r for r in out if r["slot"] < 100]
    part = sum(r["n_tokens"] for r in half)
    assert all(abs(sum(r["n_tokens"] for r in half if r["source"] == s) / part - targets[s][0]) < 0.05 for s in "abc")
    assert M.mix(df.where("false"), "k", "s", "n", targets).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, "k", "s", "n", {"a": (0.5, 0)})


def test_sizes_beyond_the_window_fill_the_slack():
    """Only one odd size, which no window of 64 holds, makes an odd sum."""
    left = {s: 3 for s in range(2, 1200, 2)} | {301: 1}
    got = P._best_subset(left, 1501, 64)
    assert sum(s * n for s, n in got.items()) == 1501 and got[301] == 1


def test_endless_stretch_counts_as_the_tokenizer_does():
    """Nothing is lost to cuts, neither within the stretch nor in the text around it."""
    prose = "A text of ordinary words, one like the other. " * 900
    for text in ("!?" * 50_000, prose + "x" * 20_001 + " " + prose, "".join(chr(97 + i * i % 26) for i in range(30_011))):
        assert P.count_tokens(text) == len(P.encoding().encode_ordinary(text))
