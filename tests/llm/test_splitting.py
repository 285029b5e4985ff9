import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.llm import splitting as S


def check(text, parts, limit, overlap):
    got = S.cuts(len(text), S.boundaries(text, parts), limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - a <= limit for a, e in got) and all(e > a for a, e in got) or not text
    for (_, e), (b, f) in zip(got, got[1:]):
        assert b == e - overlap and f > e
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n-é", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_any_text(text, limit, overlap):
    if overlap < limit:
        got = check(text, [], limit, overlap)
        assert "".join(text[a + (overlap if k else 0) : e] for k, (a, e) in enumerate(got)) == text


def test_cuts_fall_on_the_strongest_boundary_near():
    text = ("A short sentence here. " * 20 + "\n\n") * 3
    ends = [e for _, e in check(text, [], 500, 50)][:-1]
    assert all(text[:e].endswith("\n\n") or text[:e].endswith(". ") for e in ends)
    assert any(text[:e].endswith("\n\n") for e in ends)


def test_no_more_pieces_than_needed_and_even():
    got = check("word " * 1000, [], 1200, 120)
    assert len(got) <= -(-(5000 - 120) // (1200 - 120)) + 1
    sizes = [e - a for a, e in got]
    assert max(sizes) - min(sizes) < 60


def test_no_boundary_at_all():
    got = check("x" * 5000, [], 1200, 120)
    assert len(got) == 5


def test_a_boundary_in_reach_is_never_missed():
    """Wherever a piece can end at a boundary it does, with as many pieces as that takes."""
    text = ("x" * 90 + " ") * 60
    assert all(text[e - 1] == " " for _, e in check(text, [], 130, 20)[:-1])
    assert all(text[e - 1] == " " for _, e in check(text, [], 100, 5)[:-1])


def test_linear_without_a_boundary():
    import time

    for text in ("x" * 10_000_000, "word " * 1_000_000, ("y" * 3000 + ". ") * 2000, "\n" + " " * 2_000_000, "." * 2_000_000):
        began = time.time()
        check(text, [], 1200, 120)
        assert time.time() - began < 20


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        S.cuts(10, {}, 5, 5)
    with pytest.raises(ValueError):
        S.split_items(spark.createDataFrame([], "item_kind string, item_id long, parts array<string>"), {"a": (0, 0)})


def test_column_form(spark):
    rows = [("element", 1, ["a b " * 100]), ("element", 1, ["a b " * 100]), ("element", 2, [None]), ("element", 3, None), ("page", 4, ["x y. " * 20, None, "", "z w. " * 20]), ("other", 5, ["q" * 999]), ("element", None, ["n " * 200]), ("element", 6, ["l " * 300_000])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "item_kind string, item_id long, parts array<string>, piece int")
    got = S.split_items(df, {"element": (100, 10), "page": (120, 0)}).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r["item_kind"], r["item_id"]), []).append(r)
    assert len(by["element", 1]) == 2 * by["element", 1][0]["n_pieces"] and by["element", 1][0]["n_pieces"] > 1
    assert [r["piece"] for r in by["element", 2]] == [""] and [r["n_pieces"] for r in by["element", 3]] == [1]
    assert sorted(r["end"] for r in by["page", 4]) == [100, 200] and len(by["other", 5]) == 1 and ("element", None) in by
    assert all(len(r["piece"]) <= 100 for r in by["element", 6])
    assert S.split_items(df.where("false"), {"element": (100, 10)}).count() == 0
