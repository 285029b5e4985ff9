import duckdb
import pytest

from vellumgrid.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("elements", "pdf_layouts", "split_limits", "documents", "containers", "mix_targets", "common_words", "lang_samples"):
        con.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    df = Q.queries()[name](spark, d)
    want = con.sql(Q.oracle_sql()[name]).df()
    assert set(df.columns) == set(want.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got and got == sorted(map(tuple, want[columns].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs(spark, d, name):
    df = Q.queries()[name](spark, d)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", ["p1_canonical", "p2_statistics", "p3_repaired", "p4_languages"])
def test_whole_result_covers_every_text(spark, d, name):
    """The operator's own result, not only its cases: each element with text, whatever its label, once."""
    got = [r["elem_id"] for r in Q.queries()[name](spark, d).select("elem_id").collect()]
    assert sorted(got) == [r[0] for r in duckdb.sql(f"SELECT DISTINCT elem_id FROM '{d}/elements.parquet' WHERE text <> '' ORDER BY 1").fetchall()]


def test_whole_results_hold_the_cases(spark, d):
    q = Q.queries()
    canonical = {r["elem_id"]: r["canonical_text"] for r in q["p1_canonical"](spark, d).collect()}
    assert all(canonical[r[0]] == canonical[r[1]] for r in q["p1_found"](spark, d).collect())
    kinds = q["p2_statistics"](spark, d).where("n_words IS NOT NULL AND label = 'Text' AND text_kind <> 'prose'").collect()
    assert {r["elem_id"] for r in kinds} == {r[0] for r in q["p2_found"](spark, d).collect()}
    repaired = q["p3_repaired"](spark, d).where("chain IS NOT NULL AND repaired_text IS NOT NULL").collect()
    assert {r["elem_id"] for r in repaired} == {r[0] for r in q["p3_found"](spark, d).collect()}
    judged = {r["elem_id"]: r for r in q["p4_languages"](spark, d).collect()}
    assert all(lang in {p["language"] for p in judged[k]["passages"]} and judged[k]["language_confidence"] is not None for k, lang in q["p4_found"](spark, d).collect())


def test_settings_beyond_their_bound_are_an_error(spark):
    assert len(Q.few(spark.range(3), 3)) == 3
    with pytest.raises(ValueError, match="more than 2 rows of settings"):
        Q.few(spark.range(3), 2)
