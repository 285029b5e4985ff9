import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import quality as Q


@pytest.fixture(scope="module")
def common(d):
    return [r[0] for r in duckdb.sql(f"SELECT DISTINCT lower(word) FROM '{d}/common_words.parquet'").fetchall()]


@pytest.fixture(scope="module")
def rules(spark, d, common):
    return Q.fit(spark, spark.read.parquet(f"{d}/lang_samples.parquet"), common, per_kind=600)


def test_statistics(spark, common):
    df = spark.createDataFrame([("The old mill, of course.\nIt stands: 12 (3.5)",)], "t string")
    r = Q.with_statistics(df, "t", ["the", "of", "it"]).first()
    assert (r["n_chars"], r["n_words"], r["n_lines"]) == (44, 9, 2)
    assert r["punct_line_share"] == 0.5 and r["sentence_ends"] == 1
    assert r["common_word_share"] == pytest.approx(3 / 7) and r["numeric_word_share"] == pytest.approx(2 / 9)
    assert r["max_word_length"] == 7 and r["distinct_word_share"] == 1.0


def test_rules_hold_out(spark, d, common, rules):
    """Accuracy on documents of another seed."""
    pdf = pd.DataFrame(duckdb.sql(f"SELECT lang, text FROM '{d}/lang_samples.parquet'").fetchall(), columns=["lang", "text"])
    docs = Q.labelled_documents(pdf, 300, seed=99)
    got = Q.with_kind(spark.createDataFrame(docs), "text", common, rules).select("kind", "text_kind").toPandas()
    prose, found = got["kind"] == "prose", got["text_kind"] == "prose"
    assert (prose == found).mean() > 0.98
    assert (found & ~prose).sum() / (~prose).sum() < 0.03


def test_rules_hold_out_of_languages(spark, d, common):
    """Rules learnt from six languages judge documents of the three others, whose sentences and words they have not seen."""
    pdf = pd.DataFrame(duckdb.sql(f"SELECT lang, text FROM '{d}/lang_samples.parquet'").fetchall(), columns=["lang", "text"])
    held = pdf["lang"].isin(["es", "nl", "ru"])
    stats = Q.with_statistics(spark.createDataFrame(Q.labelled_documents(pdf[~held], 600)).repartition(8), "text", common).select("kind", *Q.STATS).toPandas().dropna()
    rules = Q.induce(stats[list(Q.STATS)], stats["kind"].to_numpy())
    got = Q.with_kind(spark.createDataFrame(Q.labelled_documents(pdf[held], 200, seed=99)), "text", common, rules).select("kind", "text_kind").toPandas()
    prose, found = got["kind"] == "prose", got["text_kind"] == "prose"
    print("held-out languages: right", round((prose == found).mean(), 4), "others taken for prose", round((found & ~prose).sum() / (~prose).sum(), 4), "kinds right", round((got["kind"] == got["text_kind"]).mean(), 4))
    assert (prose == found).mean() > 0.97


def test_case_equals_the_rule_list(spark, common, rules):
    docs = pd.DataFrame({"text": ["It is said that the mill stands here. The gate was old.", "a, b, c, d, e, f", "12 13 14\n15 16 17", "____\n====", "zxq vbn ghj wrt pls kjh"]})
    got = Q.with_kind(spark.createDataFrame(docs), "text", common, rules).toPandas()
    x = {s: got[s].to_numpy(dtype=float) for s in Q.STATS}
    assert list(rules.predict(x)) == list(got["text_kind"])
    assert got["text_kind"][0] == "prose" and (got["text_kind"][1:] != "prose").all()


def test_edge_rows(spark, common, rules):
    long_ = "Every line of it is prose. " * 40_000
    rows = [(1, None), (2, ""), (3, " \n　\t"), (4, long_), (4, long_), (5, "9" * 200_000 + "x"), (6, " " * 300_000 + "end of it.")]
    df = spark.createDataFrame([(k, t, "z", 0.5) for k, t in rows], "k int, t string, n_chars string, text_kind double")
    got = Q.with_kind(df, "t", common, rules)
    kinds = {r["k"]: r["text_kind"] for r in got.select("k", "text_kind").collect()}
    assert got.columns.count("n_chars") == 1 and got.count() == 7
    assert kinds[1] is None and kinds[2] is None and kinds[3] is None and kinds[4] == "prose" and kinds[5] != "prose"
    assert Q.with_kind(df.where("false"), "t", common, rules).count() == 0
    assert Q.with_kind(df, "t", [], Q.RuleList()).where("k = 4").first()["text_kind"] == "prose"
    with pytest.raises(ValueError):
        Q.with_statistics(df.select(F.col("t").alias("n_words")), "n_words", common)


def test_induction_learns_a_threshold():
    rng = np.random.default_rng(1)
    stats = pd.DataFrame({s: rng.random(400) for s in Q.STATS})
    kinds = np.where(stats["digit_share"] > 0.7, "table", "prose")
    rules = Q.induce(stats, kinds)
    hit = rules.predict({s: stats[s].to_numpy() for s in Q.STATS})
    assert (hit == kinds).mean() > 0.97 and "digit_share" in rules.case()


def test_common_words_bound(spark):
    df = spark.createDataFrame([("en", "A"), ("en", "a"), ("de", None)], "lang string, word string")
    assert Q.common_words(df) == ["a"]
    with pytest.raises(ValueError):
        Q.common_words(spark.range(20).select(F.lit("x").alias("lang"), F.col("id").cast("string").alias("word")), limit=10)
