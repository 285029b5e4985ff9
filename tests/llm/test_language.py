import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import garble, language as L


@pytest.fixture(scope="module")
def split(samples):
    return [s for i, s in enumerate(samples) if i % 3], [s for i, s in enumerate(samples) if not i % 3]


@pytest.fixture(scope="module")
def model(split):
    return L.fit(split[0])


def test_held_out_accuracy(model, split):
    for form in (str, str.upper, lambda t: t[:60]):
        got = L.judge([form(t) for _, t in split[1]], model)
        assert np.mean([g[0] == lang for g, (lang, _) in zip(got, split[1])]) > 0.98


def test_mixed_passages(model, split):
    by = {lang: t for lang, t in split[1]}
    for sep in (" ", "\n", " / ", "\n\n"):
        text = by["en"] + sep + by["pl"]
        (main, conf, parts) = L.judge([text], model)[0]
        assert [p[2] for p in parts] == ["en", "pl"] and parts[0][0] == 0 and parts[-1][1] == len(text)
        assert abs(parts[1][0] - len(by["en"])) <= len(sep) + 1 and all(0 < p[3] <= 1 for p in parts)


def test_a_few_foreign_words_do_not_mix(model, split):
    en = next(t for lang, t in split[1] if lang == "en")
    for words in ("(una serie de lecturas)", "(старую границу)", "“der alte Kanal”"):
        assert len(L.judge([f"{en} {words} {en}"], model)[0][2]) == 1


def test_batches_do_not_touch(model, split):
    """The same verdicts alone and in one batch, and over block borders."""
    texts = [t for _, t in split[1]][:40] + ["", "123", " "]
    alone = [L.judge([t], model)[0] for t in texts]
    assert [a[:1] + (a[2],) for a in alone] == [g[:1] + (g[2],) for g in L.judge(texts, model)]
    big = L.BLOCK
    try:
        L.BLOCK = 97
        assert [a[0] for a in alone] == [g[0] for g in L.judge(texts, model)]
    finally:
        L.BLOCK = big


def test_column_form(spark, model, split, samples):
    ru = next(t for lang, t in split[1] if lang == "ru")
    rows = [(1, ru), (1, ru), (2, None), (3, ""), (4, "12 + 3"), (5, ru * 4_000), (6, garble.garble(ru, "utf-8>cp1251"))]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "k int, t string, language int")
    out = L.with_language(df, "t", model, garble.fit([t for _, t in samples]))
    got = {r["k"]: (r["language"], r["passages"]) for r in out.collect()}
    assert out.count() == 7 and got[1][0] == got[5][0] == got[6][0] == "ru"
    assert got[2] == (None, None) and got[3] == (None, []) and got[4] == (None, [])
    assert L.with_language(df.where("false"), "t", model).count() == 0
    with pytest.raises(ValueError):
        L.fit([])


def test_what_is_in_no_language(model, split):
    for t in ("村里的旧桥很长而且很美", "Η παλιά γέφυρα του χωριού είναι μεγάλη", "asdkjh qwoeiu zmxnbv qpwoei alskdj fhgjty", "rsp zfpfcxrvmp zrmxkwhnrcv mm pkxjdhcwnv"):
        name, confidence, passages = L.judge([t], model)[0]
        assert name == "und" and 0 < confidence <= 1 and passages == [(0, len(t), "und", confidence)]
    assert all(g[0] == lang for g, (lang, _) in zip(L.judge([t for _, t in split[1]], model), split[1]))


def test_passages_are_places_in_the_stored_text(spark, split, samples):
    by = {lang: t for lang, t in split[1]}
    de, fr = by["de"] + " Die Übersicht prüft größere Flächen.", by["fr"]
    stored = garble.garble(f"{de}\n{fr}", "utf-8>cp1252>utf-8>cp1252")
    df = spark.createDataFrame([(1, stored)], "k int, t string")
    row = L.with_language(df, "t", L.fit(samples), garble.fit([t for _, t in samples])).first()
    parts = [(p["language"], p["start"], p["end"]) for p in row["passages"]]
    assert [p[0] for p in parts] == ["de", "fr"] and parts[0][1] == 0 and parts[1][2] == len(stored) and parts[0][2] == parts[1][1]
    assert abs(parts[1][1] - stored.index("\n")) <= 1


def test_names_of_languages(spark):
    cases = {"en": "en", "EN": "en", "en-GB": "en", "nl_BE": "nl", "deu": "de", "ger": "de", "rus": "ru", " fr ": "fr", "und": None, "zxx": None, "": None, "unknown": None, None: None, "xx-en": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r["l"]: r["n"] for r in df.select("l", L.named_language(F.col("l")).alias("n")).collect()} == cases
