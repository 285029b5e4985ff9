from pyspark.sql import functions as F

from vellumgrid.llm import scans as S

CLEAN = ["The old mill stands near the water gate of the town.", "Every field station confirms the water level near the old gate.", "The committee confirms the monthly total of the timber supply.", "A printed ledger records the water level and the timber supply."]


def setting(spark, scanned):
    texts = [(100 + i, "d", t, False) for i, t in enumerate(CLEAN * 6)] + [(i, "d", t, True) for i, t in scanned]
    df = spark.createDataFrame([(*r, "x") for r in texts], "k long, doc string, text string, s boolean, form string")
    counts = S.grams(df, "text", "s")
    return df, df.where("s"), counts


def test_skeletons(spark):
    pairs = [("modern", "modem"), ("modern", "rnodern"), ("until", "iintil"), ("wooden", "vvooclen"), ("old", "o1d"), ("vecchio", "veccliio"), ("gate", "g@+e"), ("nord", "riord"), ("извест", "и3вест"), ("ы", "ьi"), ("контора", "конт~ора")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r["x"] == r["y"] for r in df.select(S.skeleton(F.col("a")).alias("x"), S.skeleton(F.col("b")).alias("y")).collect())


def test_misread_words_are_found_and_replaced(spark):
    scanned = [(1, "The o1d mill starids near the vvater gate."), (2, "The old mill stands."), (3, "A sign (K8s5182) near v1.5781 and the water level."), (4, None), (5, ""), (1, "The o1d mill starids near the vvater gate.")]
    df, own, counts = setting(spark, scanned)
    got = {(r["id"], r["rare"], r["form"]) for r in S.misreads(own, "k", "text", counts).collect()}
    assert got == {(1, "o1d", "old"), (1, "starids", "stands"), (1, "vvater", "water")}
    assert S.replace("THE O1D gate. O1d? (o1d)", {"o1d": "old"}) == "THE OLD gate. Old? (old)"


def test_lines(spark):
    scanned = [(1, "the water\n- 3 -\nlevel"), (2, "the wa-\nter level"), (3, "the water\nRIVER TOWN HISTORY | 4\nlevel"), (4, "plain lines\nof text here"), (5, "[12] a note\nof two lines"), (6, "it was built in\n1904."), (7, "text\niv"), (8, "the wa‐ \nvi\nter"), (9, None), (10, "the water\nXylo local history\nlevel"), (11, "xylo local history\nthe water level is")]
    df, own, _ = setting(spark, scanned)
    heads = spark.createDataFrame([("d", "River town history 17"), ("e", "Zorn local history"), (None, "x"), ("d", None)], "doc string, text string")
    got: dict = {}
    for r in S.line_findings(own, "k", "text", "doc", S.header_lines(heads, "doc", "text")).collect():
        got.setdefault(r["id"], set()).add((r["finding"], r["line_no"]))
    assert got == {1: {("page_number", 1)}, 2: {("broken", -1)}, 3: {("header", 1)}, 7: {("page_number", 1)}, 8: {("page_number", 1)} | ({("broken", -1)} if ("broken", -1) in got[8] else set()), 10: {("header", 1)}, 11: {("header", 0)}}


def test_reflow(spark):
    scanned = [(1, "The o1d mill sta-\n- 3 -\nnds near the\nwater gate.\n\nA second\nparagraph."), (2, None), (3, ""), (4, "one line"), (1, "The o1d mill sta-\n- 3 -\nnds near the\nwater gate.\n\nA second\nparagraph.")]
    df, own, counts = setting(spark, scanned)
    found = S.line_findings(own, "k", "text", "doc", S.header_lines(own.where("false"), "doc", "text"))
    got = {r["id"]: r["repaired"] for r in S.reflow(own, "k", "text", found, S.misreads(own, "k", "text", counts)).collect()}
    assert got == {1: "The old mill stands near the water gate.\n\nA second paragraph.", 3: "", 4: "one line"}


def test_empty_and_long(spark):
    df, own, counts = setting(spark, [(1, "the old gate " * 20_000 + "\n- 4 -\nof the town")])
    assert S.misreads(own, "k", "text", counts).count() == 0
    assert S.line_findings(own, "k", "text", "doc", S.header_lines(own.where("false"), "doc", "text")).count() == 1
    none = own.where("false")
    assert S.misreads(none, "k", "text", S.grams(none, "text", "s")).count() == 0
    assert S.reflow(none, "k", "text", S.line_findings(none, "k", "text", "doc", S.header_lines(none, "doc", "text")), S.misreads(none, "k", "text", counts)).count() == 0


def test_sha_read_as_te(spark):
    rows = [(i, "Старый шлюз закрыт.", False) for i in range(30)] + [(100, "Старый тлюз закрыт.", True)]
    df = spark.createDataFrame(rows, "k long, t string, s boolean")
    got = S.misreads(df.where("s"), "k", "t", S.grams(df, "t", "s")).collect()
    assert [tuple(r) for r in got] == [(100, "тлюз", "шлюз")]


def test_headers_of_any_length_and_shuffled_candidates(spark, monkeypatch):
    """A header of 200 characters is found; tables of candidates too large to broadcast give the same results."""
    long = "The complete and unabridged local history of the river town " * 3
    scanned = [(1, f"the water\n{long} | 4\nlevel"), (2, "The o1d mill starids near the vvater gate."), (3, f"the gate\n{long} 17\nof the town"), (4, "plain lines\nof text here")]
    df, own, counts = setting(spark, scanned)
    heads = S.header_lines(spark.createDataFrame([("d", f"{long} 9")], "doc string, text string"), "doc", "text")
    want = {(1, "header", 1), (3, "header", 1)}, {(2, "o1d", "old"), (2, "starids", "stands"), (2, "vvater", "water")}
    for most in (S.BROADCAST_BYTES, 0):
        monkeypatch.setattr(S, "BROADCAST_BYTES", most)
        assert {tuple(r) for r in S.line_findings(own, "k", "text", "doc", heads).collect()} == want[0]
        assert {tuple(r) for r in S.misreads(own, "k", "text", counts).collect()} == want[1]


def spoil(text, rng):
    """What scanning does, on clean text: misread letters, words broken over lines, page numbers between lines."""
    swap = {"l": "1", "o": "0", "e": "c", "m": "rn", "n": "ri", "w": "vv", "s": "5", "t": "+", "a": "@", "d": "ci", "h": "li", "и": "н", "б": "6"}
    words = ["".join(swap[c] if c in swap and rng.random() < 0.3 else c for c in w) if w.isalpha() and len(w) > 4 and rng.random() < 0.15 else w for w in text.split(" ")]
    lines, line = [], ""
    for w in words:
        if line and len(line) + len(w) > 50:
            cut = rng.randint(2, len(w) - 2) if w.isalpha() and len(w) > 5 and rng.random() < 0.5 else 0
            lines.append(f"{line} {w[:cut]}-" if cut else line)
            if rng.random() < 0.1:
                lines.append(f"- {rng.randint(2, 400)} -")
            line = w[cut:]
        else:
            line = f"{line} {w}" if line else w
    return "\n".join([*lines, line])


def test_repair_of_spoilt_clean_texts(spark, d):
    """Held-out: clean texts of the table, spoilt, come out word for word as they were."""
    import random

    clean = spark.read.parquet(f"{d}/elements.parquet").where("label = 'Text' AND NOT coalesce(ocr.is_ocr, false) AND length(text) > 200 AND text NOT LIKE '%\n%' AND octet_length(text) = length(text)")
    texts = [r["text"] for r in clean.select("text").distinct().orderBy("text").collect() if " " in r["text"]]
    rng = random.Random(3)
    pairs = [(i, t, spoil(t, rng)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, "d", b, True) for i, _, b in pairs], "k long, doc string, text string, s boolean")
    every = df.select("text", "s").unionByName(clean.selectExpr("text", "false AS s"))
    counts = S.grams(every, "text", "s")
    none = S.header_lines(df.where("false"), "doc", "text")
    got = {r["id"]: r["repaired"] for r in S.reflow(df, "k", "text", S.line_findings(df, "k", "text", "doc", none), S.misreads(df, "k", "text", counts)).collect()}
    right = wrong = spoilt = 0
    for i, t, b in pairs:
        want, have = t.split(), got[i].split()
        spoilt += sum(x != y for x, y in zip(want, b.replace("-\n", "").split()))
        if len(want) == len(have):
            right += sum(x == y for x, y in zip(want, have))
        wrong += len(want) - (sum(x == y for x, y in zip(want, have)) if len(want) == len(have) else 0)
    print(f"texts {len(pairs)}, words right {right}, wrong {wrong}, spoilt {spoilt}")
    assert right / (right + wrong) > 0.97
