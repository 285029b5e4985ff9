"""The pN_ queries over the test tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import garble, language, lookalike, mixing, packing, quality, residue, scans, splitting
from vellumgrid.runtime import load, spread, stash

#: at most so many clean samples are brought to the driver to fit a model
MAX_SAMPLES = 20_000


def sample_texts(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """(lang, text) of lang_samples, a table of fixed size; MAX_SAMPLES bounds it."""
    rows = load(spark, d, "lang_samples").select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    return [(r[0], r[1]) for r in rows.orderBy("lang", "text").limit(MAX_SAMPLES).collect()]  # labelled rows, a documented bound


def few(rows: DataFrame, most: int) -> list:
    """The rows of a table of settings; more than most of them are an error, never a cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows of settings: {', '.join(rows.columns)}")
    return got


#: rows a table of settings (limits, containers, targets) may have
MAX_SETTINGS = 100_000


def all_texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(elem_id, text, columns...) of every element with text, redelivered rows once."""
    return spread(load(spark, d, "elements").where("text <> ''").select("elem_id", "text", *columns).distinct())


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_canonical(all_texts(spark, d), "text").select("elem_id", "canonical_text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(load(spark, d, "elements").select("elem_id", "text"))
    return lookalike.look_alike_pairs_of(rows, "elem_id", "text").select(F.col("a").alias("elem_id_a"), F.col("b").alias("elem_id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The members of every class of texts that look the same in several spellings."""
    rows = spread(load(spark, d, "elements").select("elem_id", "text"))
    return lookalike.look_alike_classes(rows, "elem_id", "text").withColumnRenamed("id", "elem_id")


_MODELS: dict = {}


def once(spark: SparkSession, d: str, name: str, make: "Callable[[], object]"):
    """A model fitted on the tables of d, once an application; all are of fixed size."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def chains(spark: SparkSession, d: str) -> garble.ChainModel:
    return once(spark, d, "chains", lambda: garble.fit([t for _, t in sample_texts(spark, d)]))


def languages(spark: SparkSession, d: str) -> language.LanguageModel:
    return once(spark, d, "languages", lambda: language.fit(sample_texts(spark, d)))


def quality_rules(spark: SparkSession, d: str) -> tuple[list[str], quality.RuleList]:
    common = once(spark, d, "common", lambda: quality.common_words(load(spark, d, "common_words")))
    return common, once(spark, d, "rules", lambda: quality.fit(spark, load(spark, d, "lang_samples"), common, max_samples=MAX_SAMPLES))


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    common, rules = quality_rules(spark, d)
    return quality.with_kind(all_texts(spark, d, "label"), "text", common, rules).select("elem_id", "label", *quality.STATS, "text_kind")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    common, rules = quality_rules(spark, d)
    rows = spread(load(spark, d, "elements").select("elem_id", "label", "text").where("label = 'Text' AND text <> ''"))
    return quality.with_kind(rows, "text", common, rules, keep=False).where("text_kind <> 'prose'").select("elem_id").distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every text as restored, with its chain (null if clean)."""
    return garble.with_repair(all_texts(spark, d), "text", chains(spark, d)).select("elem_id", "chain", "repaired_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(load(spark, d, "elements").select("elem_id", "text"))
    return garble.with_repair(rows, "text", chains(spark, d)).where("chain IS NOT NULL").select("elem_id").distinct()


#: labels of running text, in both spellings
RUNNING = ("Text", "ListItem", "List-Item", "Footnote")


def running_texts(spark: SparkSession, d: str, *columns: str, where: str = "true") -> DataFrame:
    """Elements of running text that are no p2 case, with text_kind."""
    common, rules = quality_rules(spark, d)
    rows = load(spark, d, "elements").where(F.col("label").isin(*RUNNING)).where(f"text <> '' AND ({where})").select("elem_id", "label", "text", *columns)
    kind = quality.with_kind(spread(rows), "text", common, rules, keep=False)
    return kind.where("text_kind IS NOT NULL AND (label <> 'Text' OR text_kind = 'prose')")


def judged_languages(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return language.with_language(rows, "text", languages(spark, d), chains(spark, d))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and passages of every text; start and end are places in the stored text."""
    rows = all_texts(spark, d, "label", "lang")
    return judged_languages(spark, d, rows).select("elem_id", "label", "lang", "language", "language_confidence", "passages")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    judged = judged_languages(spark, d, running_texts(spark, d, "lang")).select("elem_id", "lang", F.array_distinct(F.transform("passages", lambda p: p["language"])).alias("langs"))
    one = F.size("langs") == 1
    wrong = ~F.coalesce(language.named_language(F.col("lang")) == F.element_at("langs", 1), F.lit(False))
    return judged.where(((one & wrong) | (F.size("langs") > 1)) & ~F.array_contains("langs", language.UNKNOWN)).select("elem_id", F.explode("langs").alias("lang")).distinct()


def limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    return {r[0]: (r[1], r[2]) for r in few(load(spark, d, "split_limits").select("item_kind", "max_chars", "overlap_chars"), MAX_SETTINGS)}


def split_input(spark: SparkSession, d: str) -> DataFrame:
    elements = load(spark, d, "elements").select(F.lit("element").alias("item_kind"), F.col("elem_id").alias("item_id"), F.array("text").alias("parts"))
    pages = load(spark, d, "pdf_layouts").select(F.lit("page").alias("item_kind"), F.col("export_id").alias("item_id"), F.col("layouts.text").alias("parts"))
    return elements.unionByName(pages)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(split_input(spark, d), limits(spark, d)).where("n_pieces > 1").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(split_input(spark, d), limits(spark, d)).where("n_pieces > 1").select("item_kind", "item_id").distinct()


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized item: the digest of its pieces put together again without their overlaps,
    and whether every piece is within the limit, starts overlap_chars before the last one's end, and no piece is spare."""
    given = load(spark, d, "split_limits").select("item_kind", "max_chars", "overlap_chars")
    pieces = p5_pieces(spark, d).join(given, "item_kind")
    by = pieces.groupBy("item_kind", "item_id", "max_chars", "overlap_chars", "n_pieces").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))
    own = F.transform("p", lambda x: F.when(x["piece_no"] == 1, x["piece"]).otherwise(F.substr(x["piece"], F.col("overlap_chars") + 1)))
    rest = F.slice("p", 2, F.size("p"))
    meets = F.forall(F.zip_with("p", rest, lambda a, b: b.isNull() | (b["start"] == a["end"] - F.col("overlap_chars"))), lambda x: x)
    fits = F.forall("p", lambda x: (F.length(x["piece"]) <= F.col("max_chars")) & (F.length(x["piece"]) == x["end"] - x["start"]) & (F.length(x["piece"]) > F.col("overlap_chars")))
    return by.select("item_kind", "item_id", F.md5(F.array_join(own, "")).alias("digest"), fits.alias("fits"), meets.alias("meets"), (F.size("p") == F.col("n_pieces")).alias("numbered"))


def scan_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned texts, line findings, misread words)."""
    every = load(spark, d, "elements")
    texts = stash(running_texts(spark, d, "pdf_id", where="ocr.is_ocr").select("elem_id", "pdf_id", "text"), "scanned")
    headers = scans.header_lines(every.where(F.col("label").isin("PageHeader", "Page-Header")), "pdf_id", "text")
    words = every.where(F.col("label").isin(*RUNNING)).select("text", F.col("ocr.is_ocr").alias("scanned"))
    counts = stash(scans.grams(spread(words), "text", "scanned"), "grams")
    return texts, scans.line_findings(texts, "elem_id", "text", "pdf_id", headers), scans.misreads(texts, "elem_id", "text", counts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, lines, words = scan_parts(spark, d)
    return lines.select("id").unionByName(words.select("id")).select(F.col("id").alias("elem_id")).distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    texts, lines, words = scan_parts(spark, d)
    return scans.reflow(texts, "elem_id", "text", lines, words).select(F.col("id").alias("elem_id"), "repaired")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with text, tokenized once and kept in the shared folder."""
    docs = load(spark, d, "documents").select("doc_id", "source", "text").where("text IS NOT NULL")
    return stash(packing.with_tokens(spread(docs), "text").select("doc_id", "source", "n_tokens"), "tokens")


def p7_assign(spark: SparkSession, d: str) -> DataFrame:
    kinds = {r[0]: r[1] for r in few(load(spark, d, "containers").select("container_kind", "capacity_tokens"), MAX_SETTINGS)}
    return packing.pack_kinds(token_counts(spark, d), kinds, "doc_id", "n_tokens").withColumnsRenamed({"kind": "container_kind", "id": "doc_id"})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least that could hold the tokens, tokens and share filled, by kind."""
    used = p7_assign(spark, d).groupBy("container_kind", "container").agg(F.sum("size").alias("tokens"))
    caps = load(spark, d, "containers").select("container_kind", "capacity_tokens")
    return used.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(caps, "container_kind").withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def mix_targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    return {r[0]: (r[1], r[2]) for r in few(load(spark, d, "mix_targets").select("source", "target_share", "max_repeats"), MAX_SETTINGS)}


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(token_counts(spark, d), "doc_id", "source", "n_tokens", mix_targets(spark, d)).select(F.col("id").alias("doc_id"), "source", "use_no", "n_tokens", "slot")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.mix(token_counts(spark, d), "doc_id", "source", "n_tokens", mix_targets(spark, d)), mix_targets(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(spread(load(spark, d, "documents").select("doc_id", "text", "source", "page_id")), "doc_id", "text", "source", "page_id").select(F.col("id").alias("doc_id"))


def p9_residual(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: its lines, and how many of them are subtracted as boilerplate of its source."""
    rows = spread(load(spark, d, "documents").select("doc_id", "text", "source", "page_id"))
    return residue.residual(rows, "doc_id", "text", "source", "page_id").withColumnRenamed("id", "doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.exclude(spread(load(spark, d, "documents").select("doc_id", "text", "source", "page_id")), "doc_id", "text", "source", "page_id").select("doc_id", "source")


def queries() -> dict:
    return {"p6_found": p6_found, "p6_repaired": p6_repaired, "p7_assign": p7_assign, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_clean": p9_clean, "p9_residual": p9_residual, "p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt, "p1_canonical": p1_canonical, "p2_statistics": p2_statistics, "p3_repaired": p3_repaired, "p4_languages": p4_languages}


# Fixed values of the check only, apart from the operator's own tables: letters drawn like those below them, then marks.
_DRAWN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲϳЅІЈАВЕКМНОРСТУХаеорсухѕіјѴѵҮһӀӏԁԛԜԝɑɡ\u00b5\u2126" + "\u2010\u2011\uff07\u02b9\u201a\u0387\u22c5\u2219"
_DRAWN_AS = "ABEZHIKMNOPTYXvopcjSIJABEKMHOPCTYXaeopcyxsijVvYhlldqWwag\u03bc\u03a9" + "--''\u201a\u00b7\u00b7\u00b7"


def _p1_sql(result: str) -> str:
    """Look-alike forms by nested SQL functions: unseen characters out, look-alikes translated, ligatures opened, marks composed."""
    like = dict(zip(_DRAWN, _DRAWN_AS, strict=True))
    like |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    like |= {chr(c): " " for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs" and c != 0x1680}
    for c in range(0x370, 0x530):  # composed letters of other scripts, by their parts
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<" and (base := like.get(chr(int(parts[0], 16)))):
            whole = unicodedata.normalize("NFC", base + chr(int(parts[1], 16)))
            if len(whole) == 1:
                like[chr(c)] = whole
    like = {a: b for a, b in like.items() if a != b}
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    unseen = "[\\x{ad}\\x{34f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{fe00}-\\x{fe0f}\\x{feff}]"
    k = f"translate(regexp_replace(text, '{unseen}', '', 'g'), {quoted(''.join(like))}, {quoted(''.join(like.values()))})"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ĳ", "ij"), ("Ĳ", "IJ")):
        k = f"replace({k}, '{a}', '{b}')"
    return f"WITH c AS (SELECT elem_id, text, nfc_normalize({k}) AS k FROM (SELECT DISTINCT elem_id, text FROM elements WHERE text <> '')) {result}"


_P1_PAIRS = """
    SELECT DISTINCT least(a.elem_id, b.elem_id) AS elem_id_a, greatest(a.elem_id, b.elem_id) AS elem_id_b
    FROM c a JOIN c b ON a.k = b.k AND a.text < b.text AND a.elem_id <> b.elem_id"""
_P1_CLASSES = """
    , g AS (SELECT k, min(elem_id) AS class_id, count(DISTINCT text) AS spellings FROM c GROUP BY k HAVING count(DISTINCT text) > 1)
    SELECT DISTINCT elem_id, class_id, spellings FROM c JOIN g USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _p1_sql(_P1_PAIRS),
        "p1_classes": _p1_sql(_P1_CLASSES),
        "p5_found": """
            SELECT DISTINCT 'element' AS item_kind, elem_id AS item_id FROM elements
            WHERE length(text) > (SELECT max_chars FROM split_limits WHERE item_kind = 'element')
            UNION ALL
            SELECT DISTINCT 'page', export_id FROM pdf_layouts
            WHERE list_sum(list_transform(layouts, lambda x: coalesce(length(x.text), 0))) > (SELECT max_chars FROM split_limits WHERE item_kind = 'page')""",
        "p9_residual": rf"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS host, page_id, text FROM documents WHERE text <> ''),
                 l AS (SELECT doc_id, host, page_id, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '\\s+', ' ', 'g'))) AS line
                       FROM (SELECT doc_id, host, page_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
                 n AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l GROUP BY ALL), p AS (SELECT host, count(DISTINCT page_id) AS pages FROM d GROUP BY host),
                 o AS (SELECT host, line, true AS often FROM n JOIN p USING (host) WHERE n >= {residue.LEAST_PAGES} AND n >= pages * {residue.LEAST_SHARE}::DOUBLE)
            SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE often) AS subtracted FROM l LEFT JOIN o USING (host, line) GROUP BY doc_id""",
    "p5_rebuilt": """
            WITH i AS (SELECT DISTINCT 'element' AS item_kind, elem_id AS item_id, coalesce(text, '') AS t FROM elements
                       UNION ALL SELECT DISTINCT 'page', export_id, coalesce(array_to_string(list_transform(layouts, lambda x: coalesce(x.text, '')), ''), '') FROM pdf_layouts)
            SELECT item_kind, item_id, md5(t) AS digest, true AS fits, true AS meets, true AS numbered FROM i JOIN split_limits USING (item_kind) WHERE length(t) > max_chars""",
    }
