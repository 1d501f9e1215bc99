from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import corpus

DOC = f"doc_id string, pmid string, year int, abstract string, sections array<{schema.SECTION}>, figure_captions array<{schema.FIGURE}>, table_texts array<{schema.TABLE}>"


def section(text, kind="methods", heading="H"):
    return (heading, kind, "", text, len(text or ""))


def cut(text, most):
    """Greedy packing in plain steps."""
    out, now = [], ""
    for s in text.split(". "):
        if len(now) + len(s) + 2 > most and now:
            out.append(now)
            now = s + ". "
        else:
            now += s + ". "
    return out + [now] if now.strip() else out


def test_packing_of_sentences(spark):
    texts = ["A. B.", "x" * 30, "aa. bb. cc. dd. ee", "", "a. " + "y" * 40 + ". b", ". . .", "one. two. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.packed(F.col("t"), 10).alias("p"))
    for r in df.collect():
        assert list(r["p"]) == cut(r["t"], 10), r["t"]
    assert cut("A. B.", 10) == ["A. B.. "]


def test_chunks(spark):
    rows = [("P1", "1", 2001, "abs" * 900, [section("s" * 49), section("s" * 50), section("word. " * 1000, "results_discussion")], [("f", "", "c" * 30), ("f", None, "c" * 31)], [("t", "T1", "cap", "b" * 40), ("t", "", "", "x")]), ("P2", "2", None, "", None, None, None)]
    got = corpus.chunks(spark.createDataFrame(rows, DOC)).orderBy("doc_id", "position").collect()
    assert [r["chunk_id"] for r in got] == ["P1_abstract_0", "P1_methods_1", "P1_results_discussion_2", "P1_results_discussion_3", "P1_caption_4", "P1_table_5"]
    assert len(got[0]["text"]) == 2048 and got[0]["token_estimate"] == 512
    assert [r["section_heading"] for r in got[4:]] == ["Figure", "T1"] and got[5]["text"] == "cap " + "b" * 40
    assert all(len(r["text"]) <= 4096 for r in got) and got[0]["year"] == 2001


def test_record_rules_count_the_first_failure(spark):
    df = spark.createDataFrame([(["Review"], ""), (["Article"], ""), (["Article", "review"], "x"), (None, "x"), ([], None)], "publication_types array<string>, abstract string")
    v = [r[0] for r in df.select(corpus.verdict(F.col("publication_types"), F.col("abstract"), ["Review"])).collect()]
    assert v == ["excluded_type", "no_abstract", "kept", "kept", "no_abstract"]
    assert corpus.filter_records(df, ["Review"], need_abstract=False).count() == 4


def test_deduplication(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "pmid string, n int, v string")
    assert {tuple(r) for r in corpus.last_wins(df, ["pmid"], "n").collect()} == {("a", 2, "y"), ("b", 1, "z")}
    assert {tuple(r) for r in corpus.first_owner(df, "pmid", ["n"]).collect()} == {("a", 1, "x"), ("b", 1, "z")}
    once = corpus.last_wins(df, ["pmid"], "n")
    assert corpus.last_wins(once, ["pmid"], "n").exceptAll(once).count() == 0
    assert corpus.new_only(df, df.where("pmid = 'a'"), "pmid").count() == 1


def test_merges(spark):
    left = spark.createDataFrame([("1", "", "own", "PMC1"), ("2", "t", "", ""), ("3", "t", "x", "PMC9")], "pmid string, title string, abstract string, pmcid string")
    right = spark.createDataFrame([("1", "9", "new", "W1"), ("2", "8", "new", "W2")], "pmid string, pmcid string, abstract string, openalex_id string")
    got = {r["pmid"]: r for r in corpus.enrich(left, right, "pmid", ["openalex_id"], ["pmcid", "abstract"]).collect()}
    assert (got["1"]["pmcid"], got["1"]["abstract"], got["1"]["openalex_id"]) == ("PMC1", "own", "W1")
    assert (got["2"]["pmcid"], got["2"]["abstract"]) == ("8", "new") and got["3"]["openalex_id"] is None
    none = [F.array().cast(f"array<{k}>").alias(c) for c, k in (("sections", schema.SECTION), ("figure_captions", schema.FIGURE), ("table_texts", schema.TABLE))]
    parsed = spark.createDataFrame([("PMC1", "T", "A")], "pmcid string, title string, abstract string").select("*", *none)
    full = {r["pmid"]: r for r in corpus.merge_full_text(left, parsed).collect()}
    assert (full["1"]["title"], full["1"]["abstract"], full["1"]["has_fulltext"], full["1"]["doc_id"]) == ("T", "own", True, "PMC1")
    assert (full["2"]["doc_id"], full["2"]["has_fulltext"]) == ("2", False)


def test_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", 7)], "g string, v int")
    got = {r["g"]: r for r in corpus.length_statistics(df, "v", ["g"]).collect()}
    assert got["a"]["upper_median"] == 3 and got["a"]["mean_floor"] == 2 and got["b"]["upper_median"] == 7
    h = corpus.histogram(df, "g", 1).collect()
    assert [tuple(r) for r in h] == [("a", 4, 80.0)]
    e = spark.createDataFrame([(["x", "y"],), (["x"],), (None,)], "items array<string>")
    assert [tuple(r) for r in corpus.exploded_histogram(e, "items", 5).collect()] == [("x", 2, 66.7), ("y", 1, 33.3)]
