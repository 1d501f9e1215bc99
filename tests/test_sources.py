from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text as T
from tessera.sources import connect, export, records, settings
from tessera.streaming import ingest

ARTICLE = """<pmc><article><front><article-title>A <italic>t</italic> .</article-title><abstract><sec><title>Aim</title><p>To see.</p></sec><p>Rest.</p></abstract></front>
<body><sec><title>Materials and methods</title><p>We used <xref>12</xref> mice <inline-formula>x</inline-formula> here.</p><p>short</p><sec><title>Sub</title><p>A nested paragraph of text.<fig id="f1"><label>Fig 1</label><caption><p>A caption that is long.</p></caption></fig></p></sec></sec></body>
<table-wrap id="t1"><label>T</label><table><tr><th>Head</th></tr><tr><td>cell one</td><td>cell two and more text</td></tr></table></table-wrap></article></pmc>"""
RECORDS = """<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">to <i>see</i></AbstractText><AbstractText>more</AbstractText></Abstract>
<Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1998 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Li</LastName><ForeName>X</ForeName></Author><Author><LastName>Bo</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>Mice</DescriptorName><QualifierName>genetics</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10/x</ArticleId><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle/></S>"""


def test_article(spark):
    df = spark.createDataFrame([("PMC1", ARTICLE), ("PMC2", "<broken"), ("PMC3", None)], "pmcid string, xml string")
    rows = records.articles(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["abstract"]) == ("A t.", "Aim: To see. Rest.")
    assert [(s["section_type"], s["parent_heading"], s["text"]) for s in r["sections"]] == [("methods", "", "We used 12 mice [formula] here."), ("other", "Materials and methods", "A nested paragraph of text.")]
    assert r["figure_captions"][0]["caption"] == "A caption that is long." and r["table_texts"][0]["body_text"] == "cell one | cell two and more text | Head"
    assert r["has_methods"] and not r["has_results"] and r["total_chars"] == sum(s["char_count"] for s in r["sections"])


def test_metadata_records(spark):
    rows = records.metadata(spark.createDataFrame([(RECORDS,), ("no xml",)], "xml string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["pmid"], r["pmcid"], r["doi"], r["year"], r["abstract"]) == ("7", "PMC7", "10/x", 1998, "AIM: to see more")
    assert r["authors"] == ["Li, X", "Bo"] and r["mesh_terms"] == ["Mice", "Mice/genetics"] and r["publication_types"] == ["Review"]


def test_passages(spark):
    p = lambda text, **info: {"infons": info, "text": text}
    body = {"documents": [{"passages": [p("A title here", type="front"), p("tiny", section="x"), p("An abstract part", section_type="ABSTRACT"), p("Second part of it", type="abstract"), p("a figure caption " * 100, section_type="FIG", id="f1"), p("a table text", type="table"), p(" Body text here ", section="Statistical methods")]}]}
    r = records.passages(spark.createDataFrame([("P", json.dumps(body)), ("Q", "{}")], "pmcid string, json string")).orderBy("pmcid").collect()
    assert r[0]["title"] == "A title here" and r[0]["abstract"] == "An abstract part Second part of it"
    assert len(r[0]["figure_captions"][0]["caption"]) == 1000 and r[0]["table_count"] == 1
    assert [(s["section_type"], s["text"], s["char_count"]) for s in r[0]["sections"]] == [("methods", "Body text here", 16)]
    assert r[1]["section_count"] == 0 and r[1]["title"] == ""


def test_works_and_trials(spark, tmp_path):
    w = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10/x", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/12"}, "abstract_inverted_index": {"a": [0, 2], "b": [1]}, "concepts": [{"display_name": "c", "score": 0.3, "level": 1}, {"display_name": "d", "score": 0.4, "level": 2}], "referenced_works": ["https://openalex.org/W5"], "locations": [{"landing_page_url": "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC9/", "source": {"type": "repository"}}]}
    (tmp_path / "w.json").write_text(json.dumps(w) + "\n" + json.dumps({"id": None, "doi": None}))
    rows = records.works(connect.read_json_lines(spark, str(tmp_path / "w.json"), schema.RAW_WORK)).collect()
    r = next(x for x in rows if x["openalex_id"])
    assert (r["pmid"], r["pmcid"], r["doi"], r["abstract"]) == ("12", "PMC9", "10/x", "a b a") and [c["name"] for c in r["concepts"]] == ["d"] and r["referenced_work_ids"] == ["W5"]
    e = next(x for x in rows if not x["openalex_id"])
    assert e["doi"] == e["abstract"] == e["pmid"] == "" and e["authors"] == [] and e["cited_by_count"] == 0 and not e["is_oa"]
    t = {"protocolSection": {"identificationModule": {"nctId": "NCT1"}, "descriptionModule": {"detailedDescription": "x" * 3000}, "referencesModule": {"references": [{"citation": "c"}]}}}
    (tmp_path / "t.json").write_text(json.dumps(t))
    s = records.trials(spark.read.schema(schema.STUDY).json(str(tmp_path / "t.json"))).first()
    assert s["nct_id"] == "NCT1" and len(s["detailed_description"]) == 2000 and s["references"][0]["pmid"] == "" and s["phase"] == [] and not s["has_results"]
    assert "references" not in records.trials(spark.read.schema(schema.STUDY).json(str(tmp_path / "t.json")), full=False).columns


def test_connectors(spark, tmp_path):
    keys = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "pmid string")
    got = {r["pmid"]: r["payload"] for r in connect.fetch(keys, "pmid", lambda ks: {k: "p" + k for k in ks if k != "2"}, per_second=1000).collect()}
    assert got == {"1": "p1", "2": None}
    assert connect.fetch_new(keys, keys.where("pmid = '1'"), "pmid", lambda ks: {}, per_second=1000).count() == 1
    page = lambda q, c: ([f"{q}{c or 0}"] * 2, (c or 0) + 1 if (c or 0) < 2 else None)
    assert list(connect.pages("q", page, 5)) == ["q0", "q0", "q1", "q1", "q2"] and list(connect.pages("q", lambda q, c: ([], None), 5)) == []
    q = spark.createDataFrame([(0, "a"), (1, "b")], "query_ord int, query string")
    assert connect.search(q, page, 5, per_second=1000).count() == 10
    links = spark.createDataFrame([("1", "A", 0, 0), ("1", "B", 0, 1), ("1", "C", 1, 0)], "pmid string, pmcid string, set_no int, ord int")
    assert connect.id_map(links, "pmid", "pmcid", "ord").first()["pmcid"] == "C"
    slept = []
    clock = iter([0.0, 0.0, 0.1, 0.5]).__next__
    pace = connect.Pace(2, clock, slept.append)
    pace.wait(), pace.wait()
    assert slept == [pytest.approx(0.4)]
    connect.write_json_lines(keys, str(tmp_path / "k"))
    assert connect.read_json_lines(spark, str(tmp_path / "k"), "pmid string", {"pmid": ""}).where("pmid = ''").count() == 1
    (tmp_path / "x").mkdir()
    (tmp_path / "x/PMC5.xml").write_text("<a/>")
    assert [tuple(r) for r in connect.read_files(spark, str(tmp_path / "x")).collect()] == [("PMC5", "<a/>")]


def test_settings_and_checksums(tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('{"k": 1}')
    assert settings.load("a", tmp_path) == {"k": 1} and settings.folder(tmp_path, "n", "m").is_dir()
    with pytest.raises(FileNotFoundError):
        settings.load("b", tmp_path)
    with pytest.raises(RuntimeError):
        settings.required("NO_SUCH_VARIABLE_HERE")
    assert len(export.checksums([tmp_path / "a.json"])["a.json"]) == 64


def test_stream_takes_a_key_once(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type")
    e.union(e).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = ingest.first_seen(stream, "event_id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == e.count()
    r = ingest.rolling_counts(stream, "ts", "event_type").writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    r.awaitTermination()
    assert spark.table("counts").groupBy().sum("n").first()[0] == 2 * e.count()


def test_traces_are_lines_in_few_files_or_apart(spark, tmp_path):
    trace = spark.range(60).selectExpr("id % 20 as query_id", "cast(3 - id div 20 as int) as round", "cast(id as string) as action")
    schema = "query_id long, rounds array<struct<round: int, action: string>>"
    got = {}
    for name in ("lines", "apart"):
        path = tmp_path / name
        connect.write_traces(trace, str(path), apart=name == "apart")
        got[name] = {r["query_id"]: [(x["round"], x["action"]) for x in r["rounds"]] for r in spark.read.schema(schema).json(str(path)).collect()}
        files = len(list(path.rglob("*.json")))
        assert files == 20 if name == "apart" else files <= 4
    assert got["lines"] == got["apart"] and got["lines"][7] == [(1, "47"), (2, "27"), (3, "7")]


def test_texts_are_parsed_in_slices(spark, monkeypatch):
    """Python objects of a slice only: what leaves a batch of 40 rows comes in several."""
    monkeypatch.setattr(records, "SLICE_BYTES", 100)
    rows = spark.createDataFrame([(i, None if i == 5 else "x" * (i % 4) * 30) for i in range(40)], "id long, text string").coalesce(1)
    got = records._parsed(rows, lambda i, t: [{"id": i, "n": len(t or ""), "words": [t, None]}] * (i % 3), "id long, n int, words array<string>")
    assert sorted((r["id"], r["n"], r["words"][0] or "") for r in got.collect()) == sorted((r["id"], len(r["text"] or ""), r["text"] or "") for r in rows.collect() for _ in range(r["id"] % 3))
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    parts = list(records._slices(batch, 100))
    assert len(parts) > 10 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_inverted_indexes_are_made_within_rows(spark):
    """Repeated ids and null texts keep their rows."""
    rows = spark.createDataFrame([(1, "a b a "), (1, "other"), (2, ""), (3, None)] + [(9, "w " * 700)], "id long, text string")
    got = records.inverted_indexes(rows, "id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    back = sorted(got.select("id", F.when(F.col("index").isNotNull(), T.text_of_inverted_index("index")).alias("t")).collect(), key=str)
    assert back == sorted(rows.collect(), key=str)
    assert got.where("id = 1").orderBy(F.size("index").desc()).first()["index"] == {"a": [0, 2], "b": [1], "": [3]}
