"""Queries that check every field of the parsed record formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schema
from tessera.plans.registry import query, table
from tessera.sources import records

_S = F.lit


def _text(column: str):
    return F.col(column).cast("string")


@query("""SELECT p_partkey AS k, p_partkey::VARCHAR AS pmid, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'PMC' || p_partkey END AS pmcid, '10.1/' || p_partkey AS doi, p_name AS title, 1990 + p_partkey % 30 AS year, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS venue,
p_brand || '|' || p_brand AS authors, p_type || '/' || p_name || '/' || p_brand AS topic, p_size::BIGINT AS cited, p_partkey % 2 = 0 AS is_oa, CASE WHEN p_partkey % 2 = 0 THEN 'https://oa.org/' || p_partkey ELSE '' END AS oa_url, 2::BIGINT AS n_concepts, p_name AS second_concept, 'openalex' AS origin FROM part""")
def work_fields(spark, d):
    """Ids, names, topics, locations and open-access fields of works; some are absent."""
    k = _text("p_partkey")
    place = lambda url, kind: F.struct(url.alias("landing_page_url"), F.struct(_S(kind).alias("type")).alias("source"))
    author = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    concept = lambda c, s: F.struct(c.alias("display_name"), _S(s).alias("score"), _S(1).alias("level"))
    archive = F.when(F.col("p_partkey") % 3 == 0, _S("https://x.org/pmc")).otherwise(F.concat(_S("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), k, _S("/")))
    raw = F.struct(
        F.concat(_S("https://openalex.org/W"), k).alias("id"), F.concat(_S("https://doi.org/10.1/"), k).alias("doi"), F.col("p_name").alias("title"), (1990 + F.col("p_partkey") % 30).cast("int").alias("publication_year"), F.col("p_size").cast("int").alias("cited_by_count"),
        F.struct(F.concat(_S("https://pubmed.ncbi.nlm.nih.gov/"), k).alias("pmid")).alias("ids"), F.when(F.col("p_size") > 10, F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("source"))).alias("primary_location"),
        F.array(place(archive, "repository"), place(_S("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC9"), "journal")).alias("locations"), F.array(author(F.col("p_brand")), author(_S("")), author(F.col("p_brand"))).alias("authorships"),
        F.array(concept(F.col("p_type"), 0.9), concept(F.col("p_brand"), 0.3), concept(F.col("p_name"), 0.31)).alias("concepts"),
        F.array(F.struct(F.col("p_type").alias("display_name"), F.struct(F.col("p_name").alias("display_name")).alias("subfield"), F.struct(F.col("p_brand").alias("display_name")).alias("field"))).alias("topics"),
        F.when(F.col("p_partkey") % 2 == 0, F.struct(_S(True).alias("is_oa"), F.concat(_S("https://oa.org/"), k).alias("oa_url"))).alias("open_access"),
    )
    w = records.works(table(spark, d, "part").select(F.from_json(F.to_json(raw), schema.RAW_WORK).alias("w")).select("w.*"))
    topic = F.col("topics")[0]
    return w.select(F.element_at(F.split("doi", "/"), -1).cast("long").alias("k"), "pmid", "pmcid", "doi", "title", "year", "venue", F.array_join("authors", "|").alias("authors"), F.concat_ws("/", topic["name"], topic["subfield"], topic["field"]).alias("topic"), F.col("cited_by_count").alias("cited"), "is_oa", "oa_url", F.size("concepts").alias("n_concepts"), F.col("concepts")[1]["name"].alias("second_concept"), F.col("source").alias("origin"))


@query("""SELECT o_orderkey AS k, 'Brief ' || o_orderpriority AS title, 'Official ' || o_orderpriority AS official_title, 'PHASE' || (o_orderkey % 4) || ',NA' AS phase, o_orderpriority AS brief_summary, strftime(o_orderdate, '%Y-%m') AS completion_date, 'INTERVENTIONAL' AS study_type, md5(substr(repeat(o_orderpriority || ' ', 200), 1, 2000)) AS detail_md5,
'DRUG:' || o_orderstatus || ':' || substr(repeat('x', 499) || o_orderpriority, 1, 500) AS intervention, 'Rate of ' || o_orderstatus || '@1 year@' || substr(repeat('y', 299) || 'end', 1, 300) AS primary_outcome, 'Time@' AS secondary_outcome, substr(repeat('c', 990) || o_orderpriority || 'cccccccccc', 1, 1000) || '|ALL|18 Years||No' AS eligibility,
o_custkey || '|DERIVED|' || substr(repeat('z', 299) || 'end', 1, 300) AS reference, o_orderkey % 2 = 0 AS has_results, 'clinicaltrials' AS origin FROM orders""")
def trial_fields(spark, d):
    """All fields of trials, with texts past their caps and absent parts."""
    o = table(spark, d, "orders")
    k = _text("o_orderkey")
    study = F.struct(
        F.struct(
            F.struct(k.alias("nctId"), F.concat(_S("Brief "), "o_orderpriority").alias("briefTitle"), F.concat(_S("Official "), "o_orderpriority").alias("officialTitle")).alias("identificationModule"),
            F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("date")).alias("completionDateStruct")).alias("statusModule"),
            F.struct(F.col("o_orderpriority").alias("briefSummary"), F.repeat(F.concat("o_orderpriority", _S(" ")), F.lit(200)).alias("detailedDescription")).alias("descriptionModule"),
            F.struct(F.array(F.concat(_S("PHASE"), (F.col("o_orderkey") % 4).cast("string")), _S("NA")).alias("phases"), _S("INTERVENTIONAL").alias("studyType")).alias("designModule"),
            F.struct(F.array(F.struct(_S("DRUG").alias("type"), F.col("o_orderstatus").alias("name"), F.concat(_S("x" * 499), "o_orderpriority").alias("description"))).alias("interventions")).alias("armsInterventionsModule"),
            F.struct(F.array(F.struct(F.concat(_S("Rate of "), "o_orderstatus").alias("measure"), _S("1 year").alias("timeFrame"), _S("y" * 299 + "end").alias("description"))).alias("primaryOutcomes"), F.array(F.struct(_S("Time").alias("measure"))).alias("secondaryOutcomes")).alias("outcomesModule"),
            F.struct(F.concat(_S("c" * 990), "o_orderpriority", _S("c" * 10)).alias("eligibilityCriteria"), _S("ALL").alias("sex"), _S("18 Years").alias("minimumAge"), _S("No").alias("healthyVolunteers")).alias("eligibilityModule"),
            F.struct(F.array(F.struct(_text("o_custkey").alias("pmid"), _S("DERIVED").alias("type"), _S("z" * 299 + "end").alias("citation"))).alias("references")).alias("referencesModule"),
        ).alias("protocolSection"),
        F.when(F.col("o_orderkey") % 2 == 0, F.create_map(_S("a"), _S("b"))).alias("resultsSection"),
    )
    t = records.trials(o.select(F.from_json(F.to_json(study), schema.STUDY).alias("s")).select("s.*"))
    one, first, second, ref = (F.element_at(c, 1) for c in ("interventions", "primary_outcomes", "secondary_outcomes", "references"))
    e = F.col("eligibility")
    return t.select(
        F.col("nct_id").cast("long").alias("k"), "title", "official_title", F.array_join("phase", ",").alias("phase"), "brief_summary", "completion_date", "study_type", F.md5("detailed_description").alias("detail_md5"), F.concat_ws(":", one["type"], one["name"], one["description"]).alias("intervention"),
        F.concat_ws("@", first["measure"], first["timeframe"], first["description"]).alias("primary_outcome"), F.concat_ws("@", second["measure"], second["timeframe"]).alias("secondary_outcome"), F.concat_ws("|", e["criteria"], e["sex"], e["min_age"], e["max_age"], e["healthy_volunteers"]).alias("eligibility"),
        F.concat_ws("|", ref["pmid"], ref["type"], ref["citation"]).alias("reference"), "has_results", F.col("source").alias("origin"),
    )


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"""SELECT doc_id, 'A title of ' || source AS title, CASE WHEN length(t) >= 10 THEN 'First abstract part. ' || t ELSE 'First abstract part.' END AS abstract, 1::BIGINT AS section_count, 'results' AS kind, 'F' || doc_id || ':Fig. 1:' || substr(repeat('w', 995) || source || 'wwwwwwwww', 1, 1000) AS figure, 'T1:Table 1:' || 'Cells of ' || lang || ' here' AS a_table, true AS has_results, 22 + length(lang) AS total_chars
FROM (SELECT doc_id, source, lang, {_STRIPPED} AS t FROM documents)""")
def passage_fields(spark, d):
    """Every route of passages; those below ten characters are dropped."""

    def part(kind, place, text, **more):
        infons = {"type": _S(kind), "section_type": _S(place), **more}
        return F.struct(F.create_map(*[x for k, v in infons.items() for x in (_S(k), v)]).alias("infons"), text.alias("text"))

    parts = F.array(
        part("front", "", F.concat(_S(" A title of "), "source", _S("\n"))), part("title", "TITLE", _S("Another title, not taken")), part("abstract", "ABSTRACT", _S("First abstract part.")), part("", "abstract", F.col("text")), part("paragraph", "BODY", _S("Too short")),
        part("paragraph", "RESULTS", F.concat(_S("  A finding in "), "lang", _S(" text. ")), section=_S("Main findings")), part("fig_caption", "FIG", F.concat(_S("w" * 995), "source", _S("w" * 9)), id=F.concat(_S("F"), _text("doc_id")), label=_S("Fig. 1")), part("table_caption", "", F.concat(_S("Cells of "), "lang", _S(" here ")), id=_S("T1"), label=_S("Table 1")),
    )
    body = F.to_json(F.struct(F.array(F.struct(parts.alias("passages"))).alias("documents")))
    p = records.passages(table(spark, d, "documents").select("doc_id", body.alias("json")), "doc_id")
    figure, cells = F.element_at("figure_captions", 1), F.element_at("table_texts", 1)
    return p.select(F.col("pmcid").alias("doc_id"), "title", "abstract", "section_count", F.element_at("sections", 1)["section_type"].alias("kind"), F.concat_ws(":", figure["figure_id"], figure["label"], figure["caption"]).alias("figure"), F.concat_ws(":", cells["table_id"], cells["label"], cells["caption"]).alias("a_table"), "has_results", "total_chars")
