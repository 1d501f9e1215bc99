"""Nested records to the package's schemas: works, trials, passages, XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera import schema
from tessera.functions import text as T
from tessera.operators.graph import work_id


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def works(raw: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Raw works (schema RAW_WORK) as WORK rows; built-in functions only."""
    archive = F.filter("locations", lambda x: (x["source"]["type"] == "repository") & F.contains(x["landing_page_url"], F.lit("ncbi.nlm.nih.gov/pmc")))
    pmcid = F.transform(archive, lambda x: F.regexp_extract(x["landing_page_url"], r"/(PMC[^/]*)", 1))
    found = F.filter(pmcid, lambda p: p != "")
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n != "")
    concepts = F.transform(F.filter("concepts", lambda c: c["score"] > least_score), lambda c: F.struct(_or_empty(c["display_name"]).alias("name"), c["score"].alias("score"), F.coalesce(c["level"], F.lit(0)).alias("level")))
    topics = F.transform("topics", lambda t: F.struct(_or_empty(t["display_name"]).alias("name"), _or_empty(t["subfield"]["display_name"]).alias("subfield"), _or_empty(t["field"]["display_name"]).alias("field")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return raw.select(
        _or_empty("id").alias("openalex_id"), F.coalesce(work_id("ids.pmid"), F.lit("")).alias("pmid"),
        _or_empty(F.try_element_at(found, F.lit(-1))).alias("pmcid"), F.replace(_or_empty("doi"), F.lit("https://doi.org/"), F.lit("")).alias("doi"),
        _or_empty("title").alias("title"), T.text_of_inverted_index("abstract_inverted_index").alias("abstract"), F.col("publication_year").alias("year"),
        _or_empty("primary_location.source.display_name").alias("venue"), none(names, "array<string>").alias("authors"),
        none(concepts, "array<struct<name: string, score: double, level: int>>").alias("concepts"), none(topics, "array<struct<name: string, subfield: string, field: string>>").alias("topics"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        none(F.transform("referenced_works", lambda w: F.replace(w, F.lit("https://openalex.org/"), F.lit(""))), "array<string>").alias("referenced_work_ids"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"), _or_empty("open_access.oa_url").alias("oa_url"), F.lit("openalex").alias("source"),
    )


def trials(studies: DataFrame, full: bool = True) -> DataFrame:
    """Studies (schema STUDY) as flat trials; texts are capped."""
    p = "protocolSection."
    cap = lambda c, n: F.substring(_or_empty(c), 1, n)
    out = [
        _or_empty(f"{p}identificationModule.nctId").alias("nct_id"), _or_empty(f"{p}identificationModule.briefTitle").alias("title"),
        _or_empty(f"{p}identificationModule.officialTitle").alias("official_title"), _or_empty(f"{p}statusModule.overallStatus").alias("status"),
        F.coalesce(f"{p}designModule.phases", F.array().cast("array<string>")).alias("phase"), _or_empty(f"{p}descriptionModule.briefSummary").alias("brief_summary"),
        _or_empty(f"{p}statusModule.startDateStruct.date").alias("start_date"), _or_empty(f"{p}statusModule.completionDateStruct.date").alias("completion_date"),
    ]
    if not full:
        return studies.select(*out)
    described = lambda n: lambda x: F.struct(_or_empty(x["measure"]).alias("measure"), _or_empty(x["timeFrame"]).alias("timeframe"), cap(x["description"], n).alias("description"))
    e = f"{p}eligibilityModule."
    return studies.select(
        *out, _or_empty(f"{p}designModule.studyType").alias("study_type"), cap(F.col(f"{p}descriptionModule.detailedDescription"), 2000).alias("detailed_description"),
        F.coalesce(F.transform(f"{p}armsInterventionsModule.interventions", lambda x: F.struct(_or_empty(x["type"]).alias("type"), _or_empty(x["name"]).alias("name"), cap(x["description"], 500).alias("description"))), F.array()).alias("interventions"),
        F.coalesce(F.transform(f"{p}outcomesModule.primaryOutcomes", described(300)), F.array()).alias("primary_outcomes"),
        F.coalesce(F.transform(f"{p}outcomesModule.secondaryOutcomes", lambda x: F.struct(_or_empty(x["measure"]).alias("measure"), _or_empty(x["timeFrame"]).alias("timeframe"))), F.array()).alias("secondary_outcomes"),
        F.struct(cap(F.col(f"{e}eligibilityCriteria"), 1000).alias("criteria"), _or_empty(f"{e}sex").alias("sex"), _or_empty(f"{e}minimumAge").alias("min_age"), _or_empty(f"{e}maximumAge").alias("max_age"), _or_empty(f"{e}healthyVolunteers").alias("healthy_volunteers")).alias("eligibility"),
        F.coalesce(F.transform(f"{p}referencesModule.references", lambda r: F.struct(_or_empty(r["pmid"]).alias("pmid"), _or_empty(r["type"]).alias("type"), cap(r["citation"], 300).alias("citation"))), F.array()).alias("references"),
        (F.coalesce(F.size("resultsSection"), F.lit(0)) > 0).alias("has_results"), F.lit("clinicaltrials").alias("source"),
    )


def passages(raw: DataFrame, key: str = "pmcid", body: str = "json") -> DataFrame:
    """Passage JSON (schema BIOC) as PARSED rows; built-in functions only.

    Passages below 10 characters are dropped; captions are capped at 1000.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    info = lambda x, k: _or_empty(F.try_element_at(x["infons"], F.lit(k)))

    def routed(x: Column) -> Column:
        place, kind = F.lower(info(x, "section_type")), F.lower(info(x, "type"))
        to = F.when((kind == "front") | (place == "title"), "title").when((kind == "abstract") | (place == "abstract"), "abstract")
        to = to.when(F.contains(place, F.lit("fig")) | F.contains(kind, F.lit("figure")), "figure").when(F.contains(place, F.lit("table")) | F.contains(kind, F.lit("table")), "table").otherwise("section")
        return F.struct(to.alias("to"), info(x, "id").alias("id"), info(x, "label").alias("label"), info(x, "section").alias("heading"), x["text"].alias("text"), strip(x["text"]).alias("t"))

    first = F.try_element_at(F.from_json(body, schema.BIOC)["documents"], F.lit(1))["passages"]
    long = F.filter(first, lambda x: F.length(strip(_or_empty(x["text"]))) >= 10)
    p = raw.select(F.col(key).alias("pmcid"), F.coalesce(F.transform(long, routed), F.array()).alias("ps"))
    of = lambda to: F.filter("ps", lambda x: x["to"] == to)
    sections = F.transform(of("section"), lambda x: F.struct(x["heading"].alias("heading"), T.section_type_by_part(x["heading"]).alias("section_type"), F.lit("").alias("parent_heading"), x["t"].alias("text"), F.length(x["text"]).alias("char_count")))
    figures = F.transform(of("figure"), lambda x: F.struct(x["id"].alias("figure_id"), x["label"].alias("label"), F.substring(x["t"], 1, 1000).alias("caption")))
    tables = F.transform(of("table"), lambda x: F.struct(x["id"].alias("table_id"), x["label"].alias("label"), F.substring(x["t"], 1, 1000).alias("caption"), F.lit("").alias("body_text")))
    out = p.select("pmcid", _or_empty(F.try_element_at(of("title"), F.lit(1))["t"]).alias("title"), F.array_join(F.transform(of("abstract"), lambda x: x["t"]), " ").alias("abstract"), sections.alias("sections"), figures.alias("figure_captions"), tables.alias("table_texts"))
    return counted(out)


def counted(parsed: DataFrame) -> DataFrame:
    """Adds the counts and flags of PARSED."""
    return parsed.select("*", F.size("sections").alias("section_count"), F.size("figure_captions").alias("figure_count"), F.size("table_texts").alias("table_count"),
                         F.exists("sections", lambda s: s["section_type"] == "methods").alias("has_methods"), F.exists("sections", lambda s: s["section_type"] == "results").alias("has_results"),
                         F.aggregate("sections", F.lit(0), lambda a, s: a + s["char_count"]).alias("total_chars"))


_BLANKS, _BEFORE = re.compile(r"\s+"), re.compile(r" +([.,;:!?])")
_SHALLOW, _SKIPPED, _FORMULA = {"xref", "ext-link", "uri", "sup", "sub"}, {"fig", "table-wrap"}, {"disp-formula", "inline-formula"}
_HEADINGS = [(k, re.compile(rf"(?:{v})\Z", re.I)) for k, v in T.HEADINGS]


def _inner(node: ET.Element | None) -> str:
    """Text of a node, its links by their own text only, formulas by a mark."""
    if node is None:
        return ""
    got = [node.text or ""]
    for x in node:
        got.append("[formula]" if x.tag in _FORMULA else "" if x.tag in _SKIPPED else (x.text or "") if x.tag in _SHALLOW else _inner(x))
        got.append(x.tail or "")
    return "".join(got).strip()


def _tidy(text: str) -> str:
    return _BEFORE.sub(r"\1", _BLANKS.sub(" ", text).strip())


def _type_of(heading: str) -> str:
    return next((k for k, p in _HEADINGS if p.match(heading.strip())), "other")


def _summary_text(node: ET.Element | None) -> str:
    if node is None:
        return ""
    parts = []
    for x in node:
        if x.tag == "sec":
            para, head = x.find("p"), x.findtext("title", "")
            said = _inner(x if para is None else para)
            parts.append(f"{head}: {said}" if head else said)
        elif x.tag == "p" or (x.tag != "title" and _inner(x)):
            parts.append(_inner(x))
    return " ".join(parts) or _inner(node)


def _section(*parts: str) -> dict:
    """Heading, type, heading above, text."""
    return dict(zip(("heading", "section_type", "parent_heading", "text", "char_count"), (*parts, len(parts[-1]))))


def _body_sections(body: ET.Element | None) -> list[dict]:
    if body is None:
        return []
    above = {child: parent for parent in body.iter() for child in parent}  # one pass
    out = []
    for sec in body.iter("sec"):
        heading = _inner(sec.find("title"))
        text = " ".join(p for p in (_tidy(_inner(x)) for x in sec.findall("p")) if len(p) > 20)
        if text:
            parent = above.get(sec)
            over = _inner(parent.find("title")) if parent is not None and parent.tag == "sec" else ""
            out.append(_section(heading, _type_of(heading), over, text))
    whole = _tidy(_inner(body)) if not out else ""
    if len(whole) > 50:
        out.append(_section("", "body", "", whole))
    return out


def parse_article(xml: str | None) -> dict | None:
    """One full-text article, or None where it isn't XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    top = root.find(".//article")
    top = root if top is None else top
    front = top.find(".//front")
    figures, tables = [], []
    for x in top.iter("fig"):
        caption = _tidy(_inner(x.find("caption")))
        if len(caption) > 10:
            figures.append({"figure_id": x.get("id", ""), "label": x.findtext("label", ""), "caption": caption})
    for x in top.iter("table-wrap"):
        caption, grid = _tidy(_inner(x.find("caption"))), x.find(".//table")
        cells = [] if grid is None else [c for tag in ("td", "th") for c in map(_inner, grid.iter(tag)) if c]
        body = " | ".join(cells)
        if len(caption) > 10 or len(body) > 20:
            tables.append({"table_id": x.get("id", ""), "label": x.findtext("label", ""), "caption": caption, "body_text": body[:2000]})
    title = "" if front is None else _inner(front.find(".//article-title"))
    abstract = "" if front is None else _summary_text(front.find(".//abstract"))
    return {"title": _tidy(title), "abstract": _tidy(abstract), "sections": _body_sections(top.find(".//body")), "figure_captions": figures, "table_texts": tables}


def articles(files: DataFrame, key: str = "pmcid", xml: str = "xml") -> DataFrame:
    """Full-text XML as PARSED rows; mixed content needs a walk, in batches.
    Rows that aren't XML are dropped."""
    nested = f"array<{schema.SECTION}>", f"array<{schema.FIGURE}>", f"array<{schema.TABLE}>"
    kind = files.schema[key].dataType.simpleString()
    fields = f"pmcid {kind}, title string, abstract string, sections {nested[0]}, figure_captions {nested[1]}, table_texts {nested[2]}"
    parse = lambda k, x: [{"pmcid": k, **r} for r in [parse_article(x)] if r]
    return counted(_parsed(files.select(key, F.col(xml).alias("__xml")), parse, fields))


SLICE_BYTES = 1 << 20


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose last column has at most ``most`` bytes, or one longer row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy()), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _parsed(rows: DataFrame, parse: Callable[..., list[dict]], fields: str) -> DataFrame:
    """Rows that ``parse`` makes of each row, whose last column is a text, in slices of
    ``SLICE_BYTES`` bytes: only a slice is Python objects at a time."""
    types, most = to_arrow_schema(StructType.fromDDL(fields)), SLICE_BYTES

    def fn(batches):
        for b in batches:
            for part in _slices(b, most):
                yield pa.RecordBatch.from_pylist([r for row in zip(*(c.to_pylist() for c in part.columns)) for r in parse(*row)], schema=types)

    return rows.mapInArrow(fn, fields)


def _id_of(nodes, attribute: str, kind: str) -> str:
    return next((x.text or "" for x in nodes if x.get(attribute) == kind), "")


def _record(node: ET.Element) -> dict | None:
    cite = node.find(".//MedlineCitation")
    art = None if cite is None else cite.find("Article")
    if art is None or not cite.findtext("PMID", ""):
        return None
    said = []
    for x in art.findall("Abstract/AbstractText"):
        body, label = "".join(x.itertext()).strip(), x.get("Label", "")
        said.append(f"{label}: {body}" if label else body)
    when = art.find(".//PubDate")
    stamp = "" if when is None else when.findtext("Year") or when.findtext("MedlineDate", "")[:4]
    ids = node.findall(".//PubmedData//ArticleId")
    terms = []
    for m in cite.findall("MeshHeadingList/MeshHeading"):
        name = m.findtext("DescriptorName", "")
        terms += [name] if name else []
        terms += [f"{name}/{q.text}" for q in m.findall("QualifierName") if q.text]
    people = [", ".join(filter(None, (a.findtext("LastName", ""), a.findtext("ForeName", "")))) for a in art.findall("AuthorList/Author") if a.findtext("LastName", "")]
    texts = lambda path, start=art: [x.text for x in start.findall(path) if x.text]
    return {
        "pmid": cite.findtext("PMID"), "pmcid": _id_of(ids, "IdType", "pmc"), "doi": _id_of(art.findall(".//ELocationID"), "EIdType", "doi") or _id_of(ids, "IdType", "doi"),
        "title": art.findtext("ArticleTitle", ""), "abstract": " ".join(said), "year": int(stamp) if re.fullmatch(r"\s*\d+\s*", stamp) else None,
        "venue": art.findtext(".//Journal/Title", ""), "venue_abbrev": art.findtext(".//Journal/ISOAbbreviation", ""), "authors": people, "mesh_terms": terms,
        "publication_types": texts(".//PublicationTypeList/PublicationType"), "keywords": texts("KeywordList/Keyword", cite), "source": "pubmed",
    }


def parse_records(xml: str | None) -> list[dict]:
    """Metadata records of one response; malformed ones are skipped."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    return [r for r in map(_record, root.iter("PubmedArticle")) if r]


def metadata(responses: DataFrame, xml: str = "xml") -> DataFrame:
    """Metadata XML responses as METADATA rows."""
    return _parsed(responses.select(F.col(xml).alias("__xml")), parse_records, schema.METADATA)


def inverted_indexes(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, index): each text as a map of its words to their positions, made within
    the row; null for a null text.  T.text_of_inverted_index turns it back."""
    kind = texts.schema[key].dataType.simpleString()

    def fn(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ends, words, places, at_words = [], [], [0], []
                for t in part.column(1).to_pylist():
                    ends.append(None if t is None else len(words))
                    own: dict[str, list[int]] = {}
                    for i, w in enumerate(() if t is None else t.split(" ")):
                        own.setdefault(w, []).append(i)
                    for w, found in own.items():
                        words.append(w)
                        at_words += found
                        places.append(len(at_words))
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(at_words, pa.int32()))
                index = pa.MapArray.from_arrays(pa.array([*ends, len(words)], pa.int32()), pa.array(words, pa.string()), lists)
                yield pa.RecordBatch.from_arrays([part.column(0), index], names=[key, "index"])

    return texts.select(key, text).mapInArrow(fn, f"{key} {kind}, index map<string, array<int>>")
