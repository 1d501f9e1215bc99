"""Schemas of the entities that move between operators."""

from __future__ import annotations

METADATA = """pmid string, pmcid string, doi string, title string, abstract string, year int, venue string,
venue_abbrev string, authors array<string>, mesh_terms array<string>, publication_types array<string>,
keywords array<string>, source string"""

WORK = """openalex_id string, pmid string, pmcid string, doi string, title string, abstract string, year int, venue string,
authors array<string>, concepts array<struct<name: string, score: double, level: int>>,
topics array<struct<name: string, subfield: string, field: string>>, cited_by_count int,
referenced_work_ids array<string>, is_oa boolean, oa_url string, source string"""

RAW_WORK = """id string, doi string, title string, publication_year int, cited_by_count int,
ids struct<pmid: string>, abstract_inverted_index map<string, array<int>>,
primary_location struct<source: struct<display_name: string>>,
locations array<struct<landing_page_url: string, source: struct<type: string>>>,
authorships array<struct<author: struct<display_name: string>>>,
concepts array<struct<display_name: string, score: double, level: int>>,
topics array<struct<display_name: string, subfield: struct<display_name: string>, field: struct<display_name: string>>>,
referenced_works array<string>, open_access struct<is_oa: boolean, oa_url: string>"""

SECTION = "struct<heading: string, section_type: string, parent_heading: string, text: string, char_count: int>"
FIGURE = "struct<figure_id: string, label: string, caption: string>"
TABLE = "struct<table_id: string, label: string, caption: string, body_text: string>"

PARSED = f"""pmcid string, title string, abstract string, sections array<{SECTION}>, figure_captions array<{FIGURE}>,
table_texts array<{TABLE}>, section_count int, figure_count int, table_count int, has_methods boolean,
has_results boolean, total_chars int"""

BIOC = "documents array<struct<passages: array<struct<infons: map<string, string>, text: string>>>>"

STUDY = """protocolSection struct<
identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>,
statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, completionDateStruct: struct<date: string>>,
descriptionModule: struct<briefSummary: string, detailedDescription: string>,
designModule: struct<phases: array<string>, studyType: string>,
armsInterventionsModule: struct<interventions: array<struct<type: string, name: string, description: string>>>,
outcomesModule: struct<primaryOutcomes: array<struct<measure: string, timeFrame: string, description: string>>,
secondaryOutcomes: array<struct<measure: string, timeFrame: string>>>,
eligibilityModule: struct<eligibilityCriteria: string, sex: string, minimumAge: string, maximumAge: string, healthyVolunteers: string>,
referencesModule: struct<references: array<struct<pmid: string, type: string, citation: string>>>>,
resultsSection map<string, string>"""

CHUNK = """chunk_id string, doc_id string, pmid string, pmcid string, year int, venue string, mesh_terms array<string>,
seed_query string, section_type string, section_heading string, text string, token_estimate int, position int"""

TASK = """task_id string, task_family string, domain string, difficulty string, question string,
required_constraints array<struct<type: string, value: string>>, supporting_doc_ids array<string>,
hard_negative_doc_ids array<string>, expected_answer_type string, reference_answer string,
verification_status string, generation_method string, split string"""

RUN = "task_id string, retrieved_docs array<string>, rounds int, total_docs_seen int"
