"""Text expressions: all built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION_TYPES = ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "results_discussion", "caption", "table", "body", "other")

# Whole headings of each type, most specific reading first; blanks may vary.
_AND = r"\s*(?:&|and)\s*"
HEADINGS = [
    ("introduction", r"overview|background|introduction"),
    ("methods", rf"methodology|procedures?|experimental|study\s*design|(?:materials?{_AND})?methods?"),
    ("results", r"outcomes?|findings|results?"),
    ("discussion", r"interpretation|discussion"),
    ("conclusion", r"summary|conclusions?|concluding\s*remarks?"),
    ("results_discussion", rf"results?{_AND}discussion"),
]
# Parts of headings, as the passage format is classified.
HEADING_PARTS = [
    ("introduction", "introduction|background"),
    ("methods", "method|material|procedure"),
    ("results", "result|finding"),
    ("discussion", "discussion|interpretation"),
    ("conclusion", "conclusion|summary"),
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z, 0-9 and hyphens that are longer than one."""
    runs = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[a-z0-9-]{2,}"), 0)
    return F.coalesce(runs, F.array().cast("array<string>"))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(_col(text)) / 4).cast("int")


def clean(text: Column | str) -> Column:
    """One blank for each run of white space, none before punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " ")), r" +([.,;:!?])", "$1")


def section_type(heading: Column | str) -> Column:
    """Type of a whole heading, else 'other'."""
    h = F.trim(F.regexp_replace(_col(heading), r"(?U)^\s+|\s+$", ""))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in HEADINGS:
        out = out.when(h.rlike(rf"(?i)^(?:{pattern})$"), name)
    return out.otherwise("other")


def section_type_by_part(heading: Column | str) -> Column:
    """Type by what the heading holds, as for passages."""
    h = F.lower(_col(heading))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in HEADING_PARTS:
        out = out.when(h.rlike(pattern), name)
    return out.otherwise("other")


def empty_to(value: Column | str, other: Column | str) -> Column:
    """value unless it is null or empty, else other."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), _col(other))


def lexical_text(heading: Column | str, text: Column | str) -> Column:
    return F.concat_ws(" ", F.nullif(_col(heading), F.lit("")), _col(text))


def dense_text(heading: Column | str, text: Column | str, most: int = 2000) -> Column:
    return F.substring(F.concat_ws(": ", F.nullif(_col(heading), F.lit("")), _col(text)), 1, most)


def doc_id_of_chunk(chunk_id: Column | str, form: str = "set") -> Column:
    """Document id inside a chunk id, in each of the reference's three forms.

    'set' cuts at the first '_' segment that is a section type, 'prefix' where
    the rest starts with one, and both fall back to 'naive', which drops the
    last two segments.  Plans here carry ``doc_id`` and need none of them.
    """
    c = _col(chunk_id)
    naive = F.regexp_replace(c, r"_[^_]*_[^_]*$", "")
    if form == "naive":
        return naive
    if form == "set":
        types = [t for t in SECTION_TYPES if "_" not in t]
        got = F.regexp_extract(c, rf"^(.+?)_(?:{'|'.join(types)})(?:_|$)", 1)
    else:
        got = F.regexp_extract(c, rf"^(.+?)_(?:{'|'.join(SECTION_TYPES)})", 1)
    return F.when(got != "", got).otherwise(naive)


def paper_block(index: Column, title: Column, year: Column, abstract: Column, mesh: Column, most: int = 800, terms: int = 8) -> Column:
    """One paper as a block of a prompt."""
    return F.concat(
        F.lit("Paper "), index.cast("string"), F.lit(": "), F.coalesce(title, F.lit("")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")\n"),
        F.substring(F.coalesce(abstract, F.lit("")), 1, most), F.lit("\nTerms: "), F.concat_ws(", ", F.slice(mesh, 1, terms)),
    )


def json_object(reply: Column | str) -> Column:
    """From the first '{' to the last '}', or null where that isn't JSON."""
    return _valid(F.regexp_extract(_col(reply), r"(?s)\{.*\}", 0))


def json_array(reply: Column | str) -> Column:
    return _valid(F.regexp_extract(_col(reply), r"(?s)\[.*\]", 0))


def _valid(found: Column) -> Column:
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def numbered_choices(reply: Column | str, most: int | Column, cap: int = 15) -> Column:
    """Distinct integers of the reply from 1 to most, ascending, at most cap."""
    found = F.transform(F.regexp_extract_all(_col(reply), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    top = F.lit(most) if isinstance(most, int) else most
    inside = F.filter(found, lambda x: x.isNotNull() & (x >= 1) & (x <= top))
    return F.slice(F.array_sort(F.array_distinct(inside)), 1, cap)


def text_of_inverted_index(index: Column | str) -> Column:
    """Words of a word -> positions map in the order of their positions."""
    placed = F.flatten(F.transform(F.map_entries(_col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.coalesce(F.concat_ws(" ", F.transform(F.array_sort(placed), lambda x: x["word"])), F.lit(""))
