from __future__ import annotations

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def plain_tokens(text):
    """Runs of allowed characters between anything else, longer than one."""
    return re.findall(r"[0-9a-z-]{2,}", text.lower())


def test_tokens_equal_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.tokens("text").alias("t")).collect()
    assert all(list(r["t"]) == plain_tokens(r["text"]) for r in docs)
    assert one(spark, T.tokens("a"), a=None) == [] and one(spark, T.tokens("a"), a="A x-y 12, Z") == ["x-y", "12"]


@pytest.mark.parametrize("heading,whole,part", [("Methods", "methods", "methods"), (" materials & METHODS ", "methods", "methods"), ("Statistical methods", "other", "methods"), ("Result and discussion", "results_discussion", "results"), ("Overview", "introduction", "other"), ("", "other", "other")])
def test_section_types(spark, heading, whole, part):
    assert one(spark, T.section_type("a"), a=heading) == whole
    assert one(spark, T.section_type_by_part("a"), a=heading) == part


def test_clean_and_estimate(spark):
    assert one(spark, T.clean("a"), a="  a \n b , c\t. ") == "a b, c."
    assert one(spark, T.token_estimate("a"), a="é" * 11) == 2
    assert one(spark, T.lexical_text("h", "t"), h="", t="x") == "x" and one(spark, T.dense_text("h", "t", 4), h="H", t="xyz") == "H: x"


def test_document_ids_of_chunks(spark):
    for form, chunk, want in [("set", "PMC1_abstract_0", "PMC1"), ("set", "PMC1_results_discussion_4", "PMC1"), ("prefix", "PMC1_results_discussion_4", "PMC1"), ("naive", "PMC1_results_discussion_4", "PMC1_results"), ("naive", "PMC1_methods_2", "PMC1"), ("set", "A_B_odd_2", "A_B")]:
        assert one(spark, T.doc_id_of_chunk("a", form), a=chunk) == want, (form, chunk)


def test_replies(spark):
    assert one(spark, T.json_object("a"), a='Sure {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, T.json_object("a"), a="{broken") is None and one(spark, T.json_object("a"), a="none") is None
    assert one(spark, T.json_array("a"), a="x [1, 2] y") == "[1, 2]"
    assert one(spark, T.numbered_choices("a", 9), a="3, 1 and 3; 10, 0, 99999999999999 and 9") == [1, 3, 9]
    assert one(spark, F.size(T.numbered_choices("a", 30)), a=" ".join(map(str, range(40)))) == 15


def test_inverted_index(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},), ({},), (None,)], "m map<string, array<int>>")
    assert [r[0] for r in df.select(T.text_of_inverted_index("m")).collect()] == ["a b c b", "", ""]


def test_empty_to(spark):
    assert one(spark, T.empty_to("a", "b"), a="", b="y") == "y" and one(spark, T.empty_to("a", "b"), a="x", b="y") == "x"
    assert pd.isna(one(spark, T.empty_to("a", "b"), a=None, b=None))
