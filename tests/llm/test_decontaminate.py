from __future__ import annotations

import re

import pandas as pd

from tessera.llm import decontaminate as D
from tessera.llm import queries

QUESTION = "A farmer named Alice sold 12 apples for 3 dollars each and then walked 5 km to the market. How much money did she make?"
CHANGED = QUESTION.replace("Alice", "Robert").replace("12", "40").replace("3 dollars", "7 euros").replace("5 km", "9 miles")
CLEAN = "The old library stands beside the river and opens every morning when the bell of the church begins to ring across town."


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, docs, items, **how):
    return {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items, **how).collect()}


def test_copies_and_other_parameters_are_caught(spark, make_docs):
    docs = make_docs([(1, f"{CLEAN} {QUESTION} {CLEAN}"), (2, f"{CLEAN}\n{CHANGED}"), (3, CLEAN), (4, QUESTION.upper())])
    got = found(spark, docs, bench(spark, [(9, QUESTION)]))
    assert (1, 9) in got and (2, 9) in got and (3, 9) not in got


def test_slots_must_map_one_to_one(spark, make_docs):
    item = "Take 4 red balls and 6 blue balls and 4 green balls from the large wooden box and then add 6 more balls."
    mixed = "Take 1 red balls and 1 blue balls and 2 green balls from the large wooden box and then add 3 more balls."
    other = "Take 8 red balls and 9 blue balls and 8 green balls from the large wooden box and then add 9 more balls."
    docs = make_docs([(1, mixed), (2, other)])
    assert found(spark, docs, bench(spark, [(1, item)])) == {(2, 1)}


def test_one_coincidence_and_windows_without_slots(spark, make_docs):
    """Few slots of which two get one value, and words that are the item's own."""
    item = "Divide 12 cakes among 3 children so that every child has the same share and nobody is left without a piece."
    docs = make_docs([(1, item.replace("12", "5").replace("3", "5")), (2, item.replace("among 3", "among 12").replace("Divide 12", "Divide 3"))])
    assert found(spark, docs, bench(spark, [(1, item)])) == {(1, 1), (2, 1)}
    item = "Add 4 and 6 and 4 and 6; " + CLEAN
    mixed = "Add 1 and 1 and 2 and 3; " + CLEAN
    assert found(spark, make_docs([(1, mixed)]), bench(spark, [(1, item)])) == {(1, 1)}


def test_other_parameters_of_items_without_words_enough(spark, make_docs):
    item = "What is 12 + 7 * 3 - 4 / 2?"
    docs = make_docs([(1, f"{CLEAN} What is 31 + 9 * 5 - 8 / 6? {CLEAN}"), (2, f"{CLEAN} What is 31 + 9? {CLEAN}"), (3, "1 2 3 4 5 6 7 8 9"), (4, f"{CLEAN} What is 1 + 1 * 1 - 1 / 1? {CLEAN}")])
    long = "Sum " + " ".join(str(i) for i in range(30, 60)) + " and multiply"
    docs = docs.union(make_docs([(5, "Sum " + " ".join(str(i) for i in range(130, 160)) + " and multiply")]))
    assert found(spark, docs, bench(spark, [(1, item), (2, long)])) == {(1, 1), (5, 2)}


def test_every_benchmark_item_with_other_parameters_is_caught(spark, sf, make_docs):
    """Numbers of all items of the table replaced one to one."""
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    other = lambda t: re.sub(r"\d+", lambda m: str(3 * int(m.group()) + 17), t)
    rows = [(i, f"{CLEAN} {other(t)} {CLEAN}") for i, t in zip(items.item_id.tolist(), items.text)]
    got = found(spark, make_docs(rows), bench(spark, [(i, t) for i, t in zip(items.item_id.tolist(), items.text)]))
    assert {(i, i) for i, _ in rows} <= got


def test_the_removal_by_shuffle_gives_the_same(spark, make_docs, monkeypatch):
    docs, items = make_docs([(1, QUESTION), (2, CLEAN), (None, QUESTION)]), bench(spark, [(9, QUESTION)])
    few = sorted(map(str, D.remove(docs, items).collect()))
    monkeypatch.setattr(D, "MOST_GONE", 0)
    assert sorted(map(str, D.remove(docs, items).collect())) == few and len(few) == 2


def test_join_by_shuffle_gives_the_same(spark, make_docs):
    docs = make_docs([(1, f"{CLEAN} {QUESTION}"), (2, CHANGED), (3, CLEAN)])
    items = bench(spark, [(9, QUESTION), (8, CLEAN)])
    assert found(spark, docs, items) == found(spark, docs, items, most_sent=0)


def test_copies_rich_in_numbers_and_names_and_short_items_are_caught(spark, make_docs):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2?"), (2, "17 4 96 21 8 33 5 72 10 64"), (3, "Name Anna Berta, Carl Dora; Emil Fritz; Gustav Hans; Ida Jonas"), (4, "Define osmosis briefly."), (5, "Osmosis")]
    docs = make_docs([(i, f"{CLEAN} {t} {CLEAN}") for i, t in items] + [(9, f"{CLEAN} What is 13 + 7 * 3 - 4 / 2? 17 4 96 {CLEAN}")])
    want = {(i, i) for i in range(1, 5)} | {(9, 1)}  # 9 asks item 1 with another number
    assert found(spark, docs, bench(spark, items)) == want
    assert found(spark, docs, bench(spark, items), most_sent=0) == want


def test_copies_in_another_case_are_caught(spark, make_docs):
    german = "Der Bauer verkauft am Morgen seine Kartoffeln auf dem Markt und kauft mit dem Geld neue Werkzeuge im Laden der Stadt."
    docs = make_docs([(4, QUESTION.upper()), (5, QUESTION.lower()), (6, QUESTION.title()), (7, german.lower()), (8, german.upper()), (3, CLEAN.upper())])
    assert found(spark, docs, bench(spark, [(9, QUESTION), (10, german)])) == {(4, 9), (5, 9), (6, 9), (7, 10), (8, 10)}


def test_awkward_rows(spark, awkward):
    items = bench(spark, [(1, None), (2, ""), (3, "too short"), (None, QUESTION), (4, "alpha beta gamma. alpha beta gamma. alpha beta gamma."), (4, "alpha beta gamma. alpha beta gamma. alpha beta gamma.")])
    assert found(spark, awkward, items) == {(4, 4)}
    kept = D.remove(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1


def test_empty_tables(spark, make_docs):
    assert found(spark, make_docs([]), bench(spark, [(1, QUESTION)])) == set()
    assert found(spark, make_docs([(1, QUESTION)]), bench(spark, [])) == set()


def test_query_against_brute_force(spark, sf):
    """Verbatim passages are all caught; what else is caught shares most windows."""
    docs, items = (pd.read_parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    verbatim = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, q in zip(items.item_id, items.text) if q in t}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op3_benchmark_decontamination(spark, sf).collect()}
    assert verbatim <= set(got)

    def plain(text):
        doc, code, _, slot = D.tokens([text])
        out = set()
        for at in range(len(code) - D.WINDOW + 1):
            if 2 * sum(not x for x in slot[at : at + D.WINDOW]) >= D.WINDOW:
                out.add(tuple(code[at : at + D.WINDOW].tolist()))
        return out

    text, item = dict(zip(docs.doc_id, docs.text)), dict(zip(items.item_id, items.text))
    for (d, i), r in got.items():
        a, b = plain(item[i]), plain(text[d])
        if a:
            assert r["windows"] == len(a) and r["matched"] <= len(a & b) and r["coverage"] >= D.COVERAGE
