"""The operators' SQL on the tables and on awkward ones."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tessera.llm import queries


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        return "null" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else f"{float(v):.6f}"

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def awkward_folder(spark, tmp_path_factory):
    """documents and pages with nulls, empty texts, ties and repeated rows."""
    d = tmp_path_factory.mktemp("awkward")
    texts = [None, "", "  \n\t ", "Same words here.", "Same words here.", "a    b\r\nLicensed under the MIT License.\r\n\r\nmore", "Ünïcode wörds ☃ \U0001f600  end ", "x" * 300 + " " * 90, "Released under the MIT License."]
    docs = [(i if i != 4 else 3, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "An unnamed text.", "", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    urls = [None, "", "  HTTPS://Me:pw@Www.Bet-Casino.com:443/P/q.html?x#y ", "a.b", "/only/path", "https://a.org/é/" + "b" * 5000, "a.b"]
    spark.createDataFrame([(i if i else None, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(spark, sf, awkward_folder, name):
    for folder in (sf, awkward_folder):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == sf else '/*.parquet'}')")
        got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLE_SQL[name]()).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
