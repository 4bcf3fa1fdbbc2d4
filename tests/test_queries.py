"""Each query against its SQL in DuckDB, at the smallest scale."""

import random

import duckdb
import pandas as pd
import pytest

from gleaner.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("supplier", "events", "documents", "pages", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if pd.isna(x):
            return "NULL"
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_hallucination_rules_are_all_asked(spark, con):
    name = "rule_hits_hallucination"
    found = {r.rule_id for r in queries.queries()[name](spark, SF).collect()}
    assert found == {f"hallucination-{x}" for x in ("high-temperature", "no-citations", "no-grounding", "no-max-tokens")}
    assert found == set(con.sql(queries.oracle_sql()[name]).df().rule_id)


def test_rules_without_words_equal_sql(spark, con):
    rules = [r for r in queries.catalog.rules("hallucination") if r.id in queries._WITHOUT]
    parts = ["rag", "embedding", "\n", "\n ", "\n\n", "\r", " ", ": ", "=", "source", "citation", "y" * 90, "z" * 110, "model", "chat", "max_tokens", "{", "ground", "é"]
    draw = random.Random(3)
    texts = pd.DataFrame([(k, "".join(draw.choices(parts, k=draw.randint(1, 14)))) for k in range(800)], columns=["doc_id", "content"])
    con.register("texts", texts)
    wanted = con.sql(" UNION ALL ".join(queries._without_sql(rules, "texts"))).df()
    assert len(wanted) > 50
    assert rows(queries.scan.flagged(spark.createDataFrame(texts), rules).select("doc_id", "rule_id", "severity").toPandas()) == rows(wanted)
