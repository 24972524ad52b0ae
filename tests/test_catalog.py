"""Every registered query with SQL against DuckDB, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.plans import catalog, corpus, documents, logs, records  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    if name in catalog.ORACLES:
        q = duck.sql(catalog.ORACLES[name])
        assert sorted(q.columns) == columns
        at = [q.columns.index(c) for c in columns]
        assert got == sorted(repr([norm(r[i]) for i in at]) for r in q.fetchall())
    else:
        assert got


def test_boilerplate_contains_marks_that_begin_inside_a_word(spark, tmp_path):
    import duckdb

    items = [(1, "apple pie with cream"), (2, "word"), (3, ", - "), (4, "é λόγος, end"), (5, "two words"), (6, "x" * 55 + " yy zz and more"), (7, None)]
    texts = ["pineapple pie with creams", "apple pie with", "swords", "a, - b", "né λόγος, ending", "λόγος", "two  words", "x" * 57 + " yy zz", None, ""]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.n_docs) for r in catalog.QUERIES["boilerplate_contains"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        for t in ("benchmark", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert got == sorted(db.execute(catalog.ORACLES["boilerplate_contains"]).fetchall())


def test_phrase_normalise_shared_separators_and_letters_beyond_the_bmp(spark, tmp_path):
    from quillon.functions.tokens import Tokenizer

    texts = ["x of the of the y", "of the of the of the", "of the  of the", "Und Die und die OF THE", "of the und die", "of the\n", "\nof the\r\n", "𝒳of the, of the𝒳", "und d\u0131e und d\u0130e", "\u0301of the\u0301", "$of the\\", None, ""]
    rows = spark.createDataFrame([*enumerate(texts), (None, "of the of the")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((repr(tuple(r)) for r in catalog.QUERIES["phrase_normalise"](spark, str(tmp_path)).select("doc_id", "text").collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == sorted(map(repr, db.execute(catalog.ORACLES["phrase_normalise"]).fetchall()))
    tokenizer = Tokenizer(stopwords=(), phrases={"of the": "$1", "in it": "2i"})
    both = rows.select(*[tokenizer.normalised(F.lit("of the of the In It 𝒳of the"), apart=x).alias(f"a{x}") for x in (False, True)]).first()
    assert both == ("$1 $1 2i 𝒳of the", "$1 of the 2i 𝒳of the")
