"""The queries on sources, sinks, papers and nested values, each against its oracle in DuckDB."""

import collections
import os

import duckdb
import pytest

from rillflow import catalogue, catalogue_io, catalogue_values

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in catalogue.queries().items() if getattr(f, "__module__", "") in {catalogue_io.__name__, catalogue_values.__name__}]
NAMES += ["pdf_paragraphs", "pdf_joined", "pdf_organized", "paper_chunks", "paper_sections", "report_dates", "report_groups", "json_values", "engine_types", "model_answers", "web_headers", "valid_urls", "moved_indices", "host_names", "mail_times", "bullet_paragraphs", "beijing_times", "document_trees", "normal_letters"]


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_like_the_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    truth = collections.Counter(tuple(rounded(r[k]) for k in order) for r in found.fetchall())
    assert collections.Counter(tuple(map(rounded, r)) for r in df.collect()) == truth


def test_values_of_several_types(spark):
    """A dictionary means the same as a literal and as a joined table."""
    from rillflow.operators import edit
    from rillflow.operators.filters import BlackList, WhiteList

    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    few = {"a": 1, "b": "x"}
    many = few | {f"no{k}": k for k in range(edit.LITERAL + 1)}
    read = lambda t: {r.k: r.v for r in edit.lookup(df, df["k"], t, "v").collect()}
    assert read(few) == read(many) == {"a": "1", "b": "x", "c": None}
    assert {r.k for r in WhiteList(["a", 1], key="k")(df).collect()} == {"a"} and {r.k for r in BlackList(["a", 1], key="k")(df).collect()} == {"b", "c"}


def test_failures_are_counted(spark, tmp_path):
    from rillflow import sources as S
    from rillflow.records import rejected

    (tmp_path / "bad.zip").write_bytes(b"no archive")
    before = rejected(spark)
    assert S.Zip(f"file://{tmp_path}")(spark).count() == 0 and rejected(spark) == before + 1


def test_long_keyword_lists(spark):
    """A pattern of a few keywords and an automaton of many keep the same texts."""
    from rillflow.operators.filters import KeywordFilterV2

    texts = ["a cat sat", "Cat", "no", "", None, "x.y", "xzy", "Straße", "[a]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = ["cat", "x.y", "ß", "[a]"]
    for action in ("keep", "drop"):
        few = [r.t for r in KeywordFilterV2("t", words, action=action)(df).collect()]
        many = [r.t for r in KeywordFilterV2("t", [*words, *[f"zq{k}" for k in range(80)]], action=action)(df).collect()]
        assert few == many
