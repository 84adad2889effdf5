"""Queries on rows that the small test tables lack, each against its oracle in DuckDB."""

import collections

import duckdb

from rillflow import catalogue


def like_the_oracle(spark, name, folder, **tables):
    """The query gives the rows of its SQL on tables made by SQL; several statements make several files."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 1")
    for t, made in tables.items():
        (folder / f"{t}.parquet").mkdir()
        for k, sql in enumerate([made] if isinstance(made, str) else made):
            con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet/part-{k}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = catalogue.queries()[name](spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    truth = collections.Counter(tuple(r[k] for k in order) for r in found.fetchall())
    assert collections.Counter(map(tuple, df.collect())) == truth
    return truth


def test_arxiv_ids_beyond_five_digits(spark, tmp_path):
    like_the_oracle(spark, "arxiv_ids", tmp_path, part="SELECT CAST(k AS BIGINT) AS p_partkey, 'Brand#' || k AS p_brand FROM (VALUES (0), (7), (99999), (100000), (1199999), (NULL)) t(k)")


def test_titles_as_written(spark, tmp_path):
    """The query has the title as its SQL reads it from the source; the parser decodes all references."""
    from rillflow.functions import texts

    cut = "<head><title>a &amp;&amp</title></head>"
    pages = [cut, "<title>token = &quot;0b&quot;</title>", "<TITLE lang='x'>b\n  c &amp;lt; &lt;d&gt;</Title>", "<title>   e\t </title>", "<title>f\n</title>", "<title> 　 </title>", "<title></title>", "<p>none</p>", "<title>open", "<title>g</title><svg><title>h</title></svg>", "", None]
    values = ", ".join(f"({k}, " + ("NULL" if p is None else "'" + p.replace("'", "''") + "'") + ")" for k, p in enumerate(pages))
    truth = like_the_oracle(spark, "html_title", tmp_path, pages=f"SELECT CAST(k AS BIGINT) AS page_id, html FROM (VALUES {values}) t(k, html)")
    assert (0, "a &&amp") in truth
    assert texts.html_title(cut) == "a &&"


def test_texts_of_empty_lines_alone(spark, tmp_path):
    truth = like_the_oracle(spark, "remove_empty", tmp_path, documents=r"SELECT CAST(k AS BIGINT) AS doc_id, replace(v, '|', chr(10)) AS text FROM (VALUES (1, ''), (2, '|'), (3, '|||'), (4, 'a||b|'), (5, ' '), (6, NULL)) t(k, v)")
    assert (3, 0) in truth and (6, None) in truth


def test_ties_in_the_order_of_the_source(spark, tmp_path):
    """Of rows with the same price those come first that stand first in the files, whatever the files' sizes. DuckDB keeps any."""
    (tmp_path / "lineitem.parquet").mkdir()
    sizes, rows = (4, 20_000, 1), []
    for k, n in enumerate(sizes):
        part = [(1000 * k + i, i % 7, 9.0 if n == 1 else 5.0) for i in range(n, 0, -1)]
        values = f"SELECT CAST({1000 * k} + i AS BIGINT) AS l_orderkey, CAST(i % 7 AS INTEGER) AS l_linenumber, {part[0][2]}::DOUBLE AS l_extendedprice FROM range({n}, 0, -1) t(i)"
        duckdb.execute(f"COPY ({values}) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet'")
        rows += part
    got = [tuple(r) for r in catalogue.queries()["sort_topk"](spark, str(tmp_path)).collect()]
    assert got == sorted(rows, key=lambda r: -r[2])[:10]


def test_sort_keeps_the_order_of_rows(spark):
    from rillflow import operators as O

    df = spark.range(0, 4000, 1, 8).selectExpr("id", "id % 3 AS k")
    for reverse in (False, True):
        got = [(r.k, r.id) for r in O.Sort(key="k", reverse=reverse)(df).collect()]
        assert got == sorted(((k % 3, k) for k in range(4000)), key=lambda x: x[0], reverse=reverse)


def test_scrolled_files_are_full_and_in_order(spark, tmp_path):
    """Rows of many partitions fill files of a number of rows; only the last has fewer, and another run adds its own."""
    import gzip
    import json

    from rillflow import operators as O
    from rillflow.ordered import blocks

    df = spark.range(0, 1234, 1, 7).filter("id % 10 < 7 or id > 400").selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'ä' END AS t", "DATE'2025-01-02' AS d")
    want = [{"id": k, "t": "ä" if k % 2 == 0 else None, "d": "2025-01-02"} for k in range(1234) if k % 10 < 7 or k > 400]
    for times in (1, 2):
        O.WriteJsonScroll(str(tmp_path / "out"), scroll=50)(df)
        files = sorted((tmp_path / "out").glob("*.json.gz"))
        got = [[json.loads(x) for x in gzip.decompress(f.read_bytes()).decode().splitlines()] for f in files]
        assert [len(x) for x in got] == [n for n in (50,) * (len(want) // 50) + (len(want) % 50,) for _ in range(times)]
        assert [r for x in got[::times] for r in x] == want and got[::times] == got[times - 1 :: times]
    assert spark.read.json(str(tmp_path / "out")).count() == 2 * len(want)
    O.WriteJsonScroll(str(tmp_path / "none"))(df.limit(0))
    assert not list((tmp_path / "none").glob("*.json.gz"))
    # as Hadoop's own writer gets them
    blocks(df, 50, "n").drop("n").write.option("maxRecordsPerFile", 50).json(str(tmp_path / "hadoop"))
    sizes = sorted(len(f.read_text().splitlines()) for f in (tmp_path / "hadoop").glob("part-*.json"))
    assert sizes == [len(want) % 50] + [50] * (len(want) // 50)


def test_udfs_pass_pieces_on(spark, monkeypatch):
    """Of a batch, however many rows it has, a UDF holds the results of a piece."""
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import functions as F

    from rillflow.functions import texts, udf_of

    made = []
    for kind in ("pandas_udf", "arrow_udf"):
        monkeypatch.setattr(F, kind, lambda f, returns, kind=kind: lambda *c: made.append((kind, f)))
    udf_of(texts.split_recursive)(None)
    udf_of(texts.keywords)(None)
    udf_of(texts.html_content)(None)
    for kind, f in made:
        values = ["some words"] * 1000
        sizes = [len(x) for x in f(iter([pa.array(values) if kind == "arrow_udf" else pd.Series(values)]))]
        assert sum(sizes) == 1000 and max(sizes) <= 256


def test_splits_of_odd_texts(spark):
    from rillflow.functions import texts, udf_of
    from rillflow.records import rejected

    odd = ["", " ", "\n\n", "a" * 9000, "😀 ä" * 3000, "x\n\n" * 4000, None] + [f"text {k}. " * k for k in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k long, t string").coalesce(1)
    for f in (texts.split_simple, texts.split_char, texts.split_recursive, texts.split_markdown, texts.split_chinese, texts.token_windows):
        before = rejected(spark)
        got = {r.k: r.v for r in df.select("k", udf_of(f)("t").alias("v")).collect()}
        assert got == {k: None if t is None else f(t) for k, t in enumerate(odd)}
        assert rejected(spark) == before + 1
