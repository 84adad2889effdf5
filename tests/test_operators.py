import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

import rillflow.operators as O
from rillflow import sources as S
from rillflow.operators import Chain, aggs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v if isinstance(v, (int, float)) else str(v)) for v in r])


def test_truth_of_loose_values(spark):
    df = spark.createDataFrame([(1, 0, "", [], None), (2, 3, "x", [1], True)], "id int, n int, s string, a array<int>, b boolean")
    for c in "nsab":
        assert [r.id for r in O.FieldsNonEmpty(c)(df).collect()] == [2]


def test_numbers_with_commas(spark):
    df = spark.createDataFrame([("a", "1,200"), ("a", "x"), ("a", None), ("b", "5")], "k string, v string")
    out = Chain(O.Group("k", emit_fast=False), aggs.Sum("v", target_key="s"), aggs.Mean("v", target_key="m"))(df)
    assert rows(out) == [("a", 1200.0, 1200.0), ("b", 5.0, 5.0)]


def test_group_is_fused(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    out = Chain(O.Group("k", emit_fast=False), aggs.Count(target_key="n"))(df)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_runs_like_a_loop(spark, slices):
    keys = [None if k % 11 == 0 else "abc"[(k // 3 + k // 7) % 3] for k in range(100)]
    truth, last = [], object()
    for k in keys:
        k = "None" if k is None else k
        if k != last:
            truth.append([k, 0])
        truth[-1][1] += 1
        last = k
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").repartition(slices)
    out = Chain(O.Group("k", order="i"), aggs.Count(target_key="n"), aggs.First(target_key="f"))(df)
    assert [[r.key, r.n] for r in out.orderBy("f.i").collect()] == truth


def test_distinct_keeps_the_first(spark):
    df = spark.createDataFrame([(k, ["a", "b", None][k % 3]) for k in range(30)], "i int, k string").repartition(5)
    assert rows(O.Distinct("k", order="i")(df).select("i")) == [(0,), (1,), (2,)]


def test_order_operators(spark):
    df = spark.range(100).select(F.col("id")).repartition(7)
    assert rows(O.SkipN(95, order="id")(df)) == [(95,), (96,), (97,), (98,), (99,)]
    assert rows(O.Limit(3, 2, order="id")(df)) == [(3,), (4,)]
    batches = O.Buffer(30, order="id")(df).orderBy("batch").collect()
    assert [[r["id"] for r in b["values"]] for b in batches] == [list(range(k, min(100, k + 30))) for k in (0, 30, 60, 90)]


def test_head_tail_nth(spark):
    df = spark.createDataFrame([("a", k) for k in range(6)], "k string, v int")
    out = Chain(O.Group("k", emit_fast=False, order="v"), aggs.Head(2, target_key="h"), aggs.Tail(2, target_key="t"), aggs.Tail(2, target_key="c", compat=True), aggs.Nth(-1, target_key="n"), aggs.ReduceBy(lambda x: x * 10, lambda t, x: t - x, field="v", target_key="f"))(df).first()
    assert [[r.v for r in out[c]] for c in "htc"] == [[0, 1], [4, 5], [0, 1, 2, 3]]
    assert out.n.v == 5 and out.f == -15


def test_fields(spark):
    df = spark.createDataFrame([(1, None, {"x": "y"}, [1, 2])], "a int, b string, m map<string,string>, l array<int>")
    assert O.Select("m.x", short_key=True)(df).first().x == "y"
    assert O.Select("nothing")(df).first().nothing is None
    assert O.RenameFields(a="b")(df).columns == ["b", "m", "l"]
    assert O.ConcatFields("t", "a", "b")(df).first().t == "1_None"
    assert O.ConcatArray("l", "a", "gone", target_key="t")(df).first().t == [1, 2, 1]
    assert O.AddFields(b="z", c=[1])(df).first()["b"] == "z"
    assert O.InjectField({"1": "one"}, "name", "a")(df).first().name == "one"
    assert O.MergeFields(b="a")(df).first().b == "1"
    assert O.RemoveEmptyOrNullFields()(spark.createDataFrame([({"a": "", "b": "c"},)], "m map<string,string>")).first().m == {"b": "c"}


def test_flat(spark):
    df = spark.createDataFrame([(1, [10, 20], {"p": 1})], "i int, l array<int>, m map<string,int>")
    assert rows(O.Flat("l", inherit_props=True)(df).select("i", "l")) == [(1, 10), (1, 20)]
    assert rows(O.Flat("m")(df)) == [("p", 1)]
    assert O.Flat("i")(df).count() == 0
    assert rows(O.FlatMap("lambda v: v.split(' ')", key="s")(spark.createDataFrame([("a b",)], "s string"))) == [("a",), ("b",)]


def test_lambdas_become_columns_or_udfs(spark):
    df = spark.createDataFrame([("ab", 3), (None, 4)], "s string, n int")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    out = O.Map(lambda s: s.upper() + "!", key="s")(df)
    assert rows(out) == [("AB!", 3), (None, 4)] and "Python" not in plan(out)
    out = O.Map(lambda s: "".join(sorted(s, reverse=True)), key="s", target_key="t")(df)
    assert [r.t for r in out.orderBy("n").collect()] == ["ba", None] and "Python" in plan(out)
    assert rows(O.Filter(lambda r: len(r["s"]) == 2 or r["n"] > 3)(df).select("n")) == [(3,), (4,)]


def test_control(spark):
    df = spark.range(6).select(F.col("id").alias("d"))
    assert rows(O.IfElse(O.ReplaceFields(d=1), O.ReplaceFields(d=0), "lambda r: r['d'] > 2")(df)) == [(0,)] * 3 + [(1,)] * 3
    assert rows(O.While(O.Map("lambda d: d + 4", key="d"), "lambda r: r['d'] < 8")(df)) == [(8,), (8,), (9,), (9,), (10,), (11,)]
    assert rows(O.While(O.Map("lambda d: d + 1", key="d"), "lambda r: r['d'] < 100", max_iterations=2)(df))[0] == (2,)
    assert rows(O.Filter(O.Not(O.Any("lambda r: r['d'] == 1", O.Filter("sql:d > 3"))))(df)) == [(0,), (2,), (3,)]


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b", None), ("2", 'q"', "x")], "id string, t string, u string")
    O.WriteJson(str(tmp_path / "j"))(df)
    assert rows(S.JsonLine(str(tmp_path / "j"))(spark).select("id", "t", "u")) == rows(df)
    O.WriteCSV(str(tmp_path / "c"), "id", "t")(df)
    assert rows(S.CSV(str(tmp_path / "c"))(spark)) == rows(df.select("id", "t"))
    O.WriteText(str(tmp_path / "t"), mode="gzip")(df.select("t"))
    assert rows(S.Text(str(tmp_path / "t"))(spark)) == rows(df.select("t"))
    O.WriteFiles(str(tmp_path / "f"), content_key="t", suffix=".txt")(df)
    assert (tmp_path / "f" / "1.txt").read_text() == "a,b"
    assert rows(O.WriteJsonIf(O.FieldsNonEmpty("u"), str(tmp_path / "no"))(df).select("id")) == [("2",)]
    assert spark.read.json(str(tmp_path / "no")).count() == 1


def test_archives_mail_and_warc(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("two.md", "2")
    assert rows(S.Zip(str(tmp_path / "a.zip"), "txt")(spark)) == [("x/one.txt", bytearray(b"1"))]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("m.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert rows(S.Tar(str(tmp_path / "a.tar.gz"))(spark)) == [("m.txt", bytearray(b"hi"))]
    (tmp_path / "m.eml").write_bytes(b"Subject: =?utf-8?b?w6k=?=\r\nFrom: Ann <ann@x.org>\r\nTo: b@y.org\r\nDate: Mon, 01 Jan 2024 00:00:00 +0000\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody\r\n")
    mail = S.EML(str(tmp_path / "m.eml"))(spark).first()
    assert (mail.subject, mail["from"][0].n, mail["to"][0].n, mail.date, mail.text.strip()) == ("é", "Ann", "b", 1704067200000, "body")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>hi</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:u1>\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(record))
    page = S.Warc(str(tmp_path / "w.warc.gz"))(spark).first()
    assert (page["_id"], page.url, page.body, page.header["Content-Type"]) == ("u1", "http://x/", "<p>hi</p>", "text/html; charset=utf-8")


def test_other_sources(spark, tmp_path):
    (tmp_path / "y.yaml").write_text("a: [1, 2]\n")
    assert S.Yaml(str(tmp_path / "y.yaml"))(spark).select(F.to_json("value").alias("v")).first().v == '{"a":[1,2]}'
    (tmp_path / "f.json").write_text('{\n "a": {"b": 1\n}\n}\n[2]\n')
    assert S.JsonFree(str(tmp_path / "f.json"))(spark).count() == 2
    (tmp_path / "d.json").write_text('[\n{"id": "Q1"},\n{"id": "Q2"}\n]\n')
    assert S.WikidataDump(str(tmp_path / "d.json"))(spark).count() == 2
    (tmp_path / "g.tsv").write_text("1\t\tx\n2\t0.5\ty\n")
    assert rows(S.GdeltTable(str(tmp_path / "g.tsv"), ["a:int", "b:float", "c:str"])(spark)) == [(1, None, "x"), (2, 0.5, "y")]
    assert rows(S.String("a;;b", ";")(spark).select("value")) == [("",), ("a",), ("b",)]
    assert S.MultiLoader(S.Array([{"a": 1}]), S.Array([{"b": 2}]))(spark).count() == 2
    assert S.Directory(str(tmp_path), "yaml", filename_only=True)(spark).first().filename == "y.yaml"
    db = S.SQLite(str(tmp_path / "s.db"), "t")
    db.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    db.upsert(spark.createDataFrame([(2, "c")], "id long, v string"))
    assert rows(db.scroll(spark)) == [(1, "a"), (2, "c")]
    assert rows(O.DistinctByDatabase(db, "id")(spark.range(4))) == [(0,), (3,)]
    store = S.TableDatabase(str(tmp_path / "tables"), "t", "id")
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    store.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"))
    assert rows(store.scroll(spark)) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.exists(spark.range(3), "id")) == [(1,), (2,)]


def test_models(spark):
    from rillflow.operators.models import LLM, LLMModel, LLMProcessor

    df = spark.createDataFrame([("hi", 1)], "t string, n int")
    assert LLMProcessor(LLMModel(call=lambda p: p.upper()), "say {data} {n}", key="t", target_key="a")(df).first().a == "SAY HI 1"

    def fails(p):
        raise ValueError

    assert LLM(key="t", target_key="a", call=fails)(df).first().a is None


def test_flow_files(spark, tmp_path):
    from rillflow.plans.flow import Flow

    (tmp_path / "base.yaml").write_text("name: base\nnodes:\n  cut: TakeN(2)\nconsts:\n  word: keep\n")
    (tmp_path / "flow.yaml").write_text("from: base.yaml\narguments: 1\nloader: String(arg1, sep=';')\nnodes:\n  up: \"Map(lambda s: s.upper(), key='value')\"\nprocessor: Chain(Select('value'), up, cut)\n")
    assert rows(Flow.from_file(str(tmp_path / "flow.yaml"), "a;b;c").plan(spark)) == [("A",), ("B",)]
    assert Flow.from_dict({}, loader="String('1;2', sep=';')", processor="Select('value')").run(spark) == 2
    with pytest.raises((KeyError, ValueError)):
        Flow.from_dict({"loader": "__import__('os').system('x')", "processor": "Print"})


def test_streams(spark, tmp_path):
    from rillflow import streaming as st

    df = spark.createDataFrame([(k, f"2024-01-01 00:{k % 60:02d}:00", k % 5, "ab"[(k // 4) % 2]) for k in range(40)], "i long, t string, u long, k string").withColumn("t", F.to_timestamp("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = st.file_stream(spark, str(tmp_path / "in"), df.schema)
    got = st.collected(st.deduplicated(stream, "u").select("u"), str(tmp_path / "c1"), str(tmp_path / "o1"))
    assert rows(got) == [(k,) for k in range(5)]
    got = st.collected(st.windowed_counts(st.file_stream(spark, str(tmp_path / "in"), df.schema), "t", "k"), str(tmp_path / "c2"), str(tmp_path / "o2"), "complete")
    assert got.agg(F.sum("n")).first()[0] == 40
    got = st.collected(st.run_groups(st.file_stream(spark, str(tmp_path / "in"), df.schema, per_trigger=100), "u", "k", "i"), str(tmp_path / "c3"), str(tmp_path / "o3"))
    assert got.count() > 0


def test_queries_against_oracles(spark):
    import duckdb

    from rillflow import catalogue

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ["group_runs", "group_none_key", "flat_kv", "if_else", "flow_yaml", "urls", "triples_to_entity", "buffer_batches", "while_double", "json_join"]:
        a, b = catalogue.QUERIES[name](spark, d).toPandas(), db.sql(catalogue.ORACLES[name]).df()
        cols = sorted(a.columns)
        key = lambda x: sorted(map(tuple, x[cols].astype(str).values.tolist()))  # noqa: B023, E731
        assert cols == sorted(b.columns) and key(a) == key(b), name


def test_json_text(spark):
    from rillflow.functions import texts

    assert json.loads(texts.literal_answer("<think>x</think>```json\n{'a': 1}\n```")) == {"a": 1}
    assert texts.cnki_records("Title-t: A\nAuthor: x;y\n\nTitle: B\n") == [{"Title": "A", "Author": "x;y"}, {"Title": "B"}]
    assert {("x", "Colleague", "y")} <= {tuple(r.values()) for r in texts.patent_relations({"Title": "A", "Author": "x;y"})}
    assert texts.split_char("a\n\nb\n\nc", chunk_size=4, overlap=0) == ["a\n\nb", "c"]
    assert texts.markdown_tree("# A\n## 1.2 B\nx")["children"][0]["children"][0]["number"] == "1.2"
    assert texts.html_meta('<meta property="og:title" content="T">') == {"title": "T"}
    assert texts.longest_common_substring("xabcy", "zabcw") == "abc"
    assert texts.wiki_plain("'''A''' {{x|{{y}}}}[[B|b]]<ref>r</ref>") == "A b"
