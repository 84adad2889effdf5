import json

from pyspark.sql import functions as F

from rillflow.functions import dates, domain, graph, strings, texts, udf_of


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_dates(spark):
    assert one(spark, dates.normalize_time(F.col("a")), a="03/04/2025 05:06:07") == 1741064767000
    assert one(spark, dates.normalize_time(F.col("a")), a="2025-03-04T05:06:07+08:00") == 1741035967000
    assert one(spark, dates.normalize_time(F.col("a")), a="20250304") is None
    assert one(spark, dates.native_datetime_to_timestamp(F.col("a")), a="March 3, 2025 4:13:13 PM IST") == 1740998593000
    assert tuple(one(spark, dates.expand_date_range(F.col("a")), a="2024年2月")) == (1706745600, 1709251200)
    assert tuple(one(spark, dates.fill_date(F.col("a"), F.col("b")), a="2024", b="2025-01")) == (1704067200, 1738368000)
    assert one(spark, dates.ts2datetime(F.lit(None).cast("long"))) == ""


def test_text_kinds_reads_whole_texts(spark, tmp_path):
    from rillflow.catalogue import queries

    start = "Report On The Long And Winding Roads Of The Northern Valley"
    rows = {1: start, 2: start + " and then" * 5000, 3: "A" * 58 + " b,", 4: "A" * 70 + ",", 5: "1" * 60 + "a" * 200, 6: None, 7: ""}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.title for r in queries()["text_kinds"](spark, str(tmp_path)).collect()}

    def plain(t):
        """The rules by hand, for texts of one sentence."""
        if t is None:
            return None
        letters = sum(x.isalpha() for x in t)
        return bool(t.strip()) and len(t.split(" ")) <= 12 and letters >= 0.5 * sum(not x.isspace() for x in t) and not t.endswith(",") and not t.isnumeric()

    assert got == {k: plain(t) for k, t in rows.items()}
    assert got[1] and not got[2] and not got[4] and got[5]


def test_strings(spark):
    assert one(spark, strings.extract_text_before(F.col("a"), "X", 1), a="1X 2X3") == "1X 2"
    assert one(spark, strings.extract_text_after(F.col("a"), "X", 1), a="1X 2X3X4") == "3X4"
    assert one(spark, strings.filetype(F.col("a"), {".pdf": ".txt"}), a="a/b.pdf") == ".txt"
    assert one(spark, strings.tag_split(F.col("a")), a="tags: a; b。c") == ["a", "b", "c"]
    assert one(spark, strings.clean_ordered_bullets(F.col("a")), a="1.1 Text") == "Text"
    assert one(spark, strings.remove_sentence_punctuation(F.col("a"), ["-"]), a="a-b, c.") == "a-b c"
    assert tuple(one(spark, strings.extract_ordered_bullets(F.col("a")), a="1.2.3 x")) == ("1", "2", "3")
    assert one(spark, strings.group_broken_paragraphs(F.col("a")), a="a\nb\n\nc") == "a b\n\nc"
    assert one(spark, strings.extract_mapi_id(F.col("a")), a="x MAPI id 12; y") == ["12"]


def test_domain(spark):
    ner = {"s": [["Ann", "PER"], ["x", "ORG"], ["no", "O"]]}
    df = spark.createDataFrame([(ner,)], "m map<string,array<array<string>>>")
    assert [tuple(r) for r in df.select(domain.get_ner(F.col("m")).alias("x")).first().x] == [("Ann", "human")]
    assert domain.arxiv_tasks(spark, 2412, 2501, 2).count() == 4
    assert domain.quarter_hours(spark, "2025-01-01 00:00:00", "2025-01-01 01:00:00").count() == 5
    feed = "<rss><channel><item><title>T</title><link>L</link><pubDate>D</pubDate></item></channel></rss>"
    assert domain.feed_items(feed)[0]["title"] == "T"
    meta = domain.paper_meta(spark.createDataFrame([("p1",)], "_id string")).first()
    assert meta.store_path == f"{meta.sid[:3]}/{meta.sid[3:6]}/p1.json" and len(meta.sid) == 18
    tree = json.dumps(texts.markdown_tree("# T\nAnn\n## Abstract\nshort\n## Intro\nx\n## References\n[1] a"))
    paper = spark.createDataFrame([(tree,)], "t string").select(udf_of(domain.paper_from_tree)(F.col("t")).alias("p")).first().p
    assert (paper.title, paper.abstract, paper.references, paper.sections[0].title) == ("T", "short", ["[1] a"], "Intro")
    known = spark.createDataFrame([("b", 4)], "key string, id long")
    ids = domain.string_ids(spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "k string, o int"), "k", "o", known)
    assert {r.key: r.id for r in ids.collect()} == {"b": 4, "c": 5, "a": 6}
    assert domain.section_parent(["1", "1.1", "1.2.1", "2"]) == [-1, 0, 0, -1]
    assert domain.search_entity_type("c", [{"name": "a", "children": [{"name": "c", "id": 1}]}])["id"] == 1
    got = domain.fetched(spark.createDataFrame([("u",)], "url string"), fetch=lambda u: u.encode()).first()
    assert bytes(got.content) == b"u"


def test_api_descriptions():
    doc = {"info": {"title": "A", "version": "1"}, "servers": [{"url": "s"}], "components": {"schemas": {"P": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}}, "paths": {"/p": {"get": {"operationId": "g", "parameters": [{"name": "q", "in": "query", "schema": {"type": "string"}}]}, "post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/P"}}}}}}}}
    models = domain.openapi_models(doc)
    assert [m["_id"] for m in models] == ["g", "a_/p_post"]
    assert models[1]["service"]["input_args"]["body"]["n"] == {"__type": "int", "__required": True}
    back = domain.openapi_write(models)
    assert set(back["paths"]["/p"]) == {"get", "post"}
    assert back["paths"]["/p"]["post"]["requestBody"]["content"]["application/json"]["schema"]["required"] == ["n"]


def test_wikidata(spark):
    claim = "struct<id:string,mainsnak:struct<snaktype:string,datatype:string,datavalue:struct<type:string,value:struct<id:string>>>>"
    rows = [("Q1", {"en": ("en", "one")}, {"P31": [("c1", ("value", "wikibase-item", ("wikibase-entityid", ("Q5",)))), ("c2", ("novalue", "wikibase-item", None))]})]
    df = spark.createDataFrame(rows, f"id string, labels map<string,struct<language:string,value:string>>, claims map<string,array<{claim}>>")
    simple = graph.SimplifyProps()(graph.Simplify()(df))
    edge = graph.Relation()(graph.ObjectNameInject({"Q5": "human"})(simple)).first()
    assert (edge.subject_name, edge.relation, edge.object_id, edge.object_name) == ("one", "P31", "Q5", "human")
    assert graph.ValuesFilter(["Q6"])(simple).count() == 0 and graph.PropsFilter(["P31"])(simple).first().claims["P31"]
    from rillflow.operators import WikidataMatch

    assert WikidataMatch(P31=["Q5"], P39=False)(df).count() == 1 and WikidataMatch(P31=["Q6"])(df).count() == 0
    assert graph.Property()(df).first().pid == "P31"


def test_triples(spark):
    t = spark.createDataFrame([(0, "x", "a", "1"), (1, "x", "a", "2"), (2, "y", "b", "3"), (3, "x", "a", "4")], "o int, n string, p string, v string")
    out = graph.triplets2dict(t, "n", "p", "v", "o").collect()
    assert sorted((r["_name"], str(dict(r.properties))) for r in out) == [("x", "{'a': ['1', '2']}"), ("x", "{'a': ['4']}"), ("y", "{'b': ['3']}")]


def test_elements():
    elements = texts.text_elements("A Title\n\nSome text that ends here.\n\n- item\n\nOther Title\n\nMore text.")
    assert [e["type"] for e in elements] == ["Title", "NarrativeText", "ListItem", "Title", "NarrativeText"]
    assert len(texts.chunk_by_title(elements)) == 2
    assert all(len(x) <= 20 for x in texts.chunk_elements(elements, 20))
    assert texts.detect_language("der Hund und die Katze") == "de" and texts.detect_language("123") is None
