"""Queries that write a test table with a sink and read it again with a source, and sources of other kinds."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile
from email.message import EmailMessage

from pyspark.sql import functions as F

from rillflow import operators as O
from rillflow import sources as S
from rillflow.catalogue import query, table
from rillflow.functions import strings
from rillflow.records import checkpointed, plain

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def scratch(spark, name: str = "") -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/io-{uuid.uuid4().hex}{'/' + name if name else ''}"


def local(path: str) -> str:
    """The same folder as a path of the file system; for sinks that open files themselves."""
    path = path.removeprefix("file:")
    return "/" + path.lstrip("/")


def put(spark, name: str, content: bytes) -> str:
    """A small file in a new folder; its folder."""
    folder = local(scratch(spark))
    os.makedirs(folder)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(content)
    return f"file://{folder}"


@query(CUSTOMER)
def io_json_lines(spark, d):
    at = scratch(spark)
    O.WriteJson(at)(table(spark, d, "customer"))
    return S.JsonLine(at, schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")(spark)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def io_json_gzip(spark, d):
    at = scratch(spark, "orders.json.gz")
    O.WriteJson(at)(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))
    return S.JsonLine(at, schema="o_orderkey long, o_orderdate string")(spark)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io_csv(spark, d):
    at = scratch(spark)
    O.WriteCSV(at)(table(spark, d, "customer"))
    return S.CSV(at)(spark).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("SELECT c_name, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def io_csv_keys(spark, d):
    at = scratch(spark)
    O.WriteCSV(at, "c_name", "c_custkey", seperator="|")(table(spark, d, "customer"))
    return S.CSV(at, sep="|")(spark)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS \"name, with comma\" FROM nation")
def io_csv_skip(spark, d):
    rows = table(spark, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit(","), r["n_name"])), "\n").alias("v"))
    at = scratch(spark)
    O.WriteText(at)(rows.select(F.concat(F.lit('a note\nand another\nk,"name, with comma"\n'), "v")).coalesce(1))
    return S.CSV(at, skip_rows=2)(spark)


@query("SELECT r_name AS value FROM region")
def io_text(spark, d):
    at = scratch(spark)
    O.WriteText(at)(table(spark, d, "region").select(F.concat(F.lit("  "), "r_name")))
    return S.Text(at)(spark)


@query("SELECT string_agg(r_name, '|' ORDER BY r_name) AS v, CAST(count(*) AS BIGINT) AS n FROM region")
def io_text_whole(spark, d):
    at = scratch(spark)
    O.WriteText(at, sep="|")(table(spark, d, "region").select("r_name").orderBy("r_name").coalesce(1))
    return S.TextPlain(at)(spark).select(F.regexp_replace("value", r"\|$", "").alias("v")).withColumn("n", F.size(F.split("v", r"\|")).cast("long"))


@query(CUSTOMER)
def io_parquet(spark, d):
    at = scratch(spark)
    O.WriteParquet(at)(table(spark, d, "customer"))
    return S.Parquet(at)(spark)


@query("SELECT replace(n_name, '/', '%2F') || '.txt' AS filename, n_name || ' text' AS data FROM (SELECT n_name || '/' || CAST(n_nationkey AS VARCHAR) AS n_name FROM nation)")
def io_files(spark, d):
    at = scratch(spark)
    O.WriteFiles(local(at), "name", "body", suffix=".txt")(table(spark, d, "nation").select(F.concat("n_name", F.lit("/"), F.col("n_nationkey").cast("string")).alias("name")).withColumn("body", F.concat("name", F.lit(" text"))))
    return S.Directory(f"file://{local(at)}", ".txt", data_format="text")(spark)


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(ceil(count(*) / 100.0) AS BIGINT) AS files FROM orders")
def io_json_scroll(spark, d):
    at = scratch(spark)
    O.WriteJsonScroll(at, scroll=100)(table(spark, d, "orders").select("o_orderkey"))
    rows = S.JsonLine(at, schema="o_orderkey long")(spark).withColumn("f", F.input_file_name())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("f").alias("files"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'passed' ELSE 'written' END AS place FROM orders")
def io_json_if(spark, d):
    at = scratch(spark)
    passed = O.WriteJsonIf(O.Filter("lambda r: r['o_orderstatus'] == 'O'"), at)(table(spark, d, "orders"))
    written = S.JsonLine(at, schema="o_orderkey long")(spark).withColumn("place", F.lit("written"))
    return passed.select("o_orderkey", F.lit("passed").alias("place")).unionByName(written)


def json_objects(spark, d, sep: str, around: str = "%s") -> str:
    rows = table(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name")))), sep).alias("v"))
    at = scratch(spark)
    O.WriteText(at)(rows.select(F.format_string(around, "v")).coalesce(1))
    return at


@query("SELECT n_nationkey, n_name FROM nation")
def io_json_array(spark, d):
    return S.JsonArray(json_objects(spark, d, ",\n", "[%s]"), schema="n_nationkey int, n_name string")(spark)


@query("SELECT n_nationkey, n_name FROM nation")
def io_json_whole(spark, d):
    rows = S.Json(json_objects(spark, d, ",\n", '{"rows": [%s]}'), schema="rows array<struct<n_nationkey:int,n_name:string>>")(spark)
    return rows.select(F.inline("value.rows"))


@query("SELECT n_nationkey, n_name FROM nation")
def io_json_free(spark, d):
    rows = S.JsonFree(json_objects(spark, d, "\n"))(spark)
    return rows.select(F.try_variant_get("value", "$.n_nationkey", "int").alias("n_nationkey"), F.try_variant_get("value", "$.n_name", "string").alias("n_name"))


@query("SELECT n_nationkey, n_name FROM nation")
def io_binary(spark, d):
    rows = S.BinaryFile(json_objects(spark, d, ",", "[%s]"))(spark).filter(F.length("value") > 0)
    return rows.select(F.inline(F.from_json(F.decode("value", "UTF-8"), "array<struct<n_nationkey:int,n_name:string>>")))


def archived(spark, d, pack) -> str:
    """The regions as files of an archive; five rows, which the driver packs."""
    return put(spark, "regions.bin", pack([(f"{r['r_regionkey']}.txt", r["r_name"].encode()) for r in table(spark, d, "region").collect()]))


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


FILES = "SELECT CAST(r_regionkey AS VARCHAR) || '.txt' AS filename, r_name AS data FROM region"


@query(FILES)
def io_zip(spark, d):
    return S.Zip(archived(spark, d, zipped))(spark).select("filename", F.decode("data", "UTF-8").alias("data"))


@query(FILES)
def io_tar(spark, d):
    return S.Tar(archived(spark, d, tarred))(spark).select("filename", F.decode("data", "UTF-8").alias("data"))


@query("SELECT s_name AS subject, 'n' || CAST(s_suppkey AS VARCHAR) || '@example.org' AS sender, 'hello ' || s_name AS text FROM supplier")
def io_mail(spark, d):
    at = local(scratch(spark))
    mails = table(spark, d, "supplier").select("s_name", F.concat(F.lit("n"), F.col("s_suppkey").cast("string"), F.lit("@example.org")).alias("a"), F.col("s_suppkey").cast("string").alias("id"))

    @F.pandas_udf("binary")
    def written(name, sender):
        def one(n, a):
            m = EmailMessage()
            m["Subject"], m["From"], m["To"] = n, a, "all@example.org"
            m.set_content(f"hello {n}")
            return m.as_bytes()

        return name.combine(sender, one)

    O.WriteFiles(at, "id", "mail", suffix=".eml")(mails.withColumn("mail", written("s_name", "a")))
    return S.EML(f"file://{at}")(spark).select("subject", F.col("from")[0]["a"].alias("sender"), F.trim(F.regexp_replace("text", r"\s+$", "")).alias("text"))


def warc(kind: str, rows) -> bytes:
    out = b""
    for k, (url, body) in enumerate(rows):
        out += f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    return out


@query("SELECT 'http://h/' || CAST(r_regionkey AS VARCHAR) AS url, '2024-01-02T03:04:05Z' AS date, '<p>' || r_name || '</p>' AS body FROM region")
def io_warc(spark, d):
    rows = [(f"http://h/{r['r_regionkey']}", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + f"<p>{r['r_name']}</p>".encode()) for r in table(spark, d, "region").collect()]
    return S.Warc(put(spark, "a.warc", warc("response", rows)))(spark).select("url", "date", F.trim(F.regexp_replace("body", r"\s+$", "")).alias("body"))


@query("SELECT 'http://h/' || CAST(r_regionkey AS VARCHAR) AS url, r_name AS title, 'about ' || r_name AS text FROM region")
def io_wet(spark, d):
    rows = [(f"http://h/{r['r_regionkey']}", f"{r['r_name']}\nabout {r['r_name']}\n".encode()) for r in table(spark, d, "region").collect()]
    return S.WET(put(spark, "a.wet", warc("conversion", rows)))(spark).select("url", "title", "text")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey <> 3")
def io_sqlite(spark, d):
    at = local(scratch(spark))
    os.makedirs(at)
    db = S.SQLite(f"{at}/test.db", "nation")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    O.DatabaseWriter(db)(rows.withColumn("name", F.lit("old")))
    O.DatabaseWriter(db)(rows)
    db.delete(spark, [3])
    return db.scroll(spark).select(F.col("id").cast("int").alias("id"), "name", F.col("region").cast("int").alias("region"))


@query("SELECT n_name, CAST(1 AS INTEGER) AS source FROM nation UNION ALL SELECT r_name, 0 FROM region")
def sources_in_turn(spark, d):
    class Names(S.Source):
        def __init__(self, name, field):
            self.name, self.field = name, field

        def __call__(self, spark):
            return table(spark, d, self.name).select(plain(self.field).alias("n_name"))

    return S.MultiLoader(Names("region", "r_name"), Names("nation", "n_name"))(spark).withColumnRenamed("_source", "source")


@query("SELECT CAST(v AS BIGINT) AS value, 'array' AS kind FROM (VALUES (1), (2), (3)) t(v) UNION ALL SELECT v, 'function' FROM (VALUES (0), (1), (4)) t(v) UNION ALL SELECT v, 'text' FROM (VALUES (7), (8)) t(v) UNION ALL SELECT v, 'timed' FROM (VALUES (5), (5)) t(v)")
def sources_of_values(spark, d):
    one = lambda df, kind: df.select(F.col("value").cast("long").alias("value"), F.lit(kind).alias("kind"))
    out = one(S.Array([1, 2, 3])(spark), "array").unionByName(one(S.FunctionSource(lambda: (k * k for k in range(3)))(spark), "function"))
    return out.unionByName(one(S.String("7|8", "|")(spark), "text")).unionByName(one(S.TimedLoader(S.Array([5]), num_of_times=2)(spark), "timed"))


@query("SELECT CAST(1000 AS BIGINT) AS n, true AS inside")
def sources_random(spark, d):
    return S.Random(1000, seed=3)(spark).agg(F.count(F.lit(1)).alias("n"), (F.min("value") >= 0).alias("inside"))


@query("SELECT p_partkey, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('blue', 'green', 'red'))) AS BIGINT) AS n FROM part")
def io_stopwords(spark, d):
    at = scratch(spark)
    O.WriteText(at)(spark.createDataFrame([("blue",), ("green",), (" red ",), ("",)], "v string"))
    words = strings.load_stopwords(spark, at)
    return table(spark, d, "part").select("p_partkey", F.size(F.filter(F.split("p_name", " "), lambda x: ~x.isin(sorted(words)))).cast("long").alias("n"))

