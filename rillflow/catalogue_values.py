"""Queries of the functions on papers, nested values and web records, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.catalogue import functions_of, query, table
from rillflow.functions import dates, papers, strings, udf_of, values

c = F.col
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents"
WORDS = "|".join(papers.SECTIONS)


@query(f"SELECT doc_id, count(*) FILTER (regexp_matches(lower(x), '(?s)^.{{0,4}}(?:{WORDS})')) AS titles, count(*) FILTER (regexp_matches(x, '^[0-9]')) AS numbers, count(*) FILTER (regexp_matches(x, '^\\p{{L}}{{1,5}}$|[,;-]$')) AS open_ends FROM ({LINES}) GROUP BY 1")
def pdf_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(papers.lines_of(c("text"))).alias("x"))
    count = lambda e: F.count(F.when(e, 1))
    return lines.groupBy("doc_id").agg(count(papers.is_section_title(c("x"))).alias("titles"), count(papers.is_num(c("x"))).alias("numbers"), count(papers.sentence_not_end(c("x"))).alias("open_ends"))


functions_of("pdf_paragraphs", "documents", {"t": lambda: papers.joined(papers.p1(papers.lines_of(c("text"))), "|")}, """
  SELECT doc_id, array_to_string(list_filter(list_transform(list_slice(parts, 1, len(parts) - 1), lambda x: replace(x, chr(10), '')), lambda x: x <> ''), '|') AS t
  FROM (SELECT doc_id, regexp_split_to_array(CASE WHEN ends_with(text, chr(10)) THEN text || chr(10) ELSE text END, '\\n\\n+') AS parts FROM documents)""", ("doc_id",))  # fmt: skip
functions_of("pdf_joined", "part", {"t": lambda: F.array_join(papers.p2(F.array(F.concat("p_name", F.lit(",")), "p_brand", F.lit("1"), "p_type")), "|")}, "SELECT p_partkey, p_name || ',' || p_brand || '|1' || p_type AS t FROM part", ("p_partkey",))


def paper():
    return papers.organize(F.array("p_name", "p_brand", F.lit("Abstract"), "p_type", F.lit("2 Method"), "p_brand", "p_name"))


functions_of("pdf_organized", "part", {"title": lambda: paper()["title"], "authors": lambda: paper()["authors"], "s": lambda: F.array_join(F.transform(paper()["sections"], lambda s: F.concat(s["title"], F.lit(":"), F.array_join(s["content"], ","))), ";")}, "SELECT p_partkey, p_name AS title, p_brand AS authors, 'Abstract:' || p_type || ';2 Method:' || p_brand || ',' || p_name AS s FROM part", ("p_partkey",))


def flat_paper():
    return F.struct(c("p_name").alias("title"), c("p_type").alias("abstract"), F.array(F.struct(c("p_brand").alias("title"), c("p_name").alias("content")), F.struct(F.lit("").alias("title"), c("p_type").alias("content"))).alias("sections"))


functions_of("paper_chunks", "part", {"chunk": lambda: papers.simple_chunk_from_paper(flat_paper()), "t": lambda: papers.paper_text(flat_paper())}, "SELECT p_partkey, '<TITLE>' || p_name || '</TITLE>' || chr(10) || '<ABSTRACT>' || p_type || '</ABSTRACT>' AS chunk, 'title: ' || p_name || chr(10) || 'abstract: ' || p_type || chr(10) || chr(10) || chr(10) || '# ' || p_brand || chr(10) || p_name || chr(10) || p_type AS t FROM part", ("p_partkey",))
functions_of("paper_sections", "part", {"t": lambda: F.array_join(udf_of(papers.process_section)(F.to_json(F.struct(F.lit("1").alias("number"), c("p_name").alias("title"), c("p_type").alias("content"), F.array(F.struct(F.lit("1.1").alias("number"), c("p_brand").alias("title"))).alias("children"))))["lines"], "|")}, "SELECT p_partkey, '1 ' || p_name || '|' || p_type || '|1.1 ' || p_brand AS t FROM part", ("p_partkey",))
functions_of("report_dates", "orders", {"day": lambda: papers.parse_created_time(F.concat(F.lit("report_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_1.docx"))), "none": lambda: papers.parse_created_time(c("o_orderpriority"))}, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS none FROM orders", ("o_orderkey",))


def chunks():
    return papers.chunk_paragraphs(F.array("p_name", "p_brand", "p_type", F.lit(" "), "p_type", "p_name", F.lit(""), F.lit(""), F.lit("alone")))


functions_of("report_groups", "part", {"n": lambda: F.size(chunks()).cast("long"), "t": lambda: F.array_join(F.transform(udf_of(papers.group_by_headings)(chunks()), lambda g: F.concat(g["title"], F.lit(">"), F.array_join(F.transform(g["nodes"], lambda x: F.concat(x["title"], F.lit("="), x["content"])), ";"))), "|")}, "SELECT p_partkey, CAST(3 AS BIGINT) AS n, p_name || '>' || p_brand || '=' || p_type || ';' || p_type || '=' || p_name AS t FROM part", ("p_partkey",))
functions_of("json_values", "events", {"k": lambda: values.json_extract(c("props"), "k"), "none": lambda: values.json_extract(c("props"), "k.x"), "merged": lambda: udf_of(values.json_merge)(c("props"), F.lit('{"z": {"a": 1}}')), "filled": lambda: udf_of(values.json_fill)(c("props"), F.lit("a.b"), c("event_type"))}, """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none, '{"k": ' || json_extract_string(props, '$.k') || ', "z": {"a": 1}}' AS merged, '{"a": {"b": "' || event_type || '"}, "k": ' || json_extract_string(props, '$.k') || '}' AS filled FROM events""", ("event_id",))
functions_of("engine_types", "nation", {"t": lambda: values.dtype_mysql(F.element_at(F.array(F.lit("varchar(20)"), F.lit("BIGINT"), F.lit("tinyint(1)"), F.lit("datetime"), F.lit("json")), c("n_regionkey") + 1))}, "SELECT n_nationkey, (['String', 'Int64', 'Int8', 'DateTime', 'json'])[n_regionkey + 1] AS t FROM nation", ("n_nationkey",))


def completion():
    message = F.struct(c("r_name").alias("content"), F.lit("hm ").alias("reasoning_content"))
    return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))


def thinking():
    return F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("<think>hm</think> "), "r_name").alias("content")).alias("message"))).alias("choices")))


functions_of("model_answers", "region", {"whole": lambda: values.parse_result(completion()), "bare": lambda: values.parse_result(completion(), True), "own": lambda: values.parse_result_local(thinking(), True), "told": lambda: values.parse_result_local(thinking())}, "SELECT r_regionkey, 'hm ' || r_name AS whole, r_name AS bare, r_name AS own, '<think>hm</think> ' || r_name AS told FROM region", ("r_regionkey",))
functions_of("web_headers", "pages", {"name": lambda: values.parse_header_line(F.concat(F.lit("Link: "), "url"))["name"], "value": lambda: values.parse_header_line(F.concat(F.lit("Link: "), "url"))["value"], "bare": lambda: values.parse_header_line(F.lit(" HTTP ok "))["value"], "named": lambda: values.get_charset(F.lit("text/html; charset=Big5")), "guessed": lambda: values.get_charset(F.lit("text/html GB2312")), "id": lambda: values.parse_id(F.concat(F.lit("<urn:uuid:"), c("page_id").cast("string"), F.lit(">")))}, "SELECT page_id, 'Link' AS name, url AS value, 'HTTP ok' AS bare, 'Big5' AS named, 'gb2312' AS guessed, CAST(page_id AS VARCHAR) AS id FROM pages", ("page_id",))
functions_of("valid_urls", "pages", {"own": lambda: values.is_valid_url(c("url"), strings.host_from_url(c("url"), False)), "page": lambda: values.is_valid_url(F.concat(F.lit("https://h.org/a."), F.when(c("page_id") % 2 == 0, "html").otherwise("pdf")), F.lit("h.org")), "other": lambda: values.is_valid_url(c("url"), F.lit("h.org"))}, r"SELECT page_id, NOT contains(regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1), '.') OR regexp_matches(regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1), '\.(html|htm|php|asp|aspx|jsp)$') AS own, page_id % 2 = 0 AS page, false AS other FROM pages", ("page_id",))
functions_of("moved_indices", "part", {"t": lambda: udf_of(values.clean_extra_whitespace_with_index_run)(F.concat(F.lit("  "), "p_name", F.lit("   x\n")))["text"], "n": lambda: udf_of(values.clean_extra_whitespace_with_index_run)(F.concat(F.lit("  "), "p_name", F.lit("   x\n")))["moved"][F.length("p_name") + 1].cast("long")}, "SELECT p_partkey, p_name || ' x' AS t, CAST(4 AS BIGINT) AS n FROM part", ("p_partkey",))
functions_of("host_names", "documents", {"v": lambda: F.array_join(strings.extract_ip_address_name(c("text")), "|")}, rf"SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '{strings.HOST}'), '|'), '') AS v FROM documents", ("doc_id",))
functions_of("mail_times", "events", {"t": lambda: F.unix_seconds(strings.extract_datetimetz(F.concat(F.lit("Date: Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0100 (x)")))), "none": lambda: strings.extract_datetimetz(c("event_type")).isNull()}, "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 3600 AS t, true AS none FROM events", ("event_id",))
functions_of("bullet_paragraphs", "part", {"t": lambda: F.array_join(strings.group_bullet_paragraph(F.concat(F.lit("• "), "p_name", F.lit("\n  "), "p_type", F.lit("\n• "), "p_type")), "|")}, "SELECT p_partkey, '• ' || p_name || ' ' || p_type || ' |• ' || p_type AS t FROM part", ("p_partkey",))
functions_of("beijing_times", "events", {"custom": lambda: dates.custom_datetime_to_beijing_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "%Y-%m-%d %H:%M:%S"), "native": lambda: dates.native_datetime_to_beijing_timestamp(F.concat(F.date_format("ts", "MMMM d, yyyy hh:mm:ss a"), F.lit(" IST")))}, "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 AS custom, (CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 19800) * 1000 AS native FROM events", ("event_id",))
functions_of("document_trees", "region", {"t": lambda: udf_of(values.adjusted)(F.to_json(F.struct(F.lit("root").alias("title"), F.array(F.struct(F.lit("1").alias("number"), c("r_name").alias("title")), F.struct(F.lit("1.1").alias("number"), F.lit("sub").alias("title")), F.struct(F.lit("2").alias("number"), F.lit("next").alias("title"))).alias("children"))))}, """SELECT r_regionkey, '{"title": "root", "children": [{"number": "1", "title": "' || r_name || '", "children": [{"number": "1.1", "title": "sub"}]}, {"number": "2", "title": "next"}]}' AS t FROM region""", ("r_regionkey",))
functions_of("normal_letters", "region", {"t": lambda: values.normalize_text(F.concat(F.lit("ﬁＡ１"), "r_name")), "f": lambda: strings.format(F.lit("{a}-{b}"), a=c("r_name"), b=1)}, "SELECT r_regionkey, 'fiA1' || r_name AS t, r_name || '-1' AS f FROM region", ("r_regionkey",))
