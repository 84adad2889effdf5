"""Texts of papers: lines and sections of plain text, and flat papers from trees. Columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import column, python

#: Words that open a section: fixed values.
SECTIONS = (
    "abstract", "summary", "introduction", "background", "task formulation", "method", "related work", "experiments", "results", "discussion", "conclusion", "references", "appendix",
    "摘要", "引言", "背景", "相关工作", "方法", "实验", "结果", "讨论", "结论", "参考文献", "附录",
)
#: Parts of a report that are no news of their own: fixed values.
BANNER, SLOGAN = "内部资料 仅供参考", ("检测微弱信号", "为未来挑战做好准备")


@column
def is_section_title(c):
    """Whether a section word begins within the first five characters, whatever the case."""
    return F.lower(c).rlike(r"(?s)^.{0,4}(?:" + "|".join(SECTIONS) + ")")


@column
def is_num(c):
    """Whether a line begins with a heading's number."""
    return c.rlike(r"^\d")


@column
def sentence_not_end(c):
    """Whether a line goes on in the next: a short word, or an end in comma, hyphen or semicolon."""
    return c.rlike(r"^\p{L}{1,5}$|[,;-]$")


@column
def lines_of(c):
    return F.split(c, "\n", -1)


@column
def joined(c, sep="\n"):
    return F.array_join(c, sep)


@column
def p1(c):
    """Lines as paragraphs: those up to an empty one are put together. What no empty line ends is left out."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    ended = lambda s: F.struct(F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.lit("").alias("open"))
    return F.aggregate(c, start, lambda s, x: F.when(x == "", ended(s)).otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], x).alias("open"))), lambda s: s["done"])


@column
def p2(c):
    """Paragraphs with what belongs to them: after a number, or where the one before does not end and no section begins."""
    last = lambda s: F.element_at(s, -1)
    goes_on = lambda s, x: is_num(last(s)) | (~is_section_title(x) & sentence_not_end(last(s)))
    grown = lambda s, x: F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.concat(last(s), x)))
    return F.aggregate(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1), lambda s, x: F.when(goes_on(s, x), grown(s, x)).otherwise(F.concat(s, F.array(x))))


@column
def organize(c):
    """{title, authors, sections: [{title, content}]} of paragraphs: the first two, then what stands below each section title."""
    rest = F.slice(c, F.lit(3), F.greatest(F.size(c) - 2, F.lit(0)))
    opened = lambda t: F.array(F.struct(t.alias("title"), F.array().cast("array<string>").alias("content")))
    grown = lambda s, x: F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["title"].alias("title"), F.concat(F.element_at(s, -1)["content"], F.array(x)).alias("content"))))
    none = F.array().cast("array<struct<title:string,content:array<string>>>")
    sections = F.aggregate(rest, none, lambda s, x: F.when(is_section_title(x), F.concat(s, opened(x))).when(F.size(s) > 0, grown(s, x)).otherwise(s))
    return F.struct(F.get(c, F.lit(0)).alias("title"), F.get(c, F.lit(1)).alias("authors"), sections.alias("sections"))


@column
def simple_chunk_from_paper(c, fields=("title", "abstract")):
    """The named fields of a paper, each in its tags."""
    return F.array_join(F.array(*(F.concat(F.lit(f"<{f.upper()}>"), F.coalesce(c[f].cast("string"), F.lit("None")), F.lit(f"</{f.upper()}>")) for f in fields)), "\n")


@column
def paper_text(c):
    """Title, abstract and sections of a paper STRUCT<title, abstract, sections: ARRAY<STRUCT<title, content>>> as one text."""
    headed = F.transform(c["sections"], lambda s: F.concat_ws("\n", F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(F.lit("# "), s["title"])), F.coalesce(s["content"], F.lit(""))))
    return F.array_join(F.concat(F.array_compact(F.array(F.concat(F.lit("title: "), c["title"]), F.concat(F.lit("abstract: "), c["abstract"]), F.lit("\n"))), F.coalesce(headed, F.array().cast("array<string>"))), "\n")


@python("struct<lines:array<string>,tables:array<string>>")
def process_section(text):
    """The headings and texts of a section's tree, given as JSON, from top to bottom."""
    import json

    open_nodes, lines = [json.loads(text)], []
    while open_nodes:
        node = open_nodes.pop()
        lines.append(f"{node['number']} {node.get('title')}" if node.get("number") else node.get("title"))
        if node.get("content"):
            lines.append(node["content"])
        open_nodes += reversed(node.get("children") or [])
    return {"lines": lines, "tables": []}


# --- reports


@column
def parse_created_time(c):
    """The first eight digits of a name as a date; null where there are none."""
    digits = F.regexp_extract(c, r"\d{8}", 0)
    return F.date_format(F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd"), "yyyy-MM-dd")


@column
def is_empty_paragraph(c):
    return F.trim(c) == ""


@column
def chunk_paragraphs(c):
    """Runs of paragraphs between empty ones."""
    none = F.array().cast("array<array<string>>")
    start = F.struct(none.alias("done"), F.array().cast("array<string>").alias("open"))
    ended = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    step = lambda s, x: F.when(is_empty_paragraph(x), F.struct(ended(s).alias("done"), F.array().cast("array<string>").alias("open"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(x)).alias("open")))
    return F.aggregate(c, start, step, ended)


@python("array<struct<title:string,nodes:array<struct<title:string,content:string>>>>")
def group_by_headings(chunks):
    """Chunks of three lines begin a group: its title, then a first node; other chunks of two or more lines are nodes of it."""
    groups = []
    for first, *rest in (list(c) for c in chunks if len(c)):
        begins = len(rest) == 2 and rest[1] != BANNER
        if begins:
            groups.append({"title": first, "nodes": []})
            first, rest = rest[0], rest[1:]
        node = {"title": first, "content": "\n".join(rest)}
        if groups and rest and (begins or (node["title"] != SLOGAN[0] and node["content"] != SLOGAN[1])):
            groups[-1]["nodes"].append(node)
    return groups
