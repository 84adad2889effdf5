"""Nested values, as flows handle them in functions of their own: paths, merging, model answers, web records, trees."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from rillflow.functions import column, python


def split_path(path) -> list:
    return path.split(".") if isinstance(path, str) else list(path)


def extract(value: dict, path):
    """What stands at a path of a dictionary; None where the path ends early."""
    for key in split_path(path):
        if not isinstance(value, dict) or key not in value:
            return None
        value = value[key]
    return value


def fill(target: dict, path, value) -> dict:
    """Write a value at a path, with dictionaries made on the way; returns the dictionary."""
    *way, last = split_path(path)
    at = target
    for key in way:
        at = at.setdefault(key, {})
    at[last] = value
    return target


copy_val = copy.deepcopy


def merge_dicts(target: dict, source: dict) -> dict:
    """The source's values over the target's; where both have a dictionary, within it. Returns the target."""
    for key, value in source.items():
        if isinstance(target.get(key), dict) and isinstance(value, dict):
            merge_dicts(target[key], value)
        else:
            target[key] = copy_val(value)
    return target


@python("string")
def json_merge(a, b):
    """Two JSON objects merged, the second over the first, keys in order."""
    return json.dumps(merge_dicts(json.loads(a), json.loads(b)), ensure_ascii=False, sort_keys=True)


@python("string")
def json_fill(text, path, value):
    """A JSON object with a text at a path, keys in order."""
    return json.dumps(fill(json.loads(text), path, value), ensure_ascii=False, sort_keys=True)


@column
def json_extract(c, path):
    """What stands at a path of a JSON text, as text."""
    return F.get_json_object(c, "$." + ".".join(split_path(path)))


#: Engine types of column types: fixed values.
ENGINE_TYPES = {"int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "text": "String", "varchar": "String", "char": "String", "date": "Date", "datetime": "DateTime", "tinyint": "Int8"}


@column
def dtype_mysql(c):
    """The engine type of a column type; lengths do not count, and an unknown type stays."""
    base = F.lower(F.regexp_extract(c, r"^\w+", 0))
    table = F.create_map(*[F.lit(x) for pair in ENGINE_TYPES.items() for x in pair])
    known = F.try_element_at(table, F.when(c.rlike("(?i)^(varchar|char|tinyint)"), base).otherwise(F.lower(c)))
    return F.coalesce(known, c)


# --- answers of language models


@column
def parse_result(c, remove_think=False):
    """The answer in a chat completion's JSON, after its reasoning where it has one and that is not removed."""
    at = lambda f: F.get_json_object(c, f"$.choices[0].message.{f}")
    return at("content") if remove_think else F.concat(F.coalesce(at("reasoning_content"), F.lit("")), at("content"))


@column
def parse_result_local(c, remove_think=False):
    """The same of servers that write the reasoning into the answer, up to </think>."""
    text = F.coalesce(F.get_json_object(c, "$.choices[0].message.content"), F.lit(""))
    return F.when(F.contains(text, F.lit("</think>")), F.trim(F.substring_index(text, "</think>", -1))).otherwise(text) if remove_think else text


# --- web records


@column
def parse_header_line(c):
    """{name, value} of a header line; without a colon all of it is the value."""
    named = F.instr(c, ":") > 1
    return F.struct(F.when(named, F.substring_index(c, ":", 1)).alias("name"), F.trim(F.when(named, F.regexp_replace(c, r"^[^:]+:", "")).otherwise(c)).alias("value"))


#: Charsets that are looked for in a content type, in this order: fixed values.
CHARSETS = ("utf-8", "ascii", "big5", "iso-8859-1", "gb2312", "windows-1251")


@column
def guess_charset(c):
    """The first known charset that a text names."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(x)), F.lit(x)) for x in CHARSETS))


@column
def get_charset(c):
    """The charset of a content type, named or guessed."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?:^|;)\s*charset=([^;]*?)\s*(?:;|$)", 1), F.lit("")), guess_charset(F.lower(c)))


@column
def parse_id(c):
    """A record's id without its wrapping."""
    return F.replace(F.replace(c, F.lit("<urn:uuid:"), F.lit("")), F.lit(">"), F.lit(""))


#: Endings of paths that are no pages, and those of pages: fixed values.
NO_PAGES = ("jpg", "jpeg", "png", "gif", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4", "avi", "mov", "zip", "rar", "exe", "dmg")
PAGES = ("html", "htm", "php", "asp", "aspx", "jsp")


@column
def is_valid_url(c, domain):
    """Whether an address is a page of a domain."""
    path = F.lower(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")))
    leaf = F.substring_index(path, "/", -1)
    page = ~F.contains(leaf, F.lit(".")) | F.substring_index(path, ".", -1).isin(*PAGES)
    here = F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https") & (F.try_parse_url(c, F.lit("HOST")) == domain)
    return F.coalesce(here & page & ~path.rlike(r"\.(?:" + "|".join(NO_PAGES) + ")$"), F.lit(False))


# --- texts


@column
def normalize_text(c):
    """Compatibility characters as common ones."""
    return nfkc_udf()(c)


def nfkc_udf():
    from rillflow.functions import udf_of

    return udf_of(nfkc)


@python("string")
def nfkc(text):
    import unicodedata

    return unicodedata.normalize("NFKC", text)


@python("struct<text:string,moved:array<int>>")
def clean_extra_whitespace_with_index_run(text):
    """The text with single blanks, and for each of its characters how many were left out before it; the rest repeats the last."""
    kept, moved = [], []
    for at, x in enumerate(" " if x in "\xa0\n" else x for x in text):
        if x != " " or (kept and kept[-1] != " "):
            kept.append(x)
            moved.append(at - len(kept) + 1)
    end = len("".join(kept).rstrip(" "))
    last = moved[end - 1] if end else 0
    return {"text": "".join(kept[:end]), "moved": moved[:end] + [last] * (len(text) - end)}


def index_adjustment_after_clean_extra_whitespace(index: int, moved) -> int:
    return int(index - moved[index])


# --- trees


class Node:
    """A heading of a document: its number, its text and what stands below it."""

    def __init__(self, payload: dict, parent: Node | None = None):
        self.payload, self.number, self.parent = payload, payload.get("number"), parent
        self.children = [Node(c, self) for c in payload.get("children") or []]

    def as_dict(self) -> dict:
        out = {k: v for k, v in self.payload.items() if k != "children"}
        return out | ({"children": [c.as_dict() for c in self.children]} if self.children else {})


def find_parent(open_nodes: list[Node], number: str) -> Node:
    """The last open heading whose number leads to this one; the root, which comes first, where there is none."""
    inside = lambda n: n.number and number.startswith(n.number.rstrip(".") + ".")
    return next((n for n in reversed(open_nodes) if inside(n)), open_nodes[0])


def adjust_tree(root: Node) -> Node:
    """The headings again, each below the one whose number leads to its own; headings without a number stay where they are."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.children)
    seen = [root]
    for node in order[1:]:
        if node.number:
            node.parent.children.remove(node)
            node.parent = find_parent(seen, node.number)
            node.parent.children.append(node)
        seen.append(node)
    return root


@python("string")
def adjusted(text):
    """A document tree in JSON, adjusted."""
    return json.dumps(adjust_tree(Node(json.loads(text))).as_dict(), ensure_ascii=False)
