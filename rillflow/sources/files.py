"""Readers of files, each a class as flows name it: ``Source(...)(spark)`` gives a DataFrame.

Native readers wherever Spark has one. What has none is read as binary files and parsed within tasks, a file at a time.
"""

from __future__ import annotations

import bz2
import email
import email.policy
import gzip
import io
import itertools
import json
import lzma
import re
import sqlite3
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.records import ORD, Rejects, plain

__all__ = ["CSV", "EML", "MSG", "OST", "PDF", "PPT", "PST", "WET", "Archive", "Array", "BinaryFile", "Directory", "Doc", "Docx", "Excel", "ExcelStream", "FunctionSource", "GdeltTable", "Input", "Json", "JsonArray", "JsonFree", "JsonLine", "MultiLoader", "PPTX", "Parquet", "QueueLoader", "Random", "Rar", "SevenZip", "Source", "String", "Tar", "Text", "TextPlain", "TimedLoader", "Warc", "WikiXml", "WikidataDump", "Yaml", "Zip", "file_source", "parse_files"]


class Source:
    """A source: called with a session it returns a DataFrame."""

    def __call__(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


class Array(Source):
    """The elements of a list, with their position; dictionaries become records."""

    def __init__(self, data: list, schema: str | None = None):
        self.data, self.schema = data, schema

    def __call__(self, spark):
        if self.schema:
            return spark.createDataFrame(self.data, self.schema)
        if self.data and isinstance(self.data[0], dict):
            keys = list(dict.fromkeys(k for r in self.data for k in r))
            rows = [(k, *(r.get(c) for c in keys)) for k, r in enumerate(self.data)]
            return spark.createDataFrame(rows, [ORD, *keys])
        return spark.createDataFrame([(k, v) for k, v in enumerate(self.data)], [ORD, "value"])


class String(Source):
    """The pieces of a text; empty ones are kept."""

    def __init__(self, text: str, sep: str = "\n"):
        self.text, self.sep = text, sep

    def __call__(self, spark):
        return spark.range(1).select(F.posexplode(F.split(F.lit(self.text), re.escape(self.sep), -1)).alias(ORD, "value"))


class Random(Source):
    """Uniform numbers; 0 of them is a stream without end."""

    def __init__(self, num_of_times: int = 0, seed: int | None = None):
        self.n, self.seed = num_of_times, seed

    def __call__(self, spark):
        rows = spark.range(self.n) if self.n else spark.readStream.format("rate").load()
        return rows.select(F.rand(self.seed).alias("value"))


class TimedLoader(Source):
    """Another source read a number of times. An endless one is a stream: see ``rillflow.streaming.polled``."""

    def __init__(self, that: Source, interval: int = 15, num_of_times: int = 1):
        self.that, self.interval, self.n = that, interval, num_of_times

    def __call__(self, spark):
        out = self.that(spark)
        for _ in range(max(0, self.n - 1)):
            out = out.unionByName(self.that(spark))
        return out


class FunctionSource(Source):
    """What a function returns: a generator gives a record for each item, anything else is one record."""

    def __init__(self, function: Callable, *args, **kwargs):
        self.function, self.args, self.kwargs = function, args, kwargs

    def __call__(self, spark):
        out = self.function(*self.args, **self.kwargs)
        return Array(list(out) if isinstance(out, Iterator) else [out])(spark)


class MultiLoader(Source):
    """Sources one after the other; columns that one lacks are null."""

    def __init__(self, *loaders: Source):
        self.loaders = loaders

    def __call__(self, spark):
        total = None
        for k, loader in enumerate(self.loaders):
            one = loader(spark).withColumn("_source", F.lit(k))
            total = one if total is None else total.unionByName(one, allowMissingColumns=True)
        return total


class _File(Source):
    def __init__(self, input_file: str | list, encoding: str = "utf8", **options):
        self.path, self.encoding, self.options = input_file, encoding, options


class BinaryFile(_File):
    def __call__(self, spark):
        return spark.read.format("binaryFile").load(self.path).select(F.col("content").alias("value"))


class TextPlain(_File):
    """A file as one text."""

    def __call__(self, spark):
        return spark.read.text(self.path, wholetext=True)


class Text(_File):
    """Lines without the white space around them."""

    def __call__(self, spark):
        return spark.read.text(self.path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


class Json(_File):
    """A file as one value, a VARIANT, or by a schema."""

    def __call__(self, spark):
        text = spark.read.text(self.path, wholetext=True)
        schema = self.options.get("schema")
        return text.select((F.from_json("value", schema) if schema else F.parse_json("value")).alias("value"))


class JsonArray(_File):
    """The elements of a JSON array."""

    def __call__(self, spark):
        reader = spark.read.option("multiLine", "true")
        return (reader.schema(self.options["schema"]) if self.options.get("schema") else reader).json(self.path)


class JsonLine(_File):
    """A value on each line; lines that are none are left out."""

    def __call__(self, spark):
        reader = spark.read.option("mode", "DROPMALFORMED")
        return (reader.schema(self.options["schema"]) if self.options.get("schema") else reader).json(self.path)


class JsonFree(_File):
    """Values on as many lines as they like, as VARIANT."""

    def __call__(self, spark):
        from rillflow.functions import udf_of
        from rillflow.functions.texts import json_free

        text = spark.read.text(self.path, wholetext=True)
        return text.select(F.explode(udf_of(json_free)(plain("value"))).alias("value")).select(F.parse_json("value").alias("value"))


class Yaml(_File):
    """A document as a VARIANT."""

    def __call__(self, spark):
        @F.pandas_udf("string")
        def load(s: pd.Series) -> pd.Series:
            import yaml

            return s.map(lambda t: json.dumps(yaml.safe_load(t), default=str, ensure_ascii=False))

        return spark.read.text(self.path, wholetext=True).select(F.parse_json(load("value")).alias("value"))


class CSV(_File):
    """Values stay text; a short row has nulls. skip_rows: lines before the header."""

    def __init__(self, input_file, sep: str = ",", header: bool = True, skip_rows: int = 0, **options):
        super().__init__(input_file)
        self.sep, self.header, self.skip, self.options = sep, header, skip_rows, options

    def __call__(self, spark):
        if not self.skip:
            return spark.read.csv(self.path, sep=self.sep, header=self.header, quote='"', escape='"', multiLine=True, **self.options)

        skip, sep, header = self.skip, self.sep, self.header

        def rows(name, content):
            import csv

            lines = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf8", newline=""), delimiter=sep)
            names = None
            for line in itertools.islice(lines, skip, None):
                if names is None:
                    names = line if header else [f"_c{k}" for k in range(len(line))]
                    if header:
                        continue
                yield {"names": names, "row": dict(zip(names, line, strict=False))}

        table = parse_files(spark, self.path, rows, "names array<string>, row map<string,string>")
        # a row for each header that occurs; columns in the order of the files that have the most
        headers = [r[0] for r in table.groupBy("names").count().orderBy(F.desc(F.size("names")), "names").select("names").collect()]
        return table.select(*[F.try_element_at("row", F.lit(k)).alias(k) for k in dict.fromkeys(n for h in headers for n in h)])


class Parquet(_File):
    def __call__(self, spark):
        return spark.read.parquet(self.path)


def parse_files(spark: SparkSession, path: str | list, parser: Callable, schema: str, glob: str | None = None, recursive: bool = False, strict: bool = False) -> DataFrame:
    """Rows that parser(name, bytes) yields for each file, as dictionaries.

    A file that cannot be parsed ends with what it gave so far, and ``records.rejected`` counts it; strict: the job fails.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    kind, count = T._parse_datatype_string(schema), Rejects.of(spark)

    def each(name, content):
        try:
            yield from parser(name, content)
        except Exception as e:
            if strict:
                raise
            print(f"{name}: {e}")
            count.add(1)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = each(name, bytes(content))
                while some := list(itertools.islice(rows, 1000)):
                    yield pd.DataFrame(some, columns=kind.names)

    return reader.load(path).select("path", "content").mapInPandas(run, kind)


SUFFIXES = {"txt": Text, "csv": CSV, "tsv": CSV, "json": Json, "jsonl": JsonLine, "jsona": JsonArray, "jsonf": JsonFree, "yaml": Yaml, "yml": Yaml, "md": TextPlain, "html": TextPlain, "raw": BinaryFile, "parquet": Parquet}


def file_source(kind: str, *args, **kwargs) -> Source:
    """The source of a suffix."""
    more = {"doc": Doc, "ppt": PPT, "pst": PST, "ost": OST, "msg": MSG, "rar": Rar, "eml": EML, "zip": Zip, "tar": Tar, "7z": SevenZip, "xls": Excel, "xlsx": Excel, "docx": Docx, "pptx": PPTX, "pdf": PDF, "warc": Warc, "wet": WET}
    return {**SUFFIXES, **more}[kind.lstrip(".").lower()](*args, **kwargs)


class Directory(Source):
    """Files by their suffixes: {filename, data}, or only {filename, filepath}. data: bytes, or text for text files."""

    def __init__(self, path: str | list, *suffix: str, recursive: bool = False, type_mapping: dict | None = None, filename_only: bool = False, data_format: str | None = None, **kwargs):
        self.path, self.suffix, self.recursive, self.names_only, self.format = path, suffix, recursive, filename_only, data_format

    def __call__(self, spark):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).option("ignoreCorruptFiles", "true")
        if self.suffix and "all" not in self.suffix:
            reader = reader.option("pathGlobFilter", "*{" + ",".join(s if s.startswith(".") else f".{s}" for s in self.suffix) + "}")
        files = reader.load(self.path)
        name = F.substring_index("path", "/", -1).alias("filename")
        if self.names_only:
            return files.select(name, F.col("path").alias("filepath"))
        return files.select(name, (F.decode("content", "UTF-8") if self.format == "text" else F.col("content")).alias("data"))


class Archive(Source):
    """Members of archives by their suffixes: {filename, data}."""

    def __init__(self, path: str, *suffix: str, password: str | None = None, inner_file: str | None = None, **kwargs):
        self.path, self.suffix, self.password, self.inner = path, suffix, password, inner_file

    @staticmethod
    def members(content: bytes, password: str | None):
        raise NotImplementedError

    def __call__(self, spark):
        members, password, inner = type(self).members, self.password, self.inner
        wanted = tuple(s if s.startswith(".") else f".{s}" for s in self.suffix if s != "all")

        def rows(name, content):
            for member, data in members(content, password):
                if (not inner or member == inner) and (not wanted or member.endswith(wanted)):
                    yield {"filename": member, "data": data}

        return parse_files(spark, self.path, rows, "filename string, data binary")


class Zip(Archive):
    @staticmethod
    def members(content, password):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info, pwd=password.encode() if password else None)


class Tar(Archive):
    """Tar, plain or compressed by gz, bz2 or xz."""

    @staticmethod
    def members(content, password):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read()


class SevenZip(Archive):
    @staticmethod
    def members(content, password):
        import py7zr

        with py7zr.SevenZipFile(io.BytesIO(content), password=password) as z:
            for name, data in (z.readall() or {}).items():
                yield name, data.read()


class Rar(Archive):
    @staticmethod
    def members(content, password):
        import rarfile

        with rarfile.RarFile(io.BytesIO(content)) as r:
            for info in r.infolist():
                if not info.isdir():
                    yield info.filename, r.read(info, pwd=password)


class Excel(Source):
    """Rows of sheets as JSON texts with ``_sheet``; dates as text, empty cells as empty texts."""

    def __init__(self, input_file: str, sheets: list | None = None, with_header: bool = True):
        self.path, self.sheets, self.header = input_file, sheets, with_header

    def __call__(self, spark):
        sheets, header = self.sheets, self.header

        def rows(name, content):
            for sheet, table in pd.read_excel(io.BytesIO(content), sheet_name=sheets, header=0 if header else None).items():
                for row in table.to_dict("records"):
                    yield {"sheet": str(sheet), "value": json.dumps({str(k): "" if pd.isna(v) else v.strftime("%Y-%m-%d %H:%M") if hasattr(v, "strftime") else v for k, v in row.items()}, default=str, ensure_ascii=False)}

        return parse_files(spark, self.path, rows, "sheet string, value string").select(F.col("sheet").alias("_sheet"), F.parse_json("value").alias("value"))


ExcelStream = Excel


def office_texts(content: bytes, folder: str, tag: str) -> list[tuple[str, list[str]]]:
    """(part, texts of its paragraphs) of an office file, from its XML."""
    import xml.etree.ElementTree as ET

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(folder, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)] or [0])
        for n in names:
            root = ET.fromstring(z.read(n))
            out.append((n, ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith(f"}}{tag}")]))
    return out


class Docx(_File):
    """A row for each paragraph: {filename, style, text}, from the file's XML."""

    def __call__(self, spark):
        def rows(name, content):
            import xml.etree.ElementTree as ET

            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ET.fromstring(z.read("word/document.xml"))
            for p in root.iter(f"{w}p"):
                style = p.find(f"{w}pPr/{w}pStyle")
                text = "".join(t.text or "" for t in p.iter(f"{w}t"))
                if text.strip():
                    yield {"filename": name.rsplit("/", 1)[-1], "style": style.get(f"{w}val") if style is not None else None, "text": text}

        return parse_files(spark, self.path, rows, "filename string, style string, text string")


class PPTX(_File):
    """A row for each slide: {filename, page, content}."""

    def __call__(self, spark):
        def rows(name, content):
            for k, (_, texts) in enumerate(office_texts(content, r"ppt/slides/slide\d+\.xml", "p"), 1):
                yield {"filename": name.rsplit("/", 1)[-1], "page": k, "content": [t for t in texts if t.strip()]}

        return parse_files(spark, self.path, rows, "filename string, page int, content array<string>")


def converted(content: bytes, suffix: str, to: str) -> bytes:
    """An old office file in another format, by the office suite that must be on the executors."""
    import subprocess
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:
        old = Path(d, f"in{suffix}")
        old.write_bytes(content)
        subprocess.run(["soffice", "--headless", "--convert-to", to, "--outdir", d, str(old)], check=True, capture_output=True, timeout=300)
        return Path(d, f"in.{to}").read_bytes()


class Doc(_File):
    """As Docx, for files that are converted first."""

    def __call__(self, spark):
        def rows(name, content):
            for _, texts in office_texts(converted(content, ".doc", "docx"), r"word/document\.xml", "p"):
                for t in texts:
                    if t.strip():
                        yield {"filename": name.rsplit("/", 1)[-1], "style": None, "text": t}

        return parse_files(spark, self.path, rows, "filename string, style string, text string")


class PPT(_File):
    """As PPTX, for files that are converted first."""

    def __call__(self, spark):
        def rows(name, content):
            for k, (_, texts) in enumerate(office_texts(converted(content, ".ppt", "pptx"), r"ppt/slides/slide\d+\.xml", "p"), 1):
                yield {"filename": name.rsplit("/", 1)[-1], "page": k, "content": [t for t in texts if t.strip()]}

        return parse_files(spark, self.path, rows, "filename string, page int, content array<string>")


class PST(_File):
    """The mails of a mailbox file, through readpst, which must be on the executors."""

    def __call__(self, spark):
        def rows(name, content):
            import subprocess
            import tempfile
            from pathlib import Path

            with tempfile.TemporaryDirectory() as d:
                box = Path(d, "in.pst")
                box.write_bytes(content)
                subprocess.run(["readpst", "-e", "-o", d, str(box)], check=True, capture_output=True)
                for f in sorted(Path(d).rglob("*.eml")):
                    yield mail(f.read_bytes())

        return parse_files(spark, self.path, rows, MAIL)


OST = PST


class MSG(_File):
    """Outlook messages; needs extract_msg on the executors."""

    def __call__(self, spark):
        def rows(name, content):
            import extract_msg

            return [mail(extract_msg.openMsg(content).asEmailMessage().as_bytes())]

        return parse_files(spark, self.path, rows, MAIL)


class QueueLoader(Source):
    """What a list holds; the list is emptied."""

    def __init__(self, queue: list):
        self.queue = queue

    def __call__(self, spark):
        held = [self.queue.pop(0) for _ in range(len(self.queue))]
        return Array(held)(spark)


class Input(Source):
    """Lines from the terminal up to exit; blank ones are skipped."""

    def __init__(self, msg: str | None = None):
        self.msg = msg or ""

    def __call__(self, spark):
        return Array([x for x in iter(lambda: input(self.msg), "exit") if x.strip()])(spark)


class PDF(_File):
    """A row for each page: {page, content}; needs pypdf on the executors."""

    def __call__(self, spark):
        most, least = self.options.get("max_pages", 0), self.options.get("min_length", 10)

        def rows(name, content):
            import pypdf

            for k, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
                if most and k > most:
                    break
                yield {"page": k, "content": [x for x in page.extract_text().split("\n\n") if len(x) >= least]}

        return parse_files(spark, self.path, rows, "page int, content array<string>")


MAIL = "subject string, date long, `from` array<struct<n:string,a:string>>, `to` array<struct<n:string,a:string>>, cc array<struct<n:string,a:string>>, bcc array<struct<n:string,a:string>>, ext_headers array<struct<key:string,value:string>>, html string, text string, atts array<struct<name:string,type:string,size:long,content:binary>>"


def mail(content: bytes) -> dict:
    """The parts of an e-mail."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    people = lambda k: [{"n": n or a.split("@")[0], "a": a} for n, a in getaddresses([str(v) for v in message.get_all(k, [])]) if a]
    try:
        date = int(parsedate_to_datetime(message["date"]).timestamp() * 1000)
    except Exception:
        date = None
    html, text, atts = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name:
            body = part.get_payload(decode=True) or b""
            atts.append({"name": name, "type": name.rsplit(".", 1)[-1].lower() if "." in name else "", "size": len(body), "content": body})
        elif part.get_content_type() in {"text/html", "text/plain"}:
            (html if part.get_content_type() == "text/html" else text).append(part.get_content())
    known = {"subject", "date", "from", "to", "cc", "bcc"}
    return {"subject": str(message["subject"] or ""), "date": date, "from": people("from"), "to": people("to"), "cc": people("cc"), "bcc": people("bcc"), "ext_headers": [{"key": k, "value": str(v)} for k, v in message.items() if k.lower() not in known], "html": "\n".join(html), "text": "\n".join(text), "atts": atts}


class EML(_File):
    """E-mails: headers, addresses, bodies and attachments."""

    def __call__(self, spark):
        return parse_files(spark, self.path, lambda name, content: [mail(content)], MAIL)


def opened(content: bytes) -> bytes:
    for magic, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if content.startswith(magic):
            return unpack(content)
    return content


def warc_records(content: bytes):
    """(WARC headers, block) of each record."""
    data, at = opened(content), 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf8", "replace").split("\r\n")[1:])}
        size = int(head.get("content-length", 0))
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def warc_basics(head: dict) -> dict:
    return {"_id": head.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">"), "date": head.get("warc-date"), "url": head.get("warc-target-uri")}


class Warc(_File):
    """Responses: {_id, date, url, header, body}; those without a body are left out."""

    def __call__(self, spark):
        def rows(name, content):
            for head, block in warc_records(content):
                if head.get("warc-type") != "response":
                    continue
                top, _, body = block.partition(b"\r\n\r\n")
                lines = [x.partition(":") for x in top.decode("latin1").split("\r\n")]
                header = {k.strip(): v.strip() if sep else "" for k, sep, v in lines if sep} | ({"__": lines[0][0]} if not lines[0][1] else {})
                charset = re.search(r"charset=([\w-]+)", next((v for k, v in header.items() if k.lower() == "content-type"), ""), re.I)
                try:
                    text = body.decode(charset[1] if charset else "utf8")
                except (LookupError, UnicodeDecodeError):
                    text = body.decode("latin1")
                if text:
                    yield warc_basics(head) | {"header": header, "body": text}

        return parse_files(spark, self.path, rows, "_id string, date string, url string, header map<string,string>, body string")


class WET(_File):
    """Extracted texts: {_id, date, url, title, text}; the first line is the title."""

    def __call__(self, spark):
        def rows(name, content):
            for head, block in warc_records(content):
                if head.get("warc-type") == "conversion":
                    title, _, text = block.decode("utf8", "replace").partition("\n")
                    yield warc_basics(head) | {"title": title.strip(), "text": text.strip()}

        return parse_files(spark, self.path, rows, "_id string, date string, url string, title string, text string")


class WikidataDump(_File):
    """Items of a dump, an array with one item on each line, as VARIANT."""

    def __call__(self, spark):
        line = F.regexp_replace(F.trim("value"), ",$", "")
        return spark.read.text(self.path).select(line.alias("value")).filter(F.length("value") > 4).select(F.try_parse_json("value").alias("value")).filter("value IS NOT NULL")


class WikiXml(_File):
    """Pages of an XML dump, by Spark's XML reader."""

    def __call__(self, spark):
        reader = spark.read.format("xml").option("rowTag", self.options.get("row_tag", "page"))
        return (reader.schema(self.options["schema"]) if self.options.get("schema") else reader).load(self.path)


class GdeltTable(_File):
    """Tab-separated rows, typed by a ``name:type`` schema text; an empty field is null."""

    def __init__(self, input_file, schema_lines: list[str]):
        super().__init__(input_file)
        self.fields = [(n.strip(), t.strip().split("_")[0]) for n, _, t in (x.partition(":") for x in schema_lines if ":" in x)]

    def __call__(self, spark):
        kinds = {"int": "long", "float": "double"}
        raw = spark.read.csv(self.path, sep="\t", schema=", ".join(f"`{n}` string" for n, _ in self.fields))
        return raw.select(*[F.nullif(plain(n), F.lit("")).try_cast(kinds[t]).alias(n) if t in kinds else plain(n) for n, t in self.fields])


def sqlite_rows(path: str, sql: str):
    with sqlite3.connect(path) as db:
        db.row_factory = sqlite3.Row
        yield from map(dict, db.execute(sql))
