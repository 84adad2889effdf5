"""Operators that write; records pass on."""

from __future__ import annotations

import gzip
import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.base import Op
from rillflow.operators.filters import condition
from rillflow.ordered import blocks
from rillflow.records import plain

__all__ = ["BufferedWriter", "DatabaseWriter", "WriteCSV", "WriteFiles", "WriteJson", "WriteJsonIf", "WriteJsonScroll", "WriteParquet", "WriteText"]


class _Writer(Op):
    def __init__(self, output_file: str, append: bool = False, mode: str | None = None, **options):
        self.out, self.save, self.gzip = output_file, "append" if append else "overwrite", mode == "gzip" or output_file.endswith(".gz")
        self.options = options

    def write(self, df):
        raise NotImplementedError

    def __call__(self, df):
        self.write(df)
        return df


class WriteText(_Writer):
    """Lines of text: the only column, or JSON of the record."""

    def __init__(self, output_file: str, append: bool = False, encoding: str = "utf8", buffer_size: int = 1000, sep: str = "\n", mode: str | None = None):
        super().__init__(output_file, append, mode)
        self.sep = sep

    def write(self, df):
        line = plain(df.columns[0]).cast("string") if len(df.columns) == 1 else F.to_json(F.struct("*"))
        df.select(line.alias("value")).write.mode(self.save).text(self.out, compression="gzip" if self.gzip else "none", lineSep=self.sep)


class WriteJson(_Writer):
    """JSON lines; dates as text, bytes as an empty text, nulls kept."""

    @staticmethod
    def shown(df):
        return df.select(*[F.lit("").alias(f.name) if isinstance(f.dataType, T.BinaryType) else plain(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else plain(f.name) for f in df.schema.fields])

    def write(self, df):
        self.saved(self.shown(df)).json(self.out)

    def saved(self, out):
        return out.write.mode(self.save).option("ignoreNullFields", "false").option("compression", "gzip" if self.gzip else "none")


class WriteParquet(_Writer):
    def write(self, df):
        df.write.mode(self.save).parquet(self.out)


class WriteCSV(_Writer):
    """CSV with a header of the keys; values are quoted where they need it."""

    def __init__(self, output_file: str, *keys: str, seperator: str = ",", **options):
        super().__init__(output_file, **options)
        self.keys, self.sep = keys, seperator

    def write(self, df):
        (df.select(*[plain(k) for k in self.keys]) if self.keys else df).write.mode(self.save).csv(self.out, header=True, sep=self.sep, quote='"', escape='"')


class WriteFiles(Op):
    """A file for each record, named by a field. Executors write to a folder that all of them share.

    What a name may not hold (``/`` and ``%``) is written as %2F and %25, so that names stay apart. Of records of one name
    one stays: name_key is to be distinct.
    """

    def __init__(self, output_dir: str, name_key: str = "id", content_key: str = "content", suffix: str | None = None, output_format: str = "auto"):
        self.dir, self.name, self.content, self.suffix = output_dir, name_key, content_key, suffix or ""

    def __call__(self, df):
        kind = df.schema[self.content].dataType
        c = plain(self.content)
        body = c if isinstance(kind, T.BinaryType) else (c.cast("string") if isinstance(kind, T.StringType) else F.to_json(c)).cast("binary")
        folder, suffix = self.dir, self.suffix

        def write(rows):
            os.makedirs(folder, exist_ok=True)
            for row in rows:
                at = os.path.join(folder, str(row[0]).replace("%", "%25").replace("/", "%2F") + suffix)
                with open(f"{at}.part", "wb") as f:
                    f.write(row[1] or b"")
                os.replace(f"{at}.part", at)  # a task that runs again leaves whole files

        df.select(plain(self.name).cast("string"), body).foreachPartition(write)
        return df


class WriteJsonScroll(WriteJson):
    """JSON lines in files of a number of rows in their order; only the last has fewer.

    On a file system that is mounted the tasks open the files themselves, for Hadoop starts a process for each. A file
    appears whole and under a name that a repeated task gives it again; files of a job that failed stay, without ``_SUCCESS``.
    """

    def __init__(self, output_dir: str, mode: str = "gzip", scroll: int = 10_000):
        super().__init__(output_dir, True, mode)
        self.rows_per_file = scroll

    def write(self, df):
        rows = blocks(self.shown(df), self.rows_per_file, "_row")
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.out)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        if files.getUri().getScheme() != "file":
            self.saved(rows.drop("_row")).option("maxRecordsPerFile", self.rows_per_file).json(self.out)
            return
        folder = at.toUri().getPath()
        os.makedirs(folder, exist_ok=True)
        lines = rows.select("_row", F.to_json(F.struct(*[plain(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))
        lines.mapInArrow(self.files(folder), "files long").agg(F.sum("files")).collect()
        open(os.path.join(folder, "_SUCCESS"), "w").close()

    def files(self, folder):
        size, pack, job = self.rows_per_file, self.gzip, uuid.uuid4().hex

        def put(number, lines):
            data = ("\n".join(lines) + "\n").encode()
            name = f"part-{number:010d}-{job}.json{'.gz' if pack else ''}"
            own = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
            with open(own, "wb") as f:
                f.write(gzip.compress(data) if pack else data)
            os.replace(own, os.path.join(folder, name))

        def run(batches):
            held, number, n = [], 0, 0
            for batch in batches:
                for row, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not held:
                        number = row // size
                    held.append(line)
                    if len(held) == size:
                        put(number, held)
                        held, n = [], n + 1
            if held:
                put(number, held)
                n += 1
            yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

        return run


class WriteJsonIf(Op):
    """Records that fail the filter are written aside; the others pass."""

    def __init__(self, the_filter, output_dir: str, mode: str = "gzip", scroll: int = 100):
        self.filter, self.writer = the_filter, WriteJsonScroll(output_dir, mode, scroll)

    def __call__(self, df):
        c = condition(df, self.filter)
        self.writer(df.filter(~c))
        return df.filter(c)


class BufferedWriter(Op):
    """Calls ``write_batch`` with lists of records, in the tasks; records pass."""

    def __init__(self, buffer_size: int = 1000, mode: str = "single", **kwargs):
        self.size = buffer_size

    @staticmethod
    def write_batch(rows: list) -> None:
        raise NotImplementedError

    def __call__(self, df):
        size, write = self.size, self.write_batch

        def run(rows):
            held = []
            for row in rows:
                held.append(row.asDict(recursive=True))
                if len(held) >= size:
                    write(held)
                    held = []
            if held:
                write(held)

        df.foreachPartition(run)
        return df


class DatabaseWriter(Op):
    """Upsert the records into a database."""

    def __init__(self, db, write_mode: str = "upsert", **kwargs):
        self.db, self.mode, self.kwargs = db, write_mode, kwargs

    def __call__(self, df):
        self.db.upsert(df, write_mode=self.mode, **self.kwargs)
        return df
