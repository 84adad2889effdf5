"""Databases and queues behind one interface, over Spark's data sources.

A ``Database`` reads with ``scroll`` and ``search`` and writes with ``upsert``. Lookups of records (exists, get) are joins. SQLite runs
with Python's own library; the others name a data source whose package must be on the class path.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.graph import vector_topk
from rillflow.records import plain

__all__ = ["CK", "ES", "MinIO", "MongoDB", "MySQL", "Neo4j", "PG", "Database", "Jdbc", "Kafka", "Qdrant", "RDBBase", "Redis", "SQLite", "TableDatabase"]


class Database:
    """What all connectors can do."""

    def list_tables(self, spark: SparkSession, *args) -> DataFrame:
        raise NotImplementedError

    def scroll(self, spark: SparkSession, **options) -> DataFrame:
        raise NotImplementedError

    def upsert(self, df: DataFrame, write_mode: str = "upsert", **options) -> None:
        raise NotImplementedError

    def search(self, spark: SparkSession, where: str | None = None, limit: int = 0, **options) -> DataFrame:
        out = self.scroll(spark, **options)
        out = out.filter(where) if where else out
        return out.limit(limit) if limit else out

    def exists(self, df: DataFrame, key: str, column: str | None = None, **options) -> DataFrame:
        """The records whose key the database has."""
        known = self.scroll(df.sparkSession, **options)
        return df.join(known.select(plain(column or key).alias("_known")), plain(key) == F.col("_known"), "left_semi")

    def get(self, df: DataFrame, key: str, column: str | None = None, **options) -> DataFrame:
        """The records with the database's row as a struct ``_row``."""
        known = self.scroll(df.sparkSession, **options)
        side = known.select(plain(column or key).alias("_known"), F.struct(*[plain(c) for c in known.columns]).alias("_row"))
        return df.join(side, plain(key) == F.col("_known"), "left").drop("_known")

    def delete(self, spark: SparkSession, ids: list, **options) -> None:
        raise NotImplementedError


class TableDatabase(Database):
    """A folder of Parquet tables; an upsert writes a new version of the table and then points to it."""

    def __init__(self, folder: str, table: str, key: str = "_id"):
        self.folder, self.table, self.key = folder.rstrip("/"), table, key

    def _versions(self, spark):
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.table}")
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        return sorted((s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), key=lambda n: int(n[1:])) if fs.exists(fs_path) else []

    def scroll(self, spark, **options):
        versions = self._versions(spark)
        if not versions:
            raise FileNotFoundError(f"{self.folder}/{self.table}")
        return spark.read.parquet(f"{self.folder}/{self.table}/{versions[-1]}")

    def upsert(self, df, write_mode="upsert", **options):
        versions = self._versions(df.sparkSession)
        out = df.dropDuplicates([self.key])
        if versions and write_mode != "overwrite":
            old = self.scroll(df.sparkSession)
            out = (old if write_mode == "insert" else old.join(out.select(self.key), self.key, "left_anti")).unionByName(df if write_mode == "insert" else out, allowMissingColumns=True)
        out.write.parquet(f"{self.folder}/{self.table}/v{int(versions[-1][1:]) + 1 if versions else 1}")

    def delete(self, spark, ids, **options):
        version = int(self._versions(spark)[-1][1:]) + 1
        self.scroll(spark).filter(~plain(self.key).isin(ids)).write.parquet(f"{self.folder}/{self.table}/v{version}")


class Jdbc(Database):
    """Relational databases: pushed filters and columns, reads in parallel by a numeric column."""

    url, driver = "", ""

    def __init__(self, host: str = "localhost", port: int = 0, username: str = "", password: str = "", database: str = "default", table: str | None = None, **options):
        self.host, self.port, self.database, self.table = host, port, database, table
        self.options = {"url": self.url.format(host=host, port=port, database=database), "driver": self.driver, "user": username, "password": password, "fetchsize": "1000"} | {k: str(v) for k, v in options.items()}

    def scroll(self, spark, table: str | None = None, select: str = "*", where: str | None = None, partition: tuple | None = None, **options):
        reader = spark.read.format("jdbc").options(**self.options)
        if partition:  # (column, lower, upper, number)
            reader = reader.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
        out = reader.option("dbtable", table or self.table).load()
        out = out.filter(where) if where else out
        return out if select == "*" else out.selectExpr(*select.split(","))

    def upsert(self, df, write_mode="insert", table: str | None = None, **options):
        df.write.format("jdbc").options(**self.options).option("dbtable", table or self.table).option("batchsize", 1000).mode("overwrite" if write_mode == "overwrite" else "append").save()


RDBBase = Jdbc


class MySQL(Jdbc):
    url, driver = "jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"


class PG(Jdbc):
    url, driver = "jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"


class CK(Jdbc):
    url, driver = "jdbc:clickhouse://{host}:{port}/{database}", "com.clickhouse.jdbc.ClickHouseDriver"


class SQLite(Database):
    """A file on the driver; rows are read in pages of the rowid and written in batches of one transaction."""

    def __init__(self, dbpath: str, table: str | None = None, key: str = "id", **options):
        self.path, self.table, self.key = dbpath, table, key

    def _query(self, sql: str, *args):
        with sqlite3.connect(self.path) as db:
            cursor = db.execute(sql, args)
            return [c[0] for c in cursor.description or ()], cursor.fetchall()

    def list_tables(self, spark, *args):
        names = [r[0] for r in self._query("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")[1]]
        rows = [(t, [r[1] for r in self._query(f'PRAGMA table_info("{t}")')[1]]) for t in names]
        return spark.createDataFrame(rows, "name string, columns array<string>")

    desc_table = list_tables

    def scroll(self, spark, select: str = "*", where: str | None = None, fetch_size: int = 0, table: str | None = None, **options):
        names, rows = self._query(f'SELECT {select} FROM "{table or self.table}"' + (f" WHERE {where}" if where else "") + (f" LIMIT {fetch_size}" if fetch_size else ""))
        return spark.createDataFrame(rows, names) if rows else spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))

    def upsert(self, df, write_mode="upsert", table: str | None = None, **options):
        names = df.columns
        marks = ", ".join("?" * len(names))
        columns = ", ".join(f'"{n}"' for n in names)
        with sqlite3.connect(self.path) as db:
            db.execute(f'CREATE TABLE IF NOT EXISTS "{table or self.table}" ({columns}' + (f', PRIMARY KEY ("{self.key}")' if self.key in names else "") + ")")
            db.executemany(f'INSERT OR {"REPLACE" if write_mode == "upsert" else "IGNORE"} INTO "{table or self.table}" ({columns}) VALUES ({marks})', (tuple(r) for r in df.toLocalIterator()))

    def delete(self, spark, ids, table: str | None = None, **options):
        with sqlite3.connect(self.path) as db:
            db.executemany(f'DELETE FROM "{table or self.table}" WHERE "{self.key}" = ?', [(i,) for i in ids])


class _Format(Database):
    """A store behind a data source of its own."""

    format = ""

    def __init__(self, **options):
        self.options = {k: str(v) for k, v in options.items()}

    def scroll(self, spark, **options):
        return spark.read.format(self.format).options(**self.options, **{k: str(v) for k, v in options.items()}).load()

    def upsert(self, df, write_mode="upsert", **options):
        df.write.format(self.format).options(**self.options, **{k: str(v) for k, v in options.items()}).mode("append").save()


class MongoDB(_Format):
    format = "mongodb"


class ES(_Format):
    format = "org.elasticsearch.spark.sql"

    def semantic_search(self, spark, vector: list, field: str = "vector", k: int = 10, **options):
        return vector_topk(self.scroll(spark, **options), vector, k, field)


class Qdrant(_Format):
    format = "io.qdrant.spark.Qdrant"

    def vector_search(self, spark, vector: list, field: str = "embedding", k: int = 10, **options):
        return vector_topk(self.scroll(spark, **options), vector, k, field)


class Neo4j(_Format):
    format = "org.neo4j.spark.DataSource"

    def nodes(self, spark, labels: str | None = None):
        return self.scroll(spark, labels=labels or "")

    def relations(self, spark, cypher: str = "MATCH (a)-[r]->(b) RETURN a, r, b"):
        return self.scroll(spark, query=cypher)


class MinIO(_Format):
    """Objects under s3a paths."""

    format = "binaryFile"

    def __init__(self, bucket: str, prefix: str = "", **options):
        super().__init__(**options)
        self.path = f"s3a://{bucket}/{prefix}"

    def scroll(self, spark, **options):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)


class Redis(_Format):
    format = "org.apache.spark.sql.redis"


class Kafka(Database):
    """A topic of JSON values. The checkpoint of the query keeps the offsets."""

    def __init__(self, host: str, topic: str | None = None, group_id: str = "rillflow", **options):
        self.options, self.topic = {"kafka.bootstrap.servers": host} | options, topic

    def stream(self, spark: SparkSession, schema: str | None = None, topic: str | None = None) -> DataFrame:
        raw = spark.readStream.format("kafka").options(**self.options).option("subscribe", topic or self.topic).option("startingOffsets", "earliest").load()
        return self.parsed(raw, schema)

    @staticmethod
    def parsed(raw: DataFrame, schema: str | None) -> DataFrame:
        text = F.col("value").cast("string")
        return raw.select(F.from_json(text, schema).alias("r")).select("r.*") if schema else raw.select(F.try_parse_json(text).alias("value"))

    def scroll(self, spark, schema: str | None = None, **options):
        return self.parsed(spark.read.format("kafka").options(**self.options).option("subscribe", self.topic).load(), schema)

    @staticmethod
    def message(df: DataFrame, key: str | None = None) -> DataFrame:
        return df.select(*([plain(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))

    def upsert(self, df, write_mode="append", key: str | None = None, checkpoint: str | None = None, **options):
        out = self.message(df, key)
        if df.isStreaming:
            return out.writeStream.format("kafka").options(**self.options).option("topic", self.topic).option("checkpointLocation", checkpoint).start()
        return out.write.format("kafka").options(**self.options).option("topic", self.topic).save()


# --- the same as functions, for flows


def tables(spark: SparkSession, db: Database) -> DataFrame:
    return db.list_tables(spark)


def scroll(spark: SparkSession, db: Database, **options) -> DataFrame:
    return db.scroll(spark, **options)


def search(spark: SparkSession, db: Database, **options) -> DataFrame:
    return db.search(spark, **options)


def upsert(df: DataFrame, db: Database, **options) -> DataFrame:
    db.upsert(df, **options)
    return df


def exists(df: DataFrame, db: Database, key: str, **options) -> DataFrame:
    return db.exists(df, key, **options)


def get(df: DataFrame, db: Database, key: str, **options) -> DataFrame:
    return db.get(df, key, **options)


def delete(spark: SparkSession, db: Database, ids: list, **options) -> None:
    db.delete(spark, ids, **options)
