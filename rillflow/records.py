"""Loosely typed records on fixed schemas: truth, numbers, text and paths of columns."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Position of a record in its source, where an operator needs an order.
ORD = "_ord"


def plain(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def kind_of(df: DataFrame, name: str) -> T.DataType | None:
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def path(df: DataFrame, key: str | list) -> tuple[Column, T.DataType]:
    """The value at a dotted path and its type; a null string where there is nothing."""
    if isinstance(key, str) and key in df.columns:
        return plain(key), kind_of(df, key)
    parts = key.split(".") if isinstance(key, str) else list(key)
    if parts[0] not in df.columns:
        return F.lit(None).cast("string"), T.StringType()
    out, kind = plain(parts[0]), kind_of(df, parts[0])
    for k, part in enumerate(parts[1:], 1):
        if isinstance(kind, T.StructType) and part in kind.names:
            out, kind = out.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            out, kind = F.try_element_at(out, F.lit(part)), kind.valueType
        elif isinstance(kind, T.ArrayType) and part.lstrip("-").isdigit():
            out, kind = F.get(out, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.VariantType):
            return F.try_variant_get(out, "$." + ".".join(parts[k:]), "string"), T.StringType()
        elif isinstance(kind, T.StringType):
            return F.get_json_object(out, "$." + ".".join(parts[k:])), T.StringType()
        else:
            return F.lit(None).cast("string"), T.StringType()
    return out, kind


def truthy(c: Column, kind: T.DataType) -> Column:
    """What Python takes for true: not null, zero, false or empty."""
    if isinstance(kind, T.BooleanType):
        out = c
    elif isinstance(kind, T.NumericType):
        out = c != 0
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        out = F.length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        out = F.size(c) > 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def filled(c: Column, kind: T.DataType) -> Column:
    """As truthy, but numbers and booleans are never empty."""
    return c.isNotNull() if isinstance(kind, (T.NumericType, T.BooleanType)) else truthy(c, kind)


def num(c: Column, kind: T.DataType | None = None) -> Column:
    """A number, from text with thousands separators too; null for anything else."""
    if kind is None or isinstance(kind, T.StringType):
        return F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def text_of(c: Column, kind: T.DataType) -> Column:
    """The text that a record's value prints as: None for null, True and False, JSON for nested values."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("None"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(context))
    return df.checkpoint()


def shared_folder(context) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a new folder, on a local master alone."""
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="rillflow-")


class Rejects:
    """How many values or files could not be worked on, counted over all tasks of a session's actions."""

    counts: dict = {}

    @classmethod
    def of(cls, spark):
        if spark.sparkContext not in cls.counts:
            cls.counts[spark.sparkContext] = spark.sparkContext.accumulator(0)
        return cls.counts[spark.sparkContext]


def rejected(spark) -> int:
    """Files that could not be parsed and values on which a function raised, so far. Tasks that ran twice count twice."""
    return Rejects.of(spark).value


def position(df: DataFrame) -> Column:
    """Where a record stands in its source: its order if it has one, the file and row of Parquet, else as Spark reads it."""
    if ORD in df.columns:
        return plain(ORD)
    where = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        df.select(where)
    except AnalysisException:
        return F.monotonically_increasing_id()
    return where


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """Add the position of each row, from 0: in the order of the keys, or as Spark reads the source."""
    from rillflow.ordered import numbered

    if keys:
        return numbered(df, [F.col(k) for k in keys], ORD)
    return df.withColumn(ORD, F.monotonically_increasing_id())
