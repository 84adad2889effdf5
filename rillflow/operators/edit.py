"""Operators on the fields of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.base import Op
from rillflow.records import filled, kind_of, path, plain, text_of, truthy

__all__ = ["AddFields", "ConcatArray", "ConcatFields", "CopyFields", "DictEditBase", "InjectField", "MergeFields", "RemoveEmptyOrNullFields", "RemoveFields", "RenameFields", "ReplaceFields", "Select", "SelectVal", "lookup"]

#: Entries up to which a dictionary becomes a literal of the plan; a larger one becomes a table to join.
LITERAL = 1000


def constant(v):
    """A literal, nested dictionaries and lists included."""
    if isinstance(v, dict):
        return F.struct(*[constant(x).alias(k) for k, x in v.items()])
    if isinstance(v, (list, tuple, set)):
        return F.array(*[constant(x) for x in v])
    return F.lit(v)


class Select(Op):
    """Keep keys; dotted ones reach into nested values. A missing key is null."""

    def __init__(self, *keys: str, short_key: bool = False):
        self.keys, self.short = keys, short_key

    def __call__(self, df):
        return df.select(*[path(df, k)[0].alias(k.split(".")[-1] if self.short else k) for k in self.keys])


class SelectVal(Op):
    """The value of a key becomes the record; null drops it. inherit_props: keep the other fields, which win."""

    def __init__(self, key: str, inherit_props: bool = False):
        self.key, self.inherit = key, inherit_props

    def __call__(self, df):
        c, kind = path(df, self.key)
        df = df.filter(c.isNotNull())
        if not isinstance(kind, T.StructType):
            return df.select(c.alias("value"))
        rest = [n for n in df.columns if n != self.key.split(".")[0]] if self.inherit else []
        return df.select(*[c.getField(n).alias(n) for n in kind.names if n not in rest], *[plain(n) for n in rest])


class RemoveFields(Op):
    def __init__(self, key: str | list | tuple, *keys: str):
        self.keys = [*(key if isinstance(key, (list, tuple)) else [key]), *keys]

    def __call__(self, df):
        return df.select(*[plain(c) for c in df.columns if c not in self.keys])


def filled_pair(kind):
    return lambda _, v: filled(v, kind)


def filled_value(kind):
    return lambda v: filled(v, kind)


class RemoveEmptyOrNullFields(Op):
    """Empty values become null and empty entries leave maps and arrays; zero and false are not empty."""

    def __call__(self, df):
        out = []
        for f in df.schema.fields:
            c = plain(f.name)
            if isinstance(f.dataType, T.MapType):
                kind = f.dataType.valueType
                c = F.map_filter(c, filled_pair(kind))
            elif isinstance(f.dataType, T.ArrayType):
                kind = f.dataType.elementType
                c = F.filter(c, filled_value(kind))
            out.append((F.when(filled(c, f.dataType), c) if df.columns != ["value"] else c).alias(f.name))
        return df.select(*out)


class DictEditBase(Op):
    def __init__(self, tmp: dict | None = None, **kwargs):
        self.tmp = {**(tmp or {}), **kwargs}


class AddFields(DictEditBase):
    """Constants for keys that are absent (or null)."""

    def __call__(self, df):
        return df.withColumns({k: constant(v) if k not in df.columns else F.coalesce(plain(k), constant(v).cast(kind_of(df, k))) for k, v in self.tmp.items()})


class ReplaceFields(DictEditBase):
    def __call__(self, df):
        return df.withColumns({k: constant(v) for k, v in self.tmp.items()})


class RenameFields(DictEditBase):
    """New names for keys that are there; a key of the new name is overwritten."""

    def __call__(self, df):
        new = {k: v for k, v in self.tmp.items() if k in df.columns}
        gone = {v for k, v in new.items() if v != k and v not in new}
        return df.select(*[plain(c).alias(new.get(c, c)) for c in df.columns if c not in gone])


class MergeFields(DictEditBase):
    """target=source: the source fills a target that is empty."""

    def __call__(self, df):
        out = {}
        for target, source in self.tmp.items():
            s, _ = path(df, source)
            if target in df.columns:
                kind = kind_of(df, target)
                out[target] = F.when(truthy(plain(target), kind), plain(target)).otherwise(s.cast(kind))
            else:
                out[target] = s
        return df.withColumns(out)


class CopyFields(DictEditBase):
    """target=source."""

    def __call__(self, df):
        return df.withColumns({target: path(df, source)[0] for target, source in self.tmp.items()})


def alike(values: list) -> list:
    """Values of one type: as they are, as doubles where all are numbers, else as text."""
    kinds = {type(v) for v in values if v is not None}
    if len(kinds) < 2:
        return values
    to = float if kinds <= {int, float} else str
    return [None if v is None else to(v) for v in values]


def lookup(df: DataFrame, key, table: dict | DataFrame, to: str) -> DataFrame:
    """Add the value that a dictionary or a (key, value) table has for the column ``key``; null where it has none.

    A dictionary of more than LITERAL entries, and any table, is joined, so Spark checks its size before it broadcasts.
    Values of several types become text, whichever way is taken.
    """
    if isinstance(table, dict):
        table = dict(zip(table, alike(list(table.values())), strict=True))
    if isinstance(table, dict) and len(table) <= LITERAL:
        if not table:
            return df.withColumn(to, F.lit(None).cast("string"))
        entries = [x for k, v in table.items() for x in (F.lit(str(k)), constant(v))]
        return df.withColumn(to, F.try_element_at(F.create_map(*entries), key.cast("string")))
    if isinstance(table, dict):
        table = df.sparkSession.createDataFrame([(str(k), v) for k, v in table.items()], ["_k", "_v"])
    k, v = table.columns[:2]
    side = table.select(plain(k).cast("string").alias("_k"), plain(v).alias(to)).dropDuplicates(["_k"])
    return df.join(side, key.cast("string") == F.col("_k"), "left").drop("_k")


class InjectField(Op):
    """Look a value up and write what is found at a path; records without a hit stay as they are."""

    def __init__(self, kv: dict | DataFrame, inject_path: str | list, reference_path: str | None = None):
        self.kv, self.target = kv, inject_path if isinstance(inject_path, list) else inject_path.split(".")
        self.reference = reference_path or ".".join(self.target)

    def __call__(self, df):
        out = lookup(df, path(df, self.reference)[0], self.kv, "_found")
        head, rest = self.target[0], self.target[1:]
        if not rest:
            value = F.coalesce(F.col("_found"), plain(head).cast(out.schema["_found"].dataType)) if head in df.columns else F.col("_found")
        elif isinstance(kind_of(df, head), T.StructType):
            value = F.when(F.col("_found").isNotNull(), plain(head).withField(".".join(rest), F.col("_found"))).otherwise(plain(head).withField(".".join(rest), path(df, self.target)[0].cast(out.schema["_found"].dataType)))
        else:
            value = F.col("_found")
            for name in reversed(rest):
                value = F.struct(value.alias(name))
        return out.withColumn(head, value).drop("_found")


class ConcatFields(Op):
    """Join the text of values; null reads None."""

    def __init__(self, target_key: str, *source_keys: str, separator: str = "_", prefix: str = "", suffix: str = ""):
        self.target, self.sources, self.sep, self.prefix, self.suffix = target_key, source_keys, separator, prefix, suffix

    def __call__(self, df):
        return df.withColumn(self.target, F.concat(F.lit(self.prefix), F.concat_ws(self.sep, *[text_of(*path(df, k)) for k in self.sources]), F.lit(self.suffix)))


class ConcatArray(Op):
    """Join arrays; a scalar is one more element and a missing key none. Without a target the array is the record."""

    def __init__(self, *source_keys: str, target_key: str | None = None):
        self.sources, self.target = source_keys, target_key

    def __call__(self, df):
        parts = []
        for k in self.sources:
            c, kind = path(df, k)
            if isinstance(kind, T.ArrayType):
                parts.append(F.coalesce(c, F.array().cast(kind)))
            elif k in df.columns:
                parts.append(F.array(c))
        joined = F.concat(*parts)
        return df.withColumn(self.target, joined) if self.target else df.select(joined.alias("value"))
