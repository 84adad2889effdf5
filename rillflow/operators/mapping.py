"""Operators that compute values from a record, and those that make many records of one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.base import Op, packed
from rillflow.operators.edit import constant, lookup
from rillflow.plans.expressions import NotExpressible, compiled
from rillflow.records import kind_of, path, plain

__all__ = ["Flat", "FlatMap", "FlatProperty", "Function", "Map", "MapFill", "MapMulti", "MapRules", "applied"]

#: Values that a UDF works out before it passes them on.
PIECE = 256


def applied(df: DataFrame, mapper, keys: list[str] | None = None, args: tuple = (), kwargs: dict | None = None, returns: str | None = None, quiet: bool = True):
    """(column, type) of a mapper over the record or the values of keys.

    A mapper that is marked ``builds_column`` is called with the columns; one that the expression compiler understands
    becomes built-in functions; any other function runs as a pandas UDF that returns ``returns`` (string if not given), with
    null for values on which it raises, if ``quiet``.
    """
    kwargs = kwargs or {}
    if isinstance(mapper, str) and not mapper.strip().startswith(("lambda", "=")):
        from rillflow.plans.registry import function

        mapper = function(mapper)
    if getattr(mapper, "builds_column", False):
        values = [path(df, k)[0] for k in keys] if keys else [packed(df)]
        out = mapper(*values, *args, **kwargs)
        return out, df.select(out.alias("x")).schema["x"].dataType
    if not args and not kwargs and returns is None:
        try:
            value = compiled(df, mapper, keys)
            out = value.column()
            return out, df.select(out.alias("x")).schema["x"].dataType
        except NotExpressible:
            if isinstance(mapper, str):
                raise
    if isinstance(mapper, str):
        raise NotExpressible(mapper)
    kind = T._parse_datatype_string(returns or getattr(mapper, "returns", "string"))

    def one(*values):
        try:
            return mapper(*values, *args, **kwargs)
        except Exception:
            if quiet:
                return None
            raise

    values = [path(df, k)[0] for k in keys] if keys else [packed(df)]
    return _pandas(one, kind)(*values), kind


def _pandas(one: Callable, kind):
    def run(batches):
        for series in batches:
            if not isinstance(series, tuple):
                series = (series,)
            rows = zip(*(s.to_dict("records") if isinstance(s, pd.DataFrame) else s for s in series), strict=True)
            while out := [one(*r) for r in islice(rows, PIECE)]:
                yield pd.DataFrame([r or {} for r in out], columns=kind.names) if isinstance(kind, T.StructType) else pd.Series(out, dtype=object)
            del series, rows, out  # a batch is not held while the next is read

    def single(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return run(batches)

    def call(*columns):
        # the type hints are read when the UDF is made
        f = single if len(columns) == 1 else several
        f.__annotations__ = {"batches": Iterator[pd.Series] if len(columns) == 1 else Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame if isinstance(kind, T.StructType) else pd.Series]}
        return F.pandas_udf(f, kind)(*columns)

    return call


def _of_text(one: Callable, kind):
    """As _pandas for a function of one text; of a batch no more texts are objects than a piece has."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    to = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), PIECE):
                yield pa.array([one(x.as_py()) for x in batch.slice(start, PIECE)], to)
            del batch

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


class Map(Op):
    """target = mapper(record or values of the keys); without a target the result is the record, and null drops it.

    target_key: by default the key itself. A missing key leaves the record unchanged; a value on which the mapper raises
    becomes null.
    """

    def __init__(self, mapper, *args, key: str | list | None = None, target_key: str | None = "", returns: str | None = None, **kwargs):
        self.mapper, self.args, self.returns, self.kwargs = mapper, args, returns, kwargs
        self.keys = [key] if isinstance(key, str) else list(key) if key else None
        self.target = (self.keys[0] if self.keys else None) if target_key == "" else target_key

    def __call__(self, df):
        if self.keys and any(k.split(".")[0] not in df.columns for k in self.keys):
            return df
        out, kind = applied(df, self.mapper, self.keys, self.args, self.kwargs, self.returns)
        if self.target:
            return df.withColumn(self.target, out)
        return as_record(df.select(out.alias("value")), kind)


class Function(Op):
    """record = function(record); errors propagate."""

    def __init__(self, function, *args, returns: str | None = None, **kwargs):
        self.function, self.args, self.returns, self.kwargs = function, args, returns, kwargs

    def __call__(self, df):
        out, kind = applied(df, self.function, None, self.args, self.kwargs, self.returns, quiet=False)
        return as_record(df.select(out.alias("value")), kind)


def as_record(df: DataFrame, kind) -> DataFrame:
    """A struct becomes the fields of the record; null drops it."""
    df = df.filter(plain("value").isNotNull())
    return df.select("value.*") if isinstance(kind, T.StructType) else df


class MapMulti(Op):
    """The mapper over several fields: onto themselves, and source=target."""

    def __init__(self, mapper, *keys: str, returns: str | None = None, **kwargs: str):
        self.mapper, self.returns, self.pairs = mapper, returns, {k: k for k in keys} | kwargs

    def __call__(self, df):
        return df.withColumns({t: applied(df, self.mapper, [s], returns=self.returns, quiet=False)[0] for s, t in self.pairs.items() if s.split(".")[0] in df.columns})


class MapFill(Op):
    """Look the value up; one without an entry passes as it is."""

    def __init__(self, cache: dict | DataFrame, target_key: str, source_key: str | None = None):
        self.cache, self.target, self.source = cache, target_key, source_key or target_key

    def __call__(self, df):
        c = path(df, self.source)[0]
        return lookup(df, c, self.cache, "_found").withColumn(self.target, F.coalesce(F.col("_found").cast("string"), c.cast("string"))).drop("_found")


class MapRules(Op):
    """A new record from rules: target:literal or target:@source; null fields are left out of the text form."""

    def __init__(self, rules: list | str):
        self.rules = [r.strip() for r in (rules.split(",") if isinstance(rules, str) else rules)]

    def __call__(self, df):
        out = []
        for rule in self.rules:
            target, _, source = rule.partition(":")
            out.append((path(df, source[1:])[0] if source.startswith("@") else constant(source)).alias(target))
        return df.select(*out)


class Flat(Op):
    """Many records from a list or a dictionary.

    flat_mode for maps: ``kv`` {key, value}, ``key`` the keys, ``value`` the values (structs get ``_key``). inherit_props: keep the
    record's fields and put each element under target_key. A scalar gives nothing.
    """

    def __init__(self, key: str | None = None, target_key: str | None = None, flat_mode: str = "kv", inherit_props: bool = False):
        self.key, self.target, self.mode, self.inherit = key, target_key or key, flat_mode, inherit_props

    def __call__(self, df):
        if self.key:
            c, kind = path(df, self.key)
        elif df.columns == ["value"]:
            c, kind = plain("value"), kind_of(df, "value")
        else:
            kinds = {f.dataType for f in df.schema.fields}
            kind = T.MapType(T.StringType(), kinds.pop() if len(kinds) == 1 else T.StringType())
            c = F.create_map(*[x for n in df.columns for x in (F.lit(n), plain(n).cast(kind.valueType))])
        if isinstance(kind, T.StructType) and not isinstance(kind, T.MapType):
            kinds = {f.dataType for f in kind.fields}
            inner = kinds.pop() if len(kinds) == 1 else T.StringType()
            c, kind = F.create_map(*[x for n in kind.names for x in (F.lit(n), c.getField(n).cast(inner))]), T.MapType(T.StringType(), inner)
        if isinstance(kind, T.MapType):
            pairs = df.select(F.explode(c).alias("key", "value"))
            if self.mode == "key":
                return pairs.select(F.col("key").alias("value"))
            if self.mode == "value":
                return pairs.select("value.*", F.col("key").alias("_key")) if isinstance(kind.valueType, T.StructType) else pairs.select("value")
            return pairs
        if not isinstance(kind, T.ArrayType):
            return df.limit(0)
        if self.inherit:
            rest = [n for n in df.columns if n != self.target]
            return df.select(*[plain(n) for n in rest], F.explode(c).alias(self.target))
        out = df.select(F.explode(c).alias("value"))
        return out.select("value.*") if isinstance(kind.elementType, T.StructType) else out


class FlatMap(Op):
    """Flatten what a mapper returns."""

    def __init__(self, mapper, key: str | None = None, flat_mode: str = "value", returns: str | None = None):
        self.mapper, self.key, self.mode, self.returns = mapper, key, flat_mode, returns

    def __call__(self, df):
        out, _ = applied(df, self.mapper, [self.key] if self.key else None, returns=self.returns)
        return Flat(flat_mode=self.mode)(df.select(out.alias("value")))


class FlatProperty(Op):
    """A record from each of the listed fields, with the other fields if inherit_props."""

    def __init__(self, *keys: str, inherit_props: bool = False):
        self.keys, self.inherit = keys, inherit_props

    def __call__(self, df):
        total = None
        for k in self.keys:
            c, kind = path(df, k)
            rest = [plain(n) for n in df.columns if n not in self.keys] if self.inherit else []
            kept = df.filter(c.isNotNull())
            if isinstance(kind, T.StructType):
                own = {n for n in kind.names}
                one = kept.select(*[r for r, n in zip(rest, [n for n in df.columns if n not in self.keys], strict=False) if n not in own], *[c.getField(n).alias(n) for n in kind.names])
            else:
                one = kept.select(*rest, c.alias("value"))
            total = one if total is None else total.unionByName(one, allowMissingColumns=True)
        return total
