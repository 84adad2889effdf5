"""Operators that keep or drop records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.base import Op
from rillflow.operators.edit import LITERAL
from rillflow.ordered import numbered
from rillflow.records import ORD, kind_of, path, plain, truthy

__all__ = ["All", "Any", "BlackList", "Distinct", "DistinctByDatabase", "FieldsExist", "FieldsNonEmpty", "Filter", "FilterByTime", "JsonPathMatch", "KeywordFilter", "KeywordFilterV2", "LengthFilter", "Limit", "MatchBase", "Not", "Sample", "SimpleMatch", "SkipN", "TakeN", "WhiteList", "WikidataMatch", "WikidataMatchNew", "condition"]


class Filter(Op):
    """Keep records for which the matcher is true. Subclasses give ``keeps``."""

    def __init__(self, matcher=None, key: str | None = None, **kwargs):
        self.matcher, self.key, self.kwargs = matcher, key, kwargs

    def value(self, df: DataFrame) -> tuple[Column, T.DataType]:
        if self.key:
            return path(df, self.key)
        if len(df.columns) == 1:
            return plain(df.columns[0]), kind_of(df, df.columns[0])
        return F.struct(*[plain(c) for c in df.columns]), df.schema

    def keeps(self, df: DataFrame) -> Column:
        if self.matcher is None:
            return truthy(*self.value(df))
        return condition(df, self.matcher, self.key)

    def __call__(self, df):
        return df.filter(self.keeps(df))


MatchBase = Filter


def condition(df: DataFrame, matcher, key: str | None = None) -> Column:
    """What decides for a record: a filter, a column, SQL text in ``sql:``, a lambda or the name of a function."""
    from rillflow.operators.mapping import applied

    if isinstance(matcher, Filter):
        return F.coalesce(matcher.keeps(df), F.lit(False))
    if isinstance(matcher, Column):
        return F.coalesce(matcher, F.lit(False))
    if isinstance(matcher, str) and matcher.startswith("sql:"):
        return F.coalesce(F.expr(matcher[4:]), F.lit(False))
    if matcher is None:
        return truthy(*path(df, key))
    return truthy(*applied(df, matcher, [key] if key else None))


class _Listed(Filter):
    def __init__(self, cache: dict | set | list | DataFrame, key: str | None = None):
        from rillflow.operators.edit import alike

        super().__init__(key=key)
        self.cache = cache if isinstance(cache, DataFrame) else alike(list(cache))

    def keeps(self, df):
        if isinstance(self.cache, DataFrame):
            raise ValueError("a table is joined and has no condition")
        c = self.value(df)[0]
        return F.coalesce(c.isin(list(self.cache)) if self.cache else F.lit(False), F.lit(False))

    def table(self, df):
        if isinstance(self.cache, DataFrame):
            return self.cache.select(plain(self.cache.columns[0]).alias("_k"))
        if len(self.cache) > LITERAL:
            return df.sparkSession.createDataFrame([(x,) for x in self.cache], ["_k"])
        return None


class WhiteList(_Listed):
    """Keep values that are listed: a literal list for a few, a semi join for many."""

    def __call__(self, df):
        side = self.table(df)
        return df.filter(self.keeps(df)) if side is None else df.join(side, self.value(df)[0] == F.col("_k"), "left_semi")


class BlackList(_Listed):
    """Keep values that are not listed; null is kept."""

    def keeps(self, df):
        return ~super().keeps(df)

    def __call__(self, df):
        side = self.table(df)
        return df.filter(self.keeps(df)) if side is None else df.join(side, self.value(df)[0] == F.col("_k"), "left_anti")


class Sample(Op):
    """Keep each record with a probability; with keys, by a hash of them, so that reruns agree."""

    def __init__(self, rate: float = 0.1, *keys: str, seed: int | None = None):
        self.rate, self.keys, self.seed = rate, keys, seed

    def __call__(self, df):
        if self.keys:
            h = F.pmod(F.xxhash64(*[plain(k) for k in self.keys], F.lit(self.seed or 0)), F.lit(1 << 30))
            return df.filter(h < F.lit(int(self.rate * (1 << 30))))
        return df.sample(fraction=min(1.0, self.rate), seed=self.seed)


class Distinct(Op):
    """The first record of each key (or of equal records); null is a key. ``order`` decides what is first."""

    def __init__(self, key: str | None = None, order: str | None = None):
        self.key, self.order = key, order

    def __call__(self, df):
        order = self.order or (ORD if ORD in df.columns else None)
        keys = [self.key] if self.key else [c for c in df.columns if c != ORD]
        if order is None or df.isStreaming:
            return df.dropDuplicates(keys)
        # the first of each group by an aggregate, which is combined before the shuffle, and not by a window
        rest = [c for c in df.columns if c not in keys]
        if not rest:
            return df.distinct()
        first = df.groupBy(*[plain(k) for k in keys]).agg(F.min_by(F.struct(*[plain(c) for c in rest]), F.struct(plain(order), *[plain(c) for c in rest if not isinstance(kind_of(df, c), (T.MapType, T.VariantType))])).alias("_first"))
        return first.select(*[plain(k) if k in keys else F.col("_first").getField(k).alias(k) for k in df.columns])


class DistinctByDatabase(Op):
    """Drop records whose key is in a table; new ones are not compared with each other."""

    def __init__(self, db_client, key: str | None = None, column: str | None = None, **kwargs):
        self.db, self.key, self.column, self.kwargs = db_client, key, column, kwargs

    def __call__(self, df):
        known = self.db if isinstance(self.db, DataFrame) else self.db.scroll(df.sparkSession, **self.kwargs)
        name = self.column or (self.key if self.key in known.columns else known.columns[0])
        return df.join(known.select(plain(name).alias("_known")), path(df, self.key or df.columns[0])[0] == F.col("_known"), "left_anti")


class _Ordered(Op):
    order: str | None = None

    def by(self, df):
        name = self.order or (ORD if ORD in df.columns else None)
        return [F.col(name)] if name else None


class TakeN(_Ordered):
    """The first n records; by ``order`` if given, which plans as a top-n."""

    def __init__(self, n: int = 10, order: str | None = None):
        self.n, self.order = n, order

    def __call__(self, df):
        by = self.by(df)
        return (df.orderBy(*by) if by else df).limit(self.n)


class SkipN(_Ordered):
    """Without the first n records. Ordered rows are numbered slice by slice, so that no task gets them all."""

    def __init__(self, n: int = 0, order: str | None = None):
        self.n, self.order = n, order

    def __call__(self, df):
        by = self.by(df)
        if not by:
            return df.offset(self.n)
        return numbered(df, by, "_n").filter(F.col("_n") >= self.n).drop("_n")


class Limit(_Ordered):
    """Limit(n), or Limit(skip, n)."""

    def __init__(self, skip: int = 0, n: int | None = None, order: str | None = None):
        self.skip, self.n, self.order = (0, skip, order) if n is None else (skip, n, order)

    def __call__(self, df):
        by = self.by(df)
        return (df.orderBy(*by) if by else df).offset(self.skip).limit(self.n)


class FieldsExist(Filter):
    """All keys are there. A column of the schema counts as there; within maps and JSON text the key is looked for."""

    def __init__(self, *keys: str):
        super().__init__()
        self.keys = keys

    def keeps(self, df):
        out = F.lit(True)
        for k in self.keys:
            out = out & (F.lit(True) if k in df.columns else path(df, k)[0].isNotNull())
        return out


class FieldsNonEmpty(Filter):
    """All keys have values that are not empty, zero or false."""

    def __init__(self, *keys: str):
        super().__init__()
        self.keys = keys

    def keeps(self, df):
        out = F.lit(True)
        for k in self.keys:
            out = out & truthy(*path(df, k))
        return out


class All(Filter):
    def __init__(self, *filters, key: str | None = None, **kwargs):
        super().__init__(key=key)
        self.filters = filters

    def keeps(self, df):
        out = F.lit(True)
        for f in self.filters:
            out = out & condition(df, f, self.key)
        return out


class Any(All):
    def keeps(self, df):
        out = F.lit(False)
        for f in self.filters:
            out = out | condition(df, f, self.key)
        return out


class Not(Filter):
    def __init__(self, that, key: str | None = None, **kwargs):
        super().__init__(key=key)
        self.that = that

    def keeps(self, df):
        return ~condition(df, self.that, self.key)


class FilterByTime(Filter):
    """Keep times in milliseconds up to some days from now."""

    def __init__(self, key: str | None = None, offset_days: int = 0, **kwargs):
        super().__init__(key=key)
        self.days = offset_days

    def keeps(self, df):
        return F.coalesce(self.value(df)[0] <= F.unix_millis(F.current_timestamp()) + F.lit(self.days * 86_400_000), F.lit(False))


class KeywordFilter(Filter):
    """Drop (or keep) texts that hold one of the keywords, whatever the case."""

    fold = True

    def __init__(self, key: str | None = None, keywords: list | None = None, action: str = "drop", **kwargs):
        super().__init__(key=key)
        self.words, self.action = [w for w in keywords or [] if w], action

    def keeps(self, df):
        c = F.coalesce(self.value(df)[0].cast("string"), F.lit(""))
        if not self.words:
            hit = F.lit(False)
        elif len(self.words) > 64:
            hit = automaton(self.words, self.fold)(c)
        elif self.fold:
            hit = F.lower(c).rlike("|".join(re.escape(w.lower()) for w in self.words))
        else:
            hit = c.rlike("|".join(re.escape(w) for w in self.words))
        return hit if self.action == "keep" else ~hit


class KeywordFilterV2(KeywordFilter):
    """The same with case: long lists go through an automaton that finds all keywords in one pass."""

    fold = False


def automaton(words: list[str], fold: bool):
    @F.pandas_udf("boolean")
    def hits(texts: pd.Series) -> pd.Series:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w.lower() if fold else w, True)
        machine.make_automaton()
        return texts.map(lambda t: next(machine.iter(t.lower() if fold else t), None) is not None)

    return hits


class LengthFilter(Filter):
    """Keep values whose length is within bounds."""

    def __init__(self, key: str | None = None, min_length: int = 1, max_length: int | None = None, **kwargs):
        super().__init__(key=key)
        self.low, self.high = min_length, max_length

    def keeps(self, df):
        c, kind = self.value(df)
        n = F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c)
        out = n >= self.low
        return F.coalesce(out & (n <= self.high) if self.high is not None else out, F.lit(False))


class SimpleMatch(Filter):
    """Every field has its value."""

    def __init__(self, reference: dict | None = None, **kwargs):
        super().__init__()
        self.reference = {**(reference or {}), **kwargs}

    def keeps(self, df):
        out = F.lit(True)
        for k, v in self.reference.items():
            out = out & path(df, k)[0].eqNullSafe(F.lit(v))
        return out


class JsonPathMatch(Filter):
    """A JSON path finds something in the record (or in the JSON text of ``key``)."""

    def __init__(self, pattern: str, key: str | None = None):
        super().__init__(key=key)
        self.pattern = pattern

    def keeps(self, df):
        c, kind = self.value(df)
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(c, self.pattern, "variant").isNotNull()
        text = c if isinstance(kind, T.StringType) else F.to_json(c)
        return F.get_json_object(text, self.pattern).isNotNull()


class WikidataMatch(Filter):
    """Claims by property: a list of entity ids of which one must be a value, True for present, False for absent.

    claims: MAP<property, ARRAY<STRUCT<mainsnak: STRUCT<datatype, datavalue: STRUCT<value: STRUCT<id>>>>>>.
    """

    kinds, at = ("wikibase-item",), "mainsnak.datavalue.value.id"

    def __init__(self, reference: dict | None = None, **match_relations):
        super().__init__(key="claims")
        self.reference = {**(reference or {}), **match_relations}

    def entity(self, claim: Column) -> Column:
        snak = claim["mainsnak"]
        return F.when(snak["datatype"].isin(*self.kinds), snak["datavalue"]["value"]["id"])

    def among(self, values: list):
        return lambda c: F.coalesce(self.entity(c).isin(values), F.lit(False))

    def keeps(self, df):
        claims = plain("claims")
        out = F.lit(True)
        for p, wanted in self.reference.items():
            has = F.coalesce(F.map_contains_key(claims, F.lit(p)), F.lit(False))
            if isinstance(wanted, bool):
                out = out & (has if wanted else ~has)
            else:
                values = [wanted] if isinstance(wanted, str) else list(wanted)
                out = out & F.coalesce(F.exists(F.try_element_at(claims, F.lit(p)), self.among(values)), F.lit(False))
        return out


class WikidataMatchNew(WikidataMatch):
    """The same over simplified claims: ARRAY<STRUCT<datatype, datavalue>>, the entity's id as the value."""

    kinds = ("wikibase-item", "wikibase-entityid")

    def entity(self, claim):
        return F.when(claim["datatype"].isin(*self.kinds), claim["datavalue"].cast("string"))
