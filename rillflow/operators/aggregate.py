"""Group, and the reductions of its groups.

``Group`` does not collect anything by itself. The reductions that follow add aggregate expressions, and one
``groupBy().agg()`` computes them all, combined before the shuffle. Only where something else follows are the records of
each group gathered into ``values``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.operators.base import Op, ReduceBase
from rillflow.ordered import runs
from rillflow.records import ORD, num, path, plain, text_of, truthy

__all__ = ["AggCount", "Collect", "First", "Group", "Grouped", "Head", "Last", "Max", "Mean", "Min", "Nth", "OrderBy", "Reduce", "ReduceBy", "ReduceDistinct", "ReduceSample", "Std", "Sum", "Tail", "Var", "aggs"]


#: Columns that grouping adds.
HIDDEN = ("_key", "_run", "_first", "_last")


class Grouped:
    """A table with its grouping and the aggregates asked for so far."""

    def __init__(self, df: DataFrame, keys: list[Column], order: str | None, wanted: dict[str, Column] | None = None, drop: set | None = None):
        self.df, self.keys, self.order, self.wanted, self.drop = df, keys, order, wanted or {}, drop or set()

    def adding(self, name: str, value: Column) -> Grouped:
        return Grouped(self.df, self.keys, self.order, self.wanted | {name: value}, self.drop)

    def records(self) -> Column:
        """The records of a group in their order; unbounded, so only for results that hold them all."""
        row = F.struct(*[plain(c) for c in self.df.columns if c not in HIDDEN])
        if self.order:
            return F.transform(F.array_sort(F.collect_list(F.struct(plain(self.order).alias("o"), row.alias("r")))), lambda x: x["r"])
        return F.collect_list(row)

    def ranked(self, n: int, last: bool = False) -> tuple[Grouped, Column]:
        """This with a column that numbers the records of each group from its start or end, and the first n of them in order.

        A window streams through a group, so no more than n of its records are held.
        """
        if not self.order:
            return self, F.slice(self.records(), F.greatest(F.size(self.records()) - n, F.lit(0)) + 1 if last else 1, n)
        rank = f"_{'last' if last else 'first'}"
        keys = [F.col("_run")] if "_run" in self.df.columns else []
        row = F.struct(*[plain(c) for c in self.df.columns if c not in HIDDEN])
        # ties by the whole record, as where records are sorted
        by = [plain(self.order).desc(), row.desc()] if last else [plain(self.order), row]
        df = self.df if rank in self.df.columns else self.df.withColumn(rank, F.row_number().over(W.partitionBy(*keys, "_key").orderBy(*by)))
        some = F.array_sort(F.collect_list(F.when(F.col(rank) <= n, F.struct(plain(self.order).alias("o"), row.alias("r")))))
        return Grouped(df, self.keys, self.order, self.wanted, self.drop), F.transform(some, lambda x: x["r"])

    def table(self) -> DataFrame:
        wanted = self.wanted or {"values": self.records()}
        return self.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in wanted.items()]).drop("_run", *self.drop)


class Group(Op):
    """Group by the text of a field, ``None`` where it is missing.

    emit_fast: a group ends where another key follows (runs), which needs an order; else all records of a key are one group.
    """

    def __init__(self, by: str, emit_fast: bool = True, order: str | None = None):
        self.by, self.fast, self.order = by, emit_fast, order

    def __call__(self, df) -> Grouped:
        order = self.order or (ORD if ORD in df.columns else None)
        df = df.withColumn("_key", text_of(*path(df, self.by)))
        if self.fast and order:
            df = runs(df, F.col("_key"), [plain(order)], "_run")
            return Grouped(df, [F.col("_run"), F.col("_key").alias("key")], order)
        return Grouped(df, [F.col("_key").alias("key")], order)


class Reduce(ReduceBase):
    """target = func(values). A function of the expression compiler or a pandas UDF sees the array of records."""

    default = "values"

    def __init__(self, func=None, source_key: str = "values", target_key: str | None = None, returns: str | None = None, **kwargs):
        self.func, self.source, self.target, self.returns = func, source_key, target_key or self.default, returns

    def value(self, g: Grouped) -> Column:
        raise NotImplementedError

    def __call__(self, g):
        if isinstance(g, Grouped) and type(self).value is not Reduce.value:
            return g.adding(self.target, self.value(g))
        from rillflow.operators.mapping import applied

        df = g.table() if isinstance(g, Grouped) else g
        return df.withColumn(self.target, applied(df, self.func, [self.source], returns=self.returns)[0])


class ReduceBy(Reduce):
    """Fold over a whole group, which one task holds: add_func(total, item) over the items in their order, from init_func(the first) on.

    init_func and add_func take and return columns.
    """

    def __init__(self, init_func, add_func, field: str | None = None, target_key: str | None = None):
        super().__init__(target_key=target_key)
        self.init, self.add, self.field = init_func, add_func, field

    def value(self, g):
        items = F.transform(g.records(), lambda r: r[self.field]) if self.field else g.records()
        return F.when(F.size(items) > 0, F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), self.init(F.get(items, F.lit(0))), self.add))


class AggCount(Reduce):
    def value(self, g):
        return F.count(F.lit(1))


class _Numeric(Reduce):
    def __init__(self, field: str, target_key: str | None = None, **kwargs):
        super().__init__(target_key=target_key)
        self.field = field

    def number(self, g):
        return num(*path(g.df, self.field))


class Sum(_Numeric):
    """Sum of what is a number, thousands separators allowed, from init on."""

    def __init__(self, field: str, init: float = 0, target_key: str | None = None):
        super().__init__(field, target_key)
        self.init = init

    def value(self, g):
        return F.coalesce(F.sum(self.number(g)), F.lit(0.0)) + F.lit(self.init)


class Min(_Numeric):
    def value(self, g):
        return F.min(self.number(g))


class Max(_Numeric):
    def value(self, g):
        return F.max(self.number(g))


class Mean(_Numeric):
    def value(self, g):
        return F.avg(self.number(g))


class Var(_Numeric):
    """Population variance; compat: the standard deviation."""

    def __init__(self, field: str, target_key: str | None = None, compat: bool = False):
        super().__init__(field, target_key)
        self.compat = compat

    def value(self, g):
        return (F.stddev_pop if self.compat else F.var_pop)(self.number(g))


class Std(_Numeric):
    def value(self, g):
        return F.stddev_pop(self.number(g))


class _Positional(Reduce):
    def row(self, g):
        return F.struct(*[plain(c) for c in g.df.columns if c not in HIDDEN])


class First(_Positional):
    def value(self, g):
        return F.min_by(self.row(g), plain(g.order)) if g.order else F.first(self.row(g))


class Last(_Positional):
    def value(self, g):
        return F.max_by(self.row(g), plain(g.order)) if g.order else F.last(self.row(g))


class _Ranked(Reduce):
    """Reductions to some records at the start or the end of each group."""

    def picked(self, g: Grouped) -> tuple[Grouped, Column]:
        raise NotImplementedError

    def __call__(self, g):
        if not isinstance(g, Grouped):
            return super().__call__(g)
        g, value = self.picked(g)
        return g.adding(self.target, value)


class Nth(_Ranked):
    def __init__(self, i: int = 0, target_key: str | None = None):
        super().__init__(target_key=target_key)
        self.i = i

    def picked(self, g):
        g, rows = g.ranked(self.i + 1 if self.i >= 0 else -self.i, self.i < 0)
        # fewer records than asked for: none
        return g, F.get(rows, F.lit(self.i)) if self.i >= 0 else F.when(F.size(rows) == -self.i, F.get(rows, F.lit(0)))


class Head(_Ranked):
    def __init__(self, num: int = 10, target_key: str | None = None):
        super().__init__(target_key=target_key)
        self.n = num

    def picked(self, g):
        return g.ranked(self.n)


class Tail(Head):
    """The last n; compat: all but the last n, which holds a whole group."""

    def __init__(self, num: int = 10, target_key: str | None = None, compat: bool = False):
        super().__init__(num, target_key)
        self.compat = compat

    def picked(self, g):
        if not self.compat:
            return g.ranked(self.n, last=True)
        return g, F.slice(g.records(), F.lit(1), F.greatest(F.size(g.records()) - self.n, F.lit(0)))


class ReduceSample(Reduce):
    """Each record of a group with a probability, by a hash of the record, so that reruns agree."""

    def __init__(self, rate: float = 0.01, target_key: str | None = None, seed: int = 0):
        super().__init__(target_key=target_key)
        self.rate, self.seed = rate, seed

    def value(self, g):
        row = F.struct(*[plain(c) for c in g.df.columns if c not in HIDDEN])
        drawn = F.pmod(F.xxhash64(row, F.lit(self.seed)), F.lit(1 << 30)) < F.lit(int(self.rate * (1 << 30)))
        return F.collect_list(F.when(drawn, row))


class OrderBy(Reduce):
    def __init__(self, field: str, descend: bool = False, target_key: str | None = None):
        super().__init__(target_key=target_key)
        self.field, self.descend = field, descend

    def value(self, g):
        row = F.struct(*[plain(c) for c in g.df.columns if c not in HIDDEN])
        return F.transform(F.sort_array(F.collect_list(F.struct(path(g.df, self.field)[0].alias("o"), row.alias("r"))), asc=not self.descend), lambda x: x["r"])


class ReduceDistinct(Reduce):
    """The distinct values of a field, sorted."""

    def __init__(self, field: str, target_key: str | None = None):
        super().__init__(target_key=target_key)
        self.field = field

    def value(self, g):
        return F.array_sort(F.collect_set(path(g.df, self.field)[0]))


class Collect(Reduce):
    """The values of a field, in order; empty ones only with keep_null."""

    def __init__(self, field: str, keep_null: bool = False, target_key: str | None = None, **kwargs):
        super().__init__(target_key=target_key)
        self.field, self.keep_null = field, keep_null

    def value(self, g):
        c, kind = path(g.df, self.field)
        real = F.lit(True) if self.keep_null else truthy(c, kind)
        order = plain(g.order) if g.order else F.lit(0)
        return F.transform(F.array_sort(F.collect_list(F.when(real, F.struct(order.alias("o"), c.alias("v"))))) if g.order else F.collect_list(F.when(real, F.struct(order.alias("o"), c.alias("v")))), lambda x: x["v"])


class aggs:
    """The reductions under their short names, as flows write them."""

    Group, Reduce, ReduceBy, Count, Sum, Min, Max, Mean, Var, Std = Group, Reduce, ReduceBy, AggCount, Sum, Min, Max, Mean, Var, Std
    First, Last, Nth, Head, Tail, Sample, OrderBy, Distinct, Collect = First, Last, Nth, Head, Tail, ReduceSample, OrderBy, ReduceDistinct, Collect
