"""Batches, collecting and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.operators.base import Op, packed
from rillflow.ordered import numbered
from rillflow.records import ORD, path, plain, position

__all__ = ["Buffer", "CollectAll", "Sort"]


class Buffer(Op):
    """Batches of a fixed number of records, in their order: (batch, values). mode single: records pass."""

    def __init__(self, buffer_size: int = 100, mode: str = "batch", order: str | None = None):
        self.size, self.mode, self.order = buffer_size, mode, order

    def __call__(self, df):
        if self.mode == "single":
            return df
        order = self.order or (ORD if ORD in df.columns else None)
        rows = numbered(df, [plain(order)], "_n") if order else df.withColumn("_n", F.monotonically_increasing_id())
        row = packed(df)
        return rows.groupBy(F.floor(F.col("_n") / self.size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", row.alias("r")))), lambda x: x["r"]).alias("values"))


class CollectAll(Op):
    """All records as one array (mode batch), or as they are (single). One row then holds the table: for small tables."""

    def __init__(self, mode: str = "batch"):
        self.mode = mode

    def __call__(self, df):
        if self.mode == "stop":
            return df.limit(0)
        return df.agg(F.collect_list(packed(df)).alias("values")) if self.mode == "batch" else df


class Sort(Op):
    """A global sort by a key, or by a lambda of the record; ties in the order of the source."""

    def __init__(self, keyfunc=None, key: str | None = None, reverse: bool = False, mode: str = "single"):
        self.func, self.key, self.reverse, self.mode = keyfunc, key, reverse, mode

    def __call__(self, df):
        if self.func is not None and not isinstance(self.func, str):
            from rillflow.operators.mapping import applied

            c = applied(df, self.func, [self.key] if self.key else None)[0]
        else:
            c = path(df, self.key or self.func)[0]
        if self.mode == "batch":
            return df.agg(F.transform(F.sort_array(F.collect_list(F.struct(c.alias("k"), packed(df).alias("r"))), asc=not self.reverse), lambda x: x["r"]).alias("values"))
        return df.orderBy(c.desc() if self.reverse else c.asc(), position(df))
