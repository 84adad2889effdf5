"""The operator protocol and the operators that touch a record as a whole."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rillflow.records import path, plain, truthy

__all__ = ["AddTS", "Count", "DictProcessorBase", "MaxValue", "MinValue", "Op", "Print", "Processor", "Prompt", "ReduceBase", "Repeat", "Sleep", "ToArray", "ToDict", "UUID", "Wait", "WriteQueue"]


class Op:
    """An operator: a function from DataFrame to DataFrame."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return df


Processor = Op
DictProcessorBase = Op


class ReduceBase(Op):
    """Many records to one."""


def packed(df: DataFrame):
    """The record as one column: the only column where it is called ``value``, else a struct of all."""
    return plain("value") if df.columns == ["value"] else F.struct(*[plain(c) for c in df.columns])


class ToDict(Op):
    """Put the record under a key."""

    def __init__(self, key: str = "d"):
        self.key = key

    def __call__(self, df):
        return df.select(packed(df).alias(self.key))


class ToArray(Op):
    """Put the record into an array."""

    def __call__(self, df):
        return df.select(F.array(packed(df)).alias("value"))


class Repeat(Op):
    """Each record n times."""

    def __init__(self, num_of_repeats: int):
        self.n = num_of_repeats

    def __call__(self, df):
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(self.n)))).drop("_copy") if self.n > 0 else df.limit(0)


class Prompt(Op):
    """Print a message when the plan is built; records pass."""

    def __init__(self, msg: str):
        self.msg = msg

    def __call__(self, df):
        print(self.msg)
        return df


class Print(Op):
    """Show some records; all pass."""

    def __init__(self, *keys: str, with_id: bool = False, pretty: bool = False, rows: int = 20):
        self.keys, self.with_id, self.pretty, self.rows = keys, with_id, pretty, rows

    def __call__(self, df):
        shown = df.select(*[path(df, k)[0].alias(k) for k in (["_id"] if self.with_id and "_id" in df.columns else []) + list(self.keys)]) if self.keys else df
        shown.show(self.rows, truncate=False, vertical=self.pretty)
        return df


class Count(Op):
    """Count what passes, as an observed metric: ``counted`` has the number after an action."""

    def __init__(self, ticks: int = 1000, label: str = "-"):
        self.ticks, self.label = ticks, label
        self.observation: Observation | None = None

    def __call__(self, df):
        if df.isStreaming:
            return df.observe(f"count {self.label}", F.count(F.lit(1)).alias("n"))
        self.observation = Observation(f"count {self.label} {uuid.uuid4().hex[:8]}")
        return df.observe(self.observation, F.count(F.lit(1)).alias("n"))

    @property
    def counted(self) -> int:
        return self.observation.get["n"]


class AddTS(Op):
    """Set the key to the time of the query where it is not set, or always."""

    def __init__(self, key: str, millis: bool = True, upsert: bool = False):
        self.key, self.millis, self.upsert = key, millis, upsert

    def __call__(self, df):
        now = F.unix_millis(F.current_timestamp()) if self.millis else F.unix_seconds(F.current_timestamp())
        return df.withColumn(self.key, now if self.upsert or self.key not in df.columns else F.coalesce(plain(self.key), now))


class UUID(Op):
    """Set the key to a random UUID where it is not set, or always."""

    def __init__(self, key: str = "_id", upsert: bool = False):
        self.key, self.upsert = key, upsert

    def __call__(self, df):
        new = F.expr("uuid()")
        return df.withColumn(self.key, new if self.upsert or self.key not in df.columns else F.coalesce(plain(self.key), new))


class _RowWise(Op):
    def __init__(self, target_key: str, *source_keys: str):
        self.target, self.sources = target_key, source_keys

    def __call__(self, df):
        values = []
        for k in self.sources:
            c, kind = path(df, k)
            values.append(F.when(truthy(c, kind), c))
        return df.withColumn(self.target, self.pick(values))


class MinValue(_RowWise):
    """The least of the keys' values that are not empty or zero."""

    @staticmethod
    def pick(values):
        return F.least(*values) if len(values) > 1 else values[0]


class MaxValue(_RowWise):
    """The greatest of the keys' values that are not empty or zero."""

    @staticmethod
    def pick(values):
        return F.greatest(*values) if len(values) > 1 else values[0]


class Wait(Op):
    """Pause before the plan goes on; a rate for each record has no place in a batch."""

    def __init__(self, seconds: float = 1):
        self.seconds = seconds

    def __call__(self, df):
        time.sleep(self.seconds)
        return df


class Sleep(Wait):
    def __init__(self, seconds: float = 1, max_seconds: float | None = None):
        super().__init__(seconds if max_seconds is None else (seconds + max_seconds) / 2)


class WriteQueue(Op):
    """Append the records to a list on the driver, for tests and small results."""

    def __init__(self, queue: list):
        self.queue = queue

    def __call__(self, df):
        self.queue.extend(r.asDict(recursive=True) for r in df.toLocalIterator())
        return df
