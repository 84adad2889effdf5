"""Composition of operators: chains, branches and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame


from rillflow.operators.aggregate import Grouped
from rillflow.operators.base import Op, ReduceBase
from rillflow.operators.filters import condition
from rillflow.records import checkpointed

__all__ = ["Chain", "Fork", "If", "IfElse", "Multiple", "While", "run_op"]


def run_op(op, state):
    """Apply an operator; groups that no reduction takes up are gathered first."""
    if isinstance(state, Grouped) and not isinstance(op, (ReduceBase, Chain)):
        state = state.table()
    return op(state)


class Multiple(Op):
    def __init__(self, *nodes):
        self.nodes = nodes


class Chain(Multiple):
    """One operator after the other; groups at the end are finished."""

    def __call__(self, state):
        for op in self.nodes:
            state = run_op(op, state)
        return state.table() if isinstance(state, Grouped) else state


class Fork(Multiple):
    """All branches get the records; nothing comes out. A shared part is kept in memory while the branches run."""

    def __init__(self, *nodes, copy_data: bool = False):
        super().__init__(*nodes)
        self.results: list[DataFrame] = []

    def __call__(self, df):
        if not df.isStreaming and len(self.nodes) > 1:
            df = df.persist()
        self.results = [r.table() if isinstance(r := run_op(op, df), Grouped) else r for op in self.nodes]
        return df.limit(0)


class If(Op):
    """The operator for records that meet the condition; the others pass."""

    def __init__(self, node, matcher=None, key: str | None = None):
        self.node, self.matcher, self.key = node, matcher, key

    def __call__(self, df):
        c = condition(df, self.matcher, self.key)
        return Chain(self.node)(df.filter(c)).unionByName(df.filter(~c), allowMissingColumns=True)


class IfElse(Op):
    """One of two operators for each record."""

    def __init__(self, node_a, node_b, matcher=None, key: str | None = None):
        self.a, self.b, self.matcher, self.key = node_a, node_b, matcher, key

    def __call__(self, df):
        c = condition(df, self.matcher, self.key)
        return Chain(self.a)(df.filter(c)).unionByName(Chain(self.b)(df.filter(~c)), allowMissingColumns=True)


class While(Op):
    """Repeat the operator on records that meet the condition, up to max_iterations times; the others are done.

    The lineage is cut in each round. compat: records that are done before the last round are dropped.
    """

    def __init__(self, node, matcher=None, key: str | None = None, max_iterations: int = -1, compat: bool = False):
        self.node, self.matcher, self.key, self.most, self.compat = node, matcher, key, max_iterations, compat

    def __call__(self, df):
        done, turn = None, 0
        while self.most < 0 or turn < self.most:
            c = condition(df, self.matcher, self.key)
            open_rows = df.filter(c)
            if open_rows.isEmpty():
                break
            rest = df.filter(~c)
            if not self.compat:
                done = rest if done is None else done.unionByName(rest, allowMissingColumns=True)
            df = checkpointed(Chain(self.node)(open_rows))
            turn += 1
        return df if done is None else done.unionByName(df, allowMissingColumns=True)
