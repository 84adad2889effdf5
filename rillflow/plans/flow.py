"""Flows: YAML or Python definitions that become DataFrame plans.

A flow has ``arguments``, ``consts``, ``nodes``, ``loader`` and ``processor``. A node's value is a constructor call as text. The text is parsed
with ``ast``; only calls of listed names with literals, constants, arguments and other nodes are built. ``from`` inherits from
other files; the child's entries win.
"""

from __future__ import annotations

import argparse
import ast
import os
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from rillflow.operators.aggregate import Grouped
from rillflow.operators.control import Chain, Fork
from rillflow.plans import registry


def merge(base: dict, over: dict) -> dict:
    """Nested merge; the second wins."""
    return {**base, **{k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def load(path: str, seen: frozenset = frozenset()) -> dict:
    """A flow file with all that it inherits."""
    path = os.path.abspath(path)
    if path in seen:
        return {}
    with open(path, encoding="utf8") as f:
        own = yaml.safe_load(f) or {}
    parents = own.pop("from", None) or []
    out: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merge(out, load(os.path.join(os.path.dirname(path), parent), seen | {path}))
    return merge(out, own)


class Builder:
    """Builds the objects of a definition."""

    def __init__(self, names: dict):
        self.names = names
        self.kinds = {"loader": registry.sources(), "processor": registry.operators()}

    def constant(self, value):
        """$NAME is an environment variable and =text an expression; lists and dictionaries are gone through."""
        if isinstance(value, dict):
            return {k: self.constant(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.constant(v) for v in value]
        if isinstance(value, str) and value.startswith("$"):
            return os.environ.get(value[1:], "")
        if isinstance(value, str) and value.startswith("="):
            return self.value(ast.parse(value[1:].strip(), mode="eval").body, "processor")
        return value

    def build(self, text, kind: str):
        if isinstance(text, list):
            return Chain(*[self.build(x, kind) for x in text])
        if not isinstance(text, str):
            return text
        text = text.strip()
        if text.startswith("="):
            text = text[1:].strip()
        if text in self.names:
            return self.names[text]
        if text.isidentifier() or text.replace(".", "").isidentifier():
            return self.named(text, kind)()
        return self.value(ast.parse(text, mode="eval").body, kind)

    def named(self, name: str, kind: str):
        for k in (kind, "processor", "loader"):
            if name in self.kinds[k]:
                return self.kinds[k][name]
        raise KeyError(f"nothing is called {name}")

    def value(self, node: ast.AST, kind: str):
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Lambda):
            return ast.unparse(node)
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [self.value(x, kind) for x in node.elts]
        if isinstance(node, ast.Dict):
            return {self.value(k, kind): self.value(v, kind) for k, v in zip(node.keys, node.values, strict=True)}
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.value(node.operand, kind)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
            a, b = self.value(node.left, kind), self.value(node.right, kind)
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b}[type(node.op)]()
        if isinstance(node, (ast.Name, ast.Attribute)):
            name = ast.unparse(node)
            if name in self.names:
                return self.names[name]
            try:
                return self.named(name, kind)()
            except (KeyError, TypeError):
                return registry.function(name)
        if isinstance(node, ast.Call):
            target = self.named(ast.unparse(node.func), kind)
            args = []
            for a in node.args:
                args += self.value(a.value, kind) if isinstance(a, ast.Starred) else [self.value(a, kind)]
            return target(*args, **{k.arg: self.value(k.value, kind) for k in node.keywords if k.arg})
        raise ValueError(f"not allowed in a flow: {ast.unparse(node)}")


@dataclass
class Flow:
    """A source and an operator."""

    source: object
    operator: object = None
    name: str = ""
    forks: list = field(default_factory=list)

    @classmethod
    def from_dict(cls, flow: dict, *args, loader: str | None = None, processor: str | None = None) -> Flow:
        names: dict = {"argc": len(args), "args": list(args)} | {f"arg{k}": v for k, v in enumerate(args, 1)}
        need = flow.get("arguments") or 0
        if len(args) < int(need):
            raise ValueError(f"the flow needs {need} arguments")
        b = Builder(names)
        for k, v in (flow.get("consts") or {}).items():
            names[k] = b.constant(v)
        for k, v in (flow.get("nodes") or {}).items():
            names[k] = b.build(v, "loader" if k.startswith(("loader", "database")) else "processor")
        operator = processor or flow.get("processor")
        return cls(b.build(loader or flow["loader"], "loader"), b.build(operator, "processor") if operator else None, flow.get("name", ""))

    @classmethod
    def from_file(cls, path: str, *args, **kwargs) -> Flow:
        return cls.from_dict(load(path), *args, **kwargs)

    def plan(self, spark: SparkSession, skip: int = 0, limit: int = 0) -> DataFrame:
        """The DataFrame of the flow. As on the command line, skipped rows count towards the limit."""
        df = self.source(spark) if not isinstance(self.source, DataFrame) else self.source
        if skip:
            df = df.offset(skip)
        if limit:
            df = df.limit(max(0, limit - skip))
        out = self.operator(df) if self.operator is not None else df
        return out.table() if isinstance(out, Grouped) else out

    def run(self, spark: SparkSession, skip: int = 0, limit: int = 0) -> int:
        """Run the plan; the number of rows that come out."""
        return self.plan(spark, skip, limit).count()


def run(source, operator, spark: SparkSession, skip: int = 0, limit: int = 0) -> DataFrame:
    """The plan of a source and an operator from Python."""
    return Flow(source, operator).plan(spark, skip, limit)


def main(argv: list[str] | None = None) -> int:
    """rillflow FLOW [ARGUMENTS] [-i INPUT] [--loader TEXT] [--processor TEXT] [--limit N] [--skip N]."""
    p = argparse.ArgumentParser(prog="rillflow")
    p.add_argument("flow")
    p.add_argument("args", nargs="*")
    p.add_argument("-i", "--input")
    p.add_argument("--json", action="store_true")
    p.add_argument("--loader")
    p.add_argument("--processor")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--skip", type=int, default=0)
    a = p.parse_args(argv)
    definition = load(a.flow) if os.path.exists(a.flow) else {"name": a.flow}
    loader = a.loader
    if a.input is not None:
        import json

        loader = f"Array([{json.loads(a.input)!r}])" if a.json else f"String({a.input!r})"
    spark = SparkSession.builder.appName(definition.get("name") or a.flow).config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
    flow = Flow.from_dict(definition, *a.args, loader=loader, processor=a.processor)
    print(flow.run(spark, a.skip, a.limit))
    return 0


__all__ = ["Chain", "Flow", "Fork", "load", "main", "merge", "run"]
