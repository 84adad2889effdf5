"""Python expressions and small functions as columns.

``column_of`` takes a lambda, a function of one return statement, or source text, and builds the column that computes it,
from a closed list of syntax and methods. What is outside of the list raises ``NotExpressible``; callers then fall back to
a pandas UDF (for real functions) or refuse (for text). Nothing is ever evaluated.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.records import kind_of, path, plain, truthy


class NotExpressible(ValueError):
    pass


class Value:
    """A column with its type, as far as it is known, or a constant of Python, or the record itself."""

    def __init__(self, col=None, kind=None, const=None, is_const=False, record=False):
        self.col, self.kind, self.const, self.is_const, self.record = col, kind, const, is_const, record

    def column(self) -> Column:
        if self.record:
            raise NotExpressible("the record as a whole")
        return F.lit(self.const) if self.is_const else self.col

    def true(self) -> Column:
        if self.is_const:
            return F.lit(bool(self.const))
        return truthy(self.col, self.kind or T.BooleanType())


STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
COMPARE = {ast.Eq: lambda a, b: a.eqNullSafe(b), ast.NotEq: lambda a, b: ~a.eqNullSafe(b), ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
ARITHMETIC = {ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: F.pow}
METHODS = {
    "startswith": (lambda c, a: F.startswith(c, a), BOOL),
    "endswith": (lambda c, a: F.endswith(c, a), BOOL),
    "lower": (lambda c: F.lower(c), STRING),
    "upper": (lambda c: F.upper(c), STRING),
    "strip": (lambda c, chars=None: F.trim(c, chars) if chars is not None else F.regexp_replace(c, r"^\s+|\s+$", ""), STRING),
    "replace": (lambda c, a, b: F.replace(c, a, b), STRING),
    "split": (lambda c, sep: F.split(c, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1), T.ArrayType(STRING)),
}


class Compiler:
    def __init__(self, df: DataFrame, names: dict[str, Value]):
        self.df, self.names = df, names

    def field(self, key: str) -> Value:
        return Value(*path(self.df, key)) if key in self.df.columns else Value(*path(self.df, [key]))

    def visit(self, node: ast.AST) -> Value:
        method = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if method is None:
            raise NotExpressible(ast.dump(node)[:80])
        return method(node)

    def on_constant(self, node):
        return Value(const=node.value, is_const=True, kind={int: LONG, float: DOUBLE, str: STRING, bool: BOOL}.get(type(node.value)))

    def on_name(self, node):
        if node.id not in self.names:
            raise NotExpressible(node.id)
        return self.names[node.id]

    def on_subscript(self, node):
        base = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            text = base.column()
            low, high = (self.visit(x).const if x is not None else None for x in (node.slice.lower, node.slice.upper))
            if node.slice.step is not None or (low or 0) < 0 or (high or 0) < 0:
                raise NotExpressible("slice")
            if isinstance(base.kind, T.StringType):
                return Value(F.substring(text, (low or 0) + 1, (high if high is not None else 2**31 - 1) - (low or 0)), STRING)
            return Value(F.slice(text, (low or 0) + 1, (high if high is not None else 2**31 - 1) - (low or 0)), base.kind)
        key = self.visit(node.slice)
        if not key.is_const:
            raise NotExpressible("subscript")
        if base.record:
            return self.field(key.const)
        if isinstance(base.kind, T.ArrayType):
            at = F.lit(key.const) if key.const >= 0 else F.size(base.col) + key.const
            return Value(F.get(base.col, at), base.kind.elementType)
        if isinstance(base.kind, T.StructType) and key.const in base.kind.names:
            return Value(base.col.getField(key.const), base.kind[key.const].dataType)
        if isinstance(base.kind, T.MapType):
            return Value(F.try_element_at(base.col, F.lit(key.const)), base.kind.valueType)
        if isinstance(base.kind, T.StringType) and isinstance(key.const, int):
            return Value(F.substring(base.col, key.const + 1 if key.const >= 0 else key.const, 1), STRING)
        raise NotExpressible("subscript")

    def on_compare(self, node):
        left, out = self.visit(node.left), []
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                hit = self.contains(left, right_node)
                out.append(~hit if isinstance(op, ast.NotIn) else hit)
                continue
            right = self.visit(right_node)
            if isinstance(op, (ast.Is, ast.IsNot)):
                if not (right.is_const and right.const is None):
                    raise NotExpressible("is")
                out.append(left.column().isNull() if isinstance(op, ast.Is) else left.column().isNotNull())
            else:
                out.append(F.coalesce(COMPARE[type(op)](left.column(), right.column()), F.lit(False)))
            left = right
        total = out[0]
        for c in out[1:]:
            total = total & c
        return Value(total, BOOL)

    def contains(self, item: Value, holder: ast.AST) -> Column:
        if isinstance(holder, (ast.List, ast.Tuple, ast.Set)):
            return F.coalesce(item.column().isin([self.visit(x).const for x in holder.elts]), F.lit(False))
        inside = self.visit(holder)
        if inside.record:
            return F.lit(item.const in self.df.columns)
        if isinstance(inside.kind, T.ArrayType):
            return F.coalesce(F.array_contains(inside.col, item.column()), F.lit(False))
        if isinstance(inside.kind, T.MapType):
            return F.coalesce(F.map_contains_key(inside.col, item.column()), F.lit(False))
        return F.coalesce(F.contains(inside.column(), item.column()), F.lit(False))

    def on_boolop(self, node):
        parts = [self.visit(x).true() for x in node.values]
        total = parts[0]
        for c in parts[1:]:
            total = total & c if isinstance(node.op, ast.And) else total | c
        return Value(total, BOOL)

    def on_unaryop(self, node):
        inner = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~inner.true(), BOOL)
        if isinstance(node.op, ast.USub):
            return Value(const=-inner.const, is_const=True, kind=inner.kind) if inner.is_const else Value(-inner.col, inner.kind)
        raise NotExpressible("unary")

    def on_binop(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        if a.is_const and b.is_const and isinstance(node.op, ast.Add):
            return Value(const=a.const + b.const, is_const=True, kind=a.kind)
        if isinstance(node.op, ast.Add):
            if isinstance(a.kind, T.StringType) or isinstance(b.kind, T.StringType):
                return Value(F.concat(a.column(), b.column()), STRING)
            if isinstance(a.kind, T.ArrayType):
                return Value(F.concat(a.column(), b.column()), a.kind)
            return Value(a.column() + b.column(), DOUBLE if isinstance(a.kind, T.FractionalType) or isinstance(b.kind, T.FractionalType) else LONG)
        if isinstance(node.op, ast.FloorDiv):
            return Value(F.floor(a.column() / b.column()), LONG)
        if type(node.op) not in ARITHMETIC:
            raise NotExpressible("operator")
        whole = not isinstance(node.op, ast.Div) and not isinstance(a.kind, T.FractionalType) and not isinstance(b.kind, T.FractionalType)
        return Value(ARITHMETIC[type(node.op)](a.column(), b.column()), LONG if whole else DOUBLE)

    def on_ifexp(self, node):
        yes, no = self.visit(node.body), self.visit(node.orelse)
        return Value(F.when(self.visit(node.test).true(), yes.column()).otherwise(no.column()), yes.kind or no.kind)

    def on_list(self, node):
        items = [self.visit(x) for x in node.elts]
        return Value(F.array(*[x.column() for x in items]), T.ArrayType(items[0].kind if items and items[0].kind else STRING))

    def on_joinedstr(self, node):
        parts = [self.visit(x.value).column().cast("string") if isinstance(x, ast.FormattedValue) else F.lit(x.value) for x in node.values]
        return Value(F.concat(*parts), STRING)

    def on_call(self, node):
        if isinstance(node.func, ast.Attribute):
            base, name = self.visit(node.func.value), node.func.attr
            args = [self.visit(x) for x in node.args]
            if base.record and name == "get":
                found = self.field(args[0].const)
                return Value(F.coalesce(found.col, args[1].column()), found.kind) if len(args) > 1 and args[1].const is not None else found
            if name == "get" and isinstance(base.kind, (T.StructType, T.MapType)):
                return self.visit(ast.Subscript(value=node.func.value, slice=node.args[0]))
            if name == "join" and base.is_const:
                return Value(F.array_join(args[0].column(), base.const), STRING)
            if name in METHODS:
                f, kind = METHODS[name]
                return Value(f(base.column(), *[x.column() for x in args]), kind)
            raise NotExpressible(name)
        name = getattr(node.func, "id", "")
        args = [self.visit(x) for x in node.args]
        if name == "len":
            a = args[0]
            if a.record:
                return Value(const=len(self.df.columns), is_const=True, kind=LONG)
            return Value((F.size(a.col) if isinstance(a.kind, (T.ArrayType, T.MapType)) else F.length(a.col)).cast("long"), LONG)
        simple = {"int": ("long", LONG), "float": ("double", DOUBLE), "str": ("string", STRING)}
        if name in simple:
            return Value(args[0].column().try_cast(simple[name][0]), simple[name][1])
        if name == "bool":
            return Value(args[0].true(), BOOL)
        if name == "abs":
            return Value(F.abs(args[0].column()), args[0].kind)
        if name == "round":
            return Value(F.bround(args[0].column(), args[1].const if len(args) > 1 else 0), args[0].kind)
        if name in {"min", "max"} and len(args) > 1:
            return Value((F.least if name == "min" else F.greatest)(*[a.column() for a in args]), args[0].kind)
        raise NotExpressible(name)


def tree_of(function: Callable | str) -> tuple[list[str], ast.AST]:
    """The parameters and the returned expression of a lambda, a short function, or text."""
    if isinstance(function, str):
        body = ast.parse(function.strip().removeprefix("=").strip(), mode="eval").body
        return ([a.arg for a in body.args.args], body.body) if isinstance(body, ast.Lambda) else ([], body)
    try:
        source = textwrap.dedent(inspect.getsource(function)).strip()
    except (OSError, TypeError) as e:
        raise NotExpressible("no source") from e
    if getattr(function, "__closure__", None):
        raise NotExpressible("closure")
    try:
        tree = ast.parse(source)
    except SyntaxError:
        start = source.find("lambda")
        tree = None
        for end in range(len(source), start, -1):
            try:
                tree = ast.parse(source[start:end], mode="eval")
                break
            except SyntaxError:
                continue
        if tree is None:
            raise NotExpressible("source") from None
    lambdas = [x for x in ast.walk(tree) if isinstance(x, ast.Lambda)]
    if function.__name__ == "<lambda>":
        if len(lambdas) != 1:
            raise NotExpressible("several lambdas")
        return [a.arg for a in lambdas[0].args.args], lambdas[0].body
    definition = next((x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef)), None)
    body = [x for x in definition.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))] if definition else []
    if len(body) != 1 or not isinstance(body[0], ast.Return):
        raise NotExpressible("statements")
    return [a.arg for a in definition.args.args], body[0].value


def compiled(df: DataFrame, function: Callable | str, keys: list[str] | None = None, constants: dict | None = None) -> Value:
    """The value of the function for each record, or for the values of the keys."""
    names, body = tree_of(function)
    known = {k: Value(const=v, is_const=True, kind={int: LONG, float: DOUBLE, str: STRING, bool: BOOL}.get(type(v))) for k, v in (constants or {}).items()}
    if keys:
        args = [Value(*path(df, k)) for k in keys]
    elif df.columns == ["value"]:
        args = [Value(plain("value"), kind_of(df, "value"))]
    else:
        args = [Value(record=True)]
    if names and len(names) < len(args):
        raise NotExpressible("arguments")
    known |= dict(zip(names, args, strict=False))
    return Compiler(df, known).visit(body)
