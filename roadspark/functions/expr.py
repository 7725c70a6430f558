"""A small expression language for user rules, compiled to Catalyst expressions.

Python's syntax, of which literals, names, arithmetic, comparison (chained too), and/or/not, if/else, indexing,
lists, the functions below and assignments to local names before the last expression are allowed. Names are
columns of the context. Integer division truncates towards zero. And, or and if/else look at their parts from
the left and no farther than needed.

A runtime error (division by the integer zero, an index out of range, an integer overflow, a name whose column is
null) makes the value null, and a verdict tells what null means in its context. What is known to be wrong
before a row is seen is a RuleError: unknown names, booleans in order comparisons or arithmetic, a verdict that
is a list. Compiled rules are columns, so they are pushed down and generated like any other.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names a rule may use, by context.
FIELDS = {
    "route": "route_id vehicle stops travel_s service_s wait_s setup_s span_s distance load_max start_time end_time cost cost_travel cost_span jobs capacity per_hour fixed profile_speed late_jobs max_lateness time_warp overload".split(),
    "solution": "vehicles_used unassigned_count total_cost total_distance total_travel makespan spread".split(),
    "arc": "travel distance service wait load time".split(),
    "broker": "seen dist prior n mean std hour weekend cost".split(),
}
MOST_NODES = 4096
COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


class RuleError(ValueError):
    """A rule that the language does not allow."""


def _position(xs: Column, x: Column) -> Column:
    return F.array_position(xs, x)


FUNCTIONS = {
    "len": lambda x: F.size(x).cast("bigint"),
    "abs": F.abs,
    "min": lambda *x: F.array_min(x[0]) if len(x) == 1 else F.least(*x),
    "max": lambda *x: F.array_max(x[0]) if len(x) == 1 else F.greatest(*x),
    "sum": lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double")),
    "any": lambda x: F.exists(x, lambda v: v),
    "all": lambda x: F.forall(x, lambda v: v),
    "round": lambda x: F.round(x).cast("bigint"),
    "int": lambda x: x.cast("bigint"),
    "float": lambda x: x.cast("double"),
    "bool": lambda x: x.cast("boolean"),
    "contains": F.array_contains,
    "index": lambda xs, x: F.when(_position(xs, x) > 0, _position(xs, x) - 1).otherwise(F.lit(None)),
    "before": lambda xs, a, b: (_position(xs, a) > 0) & (_position(xs, b) > 0) & (_position(xs, a) < _position(xs, b)),
    "first": lambda xs: F.try_element_at(xs, F.lit(1)),
    "last": lambda xs: F.try_element_at(xs, F.lit(-1)),
}
#: What the functions give: int, float, bool or element (of their list).
GIVES = {"len": "int", "round": "int", "int": "int", "index": "int", "float": "float", "any": "bool", "all": "bool", "bool": "bool", "contains": "bool", "before": "bool", "first": "element", "last": "element"}
ORDERED = (ast.Lt, ast.LtE, ast.Gt, ast.GtE)
#: A hard constraint's weight.
HARD = 1e12


class _Compiler:
    def __init__(self, names: dict[str, Column], kinds: dict[str, str]):
        self.names, self.kinds = dict(names), dict(kinds)

    def kind(self, node: ast.AST) -> str:
        """int, float, bool, list or any (not known before a row is seen)."""
        if isinstance(node, ast.Constant):
            return {bool: "bool", int: "int", float: "float"}.get(type(node.value), "any")
        if isinstance(node, ast.Name):
            return self.kinds.get(node.id, "any")
        if isinstance(node, (ast.List, ast.Tuple)):
            return "list"
        if isinstance(node, (ast.BoolOp, ast.Compare)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return "bool"
        if isinstance(node, ast.UnaryOp):
            return self.kind(node.operand)
        if isinstance(node, (ast.BinOp, ast.IfExp)):
            a, b = (self.kind(x) for x in ((node.left, node.right) if isinstance(node, ast.BinOp) else (node.body, node.orelse)))
            return a if a == b else "float" if {a, b} == {"int", "float"} else "any"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            name, own = node.func.id, [self.kind(x) for x in node.args]
            if name in ("abs", "min", "max") and len(set(own)) == 1 and own[0] in ("int", "float"):
                return own[0]
            if name == "sum":
                elements = [self.kind(x) for x in node.args[0].elts] if node.args and isinstance(node.args[0], ast.List) else []
                return "int" if elements and set(elements) == {"int"} else "float"
            return GIVES.get(name, "any").replace("element", "any")
        return "any"

    def whole(self, node: ast.AST) -> bool:
        """Whether an expression is an integer by its parts."""
        return self.kind(node) == "int"

    def program(self, tree: ast.Module) -> tuple[Column, str]:
        """The last expression under the local names that come before it, and its kind."""
        if not tree.body or not isinstance(tree.body[-1], ast.Expr):
            raise RuleError("a rule ends with an expression")
        for line in tree.body[:-1]:
            if not isinstance(line, ast.Assign) or len(line.targets) != 1 or not isinstance(line.targets[0], ast.Name):
                raise RuleError("only local names may be set")
            name = line.targets[0].id
            self.names[name], self.kinds[name] = self.column(line.value), self.kind(line.value)
        return self.column(tree.body[-1].value), self.kind(tree.body[-1].value)

    def column(self, node: ast.AST) -> Column:
        kind = type(node).__name__
        found = getattr(self, f"_{kind}", None)
        if found is None:
            raise RuleError(f"{kind} is not allowed")
        return found(node)

    def _Constant(self, node):
        if not isinstance(node.value, (bool, int, float)):
            raise RuleError("only numbers and booleans are allowed")
        return F.lit(node.value).cast("bigint") if type(node.value) is int else F.lit(node.value)

    def _Name(self, node):
        if node.id not in self.names:
            raise RuleError(f"unknown name {node.id}")
        return self.names[node.id]

    def _BinOp(self, node):
        if "bool" in (self.kind(node.left), self.kind(node.right)) or "list" in (self.kind(node.left), self.kind(node.right)):
            raise RuleError("arithmetic takes numbers")
        a, b, op = self.column(node.left), self.column(node.right), type(node.op)
        whole = self.whole(node)
        if op is ast.Add:
            return F.try_add(a, b)
        if op is ast.Sub:
            return F.try_subtract(a, b)
        if op is ast.Mult:
            return F.try_multiply(a, b)
        if op in (ast.Div, ast.FloorDiv):
            if whole:
                return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))
            return F.when(b == 0, F.signum(a.cast("double")) * float("inf")).otherwise(F.try_divide(a, b))
        if op is ast.Mod:
            return F.try_mod(a, b)
        raise RuleError("unknown operator")

    def _UnaryOp(self, node):
        x = self.column(node.operand)
        if isinstance(node.op, ast.Not):
            return ~x
        if isinstance(node.op, ast.USub):
            return -x
        raise RuleError("unknown operator")

    def _BoolOp(self, node):
        out = self.column(node.values[-1])
        for x in reversed(node.values[:-1]):  # a null on the left is an error, whatever is on the right
            left = self.column(x)
            out = F.when(left, out if isinstance(node.op, ast.And) else F.lit(True)).when(~left, F.lit(False) if isinstance(node.op, ast.And) else out)
        return out

    def _Compare(self, node):
        out, left, kind = None, self.column(node.left), self.kind(node.left)
        for op, right in zip(node.ops, node.comparators):
            if type(op) not in COMPARE:
                raise RuleError("unknown comparison")
            if isinstance(op, ORDERED) and "bool" in (kind, self.kind(right)):
                raise RuleError("booleans compare by == and != only")
            other, kind = self.column(right), self.kind(right)
            now = getattr(left, COMPARE[type(op)])(other)
            out, left = now if out is None else F.when(out, now).when(~out, F.lit(False)), other
        return out

    def _IfExp(self, node):
        test = self.column(node.test)
        return F.when(test, self.column(node.body)).when(~test, self.column(node.orelse))

    def _Subscript(self, node):
        i = self.column(node.slice)
        return F.try_element_at(self.column(node.value), F.when(i >= 0, i + 1).otherwise(i).cast("int"))

    def _List(self, node):
        return F.array(*map(self.column, node.elts))

    _Tuple = _List

    def _Call(self, node):
        if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords:
            raise RuleError("unknown function")
        return FUNCTIONS[node.func.id](*map(self.column, node.args))


def compiled(rule: str, names: dict[str, Column], kinds: dict[str, str] | None = None, context: str | None = None) -> tuple[Column, str]:
    """The rule as a column, and its kind; names are what it may use (of the context's FIELDS, where one is given), kinds what is known of them."""
    try:
        tree = ast.parse(rule.strip())
    except SyntaxError as why:
        raise RuleError(str(why)) from None
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise RuleError("the rule is too long")
    if context is not None:
        names = {k: v for k, v in names.items() if k in FIELDS[context]}
    return _Compiler(names, kinds or {}).program(tree)


def compile_rule(rule: str, names: dict[str, Column], integers: set[str] | None = None, context: str | None = None) -> Column:
    """The rule as a column; names are what it may use, integers those that hold whole numbers."""
    return compiled(rule, names, dict.fromkeys(integers or (), "int"), context)[0]


def verdict(rule: str, names: dict[str, Column], kinds: dict[str, str] | None = None, context: str = "route") -> Column:
    """(ok, penalty) of a rule: booleans accept or reject, numbers above 0 are penalties.

    An error rejects a route and a purchase, costs a plan HARD, and gives an arc 0.
    """
    value, kind = compiled(rule, names, kinds, context)
    if kind == "list":
        raise RuleError("a verdict is no list")
    ok, penalty = (value, F.lit(0.0)) if kind == "bool" else (value.isNotNull(), F.greatest(value.cast("double"), F.lit(0.0)))
    failed = {"solution": (True, HARD), "arc": (True, 0.0)}.get(context, (False, 0.0))
    return F.struct(F.when(value.isNull(), F.lit(failed[0])).otherwise(ok).alias("ok"), F.when(value.isNull(), F.lit(failed[1])).otherwise(penalty).alias("penalty"))


def called_back(rows: DataFrame, rule, column: str = "penalty") -> DataFrame:
    """rows with what a Python function says of each row as a dict: a number is a penalty, False rejects (null), True or None or an exception costs nothing."""
    names = rows.columns

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    got = rule(row)
                except Exception:  # noqa: BLE001 - a callback that fails lets the row pass
                    got = None
                out.append(None if got is False else 0.0 if got is None or got is True else max(0.0, float(got)))
            yield pdf.assign(**{column: pd.Series(out, dtype="float64", index=pdf.index)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != column)
    return rows.select(*[n for n in names if n != column]).mapInPandas(run, f"{kinds}, `{column}` double")


def costed(ways: DataFrame, speed) -> DataFrame:
    """ways(way, tags) with kmh from a Python function of the tags; None or a speed of 0 or less closes the way (null)."""

    def run(frames):
        for pdf in frames:
            found = [speed(dict(tags) if tags is not None else {}) for tags in pdf["tags"]]
            yield pd.DataFrame({"way": pdf["way"], "kmh": pd.Series([None if x is None or x <= 0 else float(x) for x in found], dtype="float64", index=pdf.index)})

    return ways.select("way", "tags").mapInPandas(run, f"way {ways.schema['way'].dataType.simpleString()}, kmh double")
