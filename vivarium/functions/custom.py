"""User formulas: 'name = expression' lines compiled to Columns; nothing in them is ever evaluated as Python."""

from __future__ import annotations

import ast
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed list of allowed functions.
FUNCTIONS = {
    "abs": F.abs, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "round": F.bround, "floor": F.floor, "ceil": F.ceil,
    "log": lambda x: F.when(x > 0, F.log(x)), "log10": lambda x: F.when(x > 0, F.log10(x)), "log2": lambda x: F.when(x > 0, F.log2(x)),
    "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "min": F.least, "max": F.greatest,
}


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _divide, ast.Pow: F.pow,
    ast.FloorDiv: lambda a, b: F.floor(_divide(a, b)), ast.Mod: lambda a, b: a - b * F.floor(_divide(a, b)),
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_UNARY = {ast.USub: lambda a: -a, ast.UAdd: lambda a: a, ast.Not: lambda a: ~a}


def compile_expression(text: str, names: dict[str, Column]) -> Column:
    """A Column for an arithmetic or logical expression over `names`; ValueError for anything else."""

    def visit(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return visit(body)
            case ast.Constant(value=v) if isinstance(v, (bool, int, float)):
                return F.lit(v)
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](visit(a), visit(b))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
                return _UNARY[type(op)](visit(a))
            case ast.BoolOp(op=op, values=values):
                parts = [visit(v) for v in values]
                return functools.reduce((lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b), parts)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](visit(a), visit(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and args:
                return FUNCTIONS[name](*(visit(a) for a in args))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return visit(ast.parse(text, mode="eval"))


def parse_lines(text: str) -> list[tuple[str, str]]:
    """(name, expression) of each 'name = expression' line; ValueError at the first bad or repeated name."""
    out: list[tuple[str, str]] = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, eq, body = line.partition("=")
        name = name.strip()
        if not eq or not name.isidentifier() or name in dict(out):
            raise ValueError(f"not a definition: {line!r}")
        out.append((name, body.strip()))
    return out


def add_variables(df: DataFrame, text: str, **constants: float) -> tuple[DataFrame, list[str]]:
    """df with the variables, in order, later ones using earlier; names that clash or fail are left out and returned."""
    skipped = []
    for name, body in parse_lines(text):
        names = {c: F.col(f"`{c}`") for c in df.columns} | {k: F.lit(v) for k, v in constants.items()}
        try:
            if name in names:
                raise ValueError(name)
            new = df.withColumn(name, compile_expression(body, names))
            new.schema  # resolves types now  # noqa: B018
            df = new
        except Exception:  # a formula that doesn't resolve is skipped like one that doesn't parse
            skipped.append(name)
    return df, skipped
