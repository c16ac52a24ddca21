"""Alpha renaming of names that a source binds: a metamorphic test of identities."""

from __future__ import annotations

import ast
import builtins

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Rename(ast.NodeTransformer):
    def __init__(self, names: dict[str, str]):
        self.names = names

    def visit_Name(self, n):
        n.id = self.names.get(n.id, n.id)
        return n

    def visit_arg(self, n):
        n.arg = self.names.get(n.arg, n.arg)
        self.generic_visit(n)
        return n

    def visit_FunctionDef(self, n):
        n.name = self.names.get(n.name, n.name)
        self.generic_visit(n)
        return n

    visit_AsyncFunctionDef = visit_FunctionDef


def alpha(source: str | None, scope: str = "all") -> str | None:
    """The source with bound names replaced one to one; never imports, builtins, free names, attributes or keywords."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None
    functions = {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
    params = {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments) for a in [*n.posonlyargs, *n.args, *n.kwonlyargs, *filter(None, (n.vararg, n.kwarg))]}
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    fixed = {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
    fixed |= {k.arg for n in ast.walk(tree) if isinstance(n, ast.Call) for k in n.keywords if k.arg} | set(dir(builtins)) | {"self", "cls", "request", "req", "http_request"}
    fixed |= {x for n in ast.walk(tree) if isinstance(n, ast.Global | ast.Nonlocal) for x in n.names}
    chosen = {"parameters": params, "functions": functions, "all": params | functions | bound}[scope] - fixed
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | functions | params
    names, i = {}, 0
    for name in sorted(chosen):
        while f"v{i}" in used:
            i += 1
        names[name] = f"v{i}"
        i += 1
    return ast.unparse(_Rename(names).visit(tree))


def renamed(source: Column, scope: str = "all") -> Column:
    def f(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: alpha(s, scope))

    return F.pandas_udf(f, "string")(source)
