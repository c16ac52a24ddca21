"""Corpus building from sources: functions, module context, composed snippets, expected classes.

What needs a syntax tree is one Arrow stage a question; joins and counts are relations.
"""

from __future__ import annotations

import ast
import textwrap

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrain.operators import findings, parse
from tracegrain.operators.parse import dotted
from tracegrain.operators.tables import cut
from tracegrain.plans import registry as R

# What a call by these names is expected to be, whatever the registry says.
EXPECTED_NAMES = {
    "CWE-94": (
        "system", "popen", "Popen", "check_call", "check_output", "spawn", "spawnl", "spawnv", "execv", "execve", "execvp", "eval", "exec",
    ),
    "CWE-89": ("execute", "executemany", "executescript", "execute_sql"),
    "CWE-22": ("open", "send_file", "send_from_directory", "remove", "unlink", "rmdir"),
    "CWE-79": ("HttpResponse", "mark_safe", "render_to_response", "render", "Template", "send_mail"),
    "CWE-601": ("redirect", "HttpResponseRedirect", "RedirectResponse", "redirect_to", "HttpResponseRedirectPermanent"),
    "CWE-918": ("urlopen", "urlretrieve"),
    "CWE-502": ("Unpickler",),
    "CWE-611": ("fromstring", "parseString", "iterparse", "XMLParser", "make_parser"),
    "CWE-434": ("ImageField", "FileField"),
}
EXPECTED_QUALIFIED = {
    "CWE-918": ("requests.get", "requests.post", "httpx.get", "httpx.post", "urllib.request.urlopen"),
    "CWE-611": ("lxml.etree.fromstring", "lxml.etree.parse", "xml.etree.ElementTree.fromstring", "xml.etree.ElementTree.parse"),
    "CWE-601": ("django.shortcuts.redirect",),
    "CWE-94": ("subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_output"),
    "CWE-89": ("sqlite3.connect",),
    "CWE-502": (
        "pickle.load", "pickle.loads", "pickle.Unpickler", "cPickle.load", "cPickle.loads", "marshal.load", "marshal.loads", "dill.load",
        "dill.loads", "jsonpickle.decode", "jsonpickle.unpickler.decode", "joblib.load", "torch.load", "yaml.load", "yaml.full_load", "shelve.open",
    ),
}
#: Classes whose bare names count only with a positional argument.
NEEDS_VALUE = ("CWE-94", "CWE-89")


def _tree(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def function_spans(source: str | None) -> list[tuple[str, str, int, int]]:
    """(qualname, dedented text with decorators, first line, last line), outer ones first; repeated names get #2, #3."""
    tree = _tree(source)
    if tree is None:
        return []
    lines, out, seen = (source or "").split("\n"), [], {}
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, prefix = todo.pop(0)
        inner = []
        for child in ast.iter_child_nodes(node):
            name = f"{prefix}{child.name}" if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else None
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                seen[name] = n = seen.get(name, 0) + 1
                text = textwrap.dedent("\n".join(lines[first - 1 : child.end_lineno]))
                out.append((name if n == 1 else f"{name}#{n}", text, first, child.end_lineno))
            if isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case):
                inner.append((child, f"{name}." if name else prefix))
        todo = inner + todo
    return out


def context_of(source: str | None) -> str:
    """The import statements and assignments to upper-case names of a module."""
    tree = _tree(source)
    if tree is None:
        return ""
    lines = (source or "").split("\n")

    def kept(s: ast.stmt) -> bool:
        constant = isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id.isupper() for t in s.targets)
        return constant or isinstance(s, ast.Import | ast.ImportFrom)

    return "\n".join("\n".join(lines[s.lineno - 1 : s.end_lineno]) for s in tree.body if kept(s))


def extract_functions(sources: DataFrame) -> DataFrame:
    """(path, qualname, body, start, end, context) of each function of (path, source)."""

    def f(batches):
        for pdf in batches:
            rows = [(p, *x, context_of(s)) for p, s in zip(pdf["path"], pdf["source"], strict=True) for x in function_spans(s)]
            yield pd.DataFrame(rows, columns=["path", "qualname", "body", "start", "end", "context"])

    return sources.select("path", "source").mapInPandas(f, "path string, qualname string, body string, start int, end int, context string")


def composed(functions: DataFrame) -> DataFrame:
    """``functions`` with snippet: context and body, null where that doesn't parse."""

    @F.pandas_udf("string")
    def whole(context: pd.Series, body: pd.Series) -> pd.Series:
        made = [f"{c}\n\n{b}\n" if c else f"{b}\n" for c, b in zip(context, body, strict=True)]
        return pd.Series([x if _tree(x) is not None else None for x in made], dtype=object)

    return functions.withColumn("snippet", whole("context", "body"))


def ast_calls(sources: DataFrame) -> DataFrame:
    """(path, name, qualified, line, n_args) of every call; qualified is empty unless it is a dotted name throughout."""

    def plain(e: ast.expr) -> bool:
        while isinstance(e, ast.Attribute):
            e = e.value
        return isinstance(e, ast.Name)

    def f(batches):
        for pdf in batches:
            rows = []
            for path, source in zip(pdf["path"], pdf["source"], strict=True):
                for e in ast.walk(_tree(source) or ast.Module([], [])):
                    if isinstance(e, ast.Call) and isinstance(e.func, ast.Name | ast.Attribute):
                        name = e.func.id if isinstance(e.func, ast.Name) else e.func.attr
                        rows.append((path, name, dotted(e.func) if plain(e.func) else "", e.lineno, len(e.args)))
            yield pd.DataFrame(rows, columns=["path", "name", "qualified", "line", "n_args"])

    return sources.select("path", "source").mapInPandas(f, "path string, name string, qualified string, line int, n_args int")


def expected_classes(calls: DataFrame) -> DataFrame:
    """(path, cwe), distinct: a qualified name decides alone, else the bare name.  The tables are constants, so they are broadcast."""
    spark = calls.sparkSession
    by_path = spark.createDataFrame([(n, c) for c, names in EXPECTED_QUALIFIED.items() for n in names], "qualified string, a string")
    by_name = spark.createDataFrame([(n, c) for c, names in EXPECTED_NAMES.items() for n in names], "name string, b string")
    known = calls.join(F.broadcast(by_path), "qualified", "left").join(F.broadcast(by_name), "name", "left")
    bare = F.when((F.col("n_args") > 0) | ~F.col("b").isin(*NEEDS_VALUE), F.col("b"))
    return known.select("path", F.coalesce("a", bare).alias("cwe")).where("cwe is not null").distinct()


def in_scope(advisories: DataFrame) -> DataFrame:
    """Advisories (cwes) with a class that the registry has."""
    return advisories.where(F.arrays_overlap("cwes", F.array(*[F.lit(c) for c, _ in R.CATEGORIES.values()])))


def limited(changed: DataFrame, files: int, functions: int) -> DataFrame:
    """Changed functions (repo, commit, path, qualname): the first ``files`` files of a commit; a file with more than ``functions`` is skipped whole."""
    n = F.count(F.lit(1)).over(Window.partitionBy("repo", "commit", "path"))
    small = changed.withColumn("__n", n).where(F.col("__n") <= functions).drop("__n")
    order = Window.partitionBy("repo", "commit").orderBy("path")
    return small.withColumn("__f", F.dense_rank().over(order)).where(F.col("__f") <= files).drop("__f")


def paired(before: DataFrame, after: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, status): changed, unchanged, removed or added, for functions of two revisions."""
    a, b = before.select(*key, F.col(body).alias("__a")), after.select(*key, F.col(body).alias("__b"))
    status = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def statistics(records: DataFrame, accepted: str, reason: str, sets: list[str]) -> DataFrame:
    """(accepted, rejected) in all, by the reason of rejection, and for each of ``sets``, in one pass."""
    rows = records.withColumn(reason, F.when(~F.col(accepted), F.col(reason)))
    g = rows.groupingSets([[F.col(c)] for c in [reason, *sets]] + [[]], reason, *sets)
    return g.agg(F.count(F.when(F.col(accepted), 1)).alias("accepted"), F.count(F.when(~F.col(accepted), 1)).alias("rejected"))


def evidence(pairs: DataFrame) -> DataFrame:
    """(pair_id, tier) of (pair_id, cwe, snippet, module): direct-sink or module-proximity; a pair with neither has no row.

    direct-sink: the snippet passes something that is no constant, at a place that
    matters, to a sink of the class, or marks it as safe.  module-proximity: a
    function of the snippet returns something, and its module does so.
    """
    text = F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("snippet").alias("source")), F.struct(F.lit("m").alias("side"), F.col("module").alias("source"))))
    files = pairs.select(F.col("pair_id").cast("string").alias("id"), text.alias("t")).where("t.source is not null")
    scopes = cut(parse.parse(files.select(F.concat_ws("|", "t.side", "id").alias("path"), "t.source"))).where("error is null")
    hits = scopes.select("path", F.explode("hits").alias("h")).select("path", "h.*").where("not constant")
    amp = hits.where("amplifier").select("path", F.lit("CWE-79").alias("cwe"))
    own = findings.dangerous(hits.where("not amplifier"), R.dims(pairs.sparkSession)["sink"]).where("danger").select("path", "cwe")
    touched = own.unionByName(amp).distinct()
    gives = scopes.where("scope > 0 and n_returns > 0").select("path").distinct().withColumn("cwe", F.lit("returns"))
    side = lambda df: df.select(F.substring("path", 1, 1).alias("side"), F.substr("path", F.lit(3)).alias("id"), "cwe")
    known = side(touched.unionByName(gives))
    wanted = pairs.select("pair_id", F.col("pair_id").cast("string").alias("id"), F.col("cwe").alias("want"))
    m = wanted.join(known.hint("merge"), "id").groupBy("pair_id").agg(
        F.max((F.col("side") == "s") & (F.col("cwe") == F.col("want"))).alias("direct"), F.max((F.col("side") == "m") & (F.col("cwe") == F.col("want"))).alias("near"),
        F.max((F.col("side") == "s") & (F.col("cwe") == "returns")).alias("gives"),
    )
    tier = F.when(F.col("direct"), "direct-sink").when(F.col("near") & F.col("gives"), "module-proximity")
    return m.select("pair_id", tier.alias("tier")).where("tier is not null")
