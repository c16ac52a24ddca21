"""The parse stage: Python sources to facts, the one procedural operator.

Every scope of a file (its functions, its methods, its module level) becomes one
row: parameters, calls, sink contacts with the state of the value that reaches
them, invocations with the origins of their arguments, guards, and what the
feature extraction counts.  A file that doesn't parse whole gets a row with an
error and no scope, and the scopes of those parts that parse alone; one that is
nested too deeply gets such a row as well.  All decisions that follow (danger,
confidence, severity, identity, ranking) are relational and live in the other
modules.

A value is (origins, neutralised, partial, path, constant, kills).  Guards are
steps of its path.
"""

from __future__ import annotations

import ast
import itertools
import re
from collections import deque
from dataclasses import dataclass, field, replace
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracegrain.plans import registry as R

STEP = "struct<line:int,column:int,kind:string,edge:string,detail:string>"
HIT = (
    "struct<sink:string,call:string,line:int,position:int,keyword:string,splat:boolean,origins:array<string>,neutralised:array<string>,"
    f"partial:array<string>,steps:array<{STEP}>,kills:array<string>,guard:string,structural:boolean,amplifier:boolean,constant:boolean>"
)
SCHEMA = (
    "path string, error string, imports array<string>, scope int, function string, qualname string, lineno int, end_lineno int, params array<string>, "
    "decorators array<string>, calls array<string>, sinks array<string>, sanitisers array<string>, n_returns int, returns array<int>, returned array<string>, sql_literal boolean, "
    f"hits array<{HIT}>, "
    "invocations array<struct<callee:string,line:int,args:array<struct<origins:array<string>,position:int,keyword:string>>>>, "
    "guards array<struct<line:int,last:int,names:array<string>>>, guarded_returns boolean, sink_names array<struct<line:int,names:array<string>>>"
)
#: Files whose rows go back to Spark at once.
FILES = 500
#: Expressions below so many others are not looked at; their file is flagged.
DEPTH = 150
#: What a guard that ends the path can constrain, and what one by a pattern without separators can.
GUARDED = frozenset(("EXEC", "SQL", "XSS", "FILE", "REDIRECT"))
GUARDED_BY_PATTERN = frozenset(("FILE",))
#: Calls whose result decides whether a path stays inside a folder; methods that do so by being named;
#: comparisons do so if one side calls one of the last two.  Fixed names.
CONTAINMENT = frozenset(("commonpath", "commonprefix", "relative_to", "isabs", "realpath", "is_relative_to"))
CONTAINMENT_METHODS = frozenset(("relative_to", "is_relative_to"))
COMPARED_LEFT = frozenset(("startswith", "commonprefix", "join", "abspath", "normpath"))
COMPARED_METHODS = frozenset(("startswith", "dirname", "abspath", "normpath", "realpath"))
EXIT_CALLS = frozenset(("abort", "os._exit", "sys.exit", "die"))


@dataclass(frozen=True)
class Value:
    origins: frozenset = frozenset()
    neutralised: frozenset = frozenset()
    partial: frozenset = frozenset()
    path: tuple = ()
    constant: bool = False
    kills: tuple = ()


CLEAN, LITERAL = Value(), Value(constant=True)


def merge(*values: Value) -> Value:
    """The union of what flows together; only tainted operands count."""
    tainted = [v for v in values if v.origins]
    if not tainted:
        return Value(constant=bool(values) and all(v.constant for v in values), partial=frozenset().union(*(v.partial for v in values)))
    return Value(
        frozenset().union(*(v.origins for v in tainted)),
        frozenset.intersection(*(v.neutralised for v in tainted)),
        frozenset().union(*(v.partial for v in tainted)),
        min((v.path for v in tainted), key=lambda p: (len(p), p)),
        False,
        tuple(dict.fromkeys(k for v in tainted for k in v.kills)),
    )


def dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        elif isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        else:
            return ".".join(reversed(parts))


@dataclass
class Scope:
    name: str
    qualname: str
    line: int
    end: int
    params: list = field(default_factory=list)
    decorators: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    sinks: list = field(default_factory=list)
    sanitisers: list = field(default_factory=list)
    hits: list = field(default_factory=list)
    invocations: list = field(default_factory=list)
    guards: list = field(default_factory=list)
    return_lines: list = field(default_factory=list)
    return_names: list = field(default_factory=list)
    too_deep: bool = False
    sink_names: list = field(default_factory=list)
    returned: list = field(default_factory=list)
    n_returns: int = 0
    sql_literal: bool = False


class Interpreter(ast.NodeVisitor):
    """Runs the statements of one scope in order on one environment."""

    def __init__(self, scope: Scope, modules: dict[str, frozenset]):
        self.scope, self.modules, self.depth = scope, modules, 0
        self.loop_ends: list[int] = []
        self.env: dict[str, Value] = {}
        for i, p in enumerate(scope.params):
            origin = "GLOBAL" if p in ("self", "cls") else f"PARAM#{i}"
            self.env[p] = Value(frozenset([origin]), path=((scope.line, 0, p, "source", "param"),))

    # -- statements

    def run(self, body: list[ast.stmt]) -> None:
        for s in body:
            getattr(self, f"do_{type(s).__name__}", self.do_other)(s)

    def do_other(self, s: ast.stmt) -> None:
        for child in ast.iter_child_nodes(s):
            if isinstance(child, ast.expr):
                self.value(child)

    def do_Assert(self, s) -> None: ...

    do_Delete = do_Pass = do_Assert

    def do_FunctionDef(self, s) -> None:
        for e in [*s.args.defaults, *(d for d in s.args.kw_defaults if d), *s.decorator_list]:
            self.value(e)

    do_AsyncFunctionDef = do_FunctionDef

    def do_ClassDef(self, s) -> None:
        for e in [*s.bases, *s.decorator_list]:
            self.value(e)
        if self.scope.name == "<module>":
            self.run([x for x in s.body if not isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)])

    def do_Assign(self, s) -> None:
        if len(s.targets) == 1 and isinstance(s.targets[0], ast.Tuple | ast.List) and isinstance(s.value, ast.Tuple | ast.List) and len(s.targets[0].elts) == len(s.value.elts):
            for t, v in zip(s.targets[0].elts, [self.value(v) for v in s.value.elts], strict=True):
                self.bind(t, v)
            return
        v = self.value(s.value)
        for t in s.targets:
            self.bind(t, v)

    def do_AnnAssign(self, s) -> None:
        if s.value is not None:
            self.bind(s.target, self.value(s.value))

    def do_AugAssign(self, s) -> None:
        self.bind(s.target, self.step(merge(self.value(s.target), self.value(s.value)), s, "concat"))

    def bind(self, target: ast.expr, v: Value) -> None:
        if isinstance(target, ast.Name):
            self.env[target.id] = v
        elif isinstance(target, ast.Attribute):
            self.env[dotted(target)] = v
            head = dotted(target).split(".")[0]
            self.env.setdefault(head, v)
        elif isinstance(target, ast.Subscript):
            name = dotted(target)
            self.env[name] = merge(self.env.get(name, CLEAN), v)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, v)
        elif isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self.bind(t, v)

    def do_Return(self, s) -> None:
        self.scope.n_returns += 1
        self.scope.return_lines.append(s.lineno)
        self.scope.return_names.append(s.value is not None and isinstance(s.value, ast.Name | ast.Attribute | ast.Call) and dotted(s.value) or "expr")
        if s.value is not None:
            v = self.step(self.value(s.value), s, "return")
            self.scope.returned += sorted(int(o[6:]) for o in v.origins if o.startswith("PARAM#"))

    def do_If(self, s, guarding: bool = True) -> None:
        self.value(s.test)
        self.contain(s)
        self.run(s.body)
        other = s.orelse[0] if len(s.orelse) == 1 else None
        if isinstance(other, ast.If) and other.col_offset == s.col_offset:  # elif, which guards nothing after it
            self.do_If(other, False)
        else:
            self.run(s.orelse)
        if guarding:
            self.guard(s)

    def loop(self, s) -> None:
        self.loop_ends.append(s.body[-1].end_lineno or s.lineno)
        self.run(s.body)
        self.loop_ends.pop()
        self.run(s.orelse)

    def do_While(self, s) -> None:
        self.value(s.test)
        self.loop(s)

    def do_For(self, s) -> None:
        self.bind(s.target, self.step(self.value(s.iter), s, "loop"))
        self.loop(s)

    do_AsyncFor = do_For

    def do_With(self, s) -> None:
        for item in s.items:
            v = self.value(item.context_expr)
            if item.optional_vars is not None:
                self.bind(item.optional_vars, v)
        self.run(s.body)

    do_AsyncWith = do_With

    def do_Try(self, s) -> None:
        self.run(s.body)
        for h in s.handlers:
            self.run(h.body)
        self.run(s.orelse)
        self.run(s.finalbody)

    do_TryStar = do_Try

    def do_Match(self, s) -> None:
        subject = self.step(self.value(s.subject), s, "branch")
        for c in s.cases:
            for part in ast.walk(c.pattern):
                name = getattr(part, "rest", None) if isinstance(part, ast.MatchMapping) else getattr(part, "name", None)
                if name:
                    self.env[name] = subject
            self.value(c.guard)
            self.run(c.body)

    def do_Global(self, s) -> None:
        for n in s.names:
            self.env[n] = Value(frozenset(["GLOBAL"]), path=((s.lineno, s.col_offset, n, "source", "global"),))

    def contain(self, s: ast.If) -> None:
        """Record a containment test that leaves the function, or its loop, when it fails."""
        end = exit_of(s.body[0])
        if end is None or s.orelse or not decides_containment(s.test):
            return
        last = self.loop_ends[-1] if end == "loop" and self.loop_ends else self.scope.end
        self.scope.guards.append((s.lineno, last, sorted({n.id for n in ast.walk(s.test) if isinstance(n, ast.Name)})))

    def guard(self, s: ast.If) -> None:
        """A test of a bare name, by comparison or by a pattern, constrains its value from here on."""
        test, negated = s.test, False
        while isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            test, negated = test.operand, not negated
        kind, name, categories = "equality", None, GUARDED
        if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.left, ast.Name):
            name, op = test.left.id, test.ops[0]
            if isinstance(op, ast.In | ast.NotIn):
                if not isinstance(test.comparators[0], ast.List | ast.Tuple | ast.Set | ast.Name | ast.Dict):
                    return
                kind = "allowlist" if isinstance(op, ast.NotIn) != negated else "denylist"
        elif isinstance(test, ast.Call) and len(test.args) >= 2 and dotted(test.func).rsplit(".", 1)[-1] in ("match", "fullmatch", "search"):
            pattern, value = test.args[:2]
            if isinstance(value, ast.Name) and isinstance(pattern, ast.Constant) and isinstance(pattern.value, str) and path_safe(pattern.value):
                name, categories = value.id, GUARDED_BY_PATTERN
        v = self.env.get(name) if name else None
        if v is None or not v.origins:
            return
        ends = next((isinstance(x, ast.Return | ast.Raise) for x in s.body if isinstance(x, ast.Return | ast.Raise | ast.If)), False)
        if not ends:
            kind = f"weak_{kind}"
            categories = categories if categories is GUARDED_BY_PATTERN else frozenset()
        self.env[name] = replace(v, partial=v.partial | categories, path=(*v.path, (s.lineno, s.col_offset, "guard", kind, name)))

    # -- expressions

    def step(self, v: Value, node: ast.AST, edge: str, detail: str = "") -> Value:
        line = getattr(node, "lineno", 0)
        if not v.origins or not line or (v.path and v.path[-1][0] == line):
            return v
        return replace(v, path=(*v.path, (line, node.col_offset, "propagate", edge, detail)))

    def value(self, node: ast.expr | None) -> Value:
        if node is None:
            return CLEAN
        self.depth += 1
        try:
            if self.depth < DEPTH:
                return self._value(node)
            self.scope.too_deep = True
            return CLEAN
        finally:
            self.depth -= 1

    def _value(self, e: ast.expr) -> Value:
        if isinstance(e, ast.Constant):
            if isinstance(e.value, str) and len(e.value) >= 8 and any(k in e.value.upper() for k in R.SQL_MARKS):
                self.scope.sql_literal = True
            return LITERAL
        if isinstance(e, ast.Name | ast.Attribute):
            return self.name(e)
        if isinstance(e, ast.Call):
            return self.call(e)
        if isinstance(e, ast.JoinedStr):
            parts = [self.value(p.value) if isinstance(p, ast.FormattedValue) else self.value(p) for p in e.values]
            return self.step(merge(*parts), e, "fstring")
        if isinstance(e, ast.BinOp):
            edge = "percent" if isinstance(e.op, ast.Mod) else "concat"
            return self.step(merge(self.value(e.left), self.value(e.right)), e, edge)
        if isinstance(e, ast.BoolOp):
            return self.step(merge(*map(self.value, e.values)), e, "branch")
        if isinstance(e, ast.Compare):
            return self.step(merge(*map(self.value, [e.left, *e.comparators])), e, "branch")
        if isinstance(e, ast.IfExp):
            return self.step(merge(*map(self.value, [e.test, e.body, e.orelse])), e, "branch")
        if isinstance(e, ast.UnaryOp):
            return self.step(self.value(e.operand), e, "call")
        if isinstance(e, ast.Await | ast.Yield | ast.YieldFrom | ast.Starred):
            return self.step(self.value(e.value), e, "call")
        if isinstance(e, ast.List | ast.Tuple | ast.Set):
            return self.step(merge(*map(self.value, e.elts)), e, "index")
        if isinstance(e, ast.Dict):
            return self.step(merge(*(self.value(x) for x in [*e.keys, *e.values] if x is not None)), e, "index")
        if isinstance(e, ast.Subscript):
            source = self.source(e)
            v = merge(self.value(e.value), self.value(e.slice))
            return self.step(v, e, "index") if v.origins or source is None else source
        if isinstance(e, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            before = dict(self.env)
            for g in e.generators:
                self.bind(g.target, self.step(self.value(g.iter), e, "comprehension"))
                for c in g.ifs:
                    self.value(c)
            parts = [e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]
            v = self.step(merge(*map(self.value, parts)), e, "comprehension")
            self.env = before
            return v
        if isinstance(e, ast.NamedExpr):
            v = self.value(e.value)
            self.bind(e.target, v)
            return v
        if isinstance(e, ast.Lambda):
            return merge(*(self.value(x) for x in [*e.args.defaults, e.body]))
        return merge(*(self.value(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)))

    def source(self, e: ast.expr) -> Value | None:
        name = dotted(e)
        origin = R.source_of(name)
        return Value(frozenset([origin]), path=((e.lineno, e.col_offset, name, "source", "attr"),)) if origin else None

    def name(self, e: ast.Name | ast.Attribute) -> Value:
        name = dotted(e)
        if name in self.env and isinstance(e, ast.Name | ast.Attribute):
            return self.env[name]
        if isinstance(e, ast.Attribute):
            source = self.source(e)
            if source is not None:
                return source
            head = name.split(".")[0]
            if isinstance(e.value, ast.Call):
                self.value(e.value)
            return self.step(self.env.get(head, CLEAN), e, "attr")
        return self.source(e) or CLEAN

    def call(self, e: ast.Call) -> Value:
        name = dotted(e.func)
        self.scope.calls.append(name)
        args = [(None if isinstance(a, ast.Starred) else i, None, a, isinstance(a, ast.Starred)) for i, a in enumerate(e.args)]
        args += [(None, k.arg, k.value, k.arg is None) for k in e.keywords]
        values = [(i, k, self.value(a), star, a) for i, k, a, star in args]
        self.scope.invocations.append((name, e.lineno, [(sorted(v.origins), i, k) for i, k, v, _, _ in values]))
        modules = self.modules.get(name, frozenset())
        merged = merge(*(v for _, _, v, _, _ in values)) if values else CLEAN
        tail = name.rsplit(".", 1)[-1]
        if tail in R.AMPLIFIERS or name in R.AMPLIFIERS:
            if values and not values[0][2].constant and "XSS" not in values[0][2].neutralised:
                self.hit("XSS_OUTPUT", name, e, values[:1], amplifier=True)
            return self.step(merged, e, "call", name)
        sink = R.sink_of(name, modules)
        kill = R.kill_of(name) if sink is None else None
        if kill is not None:
            self.scope.sanitisers.append(kill)
            categories, full, _ = R.KILLS[kill]
            cats = frozenset(categories)
            if not merged.origins:
                return merged
            v = replace(merged, neutralised=merged.neutralised | cats) if full else replace(merged, partial=merged.partial | cats)
            v = replace(v, kills=tuple(dict.fromkeys([*v.kills, kill])))
            return self.step(v, e, "sanitize", name)
        if sink is not None:
            self.scope.sinks.append(sink)
            self.scope.sink_names.append((e.lineno, sorted({n.id for a in e.args for n in ast.walk(a) if isinstance(n, ast.Name)})))
            self.hit(sink, name, e, values)
        origin = R.source_of(name)
        if origin and origin != "GLOBAL":
            read = Value(frozenset([origin]), path=((e.lineno, e.col_offset, name, "source", "call"),))
            merged = merge(merged, read)
        return self.step(merged, e, "call", name)

    def hit(self, sink: str, name: str, e: ast.Call, values: list, amplifier: bool = False) -> None:
        shell = next((v for i, k, v, s, a in values if k == "shell" and isinstance(a, ast.Constant) and not a.value), None)
        listed = bool(e.args) and isinstance(e.args[0], ast.List | ast.Tuple)
        structural = sink == "EXEC_COMMAND" and listed and shell is not None
        for i, k, v, star, _ in values:
            steps = [*v.path, (e.lineno, e.col_offset, "sink", "sink", name)] if v.origins else []
            self.scope.hits.append((
                sink, name, e.lineno, i, k, star, _ordered(v), sorted(v.neutralised), sorted(v.partial), steps, list(v.kills),
                next((edge for _, _, kind, edge, _ in reversed(steps) if kind == "guard" and not edge.startswith("weak_")), None), structural, amplifier, v.constant,
            ))


def _ordered(v: Value) -> list[str]:
    return sorted(v.origins)


def _statements(node: ast.AST) -> list[ast.AST]:
    """The statements, handlers and cases right below a node; expressions hold none."""
    return [x for f in ("body", "handlers", "orelse", "finalbody", "cases") for x in getattr(node, f, ()) or ()]


def _imports(tree: ast.Module) -> tuple[list[str], dict[str, frozenset]]:
    """All import names, and for each bare name the first and last parts of its module."""
    names, modules = [], {}
    todo: deque[ast.AST] = deque([tree])
    while todo:
        n = todo.popleft()
        todo.extend(_statements(n))
        if isinstance(n, ast.Import):
            names += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            names += [f"{n.module}.{a.name}" for a in n.names]
            for a in n.names:
                parts = n.module.split(".")
                modules[a.asname or a.name] = frozenset([n.module, parts[0], parts[-1]])
    return names, modules


def _scopes(tree: ast.Module):
    """(qualname, node) of all functions, outer ones first."""
    queue: deque[tuple[str, ast.AST]] = deque([("", tree)])
    while queue:
        prefix, node = queue.popleft()
        for child in _statements(node):
            name = getattr(child, "name", None)
            inside = f"{prefix}.{name}" if prefix and name else name or prefix
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield inside, child
            queue.append((inside if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else prefix, child))


def exit_of(s: ast.stmt) -> str | None:
    """What a statement leaves: its function, its loop, or nothing."""
    if isinstance(s, ast.Raise | ast.Return):
        return "function"
    if isinstance(s, ast.Break | ast.Continue):
        return "loop"
    if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
        f = s.value.func
        return "function" if (f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")) in EXIT_CALLS else None
    return None


def decides_containment(test: ast.expr) -> bool:
    """Whether a test decides that a path stays where it should."""

    def called(e: ast.AST) -> str:
        return dotted(e.func).rsplit(".", 1)[-1] if isinstance(e, ast.Call) else ""

    for e in ast.walk(test):
        if called(e) in CONTAINMENT or isinstance(e, ast.Attribute) and e.attr in CONTAINMENT_METHODS:
            return True
        if isinstance(e, ast.Compare) and any(isinstance(op, ast.Eq | ast.NotEq | ast.In) for op in e.ops):
            methods = {called(x) for x in (e.left, *e.comparators) if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute)}
            if called(e.left) in COMPARED_LEFT or methods & COMPARED_METHODS:
                return True
    return False


def path_safe(pattern: str) -> bool:
    """Whether a pattern is anchored at both ends and no part of it can match / or \\.

    Decided on the parsed pattern, by trying both separators on each part.
    """
    text = pattern.strip()
    if not text.startswith("^") or not text.endswith(("$", r"\Z", r"\z")):
        return False
    try:
        tree = parser.parse(text.removesuffix(r"\z"))
    except (re.error, RecursionError, OverflowError):
        return False

    def safe(part) -> bool:
        for op, arg in part:
            name = str(op)
            if name in ("ANY", "NOT_LITERAL") or name == "LITERAL" and chr(arg) in "/\\\0":
                return False
            if name == "IN" and any(in_set(arg, c) for c in "/\\"):
                return False
            inner = []
            if name == "SUBPATTERN":
                inner = [arg[-1]]
            elif name == "BRANCH":
                inner = arg[1]
            elif name == "ATOMIC_GROUP":
                inner = [arg]
            elif name.endswith("REPEAT"):
                inner = [arg[2]]
            if name in ("ASSERT", "ASSERT_NOT", "GROUPREF_EXISTS"):
                return False
            if not all(safe(x) for x in inner):
                return False
        return True

    def in_set(items, char: str) -> bool:
        found = negated = False
        for op, arg in items:
            name = str(op)
            negated |= name == "NEGATE"
            found |= name == "LITERAL" and chr(arg) == char or name == "RANGE" and arg[0] <= ord(char) <= arg[1]
            # of the shorthands only the negated ones hold a separator
            found |= name == "CATEGORY" and "_NOT_" in str(arg)
        return found != negated

    return safe(tree)


def parts(source: str) -> list[ast.Module]:
    """The trees of those top-level blocks, and members of classes, of a broken file that parse alone."""
    lines = source.splitlines()

    def parsed(first: int, text: list[str]) -> ast.Module | None:
        try:
            return ast.parse("\n" * first + "\n".join(text))
        except (SyntaxError, ValueError):
            return None

    def blocks(first: int, last: int, indent: int):
        """(first, last) of blocks at an indent; closing brackets and further clauses belong to the block before."""
        start, decorated = None, False
        for i in range(first, last):
            text = lines[i]
            own = text[indent:] if not text[:indent].strip() else text.lstrip()
            if not own.strip() or own[0].isspace() or own[0] in "#)]}" or re.match(r"(else|elif|except|finally)\b", own):
                continue
            if not decorated:
                if start is not None:
                    yield start, i
                start = i
            decorated = own.startswith("@")
        if start is not None:
            yield start, last

    out = []
    for first, last in blocks(0, len(lines), 0):
        tree = parsed(first, lines[first:last])
        head = next((i for i in range(first, last) if lines[i].startswith("class ")), None)
        if tree is not None:
            out.append(tree)
        elif head is not None and head + 1 < last:
            body = next((i for i in range(head + 1, last) if lines[i].strip()), last)
            indent = len(lines[body]) - len(lines[body].lstrip()) if body < last else 0
            members = blocks(body, last, indent) if indent else ()
            out += [t for a, b in members if (t := parsed(head, [lines[head], *[""] * (a - head - 1), *lines[a:b]])) is not None]
    return out


def _failed(path: str, error: str) -> tuple:
    return (path, error, [], None, *[None] * 18)


def facts(path: str, source: str | None) -> list[tuple]:
    """The rows of one file."""
    source = source or ""
    out, scopes = [], []
    try:
        try:
            trees = [ast.parse(source)]
        except SyntaxError:
            out.append(_failed(path, "SyntaxError"))
            trees = parts(source)
        if not trees:
            return out
        imports, modules = [], {}
        for tree in trees:
            names, own = _imports(tree)
            imports += names
            modules |= own
        module = Scope("<module>", "<module>", 1, len(source.splitlines()) or 1)
        interpreter = Interpreter(module, modules)
        for tree in trees:
            interpreter.run(tree.body)
        scopes.append(module)
        for qualname, f in (x for tree in trees for x in _scopes(tree)):
            a = f.args
            params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
            s = Scope(f.name, qualname, f.lineno, f.end_lineno or f.lineno, params, [dotted(d) for d in f.decorator_list])
            Interpreter(s, modules).run(f.body)
            scopes.append(s)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [_failed(path, type(error).__name__)]
    if any(s.too_deep for s in scopes):
        out.append(_failed(path, "TooDeep"))
    return out + [
        (path, None, imports, i, s.name, s.qualname, s.line, s.end, s.params, s.decorators, s.calls, s.sinks, s.sanitisers, s.n_returns,
         sorted(set(s.returned)), s.return_names, s.sql_literal, s.hits, s.invocations, s.guards, guarded_returns(s), s.sink_names)
        for i, s in enumerate(scopes)
    ]


def guarded_returns(s: Scope) -> bool:
    """Whether a containment test stands before every return."""
    return bool(s.guards and s.return_lines) and min(line for line, _, _ in s.guards) < min(s.return_lines)


def _parse(sources: DataFrame) -> DataFrame:
    """The rows of all files.  Records stay tuples that Arrow reads as they are: as pandas values each would be converted in Python."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def f(batches):
        for batch in batches:
            files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while some := list(itertools.islice(files, FILES)):
                rows = [r for path, source in some for r in facts(path, source)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return sources.select("path", "source").mapInArrow(f, SCHEMA)


def parse(sources: DataFrame) -> DataFrame:
    """(path, source[, error]) to a row for each scope; rows with an error stay errors.

    Equal sources can be parsed once, see ``parse_distinct``.
    """
    if "error" not in sources.columns:
        return _parse(sources)
    out = _parse(sources.where("error is null"))
    empty = F.array().cast("array<string>")
    bad = {"path": F.col("path"), "error": F.col("error"), "imports": empty}
    failed = sources.where("error is not null").select(*[bad.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in out.schema])
    return out.unionByName(failed)


def parse_distinct(sources: DataFrame) -> DataFrame:
    """As parse(), each distinct source being parsed once, for trees of many revisions."""
    keyed = sources.withColumn("h", F.sha2("source", 256))
    once = keyed.groupBy("h").agg(F.first("source").alias("source"))
    parsed = parse(once.select(F.col("h").alias("path"), "source")).withColumnRenamed("path", "h")
    return keyed.select("path", "h").join(parsed, "h").drop("h")
