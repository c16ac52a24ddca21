"""Python sources generated from table keys, with what a reader expects to be found in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.operators.tables import spread

#: source, and the expected (cwe, sink, detector, severity, origin) or None.
TEMPLATES: list[tuple[str, tuple | None]] = [
    ('def show_N(request, cursor):\n    q = "SELECT * FROM t WHERE id = " + request\n    cursor.execute(q)\n', ("CWE-89", "SQL_EXECUTE", "taint", "high", "REQUEST")),
    ('def find_N(cursor, key):\n    cursor.execute("SELECT 1 FROM t WHERE a = %s", (key,))\n', ("CWE-89", "SQL_EXECUTE", "pattern", "medium", "")),
    ('def page_N(name):\n    return HttpResponse(f"<b>{name}</b>")\n', ("CWE-79", "XSS_RESPONSE_BODY", "taint", "medium", "PARAM")),
    ('import html\n\ndef safe_N(name):\n    return HttpResponse(html.escape(name))\n', ("CWE-79", "XSS_RESPONSE_BODY", "pattern", "low", "")),
    ('import os\n\ndef run_N(folder):\n    os.system("ls " + folder)\n', ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ('import subprocess\n\ndef list_N(folder):\n    subprocess.run(["ls", folder], shell=False)\n', ("CWE-94", "EXEC_COMMAND", "pattern", "high", "")),
    ("def read_N(path):\n    return open(path)\n", ("CWE-22", "FILE_OPEN", "taint", "high", "PARAM")),
    ("def pick_N(path):\n    if path not in ALLOWED:\n        return None\n    return open(path)\n", ("CWE-22", "FILE_OPEN", "taint", "low", "PARAM")),
    ("import pickle\n\ndef load_N(data):\n    return pickle.loads(data)\n", ("CWE-502", "DESER_UNSAFE", "taint", "critical", "PARAM")),
    ("import requests\n\ndef get_N(url):\n    return requests.get(url, timeout=3)\n", ("CWE-918", "NET_REQUEST", "taint", "high", "PARAM")),
    ("def move_N(url):\n    return redirect(url)\n", ("CWE-601", "REDIRECT_NAV", "taint", "medium", "PARAM")),
    ("def mark_N(body):\n    return mark_safe(body)\n", ("CWE-79", "XSS_OUTPUT", "amplifier", "medium", "PARAM")),
    ("def add_N(a):\n    return a + 1\n", None),
    ("def broken_N(:\n", None),
    ('import hashlib\n\ndef sum_N():\n    return hashlib.md5(b"x")\n', ("CWE-327", "CRYPTO_WEAK", "pattern", "low", "")),
    ('def row_N(cursor, key):\n    cursor.execute("SELECT " + int(key))\n', ("CWE-89", "SQL_EXECUTE", "pattern", "medium", "")),
    # a containment test; a test that is none; a pattern without separators; a broken part; a callee that checks
    ('import os\n\ndef save_N(root, path):\n    if os.path.commonpath([root, path]) != root:\n        raise ValueError("outside")\n    return open(path)\n', ("CWE-22", "FILE_OPEN", "taint", "high", "PARAM")),
    ("def some_N(path):\n    if not path:\n        return None\n    return open(path)\n", ("CWE-22", "FILE_OPEN", "taint", "high", "PARAM")),
    ('import re\n\ndef log_N(name):\n    if not re.match(r"^[a-z0-9_]+$", name):\n        return None\n    return open(name)\n', ("CWE-22", "FILE_OPEN", "taint", "medium", "PARAM")),
    ("def ok_N(path):\n    return open(path)\n\n\ndef broken_N(:\n", ("CWE-22", "FILE_OPEN", "taint", "high", "PARAM")),
    ('import os\n\ndef find_N(root, path):\n    if os.path.commonpath([root, path]) != root:\n        raise ValueError("outside")\n    return path\n\n\ndef send_N(path):\n    return open(find_N("r", path))\n', ("CWE-22", "FILE_OPEN", "taint", "high", "PARAM")),
    # statements and expressions, one each
    ("def aug_N(cursor, a):\n    q = 'SELECT '\n    q += a\n    cursor.execute(q)\n", ("CWE-89", "SQL_EXECUTE", "taint", "high", "PARAM")),
    ("import os\n\ndef loop_N(items):\n    for x in items:\n        os.system(x)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("def with_N(path, cursor):\n    with ctx(path) as p:\n        cursor.execute(p)\n", ("CWE-89", "SQL_EXECUTE", "taint", "high", "PARAM")),
    ("import os\n\ndef comp_N(items):\n    os.system([x for x in items][0])\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef walrus_N(a):\n    if (b := a):\n        os.system(b)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef parallel_N(a):\n    [b, c] = [1, a]\n    os.system(c)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef match_N(a):\n    match a:\n        case [x, *rest]:\n            os.system(x)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef global_N():\n    global g\n    os.system(g)\n", ("CWE-94", "EXEC_COMMAND", "taint", "high", "GLOBAL")),
    ("import os\n\ndef choose_N(a, b):\n    os.system(a if b else 'x')\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\nclass K_N:\n    def run_N(self, a):\n        os.system(a)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\nos.system(input())\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "STDIN")),
    ("import os\n\ndef env_N():\n    os.system(os.environ['X'])\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "ENV")),
    ("from subprocess import run\n\ndef bound_N(a):\n    run(a)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("def attr_N(cursor, o):\n    cursor.execute(f'{o.name[0]}')\n", ("CWE-89", "SQL_EXECUTE", "taint", "high", "PARAM")),
    ("def percent_N(cursor, a):\n    cursor.execute('x %s' % a)\n", ("CWE-89", "SQL_EXECUTE", "taint", "high", "PARAM")),
    ("async def wait_N(cursor, a):\n    await cursor.execute(await a)\n", ("CWE-89", "SQL_EXECUTE", "taint", "high", "PARAM")),
    ("def deny_N(path):\n    if path in BLOCKED:\n        return None\n    return open(path)\n", ("CWE-22", "FILE_OPEN", "taint", "low", "PARAM")),
    ("import os\n\ndef keyword_N(a):\n    os.system(command=a)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef splat_N(*a):\n    os.system(*a)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef both_N(a):\n    b = not a or -a\n    os.system({'k': b})\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef tried_N(a):\n    try:\n        pass\n    finally:\n        os.system(a)\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef until_N(a):\n    while a:\n        os.system(a)\n        del a\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
    ("import os\n\ndef later_N(a):\n    f = lambda: os.system(a)\n    return f\n", ("CWE-94", "EXEC_COMMAND", "taint", "critical", "PARAM")),
]


#: Groups of three files, by name; what crosses them: (entry, chain, sink, origin) or None.  _N stands for the key.
GROUPS: list[tuple[dict[str, str], tuple | None]] = [
    (
        {"db": "def run_N(q):\n    cur.execute(q)\n", "app": "import db\ndef view_N(request):\n    db.run_N('SELECT ' + request.GET['n'])\n", "x": ""},
        ("view_N", "view_N>run_N", "SQL_EXECUTE", "PARAM"),
    ),
    (
        {
            "a": "def last_N(q):\n    cur.execute(q)\n", "b": "def mid_N(q):\n    return last_N(q)\n",
            "c": "import b\ndef first_N(request):\n    return b.mid_N('SELECT ' + request.GET['x'])\n",
        },
        ("first_N", "first_N>mid_N>last_N", "SQL_EXECUTE", "PARAM"),
    ),
    ({"db": "def run_N(q):\n    cur.execute(q)\n", "app": "import db\ndef view_N():\n    db.run_N('SELECT 1')\n", "x": "def other_N():\n    return 1\n"}, None),
    (
        {"s": "import os\ndef do_N(a, b):\n    os.system(a + b)\n", "e": "import s\ndef all_N(request):\n    s.do_N(*request.args)\n", "x": "def broken_N(:\n"},
        ("all_N", "all_N>do_N", "EXEC_COMMAND", "PARAM"),
    ),
    (
        {"h": "import os\ndef own_N(request):\n    cmd = request.GET.get('c')\n    return os.system('ls ' + cmd)\n", "i": "", "j": "# nothing\n"},
        ("own_N", "own_N", "EXEC_COMMAND", "REQUEST"),
    ),
]


def groups(keys: DataFrame, key: str) -> DataFrame:
    """(path, source), the three files of a group for each key."""
    which = F.pmod(F.col(key), F.lit(len(GROUPS))).cast("int")
    number = F.concat(F.lit("_"), F.col(key).cast("string"))
    every = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in files.items()]) for files, _ in GROUPS])
    files = spread(keys).select(key, number.alias("number"), F.explode(F.element_at(every, which + 1)).alias("file"))
    return files.select(
        F.concat("file.name", "number", F.lit(".py")).alias("path"), F.replace("file.text", F.lit("_N"), F.col("number")).alias("source")
    )


def expected_groups_sql() -> str:
    """(i, entry, chain, sink, origin) as an SQL relation."""
    rows = ", ".join(f"({i}, " + ", ".join(f"'{v}'" for v in e) + ")" for i, (_, e) in enumerate(GROUPS) if e)
    return f"(VALUES {rows}) AS g(i, entry, chain, sink, origin)"


def source_of(key: Column) -> Column:
    """The template that ``key`` chooses, with the key in its names."""
    which = F.pmod(key, F.lit(len(TEMPLATES))).cast("int")
    every = F.array(*[F.lit(s) for s, _ in TEMPLATES])
    return F.replace(F.element_at(every, which + 1), F.lit("_N"), F.concat(F.lit("_"), key.cast("string")))


def sources(keys: DataFrame, key: str) -> DataFrame:
    """(path, source), a file for each key."""
    return spread(keys).select(F.concat(F.lit("p"), F.col(key).cast("string"), F.lit(".py")).alias("path"), source_of(F.col(key)).alias("source"))


_DEF = re.compile(r"^( *)(?:async )?def (\w+)\(", re.M)


def qualnames_sql() -> str:
    """(i, qualname, imports) of the functions of templates that parse, as an SQL relation, read off the text by lines."""
    rows = []
    for i, (text, _) in enumerate(TEMPLATES):
        if "(:" not in text:
            owner = re.search(r"^class (\w+)", text, re.M)
            imports = "true" if re.search(r"^(import|from) ", text) else "false"
            rows += [f"({i}, '{owner[1] + '.' if m[1] and owner else ''}{m[2]}', {imports})" for m in _DEF.finditer(text)]
    return f"(VALUES {', '.join(rows)}) AS q(i, qualname, imports)"


def names_sql() -> str:
    """(i, name) of the last function of each template that has a finding; it is the one with the sink."""
    rows = []
    for i, (text, e) in enumerate(TEMPLATES):
        if e:
            names = [m[2] for m in _DEF.finditer(text) if "(:" not in text[m.start() : m.end() + 1]]
            rows.append(f"({i}, '{names[-1].removesuffix('_N') if names else ''}')")
    return f"(VALUES {', '.join(rows)}) AS f(i, name)"


def expected_sql() -> str:
    """(i, cwe, sink, detector, severity, origin) as an SQL relation."""
    rows = ", ".join(f"({i}, " + ", ".join(f"'{v}'" for v in e) + ")" for i, (_, e) in enumerate(TEMPLATES) if e)
    return f"(VALUES {rows}) AS e(i, cwe, sink, detector, severity, origin)"
