"""Readers and writers.  Each returns a DataFrame of a fixed schema."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that no scan enters.
PRUNED = ".git .hg .svn .tox .venv __pycache__ build dist env eggs htmlcov migrations node_modules site-packages venv vendor".split()


def from_text(spark: SparkSession, source: str, path: str = "<source>") -> DataFrame:
    return spark.createDataFrame([(path, source)], "path string, source string")


def _decoded(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "UTF-8").alias("source"))


def entered(path: Column) -> Column:
    """Whether a path stays out of pruned and hidden folders."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda p: p.isin(PRUNED) | (p.startswith(".") & (F.length(p) > 1)))


def from_paths(spark: SparkSession, paths: list[str], base: str | None = None) -> DataFrame:
    """(path, source, error): the Python files below folders, and named files whatever their extension; each once.

    The file system says what a folder is.  A path that doesn't exist is a row with
    an error and no source.  The pruning filter is on the path alone, so contents of
    pruned files aren't decoded.
    """
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    frames, missing = [], []
    for p in dict.fromkeys(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(hadoop)
        if not fs.exists(path):
            missing.append((p, None, "FileNotFound"))
            continue
        r = spark.read.format("binaryFile")
        if fs.getFileStatus(path).isDirectory():
            root = (base or p).rstrip("/").split("://")[-1]
            found = r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(p)
            frames.append(_decoded(found.where(entered(F.substring_index("path", root, -1)))))
        else:
            frames.append(_decoded(r.load(p)))
    out = spark.createDataFrame(missing, "path string, source string, error string")
    for f in frames:
        out = out.unionByName(f.withColumn("error", F.lit(None).cast("string")))
    return out.dropDuplicates(["path"])


def from_records(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False) -> DataFrame:
    """(source, label, group, path) of JSON lines or of a JSON array; names have alternatives."""
    schema = "source string, code string, label string, cwe string, `group` string, advisory string, id string, path string, __bad string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__bad").option("multiLine", multi_line).json(path)
    group = F.coalesce("group", "advisory", "id")
    last = F.raise_error(F.lit("a record has no group")).cast("string") if strict else F.concat(F.lit("record-"), F.monotonically_increasing_id().cast("string"))
    return raw.where("__bad is null").select(
        F.coalesce("source", "code").alias("source"), F.coalesce("label", "cwe", F.lit("")).alias("label"), F.coalesce(group, last).alias("group"), "path"
    )


def from_dataset(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(code, label, cwe) of public vulnerability datasets; malformed lines are skipped."""
    # The names of each dataset's fields.
    fields = {"bigvul": ("function_before", "vul", "CWE"), "devign": ("func", "target", None), "realvuln": ("code", "label", None)}
    code, label, cwe = fields[kind]
    schema = f"{code} string, {label} string" + (f", {cwe} string" if cwe else "")
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return raw.select(F.col(code).alias("code"), F.col(label).isin("1", "true").cast("int").alias("label"), (F.col(cwe) if cwe else F.lit(None).cast("string")).alias("cwe"))


def advisories(lines: DataFrame, text: str = "value") -> DataFrame:
    """(advisory_id, cwes, summary, package, fix_commits, repo) of advisory JSON; malformed items give null ids and go."""
    schema = "id string, summary string, cwes array<string>, package string, references array<string>"
    a = lines.select(F.from_json(text, schema).alias("a")).select("a.*").where("id is not null")
    from tracegrain.functions import scalars as S

    urls = F.coalesce("references", F.array().cast("array<string>"))
    commits = F.filter(F.transform(urls, S.commit_of), lambda c: c != "")
    repos = F.filter(F.transform(urls, S.repo_of), lambda c: c != "")
    return a.select(
        F.col("id").alias("advisory_id"), F.array_sort(F.array_distinct(F.coalesce("cwes", F.array().cast("array<string>")))).alias("cwes"), "summary", "package",
        F.array_distinct(commits).alias("fix_commits"), F.element_at(F.concat(repos, F.array(F.lit(None).cast("string"))), 1).alias("repo"),
    )


def suppression_rules(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, pattern); blank lines and comments are skipped, a line without a colon raises."""
    t = F.trim(F.col(text))
    rules = lines.where((t != "") & ~t.startswith("#"))
    kind = F.when(F.instr(t, ":") > 0, F.trim(F.split_part(t, F.lit(":"), F.lit(1)))).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), t)).cast("string"))
    return rules.select(kind.alias("kind"), F.trim(F.substr(t, F.instr(t, ":") + 1)).alias("pattern"))


def tool_results(lines: DataFrame, tool: str, text: str = "value") -> DataFrame:
    """(path, line, rule, cwes) of external analysers' JSON; text before the object is skipped."""
    from tracegrain.functions import scalars as S

    body = F.substr(F.col(text), F.greatest(F.instr(text, F.lit("[" if tool == "ruff" else "{")), F.lit(1)))
    if tool == "bandit":
        r = F.explode(F.from_json(body, "results array<struct<filename:string,line_number:int,test_name:string,issue_cwe:struct<id:int,link:string>>>")["results"])
        return lines.select(r.alias("r")).select(
            F.col("r.filename").alias("path"), F.col("r.line_number").alias("line"), F.col("r.test_name").alias("rule"),
            F.when(F.col("r.issue_cwe.id").isNotNull(), F.array(F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("cwes"),
        )
    if tool == "semgrep":
        r = F.explode(F.from_json(body, "results array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<metadata:struct<cwe:string>>>>")["results"])
        return lines.select(r.alias("r")).select("r.path", F.col("r.start.line").alias("line"), F.col("r.check_id").alias("rule"), S.cwes_of(F.coalesce("r.extra.metadata.cwe", F.lit(""))).alias("cwes"))
    r = F.explode(F.from_json(body, "array<struct<filename:string,code:string,location:struct<row:int>>>"))
    return lines.select(r.alias("r")).select(F.col("r.filename").alias("path"), F.col("r.location.row").alias("line"), F.col("r.code").alias("rule"), F.array().cast("array<string>").alias("cwes"))


def git_blobs(requests: DataFrame) -> DataFrame:
    """(repo, revision, path, source) of (repo, revision, path); one cat-file process for each repository of a batch.

    Repositories have to be reachable from the executors.
    """

    def f(batches):
        for pdf in batches:
            rows = []
            for repo, group in pdf.groupby("repo"):
                asked = "".join(f"{r}:{p}\n" for r, p in zip(group["revision"], group["path"], strict=True))
                out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked.encode(), capture_output=True, check=False).stdout
                at = 0
                for r, p in zip(group["revision"], group["path"], strict=True):
                    end = out.index(b"\n", at) if b"\n" in out[at:] else len(out)
                    head = out[at:end].split()
                    at = end + 1
                    if len(head) == 3 and head[1] == b"blob":
                        n = int(head[2])
                        rows.append((repo, r, p, out[at : at + n].decode("utf-8", "replace")))
                        at += n + 1
                    else:
                        rows.append((repo, r, p, None))
            yield pd.DataFrame(rows, columns=["repo", "revision", "path", "source"])

    return requests.select("repo", "revision", "path").repartition("repo").mapInPandas(f, "repo string, revision string, path string, source string")


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """n generated sources, the templates in turn."""
    from tracegrain.plans import snippets

    return snippets.sources(spark.range(n), "id")


def synthetic_groups(spark: SparkSession, n: int) -> DataFrame:
    """n generated groups of three files whose functions call one another."""
    from tracegrain.plans import snippets

    return snippets.groups(spark.range(n), "id")


def write_corpus(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines; pairs have to be whole."""
    from tracegrain.operators import studies

    bad = studies.pair_violations(records, "pair_id", "kind", "source")
    if not bad.isEmpty():
        raise ValueError(f"pairs are not whole: {[r['pair_id'] for r in bad.limit(5).collect()]}")
    records.write.mode("append").json(path)
