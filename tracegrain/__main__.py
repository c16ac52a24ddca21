"""python -m tracegrain --path DIR [--json | --sarif | --traces | --cross] [--suppress FILE] [--fail-on never|high|any]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tracegrain.operators import findings, interproc, parse, patching, report
from tracegrain.operators.tables import cut
from tracegrain.sources import readers


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracegrain", description=__doc__)
    p.add_argument("--path", action="append", default=[])
    p.add_argument("--file", action="append", default=[])
    p.add_argument("--stdin", action="store_true")
    for flag in ("--json", "--sarif", "--traces", "--cross", "--fix"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--suppress")
    p.add_argument("--fail-on", choices=("never", "high", "any"), default="never")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tracegrain").getOrCreate()
    sources = readers.from_text(spark, sys.stdin.read(), "<stdin>") if a.stdin else readers.from_paths(spark, [*(f"{x.rstrip('/')}/" for x in a.path), *a.file])
    scopes = cut(parse.parse(sources))
    if a.fix:
        for r in patching.repair(sources).where("applied > 0").toLocalIterator():
            print(f"# {r['path']}: {r['applied']} patches\n{r['patched']}")
        return 0
    if a.traces:
        for r in report.traces_to_json(findings.flows(scopes)).toLocalIterator():
            print(r["json"])
        return 0
    if a.cross:
        for r in report.to_json(interproc.cross_flows(scopes).orderBy("entry_file", "entry_line", "sink", "trace_id")).toLocalIterator():
            print(r["json"])
        return 0
    found = findings.dedupe_and_rank(findings.findings(scopes, threshold=a.threshold))
    hidden = found.limit(0)
    if a.suppress:
        rules = readers.suppression_rules(spark.read.text(a.suppress))
        fields = {"cwe": "cwe", "sink": "sink", "file": "path", "trace": "trace_id", "category": "category", "function": "function"}
        hidden, found = findings.suppressed(found, rules, fields, keep=False), findings.suppressed(found, rules, fields, keep=True)
    errors = scopes.where("error is not null").select("path", "error")
    shown = report.sarif_log(found, hidden, errors).select("sarif") if a.sarif else report.to_json(found) if a.json else report.text_lines(found)
    for r in shown.toLocalIterator():
        print(r[0])
    return report.gate(found, a.fail_on)


if __name__ == "__main__":
    sys.exit(main())
