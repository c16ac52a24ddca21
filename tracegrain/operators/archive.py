"""A corpus frozen: its counts as a relation, and an archive that is the same for the same records."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(records: DataFrame, sets: list[str]) -> DataFrame:
    """(set, value, n): records, pairs, and the records of each value of ``sets``; one pass."""
    values = F.explode(F.array(*[F.struct(F.lit(s).alias("set"), F.coalesce(F.col(s).cast("string"), F.lit("")).alias("value")) for s in sets], F.struct(F.lit("records").alias("set"), F.lit("").alias("value"))))
    n = records.select(values.alias("v")).groupBy("v.set", "v.value").agg(F.count(F.lit(1)).alias("n"))
    pairs = records.agg(F.lit("pairs").alias("set"), F.lit("").alias("value"), F.countDistinct("pair_id").alias("n"))
    return n.unionByName(pairs)


def freeze(records: DataFrame, folder: str, name: str = "corpus", sets: tuple[str, ...] = ("repo", "cwe", "tier", "group")) -> dict:
    """Write name-N.tar.gz and SHA256SUMS into a local folder of the caller; refuses broken pairs.

    Records go out one by one in the order of pair and kind, times and owners are
    zero, so equal records make equal bytes.  The archive is a file for one machine
    by its nature; no more than a record is held at a time.
    """
    found = {(r["set"], r["value"]): r["n"] for r in counts(records, list(sets)).where(F.col("set").isin("records", "pairs", *sets)).toLocalIterator()}
    total, pairs = found.get(("records", ""), 0), found.get(("pairs", ""), 0)
    if total % 2 or pairs * 2 != total:
        raise ValueError(f"{total} records of {pairs} pairs can't be frozen")
    summary = {"records": total, "pairs": pairs, **{s: {v: n for (k, v), n in sorted(found.items()) if k == s} for s in sets}}
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    lines = records.orderBy("pair_id", "kind").select(F.to_json(F.struct(*sorted(records.columns))).alias("j"))
    with tempfile.TemporaryFile() as body:
        digest = hashlib.sha256()
        for r in lines.toLocalIterator():
            line = r["j"].encode() + b"\n"
            digest.update(line)
            body.write(line)
        manifest = json.dumps({"sha256": digest.hexdigest(), **summary}, indent=1, sort_keys=True).encode()
        path = out / f"{name}-{total}.tar.gz"
        with path.open("wb") as raw, gzip.GzipFile("", "wb", 9, raw, 0) as packed, tarfile.open(fileobj=packed, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for member, data, size in (("MANIFEST.json", io.BytesIO(manifest), len(manifest)), (f"{name}.jsonl", body, body.tell())):
                data.seek(0)
                info = tarfile.TarInfo(f"{name}/{member}")
                info.size = size
                tar.addfile(info, data)
    whole = hashlib.sha256(path.read_bytes()).hexdigest()
    (out / "SHA256SUMS").write_text(f"{whole}  {path.name}\n{digest.hexdigest()}  {name}.jsonl\n")
    return {"archive": str(path), "archive_sha256": whole, **summary}
