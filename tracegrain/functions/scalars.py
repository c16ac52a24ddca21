"""Column expressions: names, identities, bands and intervals.  All built in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrain.plans import registry as R

UNIT = "\x1f"


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the sha256 of the parts."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, 16)


def dotted_suffixes(name: Column) -> Column:
    """The dotted suffixes of a name, longest first."""
    parts = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tail(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def severity(category: Column, confidence: Column) -> Column:
    """low .. critical by category and confidence."""
    band = (
        F.when(category.isin("EXEC", "DESER", "CRED"), F.when(confidence >= 0.8, "critical").otherwise("high"))
        .when(category.isin("SQL", "XXE", "FILE", "NET"), F.when(confidence >= 0.8, "high").otherwise("medium"))
        .otherwise(F.when(confidence >= 0.7, "medium").otherwise("low"))
    )
    return F.when(confidence < 0.4, "low").otherwise(band)


def severity_rank(name: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in (("critical", 5), ("high", 4), ("medium", 3), ("low", 2), ("info", 1)) for x in kv])
    return F.coalesce(F.element_at(ranks, name), F.lit(0))


def confidence(partial: Column, n_steps: Column, guard: Column, only_global: Column) -> Column:
    """The confidence of a flow, in the order in which its parts apply."""
    c = F.when(partial, 0.90 * 0.65).otherwise(0.90)
    c = F.greatest(F.lit(0.55), c - 0.01 * F.greatest(F.lit(0), n_steps - 3))
    less = F.when(guard == "allowlist", 0.45).when(guard == "denylist", 0.25).when(guard == "equality", 0.15)
    c = F.when(less.isNotNull(), F.greatest(F.lit(0.05), c - less)).otherwise(c)
    return F.round(F.when(only_global, F.least(c, F.lit(0.65))).otherwise(c), 4)


def shown_origins(origins: Column, params: Column) -> Column:
    """PARAM#i as PARAM, or as REQUEST where a parameter is a request; distinct, in order."""
    request = F.arrays_overlap(params, F.array(*map(F.lit, ("request", "req", "http_request"))))
    return F.array_distinct(F.transform(origins, lambda o: F.when(~o.startswith("PARAM"), o).when(request, "REQUEST").otherwise("PARAM")))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a rate; null without trials."""
    p, zz = successes / n, z * z
    centre, wide = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (centre - wide) / (1 + zz / n), (centre + wide) / (1 + zz / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))), F.when(n > 0, F.least(high, F.lit(1.0)))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted array, not an interpolation."""
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def glob_regex(pattern: Column) -> Column:
    """A glob of * and ? and [..] as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+(){}|^$\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(quoted, F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def glob_pattern(glob: str) -> str:
    """glob_regex() of one given pattern."""
    quoted = re.sub(r"([.+(){}|^$\\])", r"\\\1", glob).replace("[!", "[^").replace("*", ".*").replace("?", ".")
    return f"(?:(?s)^{quoted}$)"


def fingerprint(source: Column) -> Column:
    """sha256 of the lines without indentation, blank lines and comment lines."""
    lines = F.transform(F.split(source, "\n", -1), lambda x: F.trim(x))
    return F.sha2(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), "\n"), 256)


def clipped(text: Column, n: int = 80) -> Column:
    """White space as one space, and at most n characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def slashes(path: Column, root: str = "") -> Column:
    """A path with forward separators, relative to ``root`` if it is below it."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).otherwise(p) if root else p


def iso_date(moment: Column) -> Column:
    """A UTC stamp to the second."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hint_tokens(function: Column, params: Column, calls: Column) -> Column:
    """nh_def, nh_arg and nh_call tokens: the hints that names hold, advisory only."""
    hints = [h for _, h in R.NAME_HINTS]

    def of(prefix: str, names: Column) -> Column:
        found = F.flatten(F.transform(names, lambda n: F.filter(F.array(*[F.lit(h) for h in dict.fromkeys(hints)]), lambda h: F.contains(name_hint(n), h))))
        return F.transform(F.array_distinct(found), lambda h: F.concat(F.lit(f"nh_{prefix}:"), h))

    return F.concat(of("def", F.array(function)), of("arg", params), of("call", calls))


def name_hint(name: Column) -> Column:
    for pattern, hint in R.NAME_HINTS:
        name = F.regexp_replace(name, pattern, hint)
    return name


def slug(name: Column) -> Column:
    """A name that a file system takes, with a digest that keeps names apart."""
    return F.concat(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 60), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8))


def unfenced(text: Column) -> Column:
    """A response without its Markdown fence."""
    inner = F.regexp_extract(text, r"(?s)```[\w+-]*\n(.*?)\n?```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def commit_of(url: Column) -> Column:
    return F.regexp_extract(url, r"/commits?/([0-9a-f]{7,40})", 1)


def repo_of(url: Column) -> Column:
    return F.regexp_extract(url, r"github\.com/([\w.-]+/[\w.-]+?)(?:\.git)?(?:[/?#]|$)", 1)


def cwes_of(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(CWE-\d+)"), F.lit(1))))


def verdict(introduced: Column, killed: Column) -> Column:
    return (
        F.when((introduced > 0) & (killed > 0), "mixed").when(introduced > 0, "regression").when(killed > 0, "improved").otherwise("neutral")
    )
