"""URL filter: rules indexed by their rarest literal token.

A rule is a host and a path (``example.net/en/``) with a verdict.  It fits its host
and all subdomains if the path of the url starts with its path.  Each rule is
filed under the one of its literal tokens (host labels, whole path segments)
that the urls of the table hold least often; the tokens of a url fetch the
candidate rules, and only their regular expressions run.  The longest fitting
rule gives the verdict, ``allow`` if there is none.

A null url, or one without ``://``, has empty host and path and fits no rule.
Rules travel in the closure: their number is given by the caller and does not
grow with the urls.  Rows stay where they are, repeated or not.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from solvens.llm.common import add_columns, fresh_name

DEFAULT = "allow"
BATCH_CACHE = 1 << 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_tokens(rule: str) -> list[str]:
    """Literal tokens every fitting url must hold: ``.label`` for host labels, ``/segment`` for closed path segments."""
    host, _, path = rule.partition("/")
    return [f".{x}" for x in host.split(".") if x] + [f"/{x}" for x in path.split("/")[:-1] if x]


def rule_pattern(rule: str) -> str:
    """Regular expression over host + path."""
    host, slash, path = rule.partition("/")
    return rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many rows hold each wanted token; the result has at most one row per wanted token."""
    labels = F.transform(F.split("_host", r"\."), lambda x: F.concat(F.lit("."), x))
    segments = F.transform(F.split("_path", "/"), lambda x: F.concat(F.lit("/"), x))
    tokens = F.array_intersect(F.array_distinct(F.concat(labels, segments)), F.array(*[F.lit(t) for t in wanted]))
    rows = urls.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    at_host, at_path = fresh_name(pages, "_host"), fresh_name(pages, "_path")
    split = pages.withColumns({at_host: host_of(F.col(url)), at_path: path_of(F.col(url))})
    wanted = sorted({t for rule, _ in rules for t in rule_tokens(rule)})
    counts = token_counts(split.select(F.col(at_host).alias("_host"), F.col(at_path).alias("_path")), wanted) if wanted else {}
    index: dict[str, list[tuple[str, str]]] = {}
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        tokens = rule_tokens(rule)
        rarest = min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""
        index.setdefault(rarest, []).append((rule, verdict))

    def judge(hosts, paths):
        compiled = {r: re.compile(rule_pattern(r)) for rs in index.values() for r, _ in rs}
        known: dict[tuple[str, str], tuple] = {}
        out = []
        for key in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
            if key not in known:
                if len(known) > BATCH_CACHE:
                    known.clear()
                host, path = key
                tokens = {""} | {f".{x}" for x in host.split(".")} | {f"/{x}" for x in path.split("/")}
                found = [rv for t in tokens for rv in index.get(t, ())]
                fits = [rv for rv in found if compiled[rv[0]].match(host + path)] if host and path else []
                known[key] = max(fits, key=lambda rv: (len(rv[0]), rv[0]), default=(None, DEFAULT))
            out.append(known[key])
        return pa.array([r for r, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())

    fields = [StructField("rule", StringType()), StructField("verdict", StringType())]
    judged = add_columns(split, [at_host, at_path], fields, judge)
    return judged.drop("host", "path").withColumnsRenamed({at_host: "host", at_path: "path"})
