"""Scans over text and file tables: secrets, forbidden files and dead links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import patterns as P


def match_lines(text: Column, regex: str) -> Column:
    """Line number (from 1) of the start of every match, in order.

    A mark is put in front of each match in the whole text, so matches that span lines are found.
    Marks add no line feed: line by line, the growth in length is the number of matches starting there.
    """
    marked = F.regexp_replace(text, F.lit(regex), F.lit("\u0001$0"))
    growth = F.zip_with(
        F.split(marked, "\n", -1), F.split(text, "\n", -1), lambda new, old: F.length(new) - F.length(old)
    )
    return F.flatten(F.transform(growth, lambda n, i: F.array_repeat(i + 1, n)))


def rule_findings(text: Column, rule: P.TextRule) -> Column:
    """Array of ``(rule, line)``; placeholders are dropped and the matched value is not kept."""
    lines = match_lines(text, rule.regex)
    if rule.secret_group is not None:
        secrets = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.secret_group))
        found = F.zip_with(lines, secrets, lambda line, secret: F.struct(line.alias("line"), _placeholder(secret).alias("skip")))
        lines = F.transform(F.filter(found, lambda f: ~f["skip"]), lambda f: f["line"])
    findings = F.transform(lines, lambda line: F.struct(F.lit(rule.name).alias("rule"), line.cast("bigint").alias("line")))
    hit = F.regexp_like(text, F.lit(rule.regex))
    if rule.literals:
        hit = _contains_any(text, rule.literals) & hit
    return F.when(hit, findings)


def _contains_any(text: Column, literals: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(literal) for literal in literals])


def _placeholder(secret: Column) -> Column:
    return _contains_any(secret, P.PLACEHOLDER_MARKS)


def secret_scan(df: DataFrame, key: str, text: str, rules: Sequence[P.TextRule] = tuple(P.SECRET_RULES)) -> DataFrame:
    """One row ``(key, rule, line)`` per finding. Map-only: no join and no shuffle."""
    per_rule = F.array_compact(F.array(*[rule_findings(F.col(text), r) for r in rules]))
    found = df.select(key, F.explode(F.flatten(per_rule)).alias("finding"))
    return found.select(key, "finding.rule", "finding.line")


def file_verdict(path: Column, length: Column, policy: P.FilePolicy = P.FilePolicy()) -> Column:
    """Reason why a file must not be published, or null. The path rule goes before the size rule."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    forbidden = (
        F.arrays_overlap(parts, F.array(*[F.lit(p) for p in policy.blocked_parts]))
        | _suffix(name).isin(list(policy.blocked_suffixes))
        | name.startswith("secrets")
        | name.contains(".tfstate")
        | (name.startswith(".env") & (name != ".env.example"))
    )
    return F.when(forbidden, "forbidden path").when(length > policy.size_limit, "oversized")


def _suffix(name: Column) -> Column:
    """Text from the last dot on; a leading or a trailing dot starts no suffix."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def file_rules(inventory: DataFrame, policy: P.FilePolicy = P.FilePolicy(), path: str = "path", length: str = "length") -> DataFrame:
    return inventory.withColumn("verdict", file_verdict(F.col(path), F.col(length), policy))


def undecodable(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files whose bytes are no valid UTF-8, images excepted."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    invalid = ~F.is_valid_utf8(F.col(content).cast("string"))
    return files.where(invalid & ~_suffix(name).isin(P.IMAGE_SUFFIXES)).select(path)


def local_links(df: DataFrame, key: str, text: str, pattern: str = P.MARKDOWN_LINK) -> DataFrame:
    """``(key, link, target)`` for each link that is neither external nor an anchor.

    The fragment is cut before percent-decoding. Decoding treats ``+`` and a stray ``%`` as plain text.
    """
    links = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("link"))
    external = reduce(lambda a, b: a | b, [F.col("link").startswith(prefix) for prefix in P.EXTERNAL_PREFIXES])
    cut = F.substring_index(F.col("link"), "#", 1)
    plain = F.regexp_replace(F.replace(cut, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return links.where(~external).withColumn("target", F.url_decode(plain))


def from_page(page: Column, target: Column) -> Column:
    """Target of a link as seen from its page: relative to the page's folder, with ``.`` and ``..`` resolved.

    Both are paths from a common root. A target that leaves the root keeps a leading ``..``, so it is never known.
    """
    folder = F.regexp_extract(page, r"(?s)^(.*/)", 1)
    whole = F.when(target.startswith("/"), F.substring(target, 2, 2**31 - 1)).otherwise(F.concat(folder, target))
    none = F.array().cast("array<string>")

    def step(path: Column, part: Column) -> Column:
        inside = (F.size(path) > 0) & (F.coalesce(F.element_at(path, -1), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), path)
            .when((part == "..") & inside, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
            .otherwise(F.array_append(path, part))
        )

    return F.array_join(F.aggregate(F.split(whole, "/"), none, lambda path, part: F.when(F.size(path) >= 0, step(path, part))), "/")


def address(page: Column, target: Column) -> Column:
    """``from_page`` for web addresses, where a folder differs from a file and an empty target is the page itself."""
    meant = F.when(target == "", page).otherwise(target)
    return F.concat(from_page(page, meant), F.when(meant.rlike(r"(?:^|/)\.{0,2}$"), "/").otherwise(""))


def dead_links(links: DataFrame, known: DataFrame, target: str = "target") -> DataFrame:
    """Links whose target is not among the known ones."""
    return links.join(known.select(target), target, "left_anti")


def url_path(url: Column) -> Column:
    """Path of a web address without query and fragment."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
