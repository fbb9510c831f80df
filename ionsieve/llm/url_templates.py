"""Verdicts on urls: given rules first, then path templates whose labelled urls are mostly blocked.

Per host, paths form a tree of segments, as deep as they are. Branch by branch, segments that are ids become a wildcard of
their shape: numbers, and words of which there are many with hardly any paths each. A segment whose labelled urls are
blocked at another rate than its siblings' stays. Named siblings merge where enough labels of each show the same rate; one
without labels never merges. Each leaf is a template. It is rejected if the smoothed share of blocked urls among its labelled
ones is high. The labels are the rules' own verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

NAMES = 16  # words of one shape beside each other, above which they may be ids
PATHS_PER_NAME = 3  # words with as many distinct paths on average are names
MERGE_BELOW = 1.96  # two rates whose difference has fewer standard errors are alike
ALIKE_LABELS = 20  # labelled urls of each named branch that merges; fewer tell too little
TABLES = 16  # tables of finished paths that are read as one
PRIOR = 2.0  # urls by which the share of all labelled urls smooths a template's
REJECT_FROM = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, domain + prefix).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A wildcard for a segment: its kind of characters, with a file ending kept."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "<n>").when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), "<x>").otherwise("<w>")
    )
    return F.when(segment == "", "").otherwise(F.concat(kind, ending))


def _score(labelled: Column, blocked: Column, all_labelled: Column, all_blocked: Column) -> Column:
    """Standard errors between the shares of blocked urls of a branch and of the others; null unless both have labels."""
    rest = all_labelled - labelled
    p, q = F.try_divide(blocked, labelled), F.try_divide(all_blocked - blocked, rest)
    pooled = (all_blocked + 1) / (all_labelled + 2)
    return F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), rest)))


def _branches(paths: DataFrame) -> DataFrame:
    """host, template, segment, name, tail, taken: how the templates of a branch's paths go on.

    A branch that merges with no other takes the segments along that all its paths share: the least and the greatest
    of its paths share no others.
    """
    key = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    ends = [F.min("rest").alias("low"), F.max("rest").alias("high")]
    segment = F.element_at("rest", 1).alias("segment")
    branches = paths.groupBy(*key, segment).agg(F.count("*").alias("paths"), *sums, *ends)
    branches = written(branches.withColumn("shape", shape(F.col("segment"))), "branches")
    kinds = branches.groupBy(*key, "shape").agg(F.count("*").alias("names"), F.sum("paths").alias("all_paths"))
    parents = branches.groupBy(*key).agg(*(F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")))
    found = branches.join(kinds, [*key, "shape"]).join(parents, key)
    many = (F.col("names") > NAMES) & (F.col("all_paths") < PATHS_PER_NAME * F.col("names"))
    ids = many | ~F.startswith(F.col("shape"), F.lit("<w>"))
    own = (F.col("labelled"), F.col("blocked"))
    differs = F.coalesce(_score(*own, F.col("all_labelled"), F.col("all_blocked")) >= MERGE_BELOW, F.lit(False))
    found = found.withColumns({"ids": ids, "kept": ~ids | differs})
    # Named branches meet those whose rate is nearly theirs.
    rate = F.when(~F.col("ids") & (F.col("labelled") >= ALIKE_LABELS), F.round(10 * F.col("blocked") / F.col("labelled")))
    found = found.withColumn("rate", rate)
    alike = found.where("rate is not null").groupBy(*key, "rate").agg(
        F.min("segment").alias("least"), F.count("*").alias("alike"), *(F.sum(c).alias(f"alike_{c}") for c in ("labelled", "blocked"))
    )
    found = found.join(alike, [*key, "rate"], "left")
    merged = (F.col("alike") > 1) & (_score(*own, F.col("alike_labelled"), F.col("alike_blocked")) < MERGE_BELOW)
    found = found.withColumn("merged", F.coalesce(merged, F.lit(False)))
    alone = F.when(F.col("kept"), ~F.col("merged")).otherwise(F.col("names") == 1)
    first = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(first == 0, F.size("low")).otherwise(first - 1).cast("int")
    along = F.transform(F.slice("low", 2, shared - 1), lambda x: F.when(F.startswith(shape(x), F.lit("<w>")), x).otherwise(shape(x)))
    name = F.when(F.col("merged"), F.concat(F.lit("<as "), "least", F.lit(">"))).when(F.col("kept"), F.col("segment")).otherwise(F.col("shape"))
    tail = F.when(alone & (shared > 1), F.concat(F.lit("/"), F.array_join(along, "/"))).otherwise("")
    return found.select(*key, "segment", name.alias("name"), tail.alias("tail"), F.when(alone, shared).otherwise(1).alias("taken"))


def _next_level(paths: DataFrame) -> DataFrame:
    """Lengthen the templates of paths that go on by a branch; `rest` is what is left of each path."""
    paths = paths.withColumn("segment", F.element_at("rest", 1))
    longer = paths.join(_branches(paths.drop("segment")), ["host", "template", "segment"])
    template = F.concat("template", F.lit("/"), "name", "tail")
    rest = F.slice("rest", F.col("taken") + 1, F.size("rest"))
    return longer.withColumns({"template": template, "rest": rest}).drop("segment", "name", "tail", "taken")


def path_templates(urls: DataFrame) -> DataFrame:
    """host, path, template, for each distinct host and path of `urls` (host, path, verdict).

    One round of joins for each branching that the deepest path passes; rounds hold only paths that go on.
    """
    blocked = F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0))
    paths = urls.groupBy("host", "path").agg(
        F.count("*").alias("urls"), F.count("verdict").alias("labelled"), blocked.alias("blocked")
    )
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    paths, done = written(paths.withColumns({"rest": segments, "template": F.lit("")}), "paths"), []
    while not paths.isEmpty():
        level = written(_next_level(paths), "level")
        done.append(level.where(F.size("rest") == 0).drop("rest"))
        paths = level.where(F.size("rest") > 0)
        if len(done) == TABLES:
            done = [written(reduce(DataFrame.unionByName, done), "templates")]
    return reduce(DataFrame.unionByName, done) if done else paths.drop("rest")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row for each row of `pages`.

    A null url, or one without `://`, has an empty host and path and is judged like any other. A template without
    labelled urls is allowed. Equal urls get equal verdicts; null page_ids are ordinary rows; other columns are
    ignored; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "verdict": verdict})
    paths = written(path_templates(parts), "paths")
    sums = [F.sum("labelled").alias("n"), F.sum("blocked").alias("b")]
    prior = paths.agg(*sums).select(F.coalesce(F.try_divide("b", "n"), F.lit(0.0)).alias("prior"))
    templates = paths.groupBy("host", "template").agg(*sums).crossJoin(F.broadcast(prior))
    purity = (F.col("b") + PRIOR * F.col("prior")) / (F.col("n") + PRIOR)
    learned = F.when((F.col("n") > 0) & (purity >= REJECT_FROM), "block").otherwise("allow")
    templates = templates.select("host", "template", purity.alias("purity"), learned.alias("learned"))
    judged = paths.select("host", "path", "template").join(templates, ["host", "template"])
    return parts.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "learned").alias("verdict"), "template", "purity"
    )
