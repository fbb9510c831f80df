import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ionsieve.llm import url_templates as urls

RULES = urls.RULES


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(d + p), d + p, v) for v, d, p in RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    "http://a.example.net/en/1?x=1", "http://a.example.net/de/1", "https://EXAMPLE.com/de/x#y", "https://example.com/de", "http://x.org/fr/",
    "http://org/fr/a", "http://net", "http://net/", "http://net?x/", "HTTP://notnet/", "noscheme", None, "", "://", "http://É.Com/a?b://c", "a://b://c/d",
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("path", F.lit("x"))
    for x in urls.judge_urls(pages).collect():
        host, path, rule, verdict = plain(URLS[x.page_id])
        assert (x.host, x.path, x.rule) == (host, path, rule), URLS[x.page_id]
        assert x.verdict == (verdict or "allow")


@pytest.fixture(scope="module")
def judged(spark):
    rules = (("block", "host.a", "/bad/x"), ("allow", "host.a", "/good/g"))
    rows = [f"http://host.a/bad/{'x' if i % 10 else 'y'}{i}.html" for i in range(200)]
    rows += [f"http://host.a/good/{'g' if i % 2 else 'h'}{i}" for i in range(200)]
    rows += [f"http://host.a/{i}/{i}/{i}/{i}/{i}" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    return {rows[x.page_id]: x for x in urls.judge_urls(pages, rules).collect()}


def test_templates_learn_from_the_rules(judged):
    row = judged["http://host.a/bad/y10.html"]
    assert (row.rule, row.verdict, row.template) == (None, "block", "/bad/<w>.html") and row.purity > 0.8
    row = judged["http://host.a/good/h10"]
    assert (row.rule, row.verdict, row.template) == (None, "allow", "/good/<w>")
    row = judged["http://host.a/7/7/7/7/7"]
    assert (row.template, row.verdict) == ("/<n>/<n>/<n>/<n>/<n>", "allow")


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, "http://a.b/c"), (2, None)], "page_id long, url string")
    pages = pages.withColumns({c: F.lit(1) for c in ("host", "template", "verdict", "n", "learned", "urls")})
    assert sorted(x.page_id or 0 for x in urls.judge_urls(pages).collect()) == [0, 1, 1, 2]
    assert urls.judge_urls(pages.where("false")).count() == 0
    long = spark.createDataFrame([(1, "http://a.b/" + "x/" * 50_000)], "page_id long, url string")
    assert urls.judge_urls(long).first().verdict == "allow"


def test_only_ids_share_labels(spark):
    rules = (("block", "host.b", "/de/"), ("block", "host.c", "/a/"), ("allow", "host.c", "/b/"))
    rows = [f"http://host.b/{word}/{i}" for word in ("de", "fr", "en") for i in range(14)]
    rows += [f"http://host.c/a/{i}" for i in range(300)] + [f"http://host.c/{word}/{i}" for word in "bc" for i in range(4)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {rows[x.page_id]: x for x in urls.judge_urls(pages, rules).collect()}
    for url, x in found.items():
        assert x.verdict == ("block" if "/de/" in url or "/a/" in url else "allow"), url
    assert {found[f"http://host.{u}/3"].template for u in ("b/de", "b/fr", "c/a", "c/c")} == {"/de/<n>", "/fr/<n>", "/a/<n>", "/c/<n>"}


def test_deep_branches_keep_their_own_labels(spark):
    rules = (("block", "host.d", "/a/b/c/d/bad/x"),)
    rows = [f"http://host.d/a/b/c/d/bad/x{i}" for i in range(400)] + [f"http://host.d/a/b/c/d/bad/y{i}" for i in range(40)]
    rows += [f"http://host.d/a/b/c/d/good/{i}" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    for x in urls.judge_urls(pages, rules).collect():
        assert x.verdict == ("allow" if "/good/" in rows[x.page_id] else "block"), rows[x.page_id]
        assert x.template == ("/a/b/c/d/good/<n>" if "/good/" in rows[x.page_id] else "/a/b/c/d/bad/<w>")


def test_siblings_merge_on_evidence_only(spark):
    rules = tuple(("block", "host.e", f"/{c}/p/") for c in "xy") + (("allow", "host.e", "/z/p/"),)
    rows = [f"http://host.e/{c}/p/{i}" for c in "xyz" for i in range(200)]
    rows += [f"http://host.e/w/p/{i}" for i in range(200)] + [f"http://host.e/v/{i}" for i in range(9)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {rows[x.page_id]: x for x in urls.judge_urls(pages, rules).collect()}
    templates = {u[14:15]: x.template for u, x in found.items()}
    assert templates == {"x": "/<as x>/p/<n>", "y": "/<as x>/p/<n>", "z": "/z/p/<n>", "w": "/w/p/<n>", "v": "/v/<n>"}
    assert {x.verdict for u, x in found.items() if u[14:15] in "wv"} == {"allow"}


def plain_shape(segment):
    ending = re.search(r"\.[A-Za-z]{1,5}$", segment)
    ending = ending.group() if ending else ""
    stem = segment[: len(segment) - len(ending)]
    kind = "<n>" if re.fullmatch("[0-9]+", stem) else "<x>" if re.fullmatch("[0-9a-fA-F-]{16,}", stem) else "<w>"
    return kind + ending if segment else ""


def plain_score(n, b, all_n, all_b):
    if not n or n == all_n:
        return None
    pooled = (all_b + 1) / (all_n + 2)
    return abs(b / n - (all_b - b) / (all_n - n)) / math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / (all_n - n)))


def plain_tree(paths, template=""):
    """{path: template} of (path, segments left, labelled, blocked), one level at a time."""
    found = {path: template for path, rest, _, _ in paths if not rest}
    children = {}
    for path, rest, n, b in paths:
        if rest:
            children.setdefault(rest[0], []).append((path, rest[1:], n, b))
    total = lambda rows, k: sum(x[k] for x in rows)
    of_shape, all_n, all_b = {}, *(sum(total(rows, k) for rows in children.values()) for k in (2, 3))
    for s in children:
        of_shape.setdefault(plain_shape(s), []).append(s)
    named, rates = {}, {}
    for s, rows in children.items():
        names, n, b = of_shape[plain_shape(s)], total(rows, 2), total(rows, 3)
        many = len(names) > urls.NAMES and sum(len(children[x]) for x in names) < urls.PATHS_PER_NAME * len(names)
        ids = many or not plain_shape(s).startswith("<w>")
        named[s] = s if not ids or (plain_score(n, b, all_n, all_b) or 0) >= urls.MERGE_BELOW else plain_shape(s)
        if not ids and n >= urls.ALIKE_LABELS:
            rates.setdefault(math.floor(10 * b / n + 0.5), []).append(s)
    for group in rates.values():
        n, b = (sum(total(children[s], k) for s in group) for k in (2, 3))
        for s in group if len(group) > 1 else []:
            if plain_score(total(children[s], 2), total(children[s], 3), n, b) < urls.MERGE_BELOW:
                named[s] = f"<as {min(group)}>"
    nodes = {}
    for s, rows in children.items():
        nodes.setdefault(named[s], []).extend(rows)
    for name, rows in nodes.items():
        found |= plain_tree(rows, f"{template}/{name}")
    return found


def test_templates_are_those_of_a_plain_tree(spark, sf_dir):
    rng = random.Random(8)
    rows = [x.url for x in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    rows += ["http://host.f/" + "/".join(rng.choice(["a", "b", "c", "7", "8", "", f"w{i}"]) for _ in range(rng.randrange(1, 8))) for i in range(1500)]
    rules = (*RULES, ("block", "host.f", "/a/"), ("block", "host.f", "/b/a"), ("allow", "host.f", "/c/"))
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    judged = urls.judge_urls(pages, rules).collect()
    hosts = {}
    for x in judged:
        rule = x.rule and next(v for v, d, p in rules if d + p == x.rule)
        path = hosts.setdefault(x.host, {}).setdefault(x.path, [0, 0])
        path[0] += rule is not None
        path[1] += rule == "block"
    for host, paths in hosts.items():
        tree = plain_tree([(p, p.removeprefix("/").split("/"), n, b) for p, (n, b) in paths.items()])
        assert tree == {x.path: x.template for x in judged if x.host == host}, host
