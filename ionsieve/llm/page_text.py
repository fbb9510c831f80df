"""Main text of web pages: blocks by markup, without the runs of tokens that a host repeats.

A page is cut into blocks. Menus, headers, footers, asides, forms, adverts, notices and comments are left out by their
markup. What is left, the article or else the whole page, is judged by the host's repeated runs.

Outside articles all tokens, page after page, make the host's token stream. Its suffixes are brought in order by their first
RUN tokens (a suffix array to that depth, as a grouping by their hash, so a large host is spread over all tasks). Neighbours
from distinct pages share a run of at least RUN tokens. Tokens that such runs cover are removed, unique runs stay.

Inside articles the suffixes of each block count, and repetition alone says little: pages carry copies of articles and quotes.
So a block goes only if all its runs are common, that is, held by at least half of the host's distinct articles, and by LEAST_HOLDERS. Equal articles
are one. An article that would lose more than half of its words is a copy: it stays whole, and common runs are
counted again without it. A block can only go if its first run is common, so only such blocks are looked at run by run.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .words import mix, run_hashes, exact_values, text_bytes

# Tokens of a repeated run, at least.
RUN = 8
# Distinct articles that hold a common run, at least.
LEAST_HOLDERS = 4
# Articles that lose blocks are broadcast up to so many.
BROADCAST_ARTICLES = 1 << 16

# Fixed names: elements by what they do to the text around them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that open a zone; the others (p, b, li, ...) need not be closed and change nothing but the block.
ZONES = set(
    "article aside body details dialog div fieldset footer form head header main menu nav ol search section table "
    "tbody td tfoot th thead tr ul dl blockquote figure h1 h2 h3 h4 h5 h6 span p li".split()
)
LEFT_OUT = set("aside dialog fieldset footer form head header menu nav search".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text, up to their own end tag.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button|canvas|audio|video|title"
# Words in class, id or role that name such parts.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice "
    "notification pagination popup promo promotion related reply replies respond share sharing sidebar skyscraper social "
    "sponsor sponsored subscribe toolbar widget alert alertdialog complementary contentinfo search".split()
)
# Elements that end where another of them (or a parent's end) begins.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}

_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _set_apart(rest: str) -> bool:
    """Whether an element's attributes name it as no part of the main text."""
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            if not NAMES.isdisjoint(_NAME.findall(value)):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return True
    return False


class Blocks(NamedTuple):
    """The blocks of a page, white space settled: inside its articles, in unmarked places, and in parts left out."""

    article: list[str]
    open: list[str]
    left_out: list[str]
    has_article: bool


def blocks_of(page: str) -> Blocks:
    """Cut a page into blocks; unclosed and misplaced tags are tolerated."""
    found = Blocks([], [], [], False)
    mains: list[list[str]] = [[], []]  # blocks in <main>, used where no <article> is
    stack: list[tuple[str, bool, bool, bool]] = []  # name, left out, in an article, in <main>
    out = in_article = in_main = saw_article = saw_main = False
    parts: list[str] = []
    position = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            if out:
                found.left_out.append(text)
            elif in_article:
                found.article.append(text)
            else:
                mains[in_main].append(text)
                found.open.append(text)

    def back_to(depth: int) -> None:
        nonlocal out, in_article, in_main
        del stack[depth:]
        _, out, in_article, in_main = stack[-1] if stack else ("", False, False, False)

    for m in _MARKUP.finditer(page):
        if m.start() > position:
            parts.append(page[position : m.start()])
        position = m.end()
        if m["name"] is None:
            if m["raw"]:
                parts.append(" ")
            continue
        name = m["name"].lower()
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name not in ZONES:
            continue
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    back_to(depth)
                    break
                if name in ("p", "li", "span") and stack[depth][0] not in ("p", "li", "span"):
                    break  # a stray end tag
        else:
            ends = SELF_CLOSING.get(name, {"p"} if name in BLOCKS else set())
            if stack and stack[-1][0] in ends:
                back_to(len(stack) - 1)
            inner = m["rest"].endswith("/")
            out_here = out or name in LEFT_OUT or (bool(m["rest"]) and name != "body" and _set_apart(m["rest"]))
            article_here = in_article or (name == "article" and not out_here)
            main_here = in_main or (not out_here and (name == "main" or "main" in m["rest"] and 'role="main"' in m["rest"]))
            saw_article |= article_here and not in_article
            saw_main |= main_here and not in_main
            if not inner:
                stack.append((name, out_here, article_here, main_here))
                out, in_article, in_main = out_here, article_here, main_here
    parts.append(page[position:])
    flush()
    if not saw_article and saw_main:
        return Blocks(mains[True], mains[False], found.left_out, True)
    return found._replace(has_article=saw_article)


def _suffixes(blocks: list[str]) -> np.ndarray:
    """A hash of each suffix's first RUN tokens, over all blocks in turn; none where fewer tokens follow."""
    data, offsets = text_bytes(pa.array([token for block in blocks for token in block.split(" ")], pa.string()))
    if len(offsets) <= RUN:
        return np.zeros(0, np.uint64)
    tokens = run_hashes(exact_values(data), offsets[:-1], offsets[1:])
    odd = mix(np.arange(1, RUN + 1)) | np.uint64(1)
    total = np.zeros(len(tokens) - RUN + 1, np.uint64)
    for j in range(RUN):
        total += tokens[j : j + len(total)] * odd[j]
    return mix(total)


CUT = "page_id long, url string, blocks array<string>, host long, article long, starts array<long>, suffixes array<long>"


def _host(url: str | None) -> bytes:
    return re.sub(r"^[^:]*://|[/?#].*$", "", url or "", flags=re.S).lower().encode()


def _starts(blocks: list[str], host: np.ndarray) -> list[int | None]:
    """The first run of each block, none where it has fewer tokens."""
    heads = [block.split(" ", RUN)[:RUN] for block in blocks]
    whole = [len(head) == RUN for head in heads]
    found = iter(mix(_suffixes([" ".join(head) for head, x in zip(heads, whole) if x])[::RUN] ^ host).astype(np.int64).tolist())
    return [next(found) if x else None for x in whole]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's article, or its open blocks where it has none, first runs of the article's blocks, suffixes of what lies outside."""
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in CUT.split(", ")]
    for batch in batches:
        rows = []
        for page_id, url, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
            blocks = blocks_of(page or "")
            name = _host(url)
            host = run_hashes(exact_values(np.frombuffer(name, np.uint8)), np.array([0]), np.array([len(name)]))
            # The open blocks come first, so that place k is their token k.
            stream = blocks.open + blocks.left_out
            suffixes = mix(_suffixes(stream) ^ host).astype(np.int64)
            own, article, starts = blocks.open, None, None
            if blocks.has_article:
                own, starts = blocks.article, _starts(blocks.article, host)
                whole = "\n\n".join([*own, ""]).encode() + name
                article = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)
            rows.append((page_id, url, own, int(host.astype(np.int64)[0]), article, starts, suffixes))
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


TEXTS = "page_id long, url string, text string, n_chars long"


def _texts(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*((i, url, text, len(text)) for i, url, text in rows))) or [[]] * 4
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "url", "text", "n_chars"]
    )


RUNS = "article long, host long, words int, block int, size int, runs int, suffix long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All suffixes, to their block's end, of the given blocks of each article."""
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()]
    names = [x.split()[0] for x in RUNS.split(", ")]
    for batch in batches:
        for article, host, blocks, of in zip(*(batch.column(k).to_pylist() for k in range(4))):
            sizes = np.array([block.count(" ") + 1 for block in blocks])
            found = [_suffixes([blocks[k]]) for k in of]
            runs = np.array([len(x) for x in found])
            suffixes = mix(np.concatenate(found) ^ np.array(host, np.int64).astype(np.uint64)).astype(np.int64)
            numbers = (np.repeat(x, runs.sum()) for x in (article, host, sizes.sum()))
            columns = [*numbers, *(np.repeat(x, runs) for x in (of, sizes[of], runs)), suffixes]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds)], names=names)


def unique_runs(blocks: list[str], repeated: list[int]) -> list[str]:
    """`blocks` without the tokens of repeated runs; `repeated` lists the places where these begin."""
    covered = np.zeros(sum(block.count(" ") + 1 for block in blocks) + RUN, np.int64)
    for place in repeated:
        if place < len(covered) - RUN:
            covered[place] += 1
            covered[place + RUN] -= 1
    covered = np.cumsum(covered) > 0
    kept, at = [], 0
    for block in blocks:
        tokens = block.split(" ")
        rest = [token for k, token in enumerate(tokens, at) if not covered[k]]
        at += len(tokens)
        if rest:
            kept.append(" ".join(rest))
    return kept


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages without the blocks and the runs that their host repeats."""
    for batch in batches:
        rows = []
        for i, url, blocks, gone, places in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if gone:
                blocks = [block for k, block in enumerate(blocks) if k not in gone]
            if places:
                blocks = unique_runs(blocks, places)
            rows.append((i, url, "\n\n".join(blocks)))
        yield _texts(rows)


def _common(found: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """The values of `key` that at least half of their host's articles hold, and LEAST_HOLDERS of them."""
    sizes = articles.groupBy("host").agg(F.count("*").alias("articles"))
    holders = found.select("host", "article", key).distinct().groupBy("host", key).agg(F.count("*").alias("holders"))
    return holders.where(F.col("holders") >= LEAST_HOLDERS).join(sizes, "host").where("2 * holders >= articles").select(key)


def _covered(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """article, words, lost, gone: the blocks of which all runs are common, and their words."""
    hits = runs.join(_common(runs, articles, "suffix"), "suffix").groupBy("article", "words", "block", "size", "runs").count()
    gone = hits.where("count = runs").groupBy("article", "words")
    return gone.agg(F.sum("size").alias("lost"), F.collect_list("block").alias("gone"))


def repeated_blocks(cut: DataFrame) -> DataFrame | None:
    """article, gone: the numbers of the blocks that articles lose; None if no article's block begins with a common run."""
    cut = cut.where("article is not null")
    articles = written(cut.groupBy("article").agg(F.min("row").alias("row"), F.min("host").alias("host")), "articles")
    starts = cut.select("host", "article", F.posexplode("starts").alias("block", "start")).where("start is not null")
    begun = starts.join(_common(starts, articles, "start"), "start").groupBy("article").agg(F.collect_set("block").alias("of"))
    begun = written(begun.join(articles, "article"), "begun")
    if begun.isEmpty():
        return None
    looked_at = cut.select("row", "blocks").join(begun, "row").select("article", "host", "blocks", "of")
    runs = written(looked_at.mapInArrow(_runs, RUNS), "runs")
    copies = written(_covered(runs, articles).where("2 * lost > words").select("article"), "copies")
    runs, articles = (x.join(copies, "article", "left_anti") for x in (runs, articles))
    return written(_covered(runs, articles).where("2 * lost <= words").select("article", "gone"), "gone")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of `pages`.

    A block's white space becomes one space; blocks are joined by an empty line. A null or empty page has an empty text,
    and so has one without article that is boilerplate throughout. Null and equal page_ids are ordinary rows (equal ones count as
    one page when runs outside articles are looked for). A null url is a host of its own. Other columns are ignored; an empty
    table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    cut = written(pages.mapInArrow(_cut, CUT).withColumn("row", F.monotonically_increasing_id()), "cut")
    page = F.coalesce("page_id", -1 - F.col("row"))
    places = cut.select("row", page.alias("page"), F.col("article").isNull().alias("open"), F.posexplode("suffixes").alias("place", "suffix"))
    repeated = places.groupBy("suffix").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.max("open").alias("open"))
    repeated = repeated.where("first <> last and open").select("suffix")
    covered = places.where("open").join(repeated, "suffix").groupBy("row").agg(F.collect_list("place").alias("places"))
    columns = ["page_id", "url", "blocks", "gone", "places"]
    open_pages = cut.where("article is null").join(covered, "row", "left").withColumn("gone", F.lit(None).cast("array<int>"))
    articles, gone = cut.where("article is not null").withColumn("places", F.lit(None).cast("array<int>")), repeated_blocks(cut)
    if gone is None:
        articles = articles.withColumn("gone", F.lit(None).cast("array<int>"))
    else:
        articles = articles.join(F.broadcast(gone) if gone.count() <= BROADCAST_ARTICLES else gone, "article", "left")
    return articles.select(*columns).unionByName(open_pages.select(*columns)).mapInArrow(_left, TEXTS)
