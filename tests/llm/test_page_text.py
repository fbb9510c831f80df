import pytest
from pyspark.sql import functions as F

from ionsieve.llm import page_text

CASES = [
    ("<article><h1>T&eacute;l &amp;&lt;</h1><p>a\n b<br>c<b>d</b>&nbsp;e<p>f</p></article>", "Tél &<\n\na b cd e\n\nf"),
    ("<nav>m</nav><article>x<div class='share-bar'>no</div>y<aside>no</aside></article><footer>f</footer>", "x\n\ny"),
    ("<article>a<!-- <p>no --><script>if (a<b) '</p>'</script><style>p{}</style>b</article>", "a b"),
    ("<article>a<section class=comments><article>no</article></section></article><article>b</article>", "a\n\nb"),
    ("<main><p>a</p><form>no</form></main><p>out</p>", "a"),
    ("<article><p>open <b>bold<br><p>next", "open bold\n\nnext"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p title='a>b'>yes</p></article>", "yes"),
    ("<article>1 < 2 &#65; &#x42; &unknown; &copy</article>", "1 < 2 A B &unknown; ©"),
    ("<article></article>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_articles(page, text):
    assert "\n\n".join(page_text.blocks_of(page or "").article) == text


def test_hosts_lose_their_repeated_runs(spark):
    menu = "Home News Sports Weather Travel Food Cars Jobs Contact"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    page = lambda i: f"<body><div>{menu}</div><div>{body(i)}</div><div>only {i} All rights reserved by the owner of this site</div></body>"
    rows = [(i, f"http://h{i % 2}/p{i}", page(i)) for i in range(6)] + [(6, "http://other/", page(6)), (7, "http://h0/a", f"<article>{menu}</article>")]
    found = {x.page_id: x.text for x in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert found[i] == f"{body(i)}\n\nonly {i}"
    assert found[6].startswith(menu)  # a host with a single page repeats nothing
    assert found[7] == menu  # an article stays whole


def test_whole_table_against_plain_markup(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {x.page_id: x for x in page_text.main_texts(pages).collect()}
    for x in pages.collect():
        inner = x.html[x.html.index("<article>") + 9 : x.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert (found[x.page_id].text, found[x.page_id].n_chars) == (text, len(text))


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "x", "<article>a</article>"), (1, "x", "<p>b</p>"), (1, "x", "<p>b</p>"), (2, "y", "<article>" + "long text <p>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("text", "blocks", "row", "places", "host")})
    found = page_text.main_texts(pages).collect()
    assert sorted(x.text[:9] for x in found) == ["", "a", "b", "b", "long text"]
    assert page_text.main_texts(pages.where("false")).count() == 0


def test_articles_lose_blocks_that_their_host_repeats(spark):
    words = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    licence = "All rights reserved by the owner of this site, ask before you copy"
    quote, long = words("quote", 20), words("long", 60)
    article = lambda *blocks: "<article>" + "".join(f"<p>{x}</p>" for x in blocks) + "</article>"
    rows = []  # url, html, text
    for i in range(6):
        own = [words(f"a{i}", 40), *([quote] * (i < 2)), f"{licence} {words(f'b{i}', 3)}"]
        rows.append((f"http://h/{i}", article(own[0], licence, *own[1:]), "\n\n".join(own)))
    # Near copies, more than half of a host's articles: whole, and their blocks are not the host's.
    for i in range(8):
        blocks = [long, words("more", 60), f"edit {i}"] if i < 5 else [words(f"c{i}", 30), long[:40]]
        rows.append((f"http://copies/{i}", article(*blocks), "\n\n".join(blocks)))
    # Equal articles are one, and three articles are too few.
    for i in range(9):
        blocks = [words(f"d{i // 3}", 30), licence]
        rows.append((f"http://few/{i}", article(*blocks), "\n\n".join(blocks)))
    pages = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(rows)], "page_id long, url string, html string")
    found = {x.page_id: x.text for x in page_text.main_texts(pages).collect()}
    assert found == {i: text for i, (_, _, text) in enumerate(rows)}
