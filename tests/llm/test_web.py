"""URL rules, archives and page texts."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.page_text import Page, left_text, main_text
from tallyframe.llm.url_rules import RULES, judged_urls
from tallyframe.llm.warc import archived_pages, chunk_rows, page_records, read_archives, write_archives
from tallyframe.session import shared_folder
from tests.llm.cases import CLASHES, empty

BIG = "<p>" + "large payload é\n" * 40_000 + "</p>"
ROWS = [
    (1, "http://A.Example.org/es/x?q#f", "x" * 1200),
    (2, "https://example.org/en/123", "x" * 1200),
    (3, "https://sub.example.org/en/2", "x" * 1200),
    (3, "https://sub.example.org/en/2", "x" * 1200),
    (4, "no scheme", "short"),
    (5, None, "short"),
    (6, "ftp://b.com/fr/", None),
    (7, "http://com/de/", ""),
    (8, "http://notexample.org/es/", BIG),
    (9, "http://example.org", BIG),
    (None, "http://x.com/de/a\r\nb", "x" * 1200),
    (None, None, None),
    (10, "http://é.example.org/es/日本", "y" * 999),
    (11, "://org/", "y" * 999),
    (12, "http://example.org/es", "z" * 1000),
    (13, "http://www.EXAMPLE.org/en/1", "z" * 1000),
]


def pages(spark, rows=None):
    found = spark.createDataFrame(ROWS if rows is None else rows, "page_id bigint, url string, html string").repartition(3)
    return found.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: f[:2], default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in judged_urls(pages(spark), rules).collect()), key=str)
    assert got == sorted(((r[0], *brute_verdict(r[1], RULES)) for r in ROWS), key=str)
    assert judged_urls(empty(pages(spark)), rules).isEmpty()
    assert {r.verdict for r in judged_urls(pages(spark), empty(rules)).collect()} == {"allow"}


def test_url_rules_of_many_lengths(spark):
    draw = random.Random(2)
    hosts = ["a", "b.a", "c.b.a", "d"]
    rules = sorted({(draw.choice(hosts), "/" + "".join(draw.choices("xy/", k=draw.randint(0, 4)))) for _ in range(30)})
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in rules]
    rows = [(k, f"http://{draw.choice(['', 'www.'])}{draw.choice(hosts)}/{''.join(draw.choices('xy/', k=6))}", None) for k in range(200)]
    found = judged_urls(pages(spark, rows), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = {r[0]: brute_verdict(r[1], rules) for r in rows}
    assert all((len(r.rule or ""), r.verdict) == (len(want[r.page_id][2] or ""), want[r.page_id][3]) for r in found)


def brute_records(rows):
    keeper = {}
    for page, _, text in rows:
        data = (text or "").encode()
        if len(data) >= 1000 and page is not None:
            keeper[data] = max(page, keeper.get(data, page))
    out = []
    for page, _, text in rows:
        data = (text or "").encode()
        first = keeper.get(data)
        again = first is not None and page != first
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    got = sorted((tuple(r) for r in archived_pages(pages(spark)).collect()), key=str)
    assert got == brute_records(ROWS)
    assert archived_pages(empty(pages(spark))).isEmpty()


def test_chunks_give_the_payload(spark):
    folder = f"{shared_folder(spark)}/chunks-test"
    files = write_archives(chunk_rows(page_records(pages(spark)), chunk=1000), folder)
    rows = read_archives(files, folder, chunk=777).where("page in (9, 4)").orderBy("page", "chunk_no").collect()
    big = [r for r in rows if r.page == 9]
    assert b"".join(r.chunk for r in big) == BIG.encode() and max(len(r.chunk) for r in big) <= 777
    assert [r.chunk_no for r in big] == list(range(len(big))) and [r.last for r in big] == [False] * (len(big) - 1) + [True]
    seen = b"".join(r.chunk for r in big[:3])
    assert (big[2].bytes_so_far, big[2].sha1_so_far) == (len(seen), hashlib.sha1(seen).hexdigest())
    with gzip.open(files.first().path) as stream:
        assert stream.read(8) == b"WARC/1.1"


def page(body):
    return Page(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>").result()


@pytest.mark.parametrize(
    "body,text",
    [
        ("<nav>menu</nav><article><h1>Head &amp; more</h1><p>One<br>two  three<p>Four</article><footer>foot</footer>", "Head & more\n\nOne two three\n\nFour"),
        ("<article>a<div class='comments'><p>said</p></div><script>var x='</article>';</script>b</article>", "a\n\nb"),
        ("<main><p>x<b>y</b>z &lt;tag&gt; &#233;&eacute; &amp;amp; &am</p></main><aside>side</aside>", "xyz <tag> éé &amp; &am"),
        ("<article><p>kept</p><form><p>field</p></form><div class=\"ad\">buy</div><ul><li>i<li>j</ul></article>", "kept\n\ni\n\nj"),
        ("<header class='top'>site</header><article><header><h1>own</h1></header><p>t</p></article>", "own\n\nt"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"),
        ("<article></article>", ""),
        ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
        ("<article><p title='a > b'>q</p><!-- <p>no</p> --><style>p{}</style></article>", "q"),
        ("", ""),
    ],
)
def test_page_rules(body, text):
    assert page(body)[0] == text


WRAPPED = [
    ("<div class='page has-sidebar'><article>a</article></div>", "a"),
    ("<div class='no-comments'><article>a</article></div>", "a"),
    ("<div id='login-content'><main>a</main></div>", "a"),
    ("<div class='page search'><main>a</main></div>", "a"),
    ("<div id='top'><div class='sidebar'><article>a</article></div></div>", "a"),
    ("<form id='all'><p>field</p><article>a</article></form>", "a"),
    ("<div role='main' class='search'>a</div>", "a"),
    ("<article>a<h2 id='social-impact'>b</h2><section id='search-and-rescue'>c</section></article>", "a\n\nb\n\nc"),
    ("<article>a<h2 id='search'>b</h2><section id='comments'>c</section><div class='no-ads'>d</div></article>", "a\n\nb\n\nc\n\nd"),
]


@pytest.mark.parametrize("body,text", WRAPPED)
def test_marks_drop_no_article(body, text):
    assert page(body)[0] == text


@pytest.mark.parametrize(
    "body,text",
    [
        ("<aside><article>teaser</article></aside><article>a</article><div class='sidebar'><article>teaser</article></div>", "a"),
        ("<article>a<div class='comments'><article>said</article></div><section class='x comments'>said</section><div id='share'>s</div></article>", "a"),
    ],
)
def test_marks_still_drop(body, text):
    assert page(body)[0] == text


NAMES = "cookie-banner cookie-notice ad-slot comment-list comments-area newsletter-signup share-buttons widget-area ad_unit_3 article-share footer-links"
LONG_TEXT = "<h1>Head</h1><p>" + "A story of some length about the river and the town. " * 6 + "</p>"


@pytest.mark.parametrize("name", NAMES.split())
@pytest.mark.parametrize("kind", ["class", "id"])
def test_parts_of_names_drop(name, kind):
    want = page(f"<article>{LONG_TEXT}</article>")[0]
    part = f"<div {kind}='x {name}'><p>We use cookies</p>buy</div>" if kind == "class" else f"<div id='{name}'>We use cookies</div>"
    assert page(f"<article>{LONG_TEXT}{part}</article>")[0] == want
    assert page(f"{part}<article>{LONG_TEXT}</article>{part}")[0] == want
    assert page(f"{part}<div>{LONG_TEXT}</div>")[0] == want  # no article


@pytest.mark.parametrize(
    "body,text",
    [
        ("<article><div class='menu-of-the-day'><h2>Soup</h2><p>hot</p></div><p>more</p></article>", "Soup\n\nhot\n\nmore"),
        ("<article><div class='ad-free-story'><p>most of the text is here, so it stays</p></div><p>more</p></article>", "most of the text is here, so it stays\n\nmore"),
        ("<article><div class='comment-body'>the only text</div></article>", "the only text"),
        ("<article><p>a</p><div class='no-ads has-comments'>b</div><div class='socially'>c</div></article>", "a\n\nb\n\nc"),
        ("<div class='share-page'><article><p>a</p></article></div>", "a"),
    ],
)
def test_parts_of_names_keep(body, text):
    assert page(body)[0] == text


def test_long_talk_goes():
    said = "<div class='comment-list'><h3>90 comments</h3>" + "<div class='entry'><p>I do not think so, and here is why.</p></div>" * 90 + "</div>"
    assert page(f"<article>{LONG_TEXT}{said}</article>")[0] == page(f"<article>{LONG_TEXT}</article>")[0]


@pytest.mark.parametrize("unit", ["<div>t", "<div class='ad-slot'>t", "<article>t", "<b>t", "<ul><li>t", "</i>t", "<p>t", "<table><tr><td>t"])
def test_nesting_takes_time_in_proportion(unit):
    def seconds(n):
        start = time.perf_counter()
        page(unit * n)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(40_000) < 16 * seconds(5_000) + 0.5


def brute_templates(rows, min_pages=5, min_share=0.1):
    """Hosts' templates from all subtrees of all pages, held in memory."""
    pages_of, seen = defaultdict(set), defaultdict(set)
    for _, url, html in rows:
        host = re.sub(r"^[^:]*://|[/?#].*$", "", url or "").lower()
        key = (len((html or "").encode()), html or "")
        pages_of[host].add(key)
        for s in Page(html or "").result()[4]:
            seen[host, s["subtree"]].add(("rest", s["rest"]) if s["rest"] is not None else ("page", key))
    return {at for at, where in seen.items() if len(where) >= min_pages and len(where) >= min_share * len(pages_of[at[0]])}


def test_templates_over_a_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    bar = "<div class='k'><ul><li>Follow this site</li></ul></div>"
    rows = [(i, f"http://h{i % 4}.example/{i}", h.replace("<p>", f"{bar}<p>", 1) if i % 8 < 4 else h) for i, _, h in rows]  # few hosts
    cut = brute_templates(rows)
    assert cut
    want = {}
    for i, u, h in rows:
        text, blocks, hashes, parents, _, own = Page(h or "").result()
        host = re.sub(r"^[^:]*://|[/?#].*$", "", u or "").lower()
        want[i] = left_text(blocks, hashes, parents, {s for at, s in cut if at == host}, own) if blocks else text
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert got == want and not any("Follow" in text for text in got.values())


def test_templates_go_and_articles_stay(spark):
    banner = "<div><div>Welcome to our site</div></div>"
    rows = [(k, f"http://{'one' if k < 40 else 'two'}.example/p{k}", f"<html><body>{banner}<div><p>story {k if k % 2 else 'same'} of the day</p></div></body></html>") for k in range(43)]
    rows += [(100 + k, "http://one.example/copy", f"<body><article><p>same article</p></article>{k}</body>") for k in range(60)]
    rows += [(300 + k, "http://three.example/", "<body><div>whole page</div></body>") for k in range(30)]
    found = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert found[1] == "story 1 of the day"  # the banner recurs on host one
    assert found[41] == "Welcome to our site\n\nstory 41 of the day"  # host two has three pages
    assert all(found[100 + k] == "same article" for k in range(60))
    assert all(found[300 + k] == "whole page" for k in range(30))  # copies of one page are one page


def test_templates_inside_articles_go(spark):
    bar = "<div class='x1'><ul><li>Send this page to a friend</li></ul></div>"
    box = "<section><div>Read also</div></section>"
    rows = [(k, f"http://one.example/p{k}", f"<body><article><h1>Story {k}</h1>{bar}<div><p>it was day {k}</p></div>{box}</article></body>") for k in range(20)]
    # copies of one article, in pages that differ
    rows += [(100 + k, "http://two.example/copy", f"<body><article><div><p>same article</p></div><ul><li>same list</li></ul></article>{k}</body>") for k in range(20)]
    rows += [(200 + k, "http://two.example/", f"<body><main><div><p>all in one box</p></div></main><div>{k}</div></body>") for k in range(20)]
    # articles of two recurring boxes alone
    rows += [(300 + k, "http://one.example/", f"<body><article>{bar}{box}</article>{k}</body>") for k in range(5)]
    found = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert all(found[k] == f"Story {k}\n\nit was day {k}" for k in range(20))
    assert all(found[100 + k] == "same article\n\nsame list" for k in range(20))
    assert all(found[200 + k] == "all in one box" for k in range(20))
    assert all(found[300 + k] == "Send this page to a friend\n\nRead also" for k in range(5))


def test_page_text_awkward_rows(spark):
    found = main_text(pages(spark)).collect()
    assert sorted((str(r.page_id) for r in found)) == sorted(str(r[0]) for r in ROWS)
    by = {r.page_id: r for r in found}
    assert by[6].text == "" and by[6].n_chars == 0
    assert by[8].text == " ".join(("large payload é " * 40_000).split()) and by[8].n_chars == len(by[8].text)
    assert main_text(empty(pages(spark))).isEmpty()
