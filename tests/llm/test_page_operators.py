from __future__ import annotations

import collections
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract, url_filter, warc

PAGE_SCHEMA = "page_id long, url string, html string, text string, host string, run string"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
ARTICLE = "<article><h1>A &amp; B</h1><p>First  para\ngraph of the text, long enough to count.</p><p>Second.</p></article>"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        ARTICLE,
        f"<nav><ul><li><a href=/>Home</a></li></ul></nav>{ARTICLE}<footer>&copy; me</footer>",
        f"<header><h2>Site</h2></header><div class='ad banner'>Buy now this thing</div>{ARTICLE}<aside>More to read on this site</aside>",
        f"<div id=cookie-notice>We use cookies, as everybody does, for all kinds of reasons that fill a long line of text here.</div>{ARTICLE}",
        f"<form><label>Name</label><input name=a><button>Send it</button></form>{ARTICLE}<section class=comments><p>Great article, I liked it a lot and more.</p></section>",
        f"<div class=sidebar>open and never closed{ARTICLE}",
        ARTICLE.replace("</p>", ""),
        ARTICLE.replace("</article>", "<article class='comment'><p>I disagree with all of that, at length.</p></article></article>"),
        f"<!-- <p>hidden</p> --><noscript>Turn on scripts</noscript>{ARTICLE}<div role=navigation><a href=x>next</a></div><p hidden>not shown</p>",
        ARTICLE.replace("article", "main"),
        f"<div class=topbar><a href=/>Home</a></div><div id=page>{ARTICLE}<ol class=commentlist><li>I liked it a lot, and so on and on.</li></ol></div><div id=siteFooter>Imprint</div>",
        f"<header class=masthead><h1>The site</h1><p>Its motto is a rather long line of text that says little.</p></header><main>{ARTICLE}</main>",
        ARTICLE.replace("article", "div"),
        f"<div class=menu><ul><li><a href=a>A</a></li></ul></div><div class=content>{ARTICLE.replace('article', 'section')}</div><div class=related><p>Read this next, it is about something else.</p></div>",
    ],
)
def test_main_text(body):
    assert html_extract.main_text(page(body)) == "A & B\nFirst para graph of the text, long enough to count.\nSecond."


LONG = "".join(f"<p>Paragraph {i} has a fair number of words in it, as text does.</p>" for i in range(12))


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='has-sidebar'>{LONG}</div>",
        f"<div id='content-sidebar-wrap'>{LONG}<div class=sidebar><p>Read this next, it is elsewhere.</p></div></div>",
        f"<article class='post no-sidebar tag-social'>{LONG}</article><div class='sidebar-wrap'><p>Read this next, it is elsewhere.</p></div>",
        f"<div class=layoutSidebarRight><div>{LONG}</div></div><p>Made by us</p>",
        f"<div class=related-layout><div>{LONG}</div><div class=comments><p>I disagree.</p></div></div>",
        f"<div class=comment-page>{LONG}</div>",
        f"<article>{LONG}</article><section class=comments>{'<article class=comment><p>I disagree with all of that, at length.</p></article>' * 200}</section>",
    ],
)
def test_names_do_not_lose_the_article(body):
    assert html_extract.main_text(page(body)) == "\n".join(f"Paragraph {i} has a fair number of words in it, as text does." for i in range(12))


def test_main_text_without_containers():
    body = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>" + "".join(f"<p>Paragraph {i} has a fair number of words in it, as text does.</p>" for i in range(4))
    assert html_extract.main_text(page(body)).split("\n")[0].startswith("Paragraph 0") and "One" not in html_extract.main_text(page(body))
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    assert html_extract.main_text("only text &lt;here&gt;") == "only text <here>"
    deep = "<div>" * 3000 + "<p>deep inside of it</p>"
    assert html_extract.main_text(deep) == "deep inside of it"
    long = "<article>" + "<p>word " * 50_000
    assert html_extract.main_text(long).count("\n") == 49_999


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{LONG}</article><article class=teaser><h3><a href=x>Another story</a></h3><p>A blurb about it.</p></article>",
        f"<main><article>{LONG}</article><article><h3><a href=x>Another story</a></h3><p>A blurb about it.</p></article></main>",
        f"<article><h3><a href=x>Another story</a></h3><p>A blurb about it.</p></article><main>{LONG}</main>",
        f"<div><article><a href=x>Another story</a> and its blurb</article></div><div><p></p>{LONG}</div>",
        f"<div><div><p><a href=a>One</a><p><a href=b>Two</a></div>{LONG}<div><a href=c>Next page</a></div></div>",
        f"<table><tr><td><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><td>{LONG}</table>",
    ],
)
def test_clusters_choose_the_region(body):
    assert html_extract.main_text(page(body)) == "\n".join(f"Paragraph {i} has a fair number of words in it, as text does." for i in range(12))


def test_ratios_and_clusters_matter(monkeypatch):
    links = "".join(f"<p><a href=x{i}>Go to page {i} of the site</a>" for i in range(30))
    bodies = [f"<div>{links}{LONG}{links}</div>", f"{links}{LONG}", f"<div>{links}</div><div><p></p>{LONG}</div>", f"<div>{links}</div><article>{LONG}</article>"]
    texts = [html_extract.main_text(page(b)) for b in bodies]
    assert all(t.startswith("Paragraph 0") and t.endswith("does.") and t.count("\n") == 11 for t in texts)
    monkeypatch.setattr(html_extract, "_clusters", lambda lines: [True] * len(lines))
    assert all(html_extract.main_text(page(b)) != t for b, t in zip(bodies[:3], texts, strict=False))


@pytest.mark.parametrize("unit", ["<div>x ", "<b>x ", "<i><div><b></i>", "<article><p>x", "<ul><li>x", "<table><tr><td>x", "<p>x<b>", "<a>x<nav>"])
def test_depth_costs_linear_time(unit):
    import time

    def seconds(n):
        began = time.perf_counter()
        html_extract.main_text(unit * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(50_000) < 20 * max(0.1, seconds(5_000))


def plain_article(html):
    """The text of a page of the tables, whose only article nests no furniture, by replacing tags alone."""
    import html as entities
    import re

    inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", html)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|li|section|blockquote)\b[^>]*>", re.sub(r"<br[^>]*>", " ", re.sub(r"(?s)<!--.*?-->", "", inner)))
    texts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in blocks)
    return "\n".join(x for x in texts if x)


def test_pages_of_the_tables(spark):
    import os

    from tessera.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the tables are not here")
    found = {r["page_id"]: r for r in queries.op1_html_extraction(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(found) == len(rows) == 250
    assert {r["page_id"]: plain_article(r["html"]) for r in rows} == {i: r["text"] for i, r in found.items()}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", "r") for r in rows], PAGE_SCHEMA)


def test_extraction_of_tables(spark):
    rows = [(1, "http://a.com/x", page(ARTICLE)), (1, "http://a.com/x", page(ARTICLE)), (None, None, None), (3, "u", "")]
    out = html_extract.extract_main_text(pages(spark, rows)).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert sorted(r["n_chars"] for r in out)[:2] == [0, 0] and out[0]["text"].startswith("A & B")
    assert html_extract.extract_main_text(pages(spark, [])).collect() == []
    with pytest.raises(ValueError):
        html_extract.extract_main_text(pages(spark, rows), keep=("page_id", "text"))


def test_url_rules(spark):
    urls = {
        "https://WWW.Example.COM/en/77?x": ("www.example.com", "/en/77", "example.com/en/7", "allow"),
        "https://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "ftp://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://a.net/DE/1": ("a.net", "/DE/1", None, "allow"),
        "http://b.org?es=/es/": ("b.org", "", None, "allow"),
        "http://c.org/es/://x": ("c.org", "/es/://x", "org/es/", "block"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "ÀB://ÀB.com/": ("Àb.com", "/", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(0, next(iter(urls)), None)]
    out = url_filter.judge_urls(pages(spark, rows), RULES).collect()
    assert collections.Counter(out) == collections.Counter((r[0], *urls[r[1]]) for r in rows)
    assert url_filter.judge_urls(pages(spark, []), RULES).collect() == []


def test_aliases_follow_blocks(spark):
    link = "<head><LINK href='{}' rel=canonical>"
    rows = [
        (1, "http://x.io/a", link.format("https://bad.com/en/1#top")), (2, "http://y.io/b", "<meta http-equiv=refresh content=\"0; URL='http://x.io/a'\">"),
        (3, "http://z.io/c#frag", link.format("/c2")), (4, "http://z.io/c2?a", None), (5, "http://z.io/c2", "<link rel=stylesheet href=//bad.com/en/1>"),
        (6, "http://w.io/", link.format("//example.com/en/7")), (7, "http://v.io/", link.format("http://w.io/")), (8, "http://u.io/", None),
    ]
    redirects = spark.createDataFrame([("http://z.io/c2", "http://q.org/es/9"), ("http://v.io/", "http://bad.com/en/2"), (None, "http://u.io/")], "src string, dst string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages(spark, rows), RULES, redirects).collect()}
    assert [out[i][1] for i in range(1, 9)] == ["block", "block", "block", "allow", "block", "allow", "allow", "allow"]
    assert all(rule is None for rule, _ in out.values())


def test_aliases_over_lines_and_relative(spark):
    link = "<head><link rel=canonical href='{}'>"
    rows = [
        (1, "http://a.io/x", "<head><link\n  rel=\"canonical\"\n  href='http://bad.com/en/1'>"), (2, "http://b.io/x", "<META\n http-equiv='refresh'\n content='0;\n url=http://bad.com/en/2'>"),
        (3, "http://q.org/es/sub/a.html?x", link.format("b.html")), (4, "http://c.io/one/two/a", link.format("../x")), (5, "http://c.io/one/x", link.format("http://bad.com/en/3")),
        (6, "http://d.io/s?p=2", link.format("?p=1")), (7, "http://d.io/s?p=1", link.format("http://bad.com/en/4")), (8, "http://e.io", link.format("b.html#top")),
        (9, "http://e.io/b.html", link.format("./c/../../d/.?u=http://f.io/../")), (10, "http://e.io/d/?u=http://f.io/../", link.format("//bad.com/en/5")),
        (11, "http://g.io/a", link.format("mailto:b")), (12, "http://g.io/mailto:b", link.format("http://bad.com/en/6")), (13, "http://h.io/a", link.format("#b")),
    ]
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages(spark, rows), RULES).collect()}
    assert {i for i, v in out.items() if v == "block"} == set(range(1, 11)) | {12}
    edges = {r["src"]: r["dst"] for r in url_filter.alias_edges(pages(spark, rows)).collect()}
    assert edges["http://q.org/es/sub/a.html?x"] == "http://q.org/es/sub/b.html" and edges["http://e.io/"] == "http://e.io/b.html"
    assert edges["http://e.io/b.html"] == "http://e.io/d/?u=http://f.io/../" and not {"http://g.io/a", "http://h.io/a"} & set(edges)


ODD_LINKS = [
    (1, "http://a.io/dir/x", '<link rel="canonical" href="y">', "block"), (2, "http://a.io/dir/y", "<link rel=canonical href='http://bad.com/en/1'>", "block"),
    (3, "http://b.io/", '<!-- <link rel="canonical" href="http://bad.com/en/1"> --><p>', "allow"), (4, "http://c.io/", '<link rel="shortlink Canonical" href="http://bad.com/en/1">', "block"),
    (5, "http://d.io/", '<link rel="canonical-x" href="http://bad.com/en/1">', "allow"), (6, "http://e.io/q", '<link rel="canonical" href="http://e.io/p">', "block"),
    (7, "http://E.io/p", '<link rel="canonical" href="http://bad.com/en/1">', "block"), (8, "http://f.io/", "<link data-href='http://bad.com/en/1' rel=canonical href=/x>", "allow"),
    (9, "http://g.io/a", "<base href='http://bad.com/en/'><link rel=canonical href=z>", "block"), (10, "HTTP://H.io", "<script>'<link rel=canonical href=http://bad.com/en/1>'</script>", "allow"),
    (11, "http://i.io/", "<link rel=canonical href=HTTP://h.IO>", "allow"), (12, "http://j.io/", "<meta content='5;http://bad.com/en/1' http-equiv=Refresh>", "block"),
    (13, "http://k.io/", "<link rel=canonical href=' http://bad.com/en/1?a=1&amp;b=2#c '>", "block"), (14, "http://l.io/x/", "<link rel=canonical href=../../a/./b/../c>", "block"),
    (15, "http://l.io/a/c", "<meta http-equiv=refresh content=\"0; URL='http://bad.com/en/1'\">", "block"), (16, None, "<link rel=canonical href=http://bad.com/en/1>", "allow"),
    (17, "http://m.io/", "<style><link rel=canonical href=http://bad.com/en/1>", "allow"), (18, "http://n.io?q", None, "allow"),
]


def test_odd_links_and_the_sql(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    frame = pages(spark, [r[:3] for r in ODD_LINKS])
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    found = url_filter.judge_urls(frame, queries.URL_RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in found} == {r[0]: r[3] for r in ODD_LINKS}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op6_url_filter"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in found) == sorted(want.fetchall())


def test_archives(spark, tmp_path):
    big, small = "x" * 99 + "é", "y" * 99
    rows = [(7, "http://b.com/p?q", big), (3, "http://a.b.com/", big), (3, "http://a.b.com/", big), (9, None, big), (None, "http://a.b.com/", big), (4, "u\r\nX: y", small), (5, "http://c.com", small), (6, "http://c.com", None), (8, "http://c.com", ""), (10, "http://d.com", "<p>\r\n\r\n</p>" * 500)]
    out = warc.archive_pages(pages(spark, rows), f"file://{tmp_path}/w").collect()
    assert len(out) == len(rows)
    for r in out:
        source = next(h for i, _, h in rows if i == r["page_id"]) or ""
        data = source.encode()
        first = 3 if source == big else r["page_id"]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", 3))
    ordered = sorted(out, key=lambda r: r["capture_rank"])
    assert [r["capture_rank"] for r in ordered] == list(range(1, len(rows) + 1))
    keys = [(r["url_key"], r["captured"], r["page_id"] is None, r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    archive = next((tmp_path / "w").glob("*.warc.gz"))
    assert gzip.decompress(archive.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.archive_pages(pages(spark, []), f"file://{tmp_path}/none").collect() == []


@pytest.mark.parametrize(("fan_in", "range_rows"), [(128, 500_000), (4, 7)])
def test_runs_are_merged_over_passes_and_ranges(spark, tmp_path, monkeypatch, fan_in, range_rows):
    monkeypatch.setattr(warc, "BLOCK", 2)
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.com/{i % 7}", "".join(rng.choices("abcdef", k=3000))) for i in range(60)]
    rows += [(None, "http://h1.com/1", "z"), (3, "http://h0.com/3", "again"), (None, None, None)]
    folder = f"file://{tmp_path}/w"
    fences = warc.write_archives(pages(spark, rows).coalesce(1), folder, archive_bytes=5000)
    assert fences.select("run").distinct().count() > 10
    merged = warc.merge_runs(fences, folder, fan_in, range_rows).collect()
    assert len({r["part"] for r in merged}) > (2 if range_rows == 7 else 0)
    keys = [(r["url_key"], r["captured"], r["page_id"] is None, r["page_id"] or 0) for r in sorted(merged, key=lambda r: (r["part"], r["position"]))]
    want = sorted((warc.url_key(u), warc.captured_at(i), i is None, i or 0) for i, u, _ in rows)
    assert keys == want and len({(r["run"], r["offset"]) for r in merged}) == len(rows)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.com/{i}", f"{i}" * 2000) for i in range(40)]
    fences = warc.write_archives(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w", archive_bytes=100)
    n = fences.select("run").distinct().count()
    read = warc.read_archives(fences, f"file://{tmp_path}/w")
    assert n >= 14 and read.select(F.spark_partition_id().alias("p")).distinct().count() > n // 2 and read.count() == 40


def test_a_merge_holds_a_block_of_each_run(tmp_path):
    folder, read = f"file://{tmp_path}", 0
    for k in range(5):
        run = warc._Run(folder)
        for i in range(20 * warc.BLOCK):
            run.add((f"r{k}", i, 1, f"k{i:08}", "t", i))
        run.close()
    runs = [_counted(warc._entries(*_opened(folder, path.stem)), state := {"n": 0}) for path in tmp_path.glob("*.index")]
    tree = iter(warc.LoserTree(runs, warc._order))
    for _ in range(10):
        read = next(tree)
    assert read[1] == 1 and state["n"] <= 3
    names = [path.stem for path in tmp_path.glob("*.index")]
    low, high = ("k00005000", "t", 0, 5000, "r0", 0), ("k00005002", "t", 0, 5002, "r2", 5002)
    assert [(e[1], e[0]) for e in warc._merged(folder, names, low, high)] == [*((i, f"r{k}") for i in (5000, 5001) for k in range(5)), (5002, "r0"), (5002, "r1")]


def _opened(folder, name):
    files, base = warc.fs.FileSystem.from_uri(folder)
    return files, f"{base}/{name}.index"


def _counted(items, state):
    for x in items:
        state["n"] += 1
        yield x


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([], lambda x: x)) == []
