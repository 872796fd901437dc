"""Page operators against plain restatements, over awkward inputs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import pytest

from tidemark.llm import html_text, url_filter, warc
from tidemark.llm.queries import ALLOW_RULES, BLOCK_RULES, SPAM_HOSTS
from tidemark.scratch import Scratch

SCHEMA = "page_id long, url string, html string"


def pages():
    big = "".join(f"<p>paragraph {i} é漢 &amp; more.</p>" for i in range(9000))
    urls = [
        None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7?x", "https://a.b.example.com/en/71", "https://example.net/de/8#f", "https://x.example.net/de/9", "ftp://org", "http://sub.org/es/",
        "http://notexample.net/de/8/", "http://evil.com?u=http://example.org/es/", "https://www.cheap-pills.example.com/fr/", "https://cheap-pills.example.com/en/1", "http://host:80/en/\nline", "a://b://c/d", "http://..com/en/",
    ]
    texts = [None, "", "same", "same", big, big, "<p>é", "x\r\n\r\ny", "\x00\x01", "0\r\n\r\n", "same"]
    return [(i, u, texts[i % len(texts)]) for i, u in enumerate(urls)] + [(2, urls[2], "same"), (None, None, "same"), (None, None, "only here")]


@pytest.fixture(scope="module")
def table(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(pages(), SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("host", "rule", "keys_", "digest_", "text", "archive", "Refers_")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def judged(url, block, allow, hosts):
    host = path = ""
    if url and "://" in url:
        found = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]
    fits = []
    for rule, verdict in [(r, "block") for r in block] + [(r, "allow") for r in allow]:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in hosts) else "allow"


def test_url_filter(table, none):
    found = url_filter.judge(table, BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS)
    want = sorted(((i, *judged(u, BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS)) for i, u, _ in pages()), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert url_filter.judge(none, BLOCK_RULES, ALLOW_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(table, [], []).collect()} == {"allow"}
    joined = url_filter.judge(table, BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS, most_bits=1, beyond="join")
    assert sorted((tuple(r) for r in joined.distinct().collect()), key=repr) == sorted(set(want), key=repr)
    with pytest.raises(OverflowError):
        url_filter.judge(table, BLOCK_RULES, [], most_bits=1)


def test_cascade_is_exact(spark):
    pick = random.Random(4)
    keys = [f"k{pick.randint(0, 10**9)}" for _ in range(4000)]
    listed = keys[::7] + ["not in the corpus"]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.build_cascade(spark, listed, universe, 40)  # a wrong size makes many false positives
    found = {r["key"] for r in universe.where(cascade.lists(universe["key"])).collect()}
    assert found == set(listed) & set(keys) and len(cascade.levels) > 2


def test_plans_stay_native(table):
    plan = url_filter.judge(table, BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


@pytest.mark.parametrize("least,segment", [(0, 32 << 10), (0, 100), (5, 1 << 20)])
def test_warc(spark, table, none, least, segment):
    found = warc.round_trip(table, least, segment)
    first = {}
    for i, _, h in pages():
        if len((h or "").encode()) >= least and i is not None:
            first[h or ""] = max(first.get(h or "", -1), i)
    want = []
    for i, _, h in pages():
        raw = (h or "").encode()
        leader = first.get(h or "", i)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), digest, "response" if leader == i else "revisit", None if leader == i else leader, True))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(none).count() == 0


def test_warc_damage(spark):
    block = warc.HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 50, 16)
    parts = [(1, None, block[:50]), (2, None, block[50:90]), (3, len(block), block[90:])]
    assert warc.join_segments(parts[::-1]) == block
    assert warc.join_segments(parts[:2]) is None and warc.join_segments(parts[1:]) is None
    assert warc.join_segments([*parts[:2], (3, len(block) + 1, block[90:])]) is None
    assert warc.dechunked(warc.chunked(b"")) == b"" and warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    head = {b"warc-type": b"response", b"warc-record-id": b"<urn:page:7:0-1>", b"warc-payload-digest": b"sha1:" + warc.base32_sha1(b"payload" * 50).encode()}
    assert warc.judge(head, block)["intact"] and not warc.judge(head, None)["intact"] and not warc.judge(head, block[:-9])["intact"]


def test_minimum_cut():
    pick = random.Random(1)
    for _ in range(200):
        n = pick.randint(1, 8)
        costs = [pick.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, pick.randint(0, 5)) for i in range(n) for j in range(i) if pick.random() < 0.5]

        def total(side):
            return sum(abs(c) for c, s in zip(costs, side) if (c > 0) != bool(s) and c) + sum(w for i, j, w in edges if side[i] != side[j])

        assert total(html_text.minimum_cut(costs, edges)) == min(total(s) for s in itertools.product([False, True], repeat=n))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header class="site-header"><h1>Site</h1></header><nav>menu</nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>First para<br>graph&nbsp;one.</p>
<div class="advert"><p>Buy now this long advert text that goes on and on.</p></div><p>ok</p><script>var t="</p>";</script><!-- <p>no</p> -->
<form><label>Email</label><input></form><p><b>Bold start.<br><p>Unclosed &lt;tag&gt;</article><section id="comments"><h2>Comments</h2><p>I think that
this is a great article with a long comment.</p></section></main><aside>side</aside><footer>f</footer></body></html>"""


def test_html_text(table, none):
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para graph one.\n\nok\n\nBold start.\n\nUnclosed <tag>"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div>") == ""
    assert html_text.main_text("<p>just a page of text</p>") == "just a page of text"
    assert html_text.main_text('<div class="page-header">Site name of the page.</div><div class="post"><div class="post-header"><h2>Head</h2></div><p>Body text.</p></div>') == "Head\n\nBody text."
    assert html_text.main_text('<ul class="menu"><li><a href="/">Home</a></ul><div><a href="/a">one</a> <a href="/b">two</a></div><p>A paragraph that says what it says, at some length.</p>') == "A paragraph that says what it says, at some length."
    assert html_text.main_text("<article><p>kept</p><!-- never closed <p>x</p>") == "kept"
    rows = {(r["page_id"], r["text"]): r["n_chars"] for r in html_text.extract(table).collect()}
    assert all(n == len(t) for (_, t), n in rows.items()) and rows[(4, "\n\n".join(f"paragraph {i} é漢 & more." for i in range(9000)))]
    assert html_text.extract(none).count() == 0


def test_segments_are_used(spark, table):
    scratch = Scratch(spark, "test")
    warc.write_archives(table.select("page_id", "url", "html"), scratch.path("a"), segment=1000)
    raw = b"".join(__import__("zlib").decompress(r["content"], 31) for r in spark.read.format("binaryFile").load(scratch.path("a")).collect())
    kinds = [head[b"warc-type"] for head, _ in warc.parse(raw)]
    assert kinds.count(b"continuation") > 50 and b"revisit" in kinds
