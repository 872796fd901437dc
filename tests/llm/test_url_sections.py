"""Long lists of rules: sections of a list, and the sizes of a list of millions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_pages import judged, pages

from tidemark.llm import url_filter
from tidemark.llm.queries import ALLOW_RULES, BLOCK_RULES, SPAM_HOSTS

SCHEMA = "page_id long, url string, html string"


def test_sections(spark):
    """A list that is divided into sections judges as a whole one."""
    table = spark.createDataFrame(pages(), SCHEMA)
    want = sorted(((i, *judged(u, BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS)) for i, u, _ in pages()), key=repr)
    found = url_filter.judge(table, BLOCK_RULES, ALLOW_RULES, SPAM_HOSTS, section_bits=24)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_many_rules(spark):
    """20,000 hosts, half of them in the corpus: no cap, exact, and level 1 is a small part of the plan."""
    pick = random.Random(9)
    hosts = [f"h{i}.example{pick.randrange(50)}.com" for i in range(30_000)]
    block, allow = hosts[:10_000], hosts[5000:15_000]
    urls = spark.createDataFrame([(i, f"http://www.{h}/x", None) for i, h in enumerate(hosts)], SCHEMA)
    found = url_filter.judge(urls, block, allow)
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in found.collect()}
    for i, h in enumerate(hosts):
        assert rows[i] == ((h, "block") if i < 5000 else (h, "allow") if i < 15_000 else (None, "allow"))
    assert "Join" not in found._jdf.queryExecution().toString()


def test_sizes_of_millions():
    """Five million hosts against 10 ** 11 keys fit one section; ten times as many are divided, none is refused."""
    rate = lambda n: min(0.5, 0.5**0.5 * n / 10**11)
    assert url_filter.level_bits(5_000_000, rate(5_000_000)) < 1 << 27 < url_filter.level_bits(50_000_000, rate(50_000_000))


def test_construction_has_no_join(spark, capfd):
    """The table of keys comes from one aggregation."""
    seen = []

    def passing(first):
        seen.append(first)
        return spark.range(1000).select(F.lit(0).alias("g"), F.col("id").cast("string").alias("key"))

    cascade = url_filter.build_cascades(spark, {0: ["1", "2", "no key"], 1: []}, passing, 1000)
    universe = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    assert {r["key"] for r in universe.where(cascade[0].lists(universe["key"])).collect()} == {"1", "2"}
    assert len(seen) == 1 and not cascade[1].levels
