"""URL filters by a cascade of Bloom filters, without joins on the lookup path.

A list holds rules ``host/path-prefix``; a rule fits its host and all subdomains if the url's path starts with the rule's.
So the keys of a url are each of its host's suffixes with each prefix of its path that has the length of some
rule's: the key universe of a corpus is the set of those keys.  Level 1 of a cascade encodes the listed keys; level 2 the
keys of the universe that pass level 1 without being listed; level 3 the listed keys that pass level 2, and so on until
no false positive is left.  A key of the universe is listed if the first level that it fails is an even one (or
if it passes all of an odd number): membership is exact, though no level is.

DataFrame functions only: hashes, bit positions and the bitwise-or aggregation of a level's words are built in, and a
lookup is a chain of array reads in the scan of the urls.

Scale: level 1 is sized so that about as many keys of the universe pass it as are listed; all levels together
take about 1.5 * log2(universe / listed) bits a listed key and do not grow with the corpus otherwise.  The urls are read three
times: to count their keys, to find the keys that pass level 1 of any list (all that is shuffled: one small table, from
which every further level of all lists is built, without joins) and to judge.  The words of a level are part of the plan, hence
sent to each task; a list whose level 1 exceeds ``section_bits`` (a list of some 6 million keys) is divided into sections by
a hash of the keys, each with a cascade of its own, and the sections are looked up one after the other.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets the default; an empty
list lists nothing; rows that repeat are judged each; an empty table gives no row; a very long url has as many keys as its host has labels,
times the lengths of paths in the rules; of several rules that fit the longest wins, of equally long ones the last in
the order of strings, and a rule that is in both lists allows; of other columns only ``keep`` are carried along, under their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .quality import once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, "^[\\s\\S]*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a url: host suffixes with the path's prefixes of the given lengths."""
    labels = F.split(host, "\\.")
    fitting = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.left(path, F.lit(n))) for n in lengths]), lambda p: p.isNotNull())
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    joined = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(joined)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits as text for the plan, ``hashes`` positions a key, salted by ``number``."""

    number: int
    bits: int
    hashes: int
    words: str

    def array(self) -> Column:
        return F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to a constant when planned

    def passes(self, key: Column, words: Column | None = None) -> Column:
        words = self.array() if words is None else words
        return F.forall(bit_positions(key, self.number, self.bits, self.hashes), lambda p: _bit(words, p))


def _bit(words: Column, position: Column) -> Column:
    """Whether the bit at a position is set."""
    return F.get(words, F.shiftright(position, 6).cast("int")).bitwiseAND(_mask(position)) != 0


def _mask(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


def bit_positions(key: Column, number: int, bits: int, hashes: int) -> Column:
    """An array of ``hashes`` positions below ``bits``, from two hashes of the key."""
    pair = F.struct(*[F.pmod(F.xxhash64(key, F.lit(2 * number + i)), F.lit(bits)).alias(name) for i, name in enumerate(("one", "two"))])
    return once(pair, lambda p: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(p["one"] + p["two"] * i, F.lit(bits))))


def level_bits(count: float, rate: float) -> int:
    """Bits of a filter of ``count`` keys with the given rate of false positives."""
    return max(64, math.ceil(-max(count, 1) * math.log(rate) / math.log(2) ** 2 / 64) * 64)


def build_levels(keys: DataFrame, counts: dict[int, float], number: int, rates: dict[int, float], most_bits: int | None) -> dict[int, Level]:
    """For each group ``g`` of ``counts`` a filter over its rows (g, key) of ``keys``; groups without a row get none.  One job."""
    shapes = {}
    for g, count in counts.items():
        bits = level_bits(count, rates[g])
        if most_bits is not None and bits > most_bits:
            raise OverflowError(f"a level of {bits} bits is more than {most_bits}")
        shapes[g] = bits, min(30, max(1, round(bits / max(count, 1) * math.log(2))))
    positions = F.array().cast("array<bigint>")
    for g, (bits, hashes) in shapes.items():
        positions = F.when(F.col("g") == g, bit_positions(F.col("key"), number, bits, hashes)).otherwise(positions)
    found = keys.select("g", F.explode(positions).alias("at"))
    rows = found.groupBy("g", F.shiftright("at", 6).alias("word")).agg(F.bit_or(_mask(F.col("at"))).alias("set")).collect()  # at most bits / 64 rows a group
    words: dict[int, dict[int, int]] = {}
    for r in rows:
        words.setdefault(r["g"], {})[r["word"]] = r["set"]
    return {g: Level(number, *shapes[g], ",".join(str(own.get(i, 0)) for i in range(shapes[g][0] // 64))) for g, own in words.items()}


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column, words: list[Column] | None = None) -> Column:
        """Whether a key of the universe is listed."""
        inner = None
        for level, own in zip(reversed(self.levels), reversed(words or [None] * len(self.levels))):
            inner = level.passes(key, own) if inner is None else level.passes(key, own) & ~inner
        return F.lit(False) if inner is None else inner

    def listed(self, keys: Column) -> Column:
        """Those of an array of keys that are listed; each level's words are in the plan once."""

        def bind(words: list[Column]) -> Column:
            if len(words) == len(self.levels):
                return F.filter(keys, lambda k: self.lists(k, words))
            return once(self.levels[len(words)].array(), lambda w: bind([*words, w]))

        return bind([]) if self.levels else F.slice(keys, 1, 0)


def build_cascades(spark: SparkSession, lists: dict[int, list[str]], passing: Callable[[dict[int, Level]], DataFrame], size: int, most_bits: int | None = None) -> dict[int, Cascade]:
    """The cascades of several lists over one universe of at most ``size`` keys, built in step.

    ``passing`` gives rows (g, key), repeats allowed, of the keys of the universe that pass the first level of list g.  It is read
    once, into a table of the distinct ones with the listed keys; all that follows reads this table.
    """
    scratch = Scratch(spark, "urls")
    own = spark.createDataFrame([(g, x) for g, keys in lists.items() for x in sorted(set(keys))], "g int, key string")
    counts: dict[int, float] = {g: len(set(keys)) for g, keys in lists.items() if keys}
    # level 1 lets through about as many others as there are listed keys
    rates = {g: min(0.5, math.sqrt(0.5) * n / max(size, 1)) for g, n in counts.items()}
    levels = {g: [level] for g, level in build_levels(own, counts, 1, rates, most_bits).items()}
    if not levels:
        return {g: Cascade(()) for g in lists}
    both = own.select("g", "key", F.lit(1).alias("listed")).unionByName(passing({g: x[0] for g, x in levels.items()}).select("g", "key", F.lit(0).alias("listed")))
    table = scratch.save(both.groupBy("g", "key").agg(F.max("listed").alias("listed")), "keys")
    sets = {side: table.where(F.col("listed") == side).select("g", "key") for side in (1, 0)}
    sizes = {side: {} for side in (1, 0)}
    for r in table.groupBy("listed", "g").count().collect():
        sizes[r["listed"]][r["g"]] = r["count"]
    side, number = 0, 2
    while sizes[side]:
        if number > 60:
            raise RuntimeError("the cascade does not end: keys that no hash tells apart")
        found = build_levels(sets[side], sizes[side], number, dict.fromkeys(sizes[side], 0.5), most_bits)
        for g, level in found.items():
            levels[g].append(level)
        # of the other set those that pass are the next level's; about half of them, and of lists that have ended none
        side, passes = 1 - side, F.lit(False)
        for g, level in found.items():
            passes = passes | ((F.col("g") == g) & level.passes(F.col("key")))
        sets[side] = sets[side].where(passes)
        if number % 8 == 0:
            sets[side] = scratch.save(sets[side], f"keys{number}")
        sizes[side] = {g: max(1.0, sizes[side][g] / 2) for g in found if g in sizes[side]}
        number += 1
    return {g: Cascade(tuple(levels.get(g, ()))) for g in lists}


def build_cascade(spark: SparkSession, listed: list[str], universe: DataFrame, size: int, most_bits: int | None = None) -> Cascade:
    """The cascade of a list over a universe (column ``key``, repeats allowed) of at most ``size`` keys."""
    passing = lambda first: universe.where(first[0].passes(F.col("key"))).select(F.lit(0).alias("g"), "key")
    return build_cascades(spark, {0: listed}, passing, size, most_bits)[0]


def judge(urls: DataFrame, block: list[str], allow: list[str], hosts: list[str] = (), default: str = "allow", keep: tuple[str, ...] = ("page_id",), most_bits: int | None = None, beyond: str = "raise", section_bits: int = 1 << 27) -> DataFrame:
    """``keep``, host, path, rule (the longest that fits, else null) and verdict of each url.

    ``hosts`` are blocked with their subdomains where no rule fits.
    """
    spark = urls.sparkSession
    block, allow, hosts = (["".join(split_rule(r)) for r in rules] for rules in (block, allow, hosts))
    lengths = sorted({len(split_rule(r)[1]) for r in (*block, *allow, *hosts)})
    host, path = host_and_path(F.col("url"))
    seen = urls.select(*keep, host.alias("host"), path.alias("path"))
    seen = seen.withColumn("keys_", keys_of(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    size = seen.agg(F.sum(F.size("keys_"))).first()[0] or 0
    lists = (block, allow, hosts)
    first_bits = [level_bits(len(set(x)), min(0.5, math.sqrt(0.5) * len(set(x)) / max(size, 1))) for x in lists if x]
    sections = max(1, -(-max(first_bits, default=0) // section_bits))
    names = ("block_", "allow_", "hosts_")
    found = seen.select("*", *[F.array().cast("array<string>").alias(n) for n in names])
    scratch = Scratch(spark, "urls") if sections > 1 else None
    for section in range(sections):
        mine = lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(sections)) == section  # noqa: E731, B023
        own = F.filter("keys_", mine) if sections > 1 else F.col("keys_")
        dealt = {g: _of_section(spark, x, sections, section) for g, x in enumerate(lists)}

        def passing(first: dict[int, Level]) -> DataFrame:
            tag = lambda g: lambda k: F.struct(F.lit(g).alias("g"), k.alias("key"))
            pairs = [F.transform(Cascade((level,)).listed(own), tag(g)) for g, level in first.items()]  # noqa: B023
            return seen.select(F.explode(F.concat(*pairs)).alias("p")).select("p.*")

        try:
            cascades = build_cascades(spark, dealt, passing, size, most_bits)
        except OverflowError:
            if beyond != "join":
                raise
            return _judge_by_join(seen, block, allow, hosts, default, keep)
        found = found.withColumns({n: F.concat(n, cascades[g].listed(own)) for g, n in enumerate(names)})
        if scratch and section + 1 < sections:
            found = scratch.save(found, f"section{section}")  # so that one section's levels are held at a time
    longest = F.array_max(F.transform(F.concat("block_", "allow_"), lambda k: F.struct(F.char_length(k).alias("n"), k.alias("rule"))))["rule"]
    found = found.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.array_contains("allow_", F.col("rule")), "allow").otherwise("block"))
    verdict = verdict.when(F.size("hosts_") > 0, "block")
    return found.select(*keep, "host", "path", "rule", verdict.otherwise(default).alias("verdict"))


def _of_section(spark: SparkSession, keys: list[str], sections: int, section: int) -> list[str]:
    """The listed keys of a section, by the hash that the plan uses."""
    if sections == 1 or not keys:
        return keys
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    return [r["key"] for r in frame.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(sections)) == section).collect()]


def _judge_by_join(seen: DataFrame, block: list[str], allow: list[str], hosts: list[str], default: str, keep: tuple[str, ...]) -> DataFrame:
    """The same for lists too long for a plan: distinct keys are joined with the lists, and the rows with what was found."""
    spark = seen.sparkSession
    rows = [(r, 2, "allow") for r in set(allow)] + [(r, 2, "block") for r in set(block) - set(allow)] + [(r, 1, "block") for r in set(hosts) - set(allow) - set(block)]
    rules = spark.createDataFrame(rows, "key string, rank int, verdict string")
    named = seen.withColumn("row_", F.struct(*keep, "host", "path"))
    best = named.select("row_", F.explode("keys_").alias("key")).join(rules, "key").groupBy("row_").agg(F.max(F.struct("rank", F.char_length("key").alias("n"), "key", "verdict")).alias("best"))
    rule = F.when(F.col("best.rank") == 2, F.col("best.key"))
    return named.join(best, "row_", "left").select(*keep, "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
