"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger holds the measurements and one failure bit per rule; a
policy is a named, versioned mask of bits, so applying another policy or asking what a rule alone removes (its
ablation) needs bitwise operations over the ledger and no second look at the texts.

DataFrame functions only.  One scan, no shuffle: repeats are found inside the row, by sorting (hash, position) pairs
of the 8-word windows of those texts that have an equal pair at all.

Defined cases: null or empty text has no words, measures zero and fails the word count; repeated rows are judged row by row, and
rows with a null doc_id like any other; an empty table gives no row; a very long text is judged in whole, by one row's sort of its
windows; columns of the input are kept by :func:`ledger` under their own names, the ledger's under ``prefix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that divides words (fixed values: \x20 and \x09-\x0D), and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW = 8


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often, and in whatever lambda, the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def line_counts(text: Column) -> Column:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)
    return once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def repeated_words(hashes: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more, from the hash of each word (an array bound once)."""
    count = F.size(hashes) - WINDOW + 1
    windows = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def positions(pairs: Column) -> Column:
        # F.get gives null beyond either end
        equal = lambda p, k: p["h"] == F.get(pairs, k)["h"]
        twice = F.filter(pairs, lambda p, k: F.coalesce(equal(p, k - 1), F.lit(False)) | F.coalesce(equal(p, k + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def of(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(once(once(pairs, positions), covered))

    return F.when(count < 2, F.lit(0)).otherwise(once(windows, of)).cast("long")


def measurements(text: Column) -> Column:
    """A struct of the measurements of a text that is not null (bound once)."""
    lengths = {
        "word_chars": F.char_length(F.translate(text, SPACES, "")),
        "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
    }

    def of(hashes: Column) -> Column:
        return F.struct(F.size(hashes).cast("long").alias("n_words"), repeated_words(hashes).alias("n_repeat_words"))

    return F.struct(
        *[c.cast("long").alias(n) for n, c in lengths.items()],
        line_counts(text).alias("lines"),
        once(F.transform(words(text), lambda w: F.xxhash64(w)), of).alias("words"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule with its bit; ``fails`` is SQL over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > word_chars"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "long_words", "word_chars > 40 * n_words"),
    Rule(5, "short_words", "2 * word_chars < 3 * n_words"),
)

#: Policies by version: the mask of the rules that reject a document.
POLICIES = {"base": 0b000011, "v1": 0b111111}
BASE = POLICIES["base"]


def ledger(documents: DataFrame, prefix: str = "", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents' columns, the measurements and ``failed``, a bit for each rule that the text fails.

    ``prefix`` goes before the ledger's names; it must keep them apart from the input's.
    """
    hidden = f"{prefix}measured"
    measured = {"word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "lines.n", "n_dup_lines": "lines.dup", "n_words": "words.n_words", "n_repeat_words": "words.n_repeat_words"}
    own = [F.col(f"`{c}`") for c in documents.columns]
    step = documents.select(*own, once(F.coalesce(F.col("text"), F.lit("")), measurements).alias(hidden))
    step = step.select(*own, *[F.col(f"{hidden}.{path}").alias(prefix + name) for name, path in measured.items()])
    bits = F.lit(0)
    for rule in rules:
        fails = rule.fails
        for name in sorted(measured, key=len, reverse=True):
            fails = fails.replace(name, f"`{prefix}{name}`") if prefix else fails
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)))
    return step.withColumn(prefix + "failed", bits)


def fails_policy(version: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[version])) != 0


def ablations(book: DataFrame, version: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that it alone rejects; one pass of conditional sums."""
    mask = POLICIES[version]
    held = [r for r in rules if mask >> r.bit & 1]
    failed = F.col("failed").bitwiseAND(F.lit(mask))
    counts = book.agg(
        *[F.count_if(failed.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in held],
        *[F.count_if(failed == F.lit(1 << r.bit)).alias(f"o{r.bit}") for r in held],
        F.count_if(failed != 0).alias("rejected"),
    )
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in held])
    return counts.select(F.explode(rows).alias("r"), "rejected").select("r.rule", "r.n_failed", "r.n_only", "rejected")


def accepted(documents: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix = "_" + prefix
    return ledger(documents, prefix).where(~fails_policy(version, prefix + "failed")).select(*[F.col(f"`{c}`") for c in documents.columns])
