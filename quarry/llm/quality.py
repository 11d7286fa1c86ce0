"""Rule bitmask ledger: each rule is evaluated once, policies are applied later.

``ledger`` measures every text and stores one failure bit for each rule beside
the measurements.  ``apply_policy`` decides from the bits alone, so a new policy
version needs no second pass over texts, and ``ablation`` counts what each rule
of a policy does from the distinct masks.  All of it is DataFrame expressions on
one row at a time: no shuffle, no Python.

Defined cases: a null text counts as an empty one (no words, so the word-count
rule fails); repeated rows and repeated or null ids are measured each on its
own; very long texts are measured whole, within their row; an empty table gives an
empty ledger; further columns are left alone
(``ledger`` drops them, ``keep_rows`` returns them).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import let, words

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the struct of measurements."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count: a text is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]


#: Thresholds of the published web-text rules (word count, repetition, mean word
#: length, symbols per word, repeated lines).
RULES = (
    Rule(0, "few_words", lambda m: m.n_words < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule(2, "many_symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule(3, "short_words", lambda m: m.word_chars < 3 * m.n_words),
    Rule(4, "long_words", lambda m: m.word_chars > 10 * m.n_words),
    Rule(5, "repeated_lines", lambda m: 100 * m.n_dup_lines > 30 * F.greatest(m.n_lines, F.lit(1))),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
#: ``v1`` rejects junk and leaves ordinary prose alone; ``strict`` takes every rule, and
#: so also rejects short texts with a line or two that recur.
V1 = Policy("v1", ("few_words", "repeated_windows", "many_symbols"))
POLICIES = {p.version: p for p in (BASE, V1, Policy("strict", tuple(r.name for r in RULES)))}


def _windows(w: Column, n: Column) -> Column:
    """A hash of each 3-word window, in order."""
    at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), at)).otherwise(F.array().cast("array<bigint>"))


def _covered(w: Column, hashes: Column) -> Column:
    """How many words lie in windows that occur at least twice.

    Windows are sorted by hash; one that equals a neighbour, word by word, is
    repeated.  Each repeated window then covers up to three words, less what
    the next one covers.
    """

    def same(i: Column, j: Column) -> Column:
        return F.coalesce((F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2)), F.lit(False))

    def twin(s: Column, k: Column, other: Column) -> Column:
        a, b = F.get(s, k), F.get(s, other)
        return F.coalesce(a.h == b.h, F.lit(False)) & same(a.i, b.i)

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = let(ordered, lambda s: F.filter(F.transform(s, lambda x, k: F.when(twin(s, k, k - 1) | twin(s, k, k + 1), x.i)), lambda i: i.isNotNull()))
    return let(
        F.sort_array(repeated),
        lambda at: F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b
        ),
    )


def measure(text: Column) -> Column:
    """A struct of all measurements of a text."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.size(w)
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        repeat = let(_windows(w, n), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(w, h)))
        return let(
            lines,
            lambda rows: F.struct(
                n.cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                repeat.cast("long").alias("n_repeat_words"),
                F.size(rows).cast("long").alias("n_lines"),
            ),
        )

    return let(words(text), of)


def fail_bits(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    by = {r.name: r for r in rules}
    return sum(1 << by[name].bit for name in policy.rules)


def _ledger_column(text: Column, rules: Sequence[Rule]) -> Column:
    return let(measure(text), lambda m: F.struct(m.alias("m"), fail_bits(m, rules).alias("bits")))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``fail_bits`` (bit r.bit: rule r fails)."""
    one = docs.select(F.col(id_col).alias("doc_id"), _ledger_column(F.col(text_col), rules).alias("l"))
    return one.select("doc_id", *(F.col(f"l.m.{k}").alias(k) for k in (*MEASUREMENTS, "n_lines")), F.col("l.bits").alias("fail_bits"))


def fails(bits: Column, policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def apply_policy(led: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept`` and the version that decided."""
    return led.withColumns({"kept": ~fails(F.col("fail_bits"), policy, rules), "policy": F.lit(policy.version)})


def keep_rows(docs: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns."""
    return docs.filter(~fails(_ledger_column(F.col(text_col), rules).bits, policy, rules))


def only_rule(bits: Column, policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """The name of the policy's rule that alone rejects a text; null if none or several do."""
    own = bits.bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    names = [F.when(own == 1 << r.bit, r.name) for r in rules if r.name in policy.rules]
    return F.coalesce(*names)


def ablation(led: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: rows failing it, failing it alone, and kept without it.

    Rows are first counted by mask, at most 2^rules of them whatever the input.
    """
    whole = F.lit(mask(policy, rules)).cast("long")
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(whole).alias("bits")).agg(F.count("*").alias("n"))
    used = [r for r in rules if r.name in policy.rules]
    each = counts.withColumn("r", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used))))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(hit).alias("n_failed"), total(alone).alias("n_failed_alone"), total(alone | (F.col("bits") == 0)).alias("n_kept_without")
    )
