"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule.  A policy is a versioned set of rules: applying
one, comparing two, or asking what a rule contributes reads the bits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .stats import MEASURES, document_measures


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measurements; null counts as passed."""
    name: str
    bit: int
    fails: str


RULES = [
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
    Rule("shouting", 6, "100 * n_shouts > 20 * n_words"),
    Rule("capitals", 7, "100 * n_upper > 50 * (n_upper + n_lower)"),
    Rule("digits", 8, "100 * n_digits > 50 * word_chars"),
    Rule("one_word", 9, "100 * top_word > 40 * n_words"),
    Rule("brackets", 10, "100 * n_brackets > 60 * n_words"),
]

BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject a document. ``base`` is fixed by the contract.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(policy: str | tuple[str, ...], rules: list[Rule] = RULES) -> int:
    """The bits of a policy, by version or by rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in rules}
    unknown = [n for n in names if n not in bits]
    if unknown:
        raise ValueError(f"no such rule: {unknown}")
    return sum(1 << bits[n] for n in set(names))


def fail_bits(rules: list[Rule] = RULES) -> Column:
    bits = [r.bit for r in rules]
    if len(set(bits)) != len(bits) or not all(0 <= b < 63 for b in bits):
        raise ValueError("rules need bits of their own from 0 to 62")
    total = F.lit(0).cast("long")
    for r in rules:
        total = total.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return total


def rule_ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, measurements, fail_bits) of every row; a null text is empty, other columns are not read."""
    return document_measures(docs, ["doc_id"]).withColumn("fail_bits", fail_bits(rules))


def passes(policy: str | tuple[str, ...], rules: list[Rule] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    return ledger.withColumn("base_failed", ~passes("base")).withColumn("kept", ~F.col("base_failed") & passes(policy))


def ablations(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT, rules: list[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only this rule rejects.

    Rows are first counted by their bits (at most one row per combination that
    occurs), then combined bitwise.  An empty ledger gives zeros.
    """
    chosen = mask(policy, rules)
    counted = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    used = [r for r in rules if chosen >> r.bit & 1]
    sums = []
    for r in used:
        bit = F.lit(1 << r.bit)
        sums.append(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias(f"{r.name}_failed"))
        sums.append(F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias(f"{r.name}_alone"))
    one = counted.agg(*sums)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"{r.name}_failed").alias("failed"), F.col(f"{r.name}_alone").alias("only_this"))
        for r in used])).alias("r")).select("r.*")


def kept_documents(docs: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns; one pass over the texts."""
    columns = docs.columns
    inner = [f"_c{i}" for i in range(len(columns))]
    renamed = docs.toDF(*inner)
    text = inner[[c.lower() for c in columns].index("text")]
    ledger = document_measures(renamed.withColumn("text", F.col(text)), inner).withColumn("fail_bits", fail_bits())
    return ledger.where(passes(policy)).select(*inner).toDF(*columns)


__all__ = ["MEASURES", "POLICIES", "RULES", "Rule", "ablations", "apply_policy", "kept_documents", "mask", "passes", "rule_ledger"]
