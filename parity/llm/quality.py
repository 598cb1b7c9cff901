"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger row keeps the measurements and one bit per failed rule, so
a policy is nothing but a mask over the bits: new policy versions and ablations are bitwise work on the ledger and
never touch the texts again.

Nothing here groups documents: all measurements are computed inside a row, so no key can be hot and the texts are
never shuffled. Repeated three-word windows are found by sorting the 64-bit hashes of a document's own windows.

Defined results: a null text has no words and no lines, an empty text no words; both fail ``few_words``. Extra
columns are carried along by ``ledger`` unless they clash with a ledger column, which then wins. Repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \\t\\n\\u000B\\u000C\\r"


@dataclass(frozen=True)
class Rule:
    """A named test on the measurements; the SQL is true where the document fails."""

    name: str
    fails: str


#: The bit of a rule is its place in this list; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(rule.name for rule in RULES),
}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_ellipsis_lines",
    "n_repeat_words",
)


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bit = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(bit[name] for name in names)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES (long), in place of any that are there already."""
    own = [c for c in docs.columns if c not in MEASURES]
    # the columns of the caller travel as one, so that no name of theirs meets one of these steps
    carried = f"struct({', '.join(f'`{c}`' for c in own)}) AS carried" if own else "struct(1 AS none) AS carried"
    source = f"coalesce(`{text}`, '')"
    plain = [m for m in MEASURES if m != "n_repeat_words"]
    trimmed = docs.selectExpr(carried, f"{source} AS t", f"trim(BOTH '{BLANKS}' FROM {source}) AS trimmed")
    cut = trimmed.selectExpr(
        "carried",
        f"if(trimmed = '', array(), split(trimmed, '[{BLANKS}]+')) AS w",
        f"filter(split(t, '\\\\n'), l -> l rlike '[^{BLANKS}]') AS lines",
        "length(regexp_replace(t, '[^#*$%&|<>]+', '')) AS n_symbols",
        "length(regexp_replace(t, '\\\\P{L}+', '')) AS n_letters",
    )
    hashed = cut.selectExpr(
        "carried",
        "cast(size(w) AS BIGINT) AS n_words",
        "cast(length(array_join(w, '')) AS BIGINT) AS word_chars",
        "cast(n_symbols AS BIGINT) AS n_symbols",
        "cast(n_letters AS BIGINT) AS n_letters",
        "cast(size(lines) AS BIGINT) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        f"cast(size(filter(lines, l -> rtrim('{BLANKS}', l) rlike '(\\\\.\\\\.\\\\.|\u2026)$')) AS BIGINT)"
        " AS n_ellipsis_lines",
        "if(size(w) < 3, array(),"
        " transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))) AS h",
    )
    placed = hashed.selectExpr(
        "carried", *plain,
        "if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))), array()) AS z",
    )
    starts = placed.selectExpr(
        "carried", *plain,
        "sort_array(transform(filter(z, (e, i) -> coalesce(e.x = get(z, i - 1).x, false)"
        " OR coalesce(e.x = get(z, i + 1).x, false)), e -> e.i)) AS p",
    )
    return starts.selectExpr(
        *(f"carried.`{c}` AS `{c}`" for c in own), *plain,
        "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, b) -> a + b)"
        " AS n_repeat_words",
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the text, with the measurements and ``failed_bits`` (bit i: rule i fails)."""
    bits = " + ".join(f"if({rule.fails}, {1 << i}L, 0L)" for i, rule in enumerate(rules))
    rows = measured(docs, text)
    return rows.select(*(c for c in rows.columns if c not in (text, "failed_bits")), F.expr(bits).alias("failed_bits"))


def verdict(bits, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES):
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask_of(names, rules))) == 0


def apply_policies(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules=RULES) -> DataFrame:
    """The ledger with one boolean column ``kept_<policy>`` for each policy."""
    return rows.select("*", *(verdict(F.col("failed_bits"), p, rules).alias(f"kept_{k}") for k, p in policies.items()))


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules=RULES) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that fail it alone, and kept without and with it.

    The ledger is first counted by its bits (at most 2^rules rows, combined before the shuffle), so the tables of
    all policies come from a frame whose size does not depend on the corpus.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame(
        [(k, r.name, mask_of(p, rules), mask_of((r.name,), rules)) for k, p in policies.items() for r in rules
         if r.name in p],
        "policy string, rule string, mask bigint, bit bigint",
    )
    seen = table.join(counts, F.lit(True), "left")
    failed = F.coalesce(F.col("failed_bits"), F.lit(0)).bitwiseAND(F.col("mask"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return seen.groupBy("policy", "rule").agg(
        F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("bit"), n).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(failed == 0, n).otherwise(0)).alias("n_kept"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, n).otherwise(0)).alias("n_kept_without"),
    )
