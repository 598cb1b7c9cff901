"""What may be delivered, and whether its prose claims only what was measured."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.functions.numbers import SIX_SIGNIFICANT, with_fixed_entries, with_printed, with_ratio_texts
from parity.operators.bench import array_median
from parity.operators.lifecycle import record_risk
from parity.sources.records import (
    explode_checks,
    explode_differences,
    semantic_differences,
    total_duration,
    validation_status,
)

# Labels, claim kinds and the patterns that recognise a claim (first group = number).
NEEDS_HUMAN = "needs-human"
CLAIM_PATTERNS = {
    "speedup": r"(\d+(?:\.\d+)?)\s*(?:x\b|\xD7)",
    "checks": r"(\d+)\s+(?:of\s+\d+\s+)?checks?\b",
    "tests": r"(\d+)\s+tests?\b",
    "rows": r"([\d,]+)\s+rows?\b",
    "differences": r"(\d+)\s+(?:semantic\s+)?(?:differences?|diffs?)\b",
    "attempts": r"(\d+)\s+(?:repair\s+)?attempts?\b",
}
ALWAYS_SUPPORTED = {"speedup": ("1", "1.0", "1.00")}


# --- disposition -----------------------------------------------------------------------------------


def _facts() -> dict[str, Column]:
    failed = F.coalesce("failed", F.lit(False))
    status = validation_status()
    recovered = F.coalesce("repair.succeeded", F.lit(False))
    return {
        "no_code": F.col("codegen").isNull(),
        "failed": failed,
        "unvalidated": F.col("validation").isNull(),
        "wrong": F.coalesce(status != "PASS", F.lit(False)) & ~recovered,
        "status": status,
    }


def disposition() -> Column:
    """refused, draft or ready; the first rule that applies decides."""
    f = _facts()
    return (
        F.when(f["no_code"], "refused")
        .when(f["failed"], "draft")
        .when(f["unvalidated"], "refused")
        .when(f["wrong"], "draft")
        .otherwise("ready")
    )


def labels(origin: str) -> Column:
    """Labels of the delivery, origin first; none when it is refused."""
    f = _facts()
    status_label = F.concat(F.lit("validation-"), F.lower(f["status"]))
    applied = F.coalesce("optimization.applied", F.lit(False))
    none = F.array().cast("array<string>")
    start, human = F.lit(origin), F.lit(NEEDS_HUMAN)
    ready = F.array_compact(
        F.array(start, F.when(record_risk() == "high", "high-risk"), F.when(applied, "optimised"))
    )
    return (
        F.when(f["no_code"], none)
        .when(f["failed"], F.array(start, human, F.lit("migration-failed")))
        .when(f["unvalidated"], none)
        .when(f["wrong"], F.array(start, human, status_label))
        .otherwise(ready)
    )


def deliveries(records: DataFrame, origin: str = "automated-migration") -> DataFrame:
    """``migration_id, disposition, labels``."""
    return records.select(
        "migration_id", disposition().alias("disposition"), labels(origin).alias("labels")
    )


# --- claims ------------------------------------------------------------------------------------------


def narrative_text(title: Column, summary: Column, focus: Column, callouts: Column) -> Column:
    """Title, summary and every bullet, one per line."""
    return F.concat_ws("\n", title, summary, focus, callouts)


def _matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?iU){CLAIM_PATTERNS[kind]}"), F.lit(1))


def _claims() -> Column:
    def tagged(kind: str) -> Column:
        def claim(value: Column, place: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), place.alias("place"), value.alias("claimed"))

        return F.transform(_matches(F.col("text"), kind), claim)

    return F.flatten(F.array(*[tagged(kind) for kind in CLAIM_PATTERNS]))


def extract_claims(texts: DataFrame) -> DataFrame:
    """``id, kind, place, claimed`` for every number claimed in ``id, text``."""
    return texts.select("id", F.inline(_claims()))


def outcome_speedup() -> str:
    """SQL text of the kept speedup of a record's optimisation, 1.0 when nothing was kept."""
    medians = (
        f"array(struct({array_median('optimization.baseline.durations')} AS b, "
        f"{array_median('optimization.final.durations')} AS f))"
    )
    kept = "optimization.applied AND optimization.baseline IS NOT NULL AND optimization.final IS NOT NULL"
    return f"if({kept}, transform({medians}, p -> if(p.f > 0, p.b / p.f, 1.0D))[0], 1.0D)"


def _entries(kind: str, *values: str) -> str:
    rows = ", ".join(f"struct('{kind}' AS kind, string({v}) AS value)" for v in values)
    return f"array({rows})"


def supported_facts(records: DataFrame) -> DataFrame:
    """``id, plain, ratios``: the (kind, value) of the whole numbers a record supports, and its speedups as doubles."""
    checks, run = "coalesce(validation.report.checks, array())", "validation.test_run"
    found = f"aggregate({checks}, 0, (n, c) -> n + greatest(coalesce(size(c.differences), 0), 0))"
    declared = "coalesce(size(flatten(transform(plan.steps, s -> s.semantic_differences))), 0)"
    counts = [f"validation.report.{side}.row_count" for side in ("reference", "candidate")]
    parts = {
        "true": [_entries(k, *[f"'{v}'" for v in values]) for k, values in ALWAYS_SUPPORTED.items()],
        "optimization IS NOT NULL": [_entries("attempts", "coalesce(size(optimization.attempts), 0)")],
        "validation IS NOT NULL": [
            _entries(
                "checks", f"size({checks})", f"size(filter({checks}, c -> c.passed))",
                f"size(filter({checks}, c -> NOT c.passed))",
            ),
            _entries("differences", found),
            _entries("rows", *counts, *[f"format_number({c}, 0)" for c in counts]),
        ],
        f"{run} IS NOT NULL": [
            _entries(
                "tests", f"{run}.passed", f"{run}.failed", f"{run}.errors",
                f"{run}.passed + {run}.failed + {run}.errors + {run}.skipped",
            ),
        ],
        "plan IS NOT NULL": [_entries("differences", declared)],
        "repair IS NOT NULL": [_entries("attempts", "coalesce(size(repair.attempts), 0)")],
    }
    nothing = f"filter({_entries('', 'NULL')}, e -> false)"
    present = [
        f"if({condition}, {text}, {nothing})" for condition, texts in parts.items() for text in texts
    ]
    plain = f"filter(concat({', '.join(present)}), e -> e.value IS NOT NULL) AS plain"
    ratios = (
        f"if(optimization IS NULL, array(), concat(array(CAST({outcome_speedup()} AS DOUBLE)),"
        " transform(coalesce(optimization.attempts, array()), a -> CAST(a.strategy.expected_speedup AS DOUBLE)))) AS ratios"
    )
    return records.selectExpr("migration_id AS id", plain, ratios)


def supported_lists(records: DataFrame) -> DataFrame:
    """``id, supported``: one row a record with an array of the (kind, value) it supports; two of its numbers may read
    the same."""
    rows = with_ratio_texts(supported_facts(records), "ratios", "quoted")
    quoted = "transform(quoted, v -> struct('speedup' AS kind, v AS value))"
    return rows.selectExpr("id", f"concat(plain, {quoted}) AS supported")


def supported_numbers(records: DataFrame) -> DataFrame:
    """``id, kind, value``: the supported numbers as rows."""
    # the outer form, as a record always supports something: for the plain one the optimizer adds a filter on the size
    # of the array and builds every array twice
    return supported_lists(records).select("id", F.inline_outer("supported"))


def violations(claims: DataFrame, supported: DataFrame) -> DataFrame:
    """Claims that the record does not support; thousands separators do not matter."""
    known = supported.select(
        F.col("id").alias("__id"), F.col("kind").alias("__kind"), F.replace("value", F.lit(","), F.lit("")).alias("__v")
    ).distinct()
    plain = F.replace("claimed", F.lit(","), F.lit(""))
    on = (F.col("id") == F.col("__id")) & (F.col("kind") == F.col("__kind")) & (plain == F.col("__v"))
    # both sides grow with the corpus, and estimates see neither rows that were exploded nor texts that were built
    return claims.join(known.hint("merge"), on, "left_anti")


def audit(texts: DataFrame, records: DataFrame) -> DataFrame:
    """``id, checked, violations, passed`` for every text, including those without a claim.

    A text meets its record once; claims and supported numbers stay arrays of the row they belong to. A speedup is
    printed only if some claim lies where one of its forms could: within a rounding of two digits, of one, or of six
    significant ones. The rest of the record's ratios cannot read like any claim.
    """
    # Both sides grow with the corpus, and nothing has measured them: no broadcast. The patterns run where the join has
    # dealt the texts out; a text is no larger than the claims found in it.
    met = texts.select("id", "text").join(supported_facts(records).hint("merge"), "id", "left")
    found = met.select("id", _claims().alias("claims"), "plain", "ratios")
    # the claimed ratios are computed once a row: a lambda over an array of one binds them
    said = "transform(filter(claims, c -> c.kind = 'speedup'), c -> CAST(c.claimed AS DOUBLE))"
    near = "exists(s, v -> abs(r - v) <= {})"
    forms = {"two": ("2", "0.00501D"), "one": ("1", "0.0501D"), "short": (SIX_SIGNIFICANT.format(x="r"), "r * 0.00001D")}
    each = ", ".join(
        f"if({near.format(reach)}, struct(r AS x, greatest(coalesce({n}, 0), 0) AS d, '{form}' AS form), NULL)"
        for form, (n, reach) in forms.items()
    )
    entries = (
        f"transform(array({said}), s -> filter(flatten(transform(filter(coalesce(ratios, array()), r -> r IS NOT NULL),"
        f" r -> array({each}))), e -> e IS NOT NULL))[0]"
    )
    printed = with_printed(found, entries, "quoted")
    plain = "replace({}, ',', '')"
    known = (
        f"concat(transform(coalesce(plain, array()), s -> struct(s.kind, {plain.format('s.value')} AS v)),"
        " transform(quoted, q -> struct('speedup' AS kind, q AS v)))"
    )
    broken = (
        f"transform(array({known}), k -> size(filter(claims, c -> NOT array_contains(k,"
        f" struct(c.kind, {plain.format('c.claimed')} AS v)))))[0]"
    )
    counted = printed.selectExpr("id", "CAST(size(claims) AS BIGINT) AS checked", f"CAST({broken} AS BIGINT) AS violations")
    return counted.withColumn("passed", F.col("violations") == 0)


def excerpts(broken: DataFrame, texts: DataFrame, length: int | None = None) -> DataFrame:
    """Add the first sentence that makes each violating claim, cut to ``length`` characters if given."""
    sentences = F.split("text", r"\n|(?<=\.)(?=\s|$)")

    def first(kind: str) -> Column:
        hits = F.filter(sentences, lambda s: F.array_contains(_matches(s, kind), F.col("claimed")))
        sentence = F.trim(F.get(hits, F.lit(0)))
        return sentence if length is None else F.substring(sentence, 1, length)

    chosen = reduce(
        lambda case, kind: case.when(F.col("kind") == kind, first(kind)),
        list(CLAIM_PATTERNS)[1:],
        F.when(F.col("kind") == list(CLAIM_PATTERNS)[0], first(list(CLAIM_PATTERNS)[0])),
    )
    # no broadcast, as in violations
    return broken.join(texts.hint("merge"), "id").withColumn("excerpt", chosen).drop("text")


# --- evidence -----------------------------------------------------------------------------------------


def evidence_rows(records: DataFrame, most_differences: int | None = None) -> DataFrame:
    """``id, section, ordinal, text``: the measured facts a reviewer reads, one per row; of the differences the first
    ``most_differences`` if given.

    Sections: checks, tests, differences, declared (differences the plan names and the check that covers each),
    repairs, performance (medians of the baseline and the final runs and the speedup that was kept),
    optimizations, provenance. A record's sections are one array, built and exploded in one pass over the records.
    """
    has_baseline, has_final = (f"optimization.{side} IS NOT NULL" for side in ("baseline", "final"))
    numbers = {
        "seconds": ("total_seconds", 1),
        "baseline": (f"if({has_baseline}, {array_median('optimization.baseline.durations')}, NULL)", 3),
        "final": (f"if({has_final}, {array_median('optimization.final.durations')}, NULL)", 3),
        "kept": (f"if(optimization.applied AND {has_baseline} AND {has_final}, {outcome_speedup()}, NULL)", 2),
    }
    entries = ", ".join(f"struct(CAST({x} AS DOUBLE) AS x, {d} AS d, '{n}' AS form)" for n, (x, d) in numbers.items())
    timed = with_fixed_entries(records.withColumn("total_seconds", total_duration()), f"array({entries})", "__printed")
    printed = {name: F.col("__printed")[i]["fixed"] for i, name in enumerate(numbers)}

    def listed(items: Column, text: Callable[[Column], Column]) -> Column:
        return F.transform(F.coalesce(items, F.array()), text)

    def present(*texts: Column) -> Column:
        return F.array_compact(F.array(*texts))

    checks = F.col("validation.report.checks")
    found = F.flatten(listed(checks, lambda c: F.coalesce(c["differences"], F.array())))
    found = found if most_differences is None else F.slice(found, 1, most_differences)
    run = F.col("validation.test_run")
    runs = [F.size(F.col(f"optimization.{side}.durations")).cast("string") for side in ("baseline", "final")]
    texts = {
        "checks": listed(checks, lambda c: F.concat_ws(
            " ", c["name"], F.when(F.coalesce(c["skipped"], F.lit(False)), "skipped").when(c["passed"], "pass").otherwise("fail"))),
        "tests": present(F.when(run.isNotNull(), F.concat_ws(
            " ", *[F.concat(F.lit(f"{n}="), run[n].cast("string")) for n in ("passed", "failed", "errors", "skipped")]))),
        "differences": listed(found, lambda d: F.concat(
            d["check"], F.when(d["column"].isNotNull(), F.concat(F.lit(" ["), d["column"], F.lit("]"))).otherwise(""),
            F.lit(": reference="), d["reference"], F.lit(" candidate="), d["candidate"])),
        "declared": listed(semantic_differences(), lambda d: F.concat(
            d["category"], F.lit(" covered by "), F.coalesce(d["validation_check"], F.lit("no check")))),
        "repairs": listed(F.col("repair.attempts"), lambda a: F.concat_ws(
            " ", F.concat_ws(":", a["strategy"]["category"], a["strategy"]["approach"]),
            F.when(~a["admitted"], "refused").otherwise(F.coalesce(a["validation_status"], F.lit("not run"))))),
        "performance": present(
            F.concat(F.lit("baseline="), printed["baseline"], F.lit(" runs="), runs[0]),
            F.concat(F.lit("final="), printed["final"], F.lit(" runs="), runs[1]),
            F.concat(F.lit("speedup="), printed["kept"])),
        "optimizations": listed(F.col("optimization.attempts"), lambda a: F.concat_ws(
            " ", a["strategy"]["approach"], F.when(~a["admitted"], "refused").when(a["accepted"], "accepted").otherwise("rejected"))),
        "provenance": present(
            F.concat(F.lit("source="), F.col("source_path")),
            F.concat(F.lit("risk="), record_risk()),
            F.concat(F.lit("stages="), F.coalesce(F.size("stages"), F.lit(0)).cast("string")),
            F.concat(F.lit("seconds="), printed["seconds"])),
    }

    def section(name: str, lines: Column) -> Column:
        def line(text: Column, place: Column) -> Column:
            return F.struct(F.lit(name).alias("section"), place.cast("int").alias("ordinal"), text.alias("text"))

        return F.transform(lines, line)

    every = F.concat(*[section(name, lines) for name, lines in texts.items()])
    return timed.select(F.col("migration_id").alias("id"), F.inline(every))
