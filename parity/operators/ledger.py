"""Which proposed repairs are worth running, and what came of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parity.operators.skew import broadcastable, largest_group
from parity.session import pinned

STRATEGY_REPEATED = "strategy_repeated"
CODE_UNCHANGED = "code_unchanged"
CODE_REPEATED = "code_repeated"

#: Pairs of a subject that one task folds without trouble.
FOLD_ROWS = 5_000_000
#: Rounds of distributed admission before the rest is folded whatever its size.
ROUNDS = 40

_PAIR = ["attempt", "signature", "fingerprint"]


def admit(attempts: DataFrame, fold_rows: int = FOLD_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``admitted`` and ``reason`` to ``subject, attempt, signature, fingerprint, baseline``.

    Refused, in this order: a signature already admitted for the subject, a fingerprint equal to the
    baseline's, a fingerprint already admitted. A refused attempt spends neither, so whether an
    attempt is admitted depends on all admissions before it.

    Only the first of equal (signature, fingerprint) pairs can be admitted, so the pairs are made distinct
    first. They are then folded in order: a task streams the sorted pairs of a subject and carries two
    sets, of the signatures and the fingerprints admitted so far. A subject of very many pairs is first worked
    down by rounds that need no order across tasks (see :func:`_settled_round`). Missing signatures equal
    each other, as missing fingerprints do.
    """
    candidates = attempts.filter(~F.col("fingerprint").eqNullSafe(F.col("baseline")))
    pairs = candidates.groupBy("subject", "signature", "fingerprint").agg(F.min("attempt").alias("attempt"))
    rest, won = pairs.select("subject", *_PAIR), []
    for _ in range(rounds):
        if largest_group(rest, ["subject"]) <= fold_rows:
            break
        now, rest = _settled_round(pinned(rest))
        won.append(now)
    winners = folded(rest)
    for now in won:
        winners = winners.unionByName(now)
    winners = winners.select(
        F.col("subject").alias("__s"), F.col("signature").alias("__sig"), F.col("attempt").alias("__at")
    )
    judged = attempts.join(
        winners,
        attempts["subject"].eqNullSafe(winners["__s"]) & attempts["signature"].eqNullSafe(winners["__sig"]),
        "left",
    )
    reason = (
        F.when(F.col("attempt") > F.col("__at"), STRATEGY_REPEATED)
        .when(F.col("fingerprint").eqNullSafe(F.col("baseline")), CODE_UNCHANGED)
        .when(F.col("attempt") == F.col("__at"), F.lit(None))
        .otherwise(CODE_REPEATED)
    )
    return (
        judged.withColumn("reason", reason)
        .withColumn("admitted", F.col("reason").isNull())
        .drop("__s", "__sig", "__at")
    )


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The admitted pairs of batches sorted by subject and order: subject, attempt, signature, fingerprint."""
    subject, started = None, False
    signatures: set = set()
    fingerprints: set = set()
    for batch in batches:
        admitted = []
        columns = (batch.column(c).to_pylist() for c in ("subject", "signature", "fingerprint"))
        for owner, signature, fingerprint in zip(*columns, strict=True):
            if not started or owner != subject:
                subject, started = owner, True
                signatures, fingerprints = set(), set()
            free = signature not in signatures and fingerprint not in fingerprints
            if free:
                signatures.add(signature)
                fingerprints.add(fingerprint)
            admitted.append(free)
        yield batch.filter(pa.array(admitted, pa.bool_()))


def folded(pairs: DataFrame) -> DataFrame:
    """The admitted pairs, subject by subject in the order of their attempts."""
    dealt = pairs.repartition("subject").sortWithinPartitions("subject", *_PAIR)
    return dealt.mapInArrow(fold, pairs.schema)


def _settled_round(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that are certainly admitted, pairs that are still open).

    A pair that is the first both of its signature and of its fingerprint is admitted whatever happens to the
    others; then every pair that shares one of the two is refused. What remains is the same question again. Both
    minima combine before their shuffle, so no subject, signature or fingerprint is ordered in one task.
    """
    first = F.min(F.struct(*_PAIR)).alias("first")
    of_signature = pairs.groupBy("subject", "signature").agg(first).select(F.struct("subject", "first").alias("p"))
    of_fingerprint = pairs.groupBy("subject", "fingerprint").agg(first).select(F.struct("subject", "first").alias("p"))
    # inside a struct missing values equal each other
    both = pinned(of_signature.join(of_fingerprint, "p").select("p.subject", *[f"p.first.{c}" for c in _PAIR]))
    rest = pairs
    for side in ("signature", "fingerprint"):
        spent = both.select(F.struct("subject", side).alias("spent"))
        spent = F.broadcast(spent) if broadcastable(spent) else spent
        rest = rest.withColumn("spent", F.struct("subject", side)).join(spent, "spent", "left_anti").drop("spent")
    return both, rest.select(*pairs.columns)


def best_attempt(attempts: DataFrame, subject: str = "migration_id") -> DataFrame:
    """The admitted attempt with fewest differences, the earliest of equals: ``attempt, differences``."""
    scored = attempts.filter(F.col("admitted") & F.col("differences").isNotNull())
    best = F.min(F.struct("differences", "attempt")).alias("b")
    return scored.groupBy(subject).agg(best).select(subject, "b.attempt", "b.differences")


def repair_outcomes(attempts: DataFrame, max_attempts: int, subject: str = "migration_id") -> DataFrame:
    """``attempts_used, succeeded, exhausted`` per subject; exhausted is a spent budget without success."""
    used, succeeded = F.count(F.lit(1)), F.bool_or(F.col("admitted") & F.col("succeeded"))
    return attempts.groupBy(subject).agg(
        used.alias("attempts_used"),
        succeeded.alias("succeeded"),
        (~succeeded & (used >= max_attempts)).alias("exhausted"),
    )
