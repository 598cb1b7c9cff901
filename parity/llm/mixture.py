"""Mixing sources to target weights by iterative proportional fitting, and sampling by calibrated probabilities.

Documents are counted into cells (source, language, topic) of tokens, combined before the shuffle. The cell weights are
then raked: in every round each dimension's sums are scaled to their targets, by a window over the cells (which are few
compared with documents). Rounds stop when every marginal is within ``tolerance`` of its target, or after ``rounds``.
The ratio of the raked weight to the tokens of a cell, times one factor, is the probability to keep each of its
documents; the factor is such that the expected tokens are the budget, with probabilities of at most one. A document
stays when a hash of its id and text falls under its probability, so the choice is the same however often it is made.

Targets: shares for each dimension, by value. A value without a target keeps its own share; ``tempered`` targets are the
shares raised to a power, which evens out large and small sources. Targets are scaled to a sum of one.

Defined results: null values of a dimension are one value of their own. Null and empty texts have no tokens and get
the probability of their cell; rows of a cell without any token stay out. An empty table gives no rows. Repeated rows share their fate. Extra columns are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parity.llm.keys import spare, text_key

DIMENSIONS = ("source", "lang", "topic")
#: Stands for null in a dimension.
NULL = "\u0000"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """What a text is about, by rule: licence text, contact data, marked-up lists, or prose by its length."""
    t = F.coalesce(text, F.lit(""))

    def has(*words: str) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(t, F.lit(w))
        return found

    return (
        F.when(has("License", "Licensed", "Copyright"), "licence")
        .when(has("@", "+1 ("), "contact")
        .when(has("%%%", "&&&", "***"), "markup")
        .when(F.length(t) < 1000, "short")
        .when(F.length(t) < 10000, "prose")
        .otherwise("long")
    )


def features(docs: DataFrame, doc_id: str, text: str, source: str, lang: str) -> DataFrame:
    """id, key, source, lang, topic, n_tokens of every row."""
    return docs.select(
        F.col(doc_id).alias("id"), text_key(text).alias("key"),
        F.coalesce(F.col(source).cast("string"), F.lit(NULL)).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit(NULL)).alias("lang"),
        topic_of(F.col(text)).alias("topic"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"),
    )


def cells_of(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    return sums.where("tokens > 0")


def with_targets(cells: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float]) -> DataFrame:
    """Adds ``target_<dimension>``, the wanted share of the cell's value."""
    spark, out = cells.sparkSession, cells
    for dim in DIMENSIONS:
        sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("own"))
        everything = Window.partitionBy()
        share = sums.withColumn("own", F.col("own") / F.sum("own").over(everything))
        given = targets.get(dim)
        if given:
            asked = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dim} string, asked double")
            share = share.join(asked, dim, "left").withColumn("own", F.coalesce("asked", "own"))
        else:
            share = share.withColumn("own", F.pow("own", F.lit(powers.get(dim, 1.0))))
        wanted = share.select(dim, (F.col("own") / F.sum("own").over(everything)).alias(f"target_{dim}"))
        out = out.join(wanted, dim)
    return out


def rake(cells: DataFrame, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """Adds ``weight``: shares of tokens that meet the marginal targets, as near to the given ones as can be."""
    total = F.sum("tokens").over(Window.partitionBy())
    out = cells.withColumn("weight", F.col("tokens") / total).checkpoint()
    for _ in range(rounds):
        for dim in DIMENSIONS:
            own = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.col("weight") * F.col(f"target_{dim}") / F.when(own > 0, own))
        out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).checkpoint()
        if deviation(out) <= tolerance:
            break
    return out


def deviation(cells: DataFrame) -> float:
    """The largest distance of a marginal share from its target."""
    worst = 0.0
    for dim in DIMENSIONS[:-1]:  # the last one was just met
        sums = cells.groupBy(dim).agg(F.sum("weight").alias("w"), F.first(f"target_{dim}").alias("t"))
        worst = max(worst, sums.agg(F.max(F.abs(F.col("w") - F.col("t"))).alias("d")).first()["d"] or 0.0)
    return worst


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """Adds ``ratio`` and ``probability``; the expected tokens are the share ``budget`` of all, or as near as full
    probabilities allow."""
    out = cells.withColumn("ratio", F.col("weight") * F.sum("tokens").over(Window.partitionBy()) / F.col("tokens"))
    out = out.checkpoint()
    factor, full = budget, -1
    while True:
        top = F.col("ratio") * factor >= 1
        row = out.agg(
            F.sum("tokens").alias("all"), F.count(F.when(top, 1)).alias("full"),
            F.sum(F.when(top, F.col("tokens")).otherwise(0)).alias("sure"),
            F.sum(F.when(top, 0.0).otherwise(F.col("tokens") * F.col("ratio"))).alias("open"),
        ).first()
        if not row["all"] or row["full"] <= full or not row["open"]:
            break
        full, factor = row["full"], max(factor, (budget * row["all"] - row["sure"]) / row["open"])
    return out.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("ratio") * factor), 9))


def chance(doc_id: Column, key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the row and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def probabilities(
    rows: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    powers: dict[str, float] | None = None,
    budget: float = 0.5,
    rounds: int = 50,
    tolerance: float = 1e-6,
) -> DataFrame:
    """The cells of ``features`` with their weight, ratio and probability."""
    cells = with_targets(cells_of(rows), targets or {}, powers or {"source": 0.7, "lang": 0.7})
    return calibrated(rake(cells, rounds, tolerance), budget).checkpoint()


def report(docs: DataFrame, doc_id="doc_id", text="text", source="source", lang="lang", seed: int = 17, **options) -> DataFrame:
    """id, key, n_tokens, topic, ratio, probability, sampled of every row."""
    rows = features(docs, doc_id, text, source, lang).checkpoint()
    cells = probabilities(rows, **options).select(*DIMENSIONS, "ratio", "probability")
    few = cells.count() <= BROADCAST_CELLS
    joined = rows.join(F.broadcast(cells) if few else cells, list(DIMENSIONS), "left")
    p = F.coalesce("probability", F.lit(0.0))
    return joined.select(
        "id", "key", "n_tokens", "topic", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), p.alias("probability"),
        (chance(F.col("id"), F.col("key"), seed) < p).alias("sampled"),
    )


#: Cells are broadcast up to this measured number.
BROADCAST_CELLS = 200_000


def mixed(docs: DataFrame, doc_id="doc_id", text="text", source="source", lang="lang", seed: int = 17, **options) -> DataFrame:
    """The sampled documents with all their columns."""
    rows = features(docs, doc_id, text, source, lang)
    cells = probabilities(rows, **options)
    names = {dim: spare(docs.columns, f"_{dim}") for dim in DIMENSIONS}
    p = spare(docs.columns, "_p")
    wanted = cells.select(*(F.col(k).alias(v) for k, v in names.items()), F.col("probability").alias(p))
    marked = docs.withColumns({
        names["source"]: F.coalesce(F.col(source).cast("string"), F.lit(NULL)),
        names["lang"]: F.coalesce(F.col(lang).cast("string"), F.lit(NULL)),
        names["topic"]: topic_of(F.col(text)),
    })
    few = cells.count() <= BROADCAST_CELLS
    if few:
        joined = marked.join(F.broadcast(wanted), list(names.values()))
        return joined.where(chance(F.col(doc_id), text_key(text), seed) < F.col(p)).select(*(F.col(f"`{c}`") for c in docs.columns))
    # too many cells to send around: the texts are not shuffled by cell, where one may hold a third of all rows
    ids = rows.join(cells.select(*DIMENSIONS, "probability"), list(DIMENSIONS))
    ids = ids.where(chance(F.col("id"), F.col("key"), seed) < F.col("probability")).select("id", "key").alias("s")
    d = docs.alias("d")
    return d.join(ids, F.col(f"d.{doc_id}").eqNullSafe(F.col("s.id")) & (text_key(text) == F.col("s.key")), "left_semi")
