"""Benchmark decontamination as a prefix-filtered set join (DataFrame functions only).

A benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words is one window). A window
is the set of its shingles of ``shingle`` words with their places. The join runs in these steps:

1. One scan of the corpus turns every document into the 64-bit hashes of its shingles and keeps those that some
   benchmark window has: the postings (document, place, shingle). The benchmark side of this join is broadcast only
   below a measured number of rows; beyond it the join is shuffled and left to adaptive execution.
2. Postings are counted by shingle, combined before the shuffle. That is the rarity order. The rarest shingle of a
   window is its necessary prefix: where it does not occur, the window does not.
3. Postings meet windows on the prefix shingle only. The place of the shingle gives the only possible start, which
   must lie inside the document (length and positional bounds).
4. A candidate is verified over the item-sized window: the shingles that start and end it must be found at exactly
   their places, so that all its words are covered. With the default sizes that is 128 bits of agreement.

Hit words are counted by sweeping the verified intervals of a document in order.

Defined results: null and empty texts have no words, no hits and no items. Null and empty benchmark texts have no
windows. Repeated rows each get their result, null ids included. An empty table on either side gives no hits.
Columns of the inputs other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parity.llm.keys import text_key

#: What separates words, after A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts without multi-byte characters take the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def n_words_of(text: Column) -> Column:
    """The number of words. Spark counts or extracts matches of a pattern ten times as slowly as it splits."""
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN_ANY_CASE)
    return F.size(F.array_remove(parts, "")).cast("bigint")


def _shingle_hashes(words: Column, size: int) -> Column:
    def one(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + j) for j in range(size)))

    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), one)).otherwise(
        F.array().cast("array<bigint>")
    )


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, gram (the words joined by spaces), n (their number): distinct windows of each item."""
    cut = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    placed = cut.select("item", "words", n.alias("n"), starts.alias("at"))
    return placed.select(
        "item", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("gram"), "n"
    ).distinct()


def window_shingles(grams: DataFrame, shingle: int) -> DataFrame:
    """gram, n, size, place, h: the shingles of each distinct window."""
    cut = grams.select("gram", "n", F.split("gram", " ").alias("words")).distinct()
    parts = [
        cut.where(F.col("n") == size if size < shingle else F.col("n") >= size).select(
            "gram", "n", F.lit(size).alias("size"), F.posexplode(_shingle_hashes(F.col("words"), size)).alias("place", "h")
        )
        for size in range(1, shingle + 1)
    ]
    return reduce(DataFrame.unionByName, parts)


def postings(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """id, key, n_words, at, size, h: where a shingle of ``wanted`` occurs."""
    rows = docs.select(
        F.col(doc_id).alias("id"), text_key(text).alias("key"), words_of(F.col(text)).alias("words")
    )
    side = F.broadcast(wanted) if small else wanted
    found = [
        rows.select(
            "id", "key", F.size("words").alias("n_words"), F.posexplode(_shingle_hashes(F.col("words"), size)).alias("at", "h")
        )
        .join(side.where(F.col("size") == size), "h")
        for size in sizes
    ]
    return reduce(DataFrame.unionByName, found)


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 10,
    shingle: int = 5,
    broadcast_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(verified windows: id, key, at, n, gram; the windows of each item: item, gram, n)."""
    # the first and the last shingle are verified, so together they must reach over the whole window
    shingle = max(min(shingle, window), -(-window // 2))
    grams = benchmark_windows(items, item_id, text, window)
    parts = window_shingles(grams, shingle).checkpoint()
    wanted = parts.select("h", "size").distinct()
    by_size = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    small = sum(by_size.values()) <= broadcast_rows
    posted = postings(docs, doc_id, text, wanted, sorted(by_size) or [shingle], small).distinct().checkpoint()

    rarity = posted.groupBy("h", "size").agg(F.count(F.lit(1)).alias("rarity"))
    order = Window.partitionBy("gram").orderBy("rarity", "place")
    missing = Window.partitionBy("gram")
    ranked = (
        parts.join(rarity, ["h", "size"], "left")
        .withColumn("absent", F.max(F.col("rarity").isNull()).over(missing))
        .where(~F.col("absent"))
        .withColumn("turn", F.row_number().over(order))
    )
    prefix = ranked.where(F.col("turn") == 1).select("gram", "n", "size", F.col("place").alias("offset"), "h")
    ends = parts.groupBy("gram").agg(F.min_by("h", "place").alias("first"), F.max_by("h", "place").alias("last"))
    prefix = prefix.join(ends, "gram")

    start = F.col("at") - F.col("offset")
    candidates = (
        posted.join(F.broadcast(prefix) if small else prefix, ["h", "size"])
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .select("id", "key", start.alias("at"), "n", "size", "gram", "first", "last")
    )
    at_start = posted.select("id", "key", F.col("at"), "size", F.col("h").alias("first"))
    at_end = posted.select("id", "key", F.col("at").alias("end"), "size", F.col("h").alias("last"))
    verified = _semi(candidates, at_start, ["key", "at", "size", "first"])
    verified = _semi(
        verified.withColumn("end", F.col("at") + F.col("n") - F.col("size")), at_end, ["key", "end", "size", "last"]
    )
    return verified.select("id", "key", "at", "n", "gram"), grams


def _semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on))
    return a.join(b, same & F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, key, n_hit, n_items, items (sorted as strings) of every document with a hit; id and key name the row."""
    found, grams = occurrences(docs, items, doc_id, text=text, **options)
    found = found.checkpoint()
    order = Window.partitionBy("id", "key").orderBy("at", "end")
    spans = found.select("id", "key", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("reached", F.coalesce(reached, F.lit(0)))
    n_hit = F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("at", "reached"))).alias("n_hit")
    hits = fresh.groupBy("id", "key").agg(n_hit)
    pairs = found.select("id", "key", "gram").distinct().join(grams.select("gram", "item"), "gram")
    of = pairs.select("id", "key", F.col("item").cast("string").alias("item")).distinct()
    named = of.groupBy("id", "key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items")
    )
    a, b = hits.alias("a"), named.alias("b")
    joined = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key")), "left")
    return joined.select("a.id", "a.key", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), "items")


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items, contaminated."""
    found = contamination(docs, items, doc_id, text, **options).alias("b")
    n_words = n_words_of(F.col(text)).alias("n_words")
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), n_words).alias("a")
    joined = rows.join(found, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        F.col("a.id").alias(doc_id), "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = contamination(docs, items, doc_id, text, **options).select(
        F.col("id").alias("_hit_id"), F.col("key").alias("_hit_key")
    )
    same = docs[doc_id].eqNullSafe(found["_hit_id"]) & (text_key(text) == found["_hit_key"])
    return docs.join(found, same, "left_anti")
