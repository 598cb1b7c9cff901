"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled document that is not held out. Spark sums the counts, which become a
matrix of log probabilities, ``buckets`` x languages float32, which is what is broadcast: its size follows from these
two numbers and not from the corpus. Scoring reads every whole text once, in slices of a bounded number of characters:
hashed n-grams index the matrix and their rows are summed by document. Only a caller who gives ``per_language`` gets a
hash-chosen sample of about so many documents of each language instead of all.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text when nothing was
learned (an empty table, no labels). Ties go to the language first in order. Training skips rows whose id, text or
language is null. Only the text enters a prediction. Repeated rows and extra columns change nothing.

The score compares the learned languages with each other and says nothing of other languages and noise. ``accepted``
therefore also holds the mean log probability of a text's n-grams, in lower case and without marks and digits, against
the range of labelled texts of the same language: exact ranks over all of them, of all folds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.operators.quantiles import order_statistics
from parity.session import pinned

UNKNOWN = "und"
#: Characters handled at a time; bounds the memory of a slice whatever the length of a text.
SLICE = 1 << 18
#: A text is out of range further below the median than so many times the distance of the lowest hundredth, at least ROOM.
RANGE, ROOM = 3.0, 1.0
#: Means of few n-grams vary: so much more room, over the square root of their number.
FEW = 8.0


def _rank(share: float):
    """The least value that ``share`` of the values, or more, do not exceed."""

    def at(n: Column) -> Column:
        return F.greatest(F.ceil(n * share), F.lit(1)) - 1

    return share, at, at


RANKS = {"middle": _rank(0.5), "low": _rank(0.01)}
_NO_LETTERS = re.compile(r"[\W\d_]+")
_ASCII_LETTER = re.compile("[A-Za-z]")

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: (buckets + 1) x languages; the last row is zero, for n-grams that span two texts.
    weights: np.ndarray
    prior: np.ndarray


def has_letter(text: str | None) -> bool:
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_buckets(c: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """For each place the bucket of the one-, two- and three-character gram that starts there; texts are separated
    by code 0, and grams that touch it (or the end) get the bucket ``buckets``."""
    shift = np.uint32(32 - (buckets - 1).bit_length())
    one = (c + np.uint32(0x51ED)) * np.uint32(0x9E3779B1)
    void = c == 0
    two, void2 = np.zeros_like(one), np.ones_like(void)
    two[:-1] = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    void2[:-1] = void[:-1] | void[1:]
    three, void3 = np.zeros_like(one), np.ones_like(void)
    three[:-1] = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + two[1:]
    void3[:-1] = void2[:-1] | void2[1:]
    out = []
    for h, gone in ((one, void), (two, void2), (three, void3)):
        h = ((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> shift
        h = h.astype(np.int32)
        h[gone] = buckets
        out.append(h)
    return tuple(out)


def _slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, first place of each piece, text of each piece); a long text comes in overlapping pieces."""
    pieces, of, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), SLICE):
            # the next slice starts the grams that start there; two more characters complete those that start here
            piece = text[at : at + SLICE + 2]
            pieces.append((piece, min(SLICE, len(text) - at)))
            of.append(i)
            size += len(piece) + 1
            if size >= SLICE:
                yield _joined(pieces, of)
                pieces, of, size = [], [], 0
    if pieces:
        yield _joined(pieces, of)


def _joined(pieces: list[tuple[str, int]], of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = codes("\0".join(p for p, _ in pieces) + "\0").astype(np.uint32)
    lengths = np.array([len(p) + 1 for p, _ in pieces])
    return c, np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array(of)



def log_likelihoods(texts: list[str], model: Model) -> np.ndarray:
    """One row of summed log probabilities for each text."""
    buckets = len(model.weights) - 1
    out = np.zeros((len(texts), len(model.languages)))
    for c, starts, of in _slices(texts):
        ones, twos, threes = gram_buckets(c, buckets)
        _drop_overlap(starts, len(c), (ones, twos, threes), buckets)
        for h in (ones, twos, threes):
            np.add.at(out, of, np.add.reduceat(model.weights[h], starts, axis=0).astype(np.float64))
    return out + model.prior


def _drop_overlap(starts: np.ndarray, total: int, grams: tuple[np.ndarray, ...], buckets: int) -> None:
    """Grams that start in the two overlap characters of a full piece belong to the next piece."""
    ends = np.append(starts[1:], total) - 1
    for i in np.flatnonzero(ends - starts > SLICE):
        for h in grams:
            h[starts[i] + SLICE : ends[i]] = buckets


def gram_counts(texts: list[str], buckets: int) -> np.ndarray:
    total = np.zeros(buckets + 1, dtype=np.int64)
    for c, starts, _ in _slices(texts):
        grams = gram_buckets(c, buckets)
        _drop_overlap(starts, len(c), grams, buckets)
        for h in grams:
            total += np.bincount(h, minlength=buckets + 1)
    return total[:buckets]


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(labelled: DataFrame, per_language: int | None) -> DataFrame:
    """Columns lang and text of all rows or, if a number is given, of about so many of each language by a hash of the id."""
    if per_language is None:
        return labelled.select("lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    whole = F.lit(1 << 31)
    return (
        labelled.join(F.broadcast(sizes), "lang")
        .where(F.pmod(F.xxhash64("id"), whole) < whole * F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")))
        .select("lang", "text")
    )


def labelled_rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    rows = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    buckets: int = 1 << 16,
    per_language: int | None = None,
    smoothing: float = 0.5,
    held_out: Column | None = None,
) -> Model:
    """Learn from every labelled document that is not held out (of about ``per_language`` of each language, if given)."""
    held_out = fold(F.col(doc_id)) == 1 if held_out is None else held_out
    chosen = sample(labelled_rows(docs.where(~held_out), doc_id, text, lang), per_language)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for name, part in batch.groupby("lang")["text"]:
                sums[name] = sums.get(name, 0) + gram_counts(list(part), buckets)
                texts[name] = texts.get(name, 0) + len(part)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": n[at]})
            yield pd.DataFrame({"lang": [name], "bucket": [-1], "n": [texts[name]]})

    counts = chosen.mapInPandas(counted, "lang string, bucket bigint, n bigint")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most (buckets + 1) rows for each language
    table: dict[str, np.ndarray] = {}
    for row in rows.toLocalIterator():
        table.setdefault(row["lang"], np.zeros(buckets + 1))[row["bucket"]] += row["n"]
    languages = tuple(sorted(table))
    if not languages:
        return Model((), np.zeros((buckets + 1, 0), np.float32), np.zeros(0))
    n = np.stack([table[x] for x in languages], axis=1)
    texts, n = n[-1], n[:-1]
    weights = np.zeros((buckets + 1, len(languages)), np.float32)
    weights[:-1] = np.log((n + smoothing) / (n.sum(0) + smoothing * buckets))
    return Model(languages, weights, np.log(texts / texts.sum()))


def predict(texts: pd.Series, model: Model) -> pd.DataFrame:
    names = np.full(len(texts), UNKNOWN, dtype=object)
    score = np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    if known and model.languages:
        like = log_likelihoods([texts.iloc[i] for i in known], model)
        best = like.argmax(axis=1)
        names[known] = np.array(model.languages, dtype=object)[best]
        score[known] = 1.0 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
    return pd.DataFrame({"lang_pred": names, "score": score})


def predictor(docs: DataFrame, model: Model):
    """A function of a text column giving the struct (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(texts, shared.value)

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """id, held_out, lang_pred, score for every row; trained on the rows that are not held out."""
    run = predictor(docs, train(docs, doc_id, text, lang, **options))
    held_out = F.coalesce(fold(F.col(doc_id)) == 1, F.lit(False))
    rows = docs.select(F.col(doc_id).alias(doc_id), held_out.alias("held_out"), run(F.col(text)).alias("said"))
    return rows.select(doc_id, "held_out", "said.lang_pred", "said.score")


def means(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its best language (a number), the mean log probability of its n-grams there, and their number."""
    bare = [_NO_LETTERS.sub(" ", t.lower()) for t in texts]
    like = log_likelihoods(bare, model) - model.prior
    n = np.array([max(3 * len(t) - 3, 1) for t in bare])
    return like.argmax(axis=1), like.max(axis=1) / n, n


def floors(
    docs: DataFrame, model: Model, doc_id: str, text: str, lang: str, per_language: int | None = None
) -> np.ndarray:
    """The least mean log probability of each language of the model; of the lowest one where no text had it as its best."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t for t in batch["text"] if has_letter(t)]
            if texts:
                best, mean, _ = means(texts, shared.value)
                yield pd.DataFrame({"best": best, "mean": mean})

    seen = sample(labelled_rows(docs, doc_id, text, lang), per_language).mapInPandas(measured, "best bigint, mean double")
    # two numbers a text, read several times: not to be measured again
    ranges = order_statistics(pinned(seen), ["best"], "mean", RANKS)
    out = np.full(len(model.languages), np.nan)
    for row in ranges.toLocalIterator():  # a row a language
        middle, low = row["middle"], row["low"]
        out[row["best"]] = middle - max(RANGE * (middle - low), ROOM)
    return np.where(np.isnan(out), np.nanmin(out), out) if not np.isnan(out).all() else np.full(len(out), -np.inf)


def accepted(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", least: float = 0.5, **options) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more and whose text is in the range of that
    language, with all their columns."""
    model = train(docs, doc_id, text, lang, **options)
    bounded = {k: v for k, v in options.items() if k == "per_language"}
    lows = floors(docs, model, doc_id, text, lang, **bounded) if model.languages else np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast((model, lows))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, lows = shared.value
        for texts in batches:
            said = predict(texts, model)
            kept = ((said["lang_pred"] != UNKNOWN) & (said["score"] >= least)).to_numpy()
            at = np.flatnonzero(kept)
            if len(at):
                best, mean, n = means([texts.iloc[i] for i in at], model)
                kept[at] = mean >= lows[best] - FEW / np.sqrt(n)
            yield pd.Series(kept)

    return docs.where(known(F.col(text)))
