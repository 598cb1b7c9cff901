"""Personal data by a semi-Markov conditional random field over candidate spans.

Base spans come from four fixed patterns. A model then looks at the regions where personal data can be at all: runs
of the characters of numbers and telephone notation with a digit or plus sign, and runs of the characters of
addresses around an at sign. A region is cut into tokens; every span of at most ``SPAN`` tokens that has the shape of
a kind is a candidate segment, scored by features of the whole span (digits, check digit, parts, neighbours). The
best segmentation of the region, boundaries and kinds together, is found by dynamic programming over segments of
bounded length, so the work is linear in the length of the text. Tokens outside of entities score zero.

The model learns from base spans: regions of a bounded, hash-chosen sample of documents (``sample`` documents and
``most`` regions, documented bounds of a model with a fixed number of weights), by gradient descent on the
conditional likelihood with the forward-backward recursion. Regions in which a pattern matched but failed its test
are left out, since their truth is unknown: two card numbers side by side, or a telephone number before an address,
are what the model adds.

Defined results: a null or empty text has no spans. Base spans always stay; a span of the model is added where it
overlaps no base span. Places count code points. Repeated rows and extra columns change nothing. Without examples
(an empty table) the model adds nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMERIC_REGION = re.compile(r"[0-9+][0-9+().\x20-]*")
AFTER_AT = re.compile(r"[A-Za-z0-9._%+@-]*")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
#: Tokens of a candidate span at most, and characters of a region that is learned from.
SPAN, LEARNED = 32, 400

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 13 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(digits_of(s)) <= 15


def find_emails(text: str) -> list[tuple[int, int]]:
    """What the address pattern finds, leftmost and without overlap, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def regions_of(text: str) -> list[tuple[int, int]]:
    """Runs in which there can be personal data, overlapping ones joined."""
    runs = [m.span() for m in NUMERIC_REGION.finditer(text)]
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and (text[start - 1] in LOCAL or text[start - 1] == "@"):
            start -= 1
        end = AFTER_AT.match(text, at).end()
        runs.append((start, end))
        at = text.find("@", end)
    runs.sort()
    out: list[tuple[int, int]] = []
    for start, end in runs:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans that hold, matches that failed their test), ordered by kind and start."""
    good: list[Span] = [(0, a, b) for a, b in find_emails(text)]
    bad: list[Span] = []
    for region in NUMERIC_REGION.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for kind, pattern, test in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
            for m in pattern.finditer(text, a, b):
                (good if test(m[0]) else bad).append((kind, *m.span()))
    return sorted(good), bad


# ---- the model


def span_features(kind: int, s: str, before: str, after: str) -> tuple[tuple[str, float], ...] | None:
    """Features of a whole span as one kind, or None where it cannot be one."""
    name = KINDS[kind]
    d = digits_of(s)
    out = ["is"]
    if kind == 0:
        if not EMAIL.fullmatch(s):
            return None
        tail = s.rpartition(".")[2]
        out += [f"tail{min(len(tail), 8)}", f"labels{min(s.count('.'), 4)}", f"alphatail{tail.isalpha()}"]
        inner = (before in LOCAL) or (after in LOCAL and after != ".")
    elif kind == 1:
        if not IP.fullmatch(s):
            return None
        out += [f"bytes{is_ip(s)}", f"led0{any(len(p) > 1 and p[0] == '0' for p in s.split('.'))}"]
        inner = before.isdigit() or after.isdigit() or before == "."
    elif kind == 2:
        if len(d) < 12 or len(d) > 20 or not CARD.fullmatch(s):
            return None
        out += [f"luhn{luhn(d)}", f"n{len(d)}", f"range{13 <= len(d) <= 19}", f"luhn{luhn(d)}n{len(d)}",
                f"parts{min(len(re.split('[ -]', s)), 6)}"]
        inner = before.isdigit() or after.isdigit()
    else:
        if s[0] != "+" or len(d) < 7 or len(d) > 17 or not PHONE.fullmatch(s):
            return None
        groups = re.findall("[0-9]+", s)
        out += [f"n{len(d)}", f"range{9 <= len(d) <= 15}", f"groups{min(len(groups), 7)}",
                f"last{min(len(groups[-1]), 6)}", f"open{s.count('(') == s.count(')')}",
                f"dots{min(s.count('.'), 3)}", "shape" + re.sub("[0-9]+", lambda m: str(min(len(m[0]), 9)), s)]
        inner = before.isdigit() or after.isdigit()
    out.append(f"inner{inner}")
    return tuple((f"{name}:{f}", 1.0) for f in out)


def lattice(region: str, before: str, after: str) -> tuple[list[int], list[list[tuple[int, int, tuple]]]]:
    """(token bounds, for each token the candidate segments that end with it: first token, kind, features)."""
    bounds = [m.start() for m in TOKEN.finditer(region)] + [len(region)]
    n = len(bounds) - 1
    ending: list[list[tuple[int, int, tuple]]] = [[] for _ in range(n + 1)]
    has_at = "@" in region
    for i in range(n):
        c = region[bounds[i]]
        if not (c.isascii() and (c.isalnum() or c in "+._%-")):
            continue
        kinds = ([0] if has_at else []) + ([1, 2] if c.isdigit() else [3] if c == "+" else [])
        if not kinds:
            continue
        for j in range(i + 1, min(n, i + SPAN) + 1):
            s = region[bounds[i] : bounds[j]]
            if not s[-1].isalnum() and s[-1] != "-":
                continue
            left = region[bounds[i] - 1] if bounds[i] else before
            right = region[bounds[j]] if bounds[j] < len(region) else after
            for kind in kinds:
                found = span_features(kind, s, left, right)
                if found is not None:
                    ending[j].append((i, kind, found))
    return bounds, ending


def _score(weights: dict[str, float], found: tuple) -> float:
    return sum(weights.get(f, 0.0) * x for f, x in found)


def decode(region: str, before: str, after: str, weights: dict[str, float]) -> list[Span]:
    """The best segmentation's entities, with places inside the region."""
    bounds, ending = lattice(region, before, after)
    if not any(ending):
        return []
    best, back = [0.0], [None]
    for j in range(1, len(bounds)):
        top, step = best[j - 1], None
        for i, kind, found in ending[j]:
            s = best[i] + _score(weights, found)
            if s > top:
                top, step = s, (i, kind)
        best.append(top)
        back.append(step)
    out, j = [], len(bounds) - 1
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, bounds[i], bounds[j]))
            j = i
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def expected(ending: list, weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """(log of the sum over segmentations, expected features) by the forward and backward recursions."""
    n = len(ending) - 1
    scores = [[_score(weights, f) for _, _, f in e] for e in ending]
    ahead = [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for (i, _, _), s in zip(ending[j], scores[j], strict=True):
            ahead[j] = _log_add(ahead[j], ahead[i] + s)
    behind = [-math.inf] * (n + 1)
    behind[n] = 0.0
    total: dict[str, float] = {}
    for j in range(n, 0, -1):
        behind[j - 1] = behind[j] if behind[j - 1] == -math.inf else _log_add(behind[j - 1], behind[j])
        for (i, _, found), s in zip(ending[j], scores[j], strict=True):
            behind[i] = behind[j] + s if behind[i] == -math.inf else _log_add(behind[i], behind[j] + s)
            p = math.exp(ahead[i] + s + behind[j] - ahead[n])
            for f, x in found:
                total[f] = total.get(f, 0.0) + p * x
    return ahead[n], total


def learn(examples: list[tuple[str, str, str, list[Span]]], rounds: int = 12, rate: float = 0.5) -> dict[str, float]:
    """Weights from (region, character before, character after, true spans) by stochastic gradient ascent."""
    weights: dict[str, float] = {}
    built = []
    for region, before, after, truth in examples:
        bounds, ending = lattice(region, before, after)
        place = {b: k for k, b in enumerate(bounds)}
        gold: dict[str, float] = {}
        for kind, a, b in truth:
            for i, k, found in ending[place[b]] if b in place else []:
                if k == kind and bounds[i] == a:
                    for f, x in found:
                        gold[f] = gold.get(f, 0.0) + x
        if any(ending):
            built.append((ending, gold))
    for r in range(rounds):
        step = rate / (1 + r)
        for ending, gold in built:
            _, mean = expected(ending, weights)
            for f in {*gold, *mean}:
                move = gold.get(f, 0.0) - mean.get(f, 0.0)
                weights[f] = weights.get(f, 0.0) + step * (move - 1e-4 * weights.get(f, 0.0))
    return weights


def examples_of(text: str | None) -> Iterator[tuple[str, str, str, list[Span]]]:
    """Regions whose truth the base patterns settle."""
    if not text:
        return
    good, bad = base_spans(text)
    for a, b in regions_of(text):
        if b - a > LEARNED:
            continue
        inside = [s for s in good if a <= s[1] and s[2] <= b]
        spans = sorted(inside, key=lambda s: s[1])
        if any(x[2] > y[1] for x, y in zip(spans, spans[1:], strict=False)):
            continue
        long = [s for s in bad if a <= s[1] and s[2] <= b and len(digits_of(text[s[1] : s[2]])) > 16]
        if not long:
            yield text[a:b], text[a - 1] if a else "", text[b : b + 1], [(k, x - a, y - a) for k, x, y in inside]


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and those the model adds), each by kind and start."""
    good, _ = base_spans(text)
    if not weights:
        return good, good
    added = []
    for a, b in regions_of(text):
        if b - a < 5:
            continue
        for kind, x, y in decode(text[a:b], text[a - 1] if a else "", text[b : b + 1], weights):
            if not any(x + a < s[2] and s[1] < y + a for s in good):
                added.append((kind, x + a, y + a))
    return good, sorted([*good, *added])


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


RESULT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 6000, most: int = 4000
) -> dict[str, float]:
    """Weights learned from at most about ``sample`` documents and ``most`` of their regions."""
    n = docs.count()
    whole = 1 << 31
    part = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(
        F.pmod(F.xxhash64("id"), F.lit(whole)) < int(whole * min(1.0, sample / max(n, 1)))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, x, y, rendered(s)) for t in batch["text"] for r, x, y, s in examples_of(t)]
            yield pd.DataFrame(rows, columns=["region", "before", "after", "spans"])

    found = part.mapInPandas(cut, "region string, before string, after string, spans string")
    rows = found.orderBy(F.xxhash64("region"), "region", "before", "after", "spans").limit(most)
    out = []
    for r in rows.toLocalIterator():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        out.append((r["region"], r["before"], r["after"], [(KINDS.index(k), int(a), int(b)) for k, a, b in spans]))
    return learn(out)


def detector(docs: DataFrame, weights: dict[str, float]):
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            good, every = all_spans(text, shared.value) if text else ([], [])
            out.append((*(sum(s[0] == k for s in good) for k in range(4)), rendered(good), rendered(every)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, base counts, base and all spans (``kind:start:end``, by kind and start) of every row."""
    run = detector(docs, train(docs, doc_id, text, **options))
    return docs.select(F.col(doc_id).alias(doc_id), run(F.col(text)).alias("found")).select(doc_id, "found.*")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, found, strict=True):
            if not t or not s:
                out.append(t)
                continue
            cuts = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(",")))
            parts, at = [], 0
            for a, b, k in cuts:
                if a >= at:
                    parts += [t[at:a], f"[{k}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return run(text, spans)
