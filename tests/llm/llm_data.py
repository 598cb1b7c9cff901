"""Small frames with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
from collections import Counter

#: Extra columns whose names the operators use inside.
CLASHING = ("id", "key", "node", "bucket", "found", "n", "words", "h", "at", "prefix", "gram", "root", "_p", "_turn",
            "_said", "n_words", "failed_bits", "host", "page", "probability", "kept", "size")


def prose(rng, n, stock=None):
    stock = stock or [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "r", "st", "")]
    return " ".join(rng.choice(stock) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): nulls, empty and blank texts, repeated rows, one id with two texts, a very long text."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
        (7, "one two"), (None, base), (None, "another text without an id"), (8, prose(rng, 30000)),
        (9, "a " * 500), (10, "é ü ñ " * 60 + base), (11, prose(rng, 80)), (11, prose(rng, 80)), (12, "x"),
    ]
    return rows


def frame(spark, rows, clashing=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", *(f"'z' AS `{c}`" for c in CLASHING)) if clashing else df


def counted(rows):
    """Rows as a multiset, with values that compare."""
    return Counter(tuple(r) for r in rows)


def windows_removed(rows, width, cut, glue):
    """For each row (n, removed, spans, sha256 of what is left): windows that start anywhere else go."""
    units = [cut(t or "") for _, t in rows]
    seen = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = glue([x for x, g in zip(u, gone, strict=True) if not g])
        out.append((len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard_classes(rows):
    """(class id, links, class size) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        members = [j for j in range(len(rows)) if find(j) == find(i)]
        ids = [rows[j][0] for j in members if rows[j][0] is not None]
        out.append((min(ids) if ids else rows[i][0], links[i], len(members)))
    return out
