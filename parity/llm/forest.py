"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

1. One scan turns every text into its set of hashed word shingles. Texts with one and the same set (exact copies among
   them) become one node, so a group of copies of any size is one node with a count, combined before the shuffle.
2. A node gets ``trees`` signatures of ``deepest`` MinHash values. A tree is the sorted trie of its signatures; nodes
   that agree on a prefix are neighbours in it. Matched prefixes are shortened from the deepest until a pair at the
   threshold is a neighbour in some tree with a probability of ``recall`` at least (``depth_for``). The default leaves
   out fewer than one pair in ten million.
3. Neighbours in a prefix are compared by all their MinHash values, in blocks of bounded size; the neighbours that are
   similar enough to be worth a look are joined into components. Only a spanning forest of each block leaves the task.
4. The members of a component are brought together once, with their whole shingle sets, again in pairs of blocks: a
   block's intersections are counted exactly by matrix products. Out come the links of each node (weighted by copies)
   and a spanning forest of the verified links. Pairs are never rows.
5. Components of the verified links are the classes.

A prefix or component of any size is split into blocks of ``BLOCK`` nodes and dealt out as pairs of blocks, so no task
holds more than two blocks at a time. Every link between different texts is tested, which is quadratic in the
*different* texts of a near-duplicate group by the nature of the question.

Defined results: null and empty texts, and texts of blanks, have no shingles: no links, a class of their own. A text
of fewer words than a shingle is one shingle. Repeated rows are copies of each other. Null ids keep their own rows.
Columns other than id and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parity.llm import words
from parity.llm.components import components
from parity.llm.keys import text_key

BLOCK = 256
#: Nodes are looked at more closely from this share of equal values, five standard errors under the threshold.
ERRORS = 5.5


def depth_for(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the wanted probability."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    salts = words.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return salts, words.mix(salts) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The smallest of ``n`` hash functions over each (non-empty) set, uint32."""
    salts, factors = _salts(n)
    out = np.zeros((len(sets), n), np.uint32)
    group, size, first = [], 0, 0
    for i, s in enumerate(sets):
        group.append(s)
        size += len(s)
        if size >= 1 << 15 or i == len(sets) - 1:
            flat = np.concatenate(group)
            starts = np.cumsum([0] + [len(x) for x in group[:-1]])
            for k in range(n):
                h = (flat ^ salts[k]) * factors[k]
                out[first : i + 1, k] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts) >> np.uint64(32)
            group, size, first = [], 0, i + 1
    return out


def nodes_of(docs: DataFrame, shingle: int, trees: int, depth: int) -> DataFrame:
    """id, key, node (null without shingles), n, prefixes, sketch of every row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, parts in words.chunks(list(batch["text"])):
                sets = words.shingle_sets(parts, shingle)
                rows = batch.iloc[first : first + len(parts)]
                full = [i for i, s in enumerate(sets) if len(s)]
                node, prefixes, sketch = ([None] * len(sets) for _ in range(3))
                if full:
                    signed = signatures([sets[i] for i in full], trees * depth)
                    tree = np.arange(trees, dtype=np.uint64) * np.uint64(words._BASE)
                    key = np.broadcast_to(tree, (len(full), trees)).copy()
                    for d in range(depth):
                        key = words.mix(key + signed[:, d::depth] + np.uint64(d + 1))
                    low = (signed & np.uint32(0xFF)).astype(np.uint8)
                    for k, i in enumerate(full):
                        node[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        prefixes[i] = key[k].view(np.int64)
                        sketch[i] = low[k].tobytes()
                yield pd.DataFrame({
                    "id": rows["id"].to_numpy(), "none": rows["none"].to_numpy(), "key": rows["key"].to_numpy(), "node": node,
                    "n": [len(s) for s in sets], "prefixes": prefixes, "sketch": sketch,
                })

    # an id beside a null one would become a double on its way through pandas: nulls travel as a flag
    kind = docs.schema["id"].dataType.simpleString()
    given = docs.select(
        F.coalesce("id", F.lit("0").cast(kind)).alias("id"), F.col("id").isNull().alias("none"), "key", "text"
    )
    schema = f"id {kind}, none boolean, key bigint, node binary, n int, prefixes array<bigint>, sketch binary"
    return given.mapInPandas(scan, schema).withColumn("id", F.when(~F.col("none"), F.col("id"))).drop("none")


def in_block_pairs(rows: DataFrame, group: str, size: str, node: str = "node") -> DataFrame:
    """``rows`` dealt out for comparison: a group of up to BLOCK nodes is one block, a larger one is cut into blocks by
    a hash and every block meets every block. Adds ``x`` and ``y`` (the two blocks) and ``own`` (the row's block)."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.col(node), F.col(group)), blocks).cast("int")
    cut = rows.withColumn("_blocks", blocks).withColumn("own", own)
    dealt = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("x", F.least("own", "_other")).withColumn("y", F.greatest("own", "_other")).drop("_blocks", "_other")


def by_group(rows: DataFrame, group: str, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work`` on the rows of each (group, x, y), many groups to a task, one group in memory at a time."""
    on = [group, "x", "y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        for batch in batches:
            g, x, y = (batch[c].to_numpy() for c in on)
            new = np.flatnonzero((g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            cuts = [0, *new.tolist(), len(batch)]
            out = []
            if left and tuple(left[-1][on].iloc[-1]) != tuple(batch[on].iloc[0]):
                out.append(work(pd.concat(left, ignore_index=True)))
                left = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.iloc[a:b]
                if b == len(batch):
                    left.append(part)
                elif left:
                    out.append(work(pd.concat([*left, part], ignore_index=True)))
                    left = []
                else:
                    out.append(work(part))
            out = [o for o in out if o is not None and len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if left:
            last = work(pd.concat(left, ignore_index=True))
            if last is not None and len(last):
                yield last

    return rows.repartition(*on).sortWithinPartitions(*on).mapInPandas(run, schema)


def spanning(adjacent: np.ndarray, nodes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Edges from the smallest node of each component of a symmetric adjacency matrix to its other nodes."""
    label = np.arange(len(nodes))
    linked = np.flatnonzero(adjacent.any(axis=1))
    if not len(linked):
        return []
    near = adjacent[np.ix_(linked, linked)]
    np.fill_diagonal(near, True)
    label = np.arange(len(linked))
    while True:
        low = np.where(near, label[None, :], len(linked)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(nodes[linked[r]], nodes[linked[i]]) for i, r in enumerate(label.tolist()) if r != i]


def likely_edges(members: DataFrame, least: float, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each block whose sketches and sizes allow the threshold."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        if len(rows) < 2:
            return None
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        n = rows["n"].to_numpy(np.int64)
        if len(rows) == 2:
            ok = (sketch[0] == sketch[1]).mean() >= least and min(n) >= threshold * max(n)
            nodes = rows["node"].to_numpy()
            return pd.DataFrame({"a": [nodes[0]], "b": [nodes[1]]}) if ok else None
        same = np.empty((len(rows), len(rows)), bool)
        for a in range(0, len(rows), 64):
            same[a : a + 64] = (sketch[a : a + 64, None, :] == sketch[None, :, :]).mean(axis=2) >= least
        same &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
        if rows["x"].iloc[0] != rows["y"].iloc[0]:
            own = rows["own"].to_numpy()
            same &= own[:, None] != own[None, :]
        np.fill_diagonal(same, False)
        return pd.DataFrame(spanning(same, rows["node"].to_numpy()), columns=["a", "b"])

    dealt = in_block_pairs(members, "prefix", "together")
    return by_group(dealt, "prefix", work, "a binary, b binary").distinct()


def verified(members: DataFrame, shingle: int, over: tuple[int, int]) -> DataFrame:
    """From root, size, node, copies, text: rows (a, b, links): a verified link of a spanning forest where b is given,
    and the links of a (counting copies) inside one pair of blocks where not. ``over`` is the threshold as a fraction."""
    up, down = over

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, parts in words.chunks(list(batch["text"])):
                rows = batch.iloc[first : first + len(parts)].drop(columns="text")
                yield rows.assign(shingles=[s.tobytes() for s in words.shingle_sets(parts, shingle)])

    sets = members.select("root", "size", "node", "copies", "text").mapInPandas(
        cut, "root binary, size bigint, node binary, copies bigint, shingles binary"
    )

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        if len(rows) < 2:
            return None
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
        name = np.cumsum(fresh) - 1
        shared = np.bincount(name)[name] > 1
        owner, name = owner[shared], name[shared]
        common = np.zeros((len(sets), len(sets)), np.float32)
        if len(name):
            name = np.unique(name, return_inverse=True)[1]
            edges = np.searchsorted(name, np.arange(0, name[-1] + 4097, 4096))
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    there = np.zeros((len(sets), 4096), np.float32)
                    there[owner[a:b], name[a:b] - name[a]] = 1
                    common += there @ there.T
        both = np.rint(common).astype(np.int64)
        linked = down * both >= up * (n[:, None] + n[None, :] - both)
        if rows["x"].iloc[0] != rows["y"].iloc[0]:
            own = rows["own"].to_numpy()
            linked &= own[:, None] != own[None, :]
        np.fill_diagonal(linked, False)
        links = linked @ rows["copies"].to_numpy(np.int64)
        nodes = rows["node"].to_numpy()
        out = [(nodes[i], None, int(links[i])) for i in np.flatnonzero(links)]
        out += [(a, b, 0) for a, b in spanning(linked, nodes)]
        return pd.DataFrame(out, columns=["a", "b", "links"])

    return by_group(in_block_pairs(sets, "root", "size"), "root", work, "a binary, b binary, links bigint")


def classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    threshold: tuple[int, int] = (4, 5),
    trees: int = 24,
    deepest: int = 6,
    recall: float = 1 - 1e-7,
) -> DataFrame:
    """id, key, class_id (smallest id of the class), n_links, n_class, root of every row. Id and key name a row, root
    names the class (null for rows without shingles)."""
    level = threshold[0] / threshold[1]
    depth = depth_for(trees, deepest, level, recall)
    values = trees * depth
    least = level - ERRORS * (level * (1 - level) / values) ** 0.5
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))
    scanned = nodes_of(rows, shingle, trees, depth).checkpoint()
    nodes = (
        scanned.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min(F.struct("id", "key")).alias("first"), F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
            F.first("prefixes").alias("prefixes"), F.first("sketch").alias("sketch"),
        )
        .checkpoint()
    )
    prefixes = nodes.select("node", F.explode("prefixes").alias("prefix"))
    together = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("together")).where("together > 1")
    members = prefixes.join(together, "prefix").join(nodes.select("node", "n", "sketch"), "node")
    likely = likely_edges(members, least, level)
    rooted = components(likely)
    sized = rooted.join(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    asked = sized.join(nodes.select("node", "copies", "first"), "node").select(
        "root", "size", "node", "copies", F.col("first.id").alias("id"), F.col("first.key").alias("key")
    )
    # rows that agree in id and text are one and the same here: any of them stands for the node
    a, b = asked.alias("a"), rows.alias("b")
    fetched = b.join(a, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key")))
    fetched = fetched.select("root", "size", "node", "copies", "text").dropDuplicates(["node"])
    found = verified(fetched, shingle, threshold).checkpoint()
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    grouped = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    classed = (
        nodes.select("node", "low", "copies")
        .join(links, "node", "left")
        .join(grouped, "node", "left")
        .select(
            "node", "low", F.coalesce("root", "node").alias("root"), "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    of_root = classed.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("copies").alias("n_class"))
    of_node = classed.join(of_root, "root").select("node", "root", "class_id", "n_links", "n_class")
    return (
        scanned.select("id", "key", "node")
        .join(of_node, "node", "left")
        .select(
            "id", "key", F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_class", F.lit(1)).alias("n_class"),
            "root",
        )
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of every class, the one with the smallest id (ties: by the hash of the text), with all its columns; rows
    without shingles all stay."""
    found = classes(docs, doc_id, text, **options)
    alone = found.where("root IS NULL").select("id", "key").distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("f")
    kept = found.where("root IS NOT NULL").groupBy("root").agg(first).select("f.id", "f.key").union(alone).alias("k")
    d, key = docs.alias("d"), text_key(text)
    mine = d.join(kept, F.col(f"d.{doc_id}").eqNullSafe(F.col("k.id")) & (key == F.col("k.key")), "left_semi")
    turn = "_turn"
    while turn in docs.columns:
        turn = f"_{turn}"
    order = Window.partitionBy(doc_id, key).orderBy(F.lit(0))
    numbered = mine.withColumn(turn, F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", 1).otherwise(F.row_number().over(order)))
    return numbered.where(F.col(turn) == 1).drop(turn)
