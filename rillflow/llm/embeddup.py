"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors form a class and are searched once; a class counts as many times as it has rows.
2. Centres of cells come from a bounded sample (some ``sample`` vectors, as many centres as make cells of ``cell`` vectors, at most
   ``most_centres``). A vector belongs to the ``overlap`` cells whose centres are nearest. A cell with more members
   than ``most_members`` is dealt over shards by a hash; each of its vectors is still searched in all of them.
3. Each shard builds its graph. The neighbour lists that a vector has in its shards are united.
4. Each shard searches the united lists for the vectors of its cell, greedily from medoids and the vector's own place, and
   then by range expansion. What is found is verified by the cosine in double precision. A pair that shares several
   shards is counted in the first of them. A shard returns the number of links of each vector and a spanning
   forest of them, not the pairs.
5. Recall is audited: for a sample of ``queries`` vectors the links found are held against all vectors, by brute force in
   blocks, each pair of classes once. If it is below ``least_recall``, the search is run again with one more cell for each
   vector. Where ``most_overlap`` cells do not reach it, all vectors are compared, block by block.

Defined results: vectors that are null or zero, or hold a null or a value that is not finite, link with nothing. Vectors of
different lengths never link; each length is searched by itself. Equal vectors link with each other. Rows with a null id are counted as others are;
a component's id is the least id in it that is not null. An empty table gives no rows.

Classes are named by 64 bits of a hash of the vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import vectors as V
from rillflow.llm.common import checkpointed, components

DEGREE = 16
FOUND = "node long, links long, pairs long, root long"


def stacked(column) -> np.ndarray:
    """The rows of a list column of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def centres_of(x: np.ndarray, count: int, seed: int = 11, turns: int = 8) -> np.ndarray:
    """Spherical k-means of a sample."""
    rng = np.random.default_rng(seed)
    x = V.unit(x)
    out = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(turns):
        near = (x @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        some = (sums * sums).sum(axis=1) > 1e-12
        out[some] = V.unit(sums[some])
    return out


def searched(classes: DataFrame, least: float, centres: np.ndarray, overlap: int, most_members: int) -> tuple[DataFrame, DataFrame]:
    """((node, links), (a, b)): links of each class to others, weighted by their rows, and a forest of them."""
    overlap = min(overlap, len(centres))

    def assign(batches):
        for batch in batches:
            x = V.unit(stacked(batch.column(2)))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, overlap, dtype=np.int32)), pa.array(np.sort(near, axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["node", "times", "embedding", "cells"])

    placed = checkpointed(classes.select("node", "times", "embedding").mapInArrow(assign, f"node long, times long, embedding {classes.schema['embedding'].dataType.simpleString()}, cells array<int>"))
    in_cells = placed.select("*", F.explode("cells").alias("cell"))
    # a row for each cell, of which there are most_centres at most
    sizes = in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / most_members).cast("int").alias("shards"))
    in_cells = in_cells.join(sizes, "cell").withColumn("home", F.pmod(F.xxhash64("node"), "shards").cast("int"))

    def grow(key, table):
        x = V.unit(stacked(table.column("embedding")))
        node = table.column("node").to_numpy()
        edges = V.build(x, DEGREE, seed=int(node.min() & 0x7FFFFFFF)) if len(x) > 1 else np.full((1, 1), -1)
        lists = [node[e[e >= 0]].tolist() for e in edges]
        return pa.table({"node": node, "edges": pa.array(lists, pa.list_(pa.int64()))})

    grown = in_cells.select("cell", "home", "node", "embedding").groupBy("cell", "home").applyInArrow(grow, "node long, edges array<long>")
    united = checkpointed(grown.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")))
    # members of a shard, and the vectors of its cell that live in another shard of it and are only searched here
    everywhere = in_cells.join(united, "node").select("cell", "node", "times", "embedding", "cells", "edges", "home", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def search(key, table):
        cell = key[0].as_py()
        shard = key[1].as_py()
        table = table.sort_by("node")
        x = V.unit(stacked(table.column("embedding")))
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        cells = np.array(table.column("cells").to_pylist()).reshape(len(node), -1)
        inside = table.column("home").to_numpy() == shard
        member = np.flatnonzero(inside)
        local = np.full(len(node), -1)
        local[member] = np.arange(len(member))
        links, pairs, forest = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), Forest(len(node))
        if len(member):
            rows = table.column("edges").combine_chunks()
            offsets, ends = rows.offsets.to_numpy(), rows.flatten().to_numpy()
            at = np.searchsorted(node, ends)
            at = np.where((at < len(node)) & (node[np.minimum(at, len(node) - 1)] == ends), at, -1)
            to = np.where(at >= 0, local[np.maximum(at, 0)], -1)
            width = int(np.diff(offsets).max(initial=1))
            edges = np.full((len(node), max(1, width)), -1, dtype=np.int64)
            length = np.diff(offsets)
            edges[np.repeat(np.arange(len(node)), length), np.arange(len(ends) - 0) - np.repeat(offsets[:-1] - offsets[0], length)] = to
            edges = edges[member]
            graph = x[member]
            for r, m in V.within(graph, edges, x, V.medoids(graph, 8), local, least):
                other = member[m]
                real = (other != r) & (V.cosines(x, r, x, other) >= least)
                r, other = r[real], other[real]
                # the first cell that both are in counts the pair
                both = (cells[r][:, :, None] == cells[other][:, None, :]).any(axis=2)
                first = cells[r, both.argmax(axis=1)]
                r, other = r[first == cell], other[first == cell]
                links += np.bincount(r, times[other], len(node)).astype(np.int64)
                pairs += np.bincount(r, minlength=len(node))
                forest.join(r, other)
        return pa.table({"node": node, "links": links, "pairs": pairs, "root": node[forest.roots()] if len(node) else node})

    return summed(everywhere.groupBy("cell", "shard").applyInArrow(search, FOUND))


def summed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, links, pairs), (a, b)) of what the shards or blocks have found."""
    found = checkpointed(found)
    return found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


class Forest:
    """Which of some nodes hang together."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put both ends of every link under one root: the least that either knows, until nothing moves."""
        while len(a):
            x, y = self.up[a], self.up[b]
            some = x != y
            if not some.any():
                return
            a, b, x, y = a[some], b[some], x[some], y[some]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            self.up = self.roots()

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        return up


def searched_in_full(classes: DataFrame, least: float, count: int, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The same by comparing all vectors, block by block: each is sent to as many tasks as there are blocks."""
    blocks = max(1, math.ceil(count / block))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)).cast("int")
    dealt = classes.select("node", "times", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        x, node, times = V.unit(stacked(table.column("embedding"))), table.column("node").to_numpy(), table.column("times").to_numpy()
        own = table.column("own").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, pairs, forest = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), Forest(len(node))
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            r, m = np.nonzero(x[rows] @ x[right].T >= least - 1e-9)
            r, m = rows[r], right[m]
            real = (r < m if i == j else r != m) & (V.cosines(x, r, x, m) >= least)
            for a, b in ((r[real], m[real]), (m[real], r[real])):
                links += np.bincount(a, times[b], len(node)).astype(np.int64)
                pairs += np.bincount(a, minlength=len(node))
            forest.join(r[real], m[real])
        return pa.table({"node": node, "links": links, "pairs": pairs, "root": node[forest.roots()]})

    return summed(dealt.groupBy("i", "j").applyInArrow(compare, FOUND))


def drawn(classes: DataFrame, count: int, wanted: int, salt: str) -> list:
    """Some ``wanted`` of ``count`` rows, by a hash: no partition sends the driver more than its share."""
    h = F.xxhash64("node", F.lit(salt))
    some = classes.select("node", "embedding", h.alias("h"))
    if count > wanted:
        some = some.filter(F.pmod("h", F.lit(1 << 40)) < F.lit(int((1 << 40) * wanted / count)))
    return sorted(some.collect(), key=lambda r: (r["h"], r["node"]))


def audited(classes: DataFrame, counts: DataFrame, least: float, count: int, queries: int) -> float:
    """The share of links, of a drawn sample of vectors to all, that the search has found."""
    asked = drawn(classes, count, queries, "audit")
    if not asked:
        return 1.0
    q = V.unit(np.array([r["embedding"] for r in asked], dtype=np.float64))
    ids = np.array([r["node"] for r in asked])

    def hold(batches):
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            x = V.unit(stacked(batch.column(1)))
            node = batch.column(0).to_numpy()
            for at in range(0, len(x), 1000):
                near = (q @ x[at : at + 1000].T >= least) & (ids[:, None] != node[None, at : at + 1000])
                total += near.sum(axis=1)
        yield pa.RecordBatch.from_pydict({"node": ids, "truth": total})

    truth = classes.select("node", "embedding").mapInArrow(hold, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    row = truth.join(counts, "node", "left").agg(F.sum(F.least("truth", F.coalesce("pairs", F.lit(0)))).alias("found"), F.sum("truth").alias("truth")).first()
    return 1.0 if not row["truth"] else row["found"] / row["truth"]


def links_of(classes: DataFrame, least: float, overlap: int, cell: int, most_centres: int, sample: int, most_members: int, queries: int, least_recall: float, most_overlap: int) -> tuple[DataFrame, DataFrame, float]:
    """((node, links, pairs), (a, b), recall) of classes of vectors of one length."""
    count = classes.count()
    taught = np.array([r["embedding"] for r in drawn(classes, count, sample, "sample")], dtype=np.float64)
    centres = centres_of(taught, min(most_centres, max(1, math.ceil(count / cell))))
    while overlap <= most_overlap:
        counts, forest = searched(classes, least, centres, overlap, most_members)
        recall = audited(classes, counts, least, count, queries)
        if recall >= least_recall:
            return counts, forest, recall
        overlap += 1
    return (*searched_in_full(classes, least, count), 1.0)


def linked(table: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.9, overlap: int = 3, cell: int = 600, most_centres: int = 4096, sample: int = 20_000, most_members: int = 4096, queries: int = 1000, least_recall: float = 0.99, most_overlap: int = 6) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall of every vector. recall: the least that an audit found."""
    v = F.col(f"`{embedding}`")
    kind = table.schema[embedding].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    v = v.cast(f"array<{kind}>")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = table.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda e: e + F.lit(0.0).cast(kind))).alias("embedding"))
    rows = checkpointed(rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("row", F.monotonically_increasing_id()))
    alone = rows.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.filter("node IS NOT NULL")
    # a row for each length that occurs
    lengths = sorted(r["d"] for r in good.groupBy(F.size("embedding").alias("d")).count().collect())
    if not lengths:
        return alone.withColumn("recall", F.lit(1.0))
    times = good.groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least_id"), F.min("row").alias("first"))
    classes = checkpointed(times.join(good.select("node", F.col("row").alias("first"), "embedding"), ["node", "first"]).select("node", "times", "least_id", "embedding"))
    found = [links_of(classes.filter(F.size("embedding") == d), least, overlap, cell, most_centres, sample, most_members, queries, least_recall, most_overlap) for d in lengths]
    counts, forest = found[0][:2]
    for c, f, _ in found[1:]:
        counts, forest = counts.unionByName(c), forest.unionByName(f)
    roots = components(forest)
    named = classes.join(counts, "node", "left").join(roots, "node", "left").select("node", "least_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # written first, so that the last join has an exchange on either side, whose large partitions Spark can split
    named = checkpointed(named.join(groups, "root").select("node", "n_links", "component_id"))
    out = good.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionByName(alone).withColumn("recall", F.lit(min(f[2] for f in found)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT r.a AS vec_id, coalesce(max(d.n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept, 1.0::DOUBLE AS recall
FROM reached r LEFT JOIN degree d ON d.a = r.a GROUP BY r.a
"""
