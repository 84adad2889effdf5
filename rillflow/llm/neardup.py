"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, and verification of every link.

A text's shingles are its runs of ``width`` words (all its words where it has fewer), weighted by how often they occur
in it. A text that repeats a shingle is signed once more with a weight of 1 for each, as links are defined by the plain
sets: such signatures agree with the chance of the similarity that is verified, however often a passage repeats. In a
text without repeats both are the same. Equal texts form a class and are compared once. Classes of which a signature
of either kind agrees in a band share a bucket. Links
are found in rounds: in each, every bucket draws a leader and each member in another component than its leader is
compared with it, by the exact Jaccard similarity of the two shingle sets. A large group of near copies so takes a
comparison for each member, bucket and round and not one for each pair. What then still shares a bucket in different
components is compared in full, in blocks of bounded size, within tasks that return a spanning forest of the links:
no pair that shares a bucket and would join two components is left out.

Defined results: a null text counts as an empty one; texts without words are near nothing but their equals. Rows with a
null key get results too; a group's id is the least key that is not null. Equal rows are members of one class. Two rows
of the same key and different texts are different texts. An empty table gives no rows.

Classes are named by 60 bits of one digest of the text and 64 of another. Links are drawn between the former alone: of
different texts that share them by chance one is compared, and the others stay as groups of their own.
The share of links that banding finds at the threshold is measured in the tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import checkpointed, components, gathered, mixed, text_chunks, tidy, unused
from rillflow.llm.probminhash import STEP, jaccard, shingles, signatures

CHUNK_BYTES = 3_000_000
#: Rows of either side in a block of the last, full comparison.
BLOCK = 512


def node_of(text):
    """The 64 bits by which texts are compared and linked."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def digest_of(text):
    """Another 64 bits of a text, which tell texts of one node apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def band_rows(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, digest, bands): hashes of each band of a text's signatures; none for a text without words."""

    def keys(value, text, weight, size):
        found = signatures(value, text, weight, size, bands * rows).reshape(size, bands, rows)
        key = np.zeros((size, bands), np.uint64)
        for k in range(rows):
            key = mixed(key * STEP + found[:, :, k] + np.arange(1, bands + 1, dtype=np.uint64))
        return key

    def sign(batches):
        for batch in batches:
            for at, stop in text_chunks(batch.column(3), CHUNK_BYTES):
                part = batch.slice(at, stop - at)
                value, text, count = shingles(part.column(3), width)
                key = np.zeros((len(part), 2, bands), np.uint64)
                key[:, 0] = keys(value, text, count.astype(np.float64), len(part))
                some = np.zeros((len(part), 2), bool)
                some[text, 0] = True
                # the sets, where they are not what is signed already
                some[text[count > 1], 1] = True
                again = some[text, 1]
                number = np.cumsum(some[:, 1]) - 1
                key[some[:, 1], 1] = keys(value[again], number[text[again]], np.ones(int(again.sum())), int(some[:, 1].sum()))
                offsets = np.concatenate([[0], np.cumsum(some.sum(axis=1) * bands)]).astype(np.int32)
                del value, text, count, again
                tidy()
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["doc_id", "node", "digest", "bands"])

    return docs.mapInArrow(sign, "doc_id long, node long, digest long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""

    def check(batches):
        for batch in batches:
            for at, stop in text_chunks(batch.column(2), CHUNK_BYTES):
                part = batch.slice(at, stop - at)
                keep = jaccard(part.column(2), part.column(3), width) >= least - 1e-12
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right").mapInArrow(check, "a long, b long")


def compared_in_full(open_buckets: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) between components that share a bucket: a forest of them from each block.

    open_buckets: (bucket, node, root). In a bucket, nodes outside its most frequent component meet all others.
    """
    per = open_buckets.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    per = per.select("bucket", F.col("top.root").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("deep"))
    rows = open_buckets.join(per, "bucket").withColumn("h", F.xxhash64("node"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    members = rows.select("bucket", "node", "root", F.explode(every(F.col("deep"))).alias("row"), F.pmod("h", "wide").cast("int").alias("col"), F.lit(False).alias("asks"))
    asking = rows.filter("root <> main").select("bucket", "node", "root", F.pmod("h", "deep").cast("int").alias("row"), F.explode(every(F.col("wide"))).alias("col"), F.lit(True).alias("asks"))
    placed = members.unionByName(asking).join(texts, "node").select("bucket", "row", "col", "node", "root", "asks", "text")

    def compare(key, table):
        table = table.sort_by([("asks", "ascending"), ("node", "ascending")])
        value, text, _ = shingles(table.column("text").combine_chunks(), width)
        asks = table.column("asks").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        size = np.bincount(text, minlength=len(node))
        first = int(np.searchsorted(asks, True))  # the members stand before those that ask
        order = np.argsort(value, kind="stable")
        _, inverse = np.unique(value, return_inverse=True)
        held = order[text[order] < first]
        groups = inverse[held]
        begin = np.searchsorted(groups, np.arange(inverse.max(initial=-1) + 2))
        up = {r: r for r in root.tolist()}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        bounds = np.searchsorted(text, np.arange(len(node) + 1))
        for k in range(first, len(node)):
            own = inverse[bounds[k] : bounds[k + 1]]
            lengths = begin[own + 1] - begin[own]
            total = int(lengths.sum())
            at = np.arange(total) + np.repeat(begin[own] - (np.cumsum(lengths) - lengths), lengths)
            both = np.bincount(text[held[at]], minlength=first)
            near = np.flatnonzero(both >= (least - 1e-12) * (size[:first] + size[k] - both))
            for j in near[(size[near] > 0) & (root[near] != root[k])].tolist():
                x, y = top(root[j]), top(root[k])
                if x != y:
                    up[x] = y
                    a.append(node[j])
                    b.append(node[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("bucket", "row", "col").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, bands: int = 16, rows: int = 5, rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, node, class_id (least key of its equals), component_id (least key of its group), kept."""
    body = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), node_of(body).alias("node"), digest_of(body).alias("digest"), body.alias("text"))
    signed = checkpointed(band_rows(base, width, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    count = signed.count()
    # tables that grow with the documents are kept in partitions of some 10,000 rows each, whatever the session deals
    signed = gathered(signed, count, 10_000)
    filed = gathered(signed.select("node", F.explode("bands").alias("bucket")).distinct(), count, 10_000)
    shared = gathered(filed.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("bucket"), count)
    filed = checkpointed(gathered(filed.join(shared, "bucket", "left_semi"), count, 10_000))
    wanted = gathered(filed.select("node").distinct(), count)
    texts = checkpointed(gathered(base.select("node", "digest", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("digest", "text"))["text"].alias("text")), count, 8_000))
    links, roots = None, None

    def joined(new: DataFrame):
        found = checkpointed(new)
        everything = found if links is None else links.unionByName(found)
        return everything, components(everything)

    def rooted(frame: DataFrame, node: str, to: str) -> DataFrame:
        if roots is None:
            return frame.withColumn(to, F.col(node))
        return frame.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(to, F.coalesce("_root", node)).drop("_root")

    for turn in range(rounds):
        leaders = filed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), "node"))["node"].alias("lead"))
        # written first, so that the join has an exchange on either side, whose large partitions Spark can split
        leaders = checkpointed(gathered(leaders, count))
        pairs = gathered(filed.join(leaders, "bucket"), count, 50_000).filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        pairs = rooted(rooted(pairs, "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b")
        links, roots = joined(gathered(verified(gathered(pairs, count, 8_000), texts, width, least), count, 10_000))
    links, roots = joined(gathered(compared_in_full(checkpointed(gathered(rooted(filed, "node", "root"), count, 50_000)), texts, width, least), count, 5_000))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    per_text = gathered(signed.groupBy("node", "digest").agg(F.min("doc_id").alias("class_id"), best), count, 50_000)
    # of texts that share a node by chance one is compared, the others stand alone
    compared = per_text.groupBy("node").agg(F.min("digest").alias("first"))
    per_text = per_text.join(compared, "node").withColumn("alone", F.col("digest") != F.col("first")).drop("first")
    classes = rooted(per_text, "node", "root").withColumn("own", F.when(F.col("alone"), F.col("digest")))
    groups = gathered(classes, count, 50_000).groupBy("root", "own").agg(F.min("class_id").alias("component_id"), F.min("best")["row"].alias("keeper")).select(F.col("root").alias("_root"), F.col("own").alias("_own"), "component_id", "keeper")
    named = classes.join(groups, (F.col("root") == F.col("_root")) & F.col("own").eqNullSafe(F.col("_own"))).select("node", "digest", "class_id", "component_id", "keeper")
    # written first, so that the last join has an exchange on either side, whose large partitions Spark can split
    named = checkpointed(gathered(named, count, 50_000))
    return signed.select("doc_id", "node", "digest", "row").join(named, ["node", "digest"]).select("doc_id", "node", "digest", "class_id", "component_id", (F.col("row") == F.col("keeper")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without all but one of each group. Columns and their order stay, whatever their names."""
    columns = docs.columns
    k, n, d, own_n, own_d = unused(columns, "kept_key", "kept_node", "kept_digest", "own_node", "own_digest")
    kept = near_duplicates(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, **options).filter("kept").select(F.col("doc_id").alias(k), F.col("node").alias(n), F.col("digest").alias(d))
    named = docs.withColumn(own_n, node_of(F.col(f"`{text}`"))).withColumn(own_d, digest_of(F.col(f"`{text}`")))
    kept = checkpointed(kept)
    out = named.join(kept, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(k)) & (F.col(own_n) == F.col(n)) & (F.col(own_d) == F.col(d)), "left_semi")
    # rows of one key and text: one of them stays
    twice = out.groupBy(F.col(f"`{key}`"), own_n, own_d).count().filter("count > 1").limit(1).count()
    return (out.dropDuplicates([key, own_n, own_d]) if twice else out).select(*[F.col(f"`{c}`") for c in columns])
