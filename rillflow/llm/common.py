"""What the operators of this subpackage share: checkpoints, word splitting in Arrow, components."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows of a small table that one partition holds.
GATHERED = 100_000


def shared_folder(context) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a new folder, on a local master alone."""
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="rillflow-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(context))
    return df.checkpoint()


def gathered(df: DataFrame, rows: int, each: int = GATHERED) -> DataFrame:
    """Rows in as many partitions as they fill, ``each`` rows in one: what is small is not written as many tiny files."""
    return df.coalesce(max(1, -(-rows // each)))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, with a number where a column has such a name (names are compared as Spark does, whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        k = 0
        while (own := f"{name}{k or ''}").lower() in taken:
            k += 1
        taken.add(own.lower())
        out.append(own)
    return out


def tidy() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def parts_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_chunks(texts: pa.Array, most_bytes: int):
    """Yield (start, stop) of consecutive rows that hold about ``most_bytes`` of text; a longer row stands alone."""
    ends = np.cumsum(np.maximum(1, np.nan_to_num(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))))
    start, base = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of all texts (null: none), each text's start and end among them, and the words by code."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = words.filter(real).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), kept[offsets - offsets[0]], coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine: its bytes, each by its place, summed and mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = pa.concat_arrays([words])
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(words) + 1].astype(np.int64)
    size = np.diff(ends)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        at = np.arange(len(raw)) - np.repeat(ends[:-1], size)
        letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        places = mixed(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        out[some] = np.add.reduceat(letters[raw] * places[at], ends[:-1][some])
    return mixed(out + size.astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the least node that is reached.

    Alternates the large-star and small-star steps, each a group-by with a min and a join on the node, until every node
    has one link, to a node that has none; the lineage is cut after each pair of steps. Nothing but counts reaches the
    driver. Nodes without links do not occur.
    """
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    rows = now.count()
    few = lambda df: gathered(df, rows)
    # what is joined is written first, so that Spark can split the neighbours of a node that has many, or broadcast where
    # there are GATHERED links at most (no step makes more of them): every job leaves its plan in the driver's memory
    written = checkpointed if rows > GATHERED else F.broadcast
    now = few(now)
    while True:
        # a star forest: what has a link has one, and is no other's root
        ends = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select(F.col("u").alias("x"), "n").unionByName(now.select(F.col("v").alias("x"), F.lit(0).cast("long").alias("n")).distinct())
        loose = few(few(ends).groupBy("x").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sides"))).filter("n > 1 OR sides > 1").limit(1).count()
        if not loose:
            break
        # Large star: each node sends its larger neighbours to the least node that it knows.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = few(few(both.filter("v > u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v"))
        large = checkpointed(few(large.distinct()))
        # Small star: each node sends its smaller neighbours, and itself, to the least of them.
        least = written(few(large.groupBy("u").agg(F.min("v").alias("m"))))
        small = few(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v"))
        now = checkpointed(few(small.distinct()))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
