"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in an order that a digest of the document decides, up to ``most_epochs`` times
over. An entry's virtual finish time is the words of its source so far, itself included, divided by the source's target.
All entries are sorted by finish time over the cluster, and the mix is cut where its words reach the budget.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating; a target stops at ``most_epochs`` times its
source's size and what it leaves is shared by weight among the others until none is above. As the caps together are at
least the budget, some level L gives every source min(cap, weight * L); the sources are capped in the order of cap over
weight.

Running sums over a source that holds a third of all rows are not one task's work: rows are range-sorted into slices,
a slice sums its own, and the sums of the slices before it are added. What reaches a join by broadcast is a row per
slice and source at most (slices are as many as shuffle partitions; a source that spans several slices has one row in each).

Defined results: a null or empty text has size 0 and nothing taken; a null source is a source of its own, last. Equal
rows are separate entries, and which of them comes first makes no difference to the rows returned. An empty table gives
none. Columns that are not named here are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import WORD, checkpointed, parts_for, unused

RESULT = ["doc_id", "size", "source_size", "target", "taken"]


def n_words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, most_epochs: int) -> DataFrame:
    """(source, source_size, target) of (source, source_size). Ranks and running sums are worked out in slices."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = summed_before(sizes.withColumn("one", F.lit(1)), by_name, None, {"one": "rank"})
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", most_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")).drop("one", "rank")
    levelled = summed_before(ranked, ["ratio", *by_name], None, {"cap": "caps", "weight": "weights"})
    sums = levelled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left = lambda total, upto, own: F.lit(total) - (F.col(upto) - F.col(own))
    levelled = levelled.withColumn("own_level", left(sums["size"], "caps", "cap") / left(sums["weight"], "weights", "weight"))
    # the first source, in the order of ratio, that the level of those left does not lift above its cap
    fits = levelled.filter("own_level <= ratio").agg(F.min(F.struct("ratio", F.col("source").isNull().alias("last"), "source", F.col("own_level").alias("level")))["level"].alias("level")).first()["level"]
    level = F.lit(fits).cast("double")
    return levelled.select("source", "source_size", F.when(level.isNull() | (F.col("ratio") < level), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def summed_before(df: DataFrame, order: list, key: str | None, amounts: dict[str, str]) -> DataFrame:
    """Add the running sums of ``amounts`` (column: its sum's name), itself included, in a global order (within ``key``, which leads the order)."""
    parts = parts_for(df)
    cut = df.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id())
    cut = checkpointed(cut)  # the slices of a range partition are drawn by sampling: fix them
    keys = ["_slice", *([key] if key else [])]
    totals = cut.groupBy(*keys).agg(*(F.sum(a).alias(f"_sum_{a}") for a in amounts))
    earlier = W.partitionBy(*([key] if key else [])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("_slice").alias("_s"), *([F.col(key).alias("_k")] if key else []), *(F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_before_{a}") for a in amounts))
    match = F.col("_slice") == F.col("_s")
    if key:
        match = match & F.col(key).eqNullSafe(F.col("_k"))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    owned = cut.select("*", *(F.sum(a).over(within).alias(f"_own_{a}") for a in amounts)).join(offsets, match)
    return owned.select(*[F.col(f"`{c}`") for c in df.columns], *((F.col(f"_own_{a}") + F.col(f"_before_{a}")).alias(out) for a, out in amounts.items()))


def fair_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; the budget is the size of them all."""
    sized = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"))
    sized = sized.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sized = checkpointed(sized)
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most_epochs)
    # one row for each source; Spark broadcasts it if its own check of the size allows that
    shares = checkpointed(per_source).select(F.col("source").alias("_source"), "source_size", "target")
    queued = summed_before(sized, ["source", "draw", "doc_id", "size"], "source", {"size": "_cum"})
    queued = queued.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(most_epochs - 1)), lambda e: F.struct(e.cast("int").alias("epoch"), ((F.col("_cum") + e * F.col("source_size")) / F.col("target")).alias("finish"))))
    entries = queued.select("doc_id", "draw", "size", F.explode(epochs).alias("e")).select("doc_id", "draw", "size", "e.epoch", "e.finish")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    merged = summed_before(entries, ["finish", "draw", "doc_id", "epoch", "size"], None, {"size": "_total"})
    last = merged.filter(F.col("_total") <= F.lit(budget)).agg(F.max(F.struct("finish", "draw", "doc_id", "epoch")).alias("cut")).first()["cut"]
    taken = F.lit(0).cast("long")
    if last is not None:
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["draw"]).alias("draw"), F.lit(last["doc_id"]).cast(sized.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["epoch"]).alias("epoch"))
        count = F.size(F.filter(epochs, lambda e: F.struct(e["finish"].alias("finish"), F.col("draw").alias("draw"), F.col("doc_id").alias("doc_id"), e["epoch"].alias("epoch")) <= cut))
        taken = F.when(F.col("size") > 0, count * F.col("size")).otherwise(0).cast("long")
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most_epochs: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken. Columns and their order stay, whatever their names."""
    own_id, own_size, times, words, nth, row, copy = unused(docs.columns, "mix_id", "mix_size", "mix_times", "mix_words", "mix_nth", "mix_row", "mix_copy")
    mix = fair_mix(docs, key, text, source, most_epochs).filter("taken > 0")
    mix = checkpointed(mix.select(F.col("doc_id").alias(own_id), F.col("size").alias(own_size), (F.col("taken") / F.col("size")).cast("int").alias(times)))
    sized = docs.withColumn(words, n_words(F.col(f"`{text}`")))
    match = F.col(f"`{key}`").eqNullSafe(F.col(own_id)) & (F.col(words) == F.col(own_size))
    if mix.groupBy(own_id, own_size).count().filter("count > 1").limit(1).count():
        # rows of one key and size: the first of them gets the most copies
        mix = mix.withColumn(nth, F.row_number().over(W.partitionBy(own_id, own_size).orderBy(F.desc(times))))
        sized = sized.withColumn(row, F.row_number().over(W.partitionBy(F.col(f"`{key}`"), words).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
        match = match & (F.col(nth) == F.col(row))
    return sized.join(mix, match).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM per
), ratios AS (SELECT *, cap / weight AS ratio FROM ranked),
levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own_level FROM ratios
), lvl AS (
  SELECT own_level AS level FROM levelled WHERE own_level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), shares AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM levelled LEFT JOIN lvl ON true
), queued AS (
  SELECT s.doc_id, s.size, s.draw, h.source_size, h.target,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM sized s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source
), entries AS (
  SELECT doc_id, draw, size, e AS epoch, (cum + e * source_size) / target AS finish FROM queued, range(3) t(e) WHERE size > 0
), merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, draw, doc_id, epoch, size ROWS UNBOUNDED PRECEDING) AS total FROM entries
), mix AS (
  SELECT doc_id, sum(size) AS taken FROM merged WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(m.taken, 0) AS BIGINT) AS taken FROM queued q LEFT JOIN mix m USING (doc_id)
"""
