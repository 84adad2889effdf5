"""Line dedup by a log-template tree, in DataFrame functions only.

A line's white-space tokens that hold a digit count as variable fields. The tree has a fixed depth: the first level is
the number of tokens, the next ``depth`` levels are the leading tokens (a variable field matches any other). Leaves that
one text alone reaches cannot recur and are left at once, by a group-by on hashes. A leaf holds a list of templates: the
least of its lines leads the first, all lines that agree with it in ``similarity`` of their positions belong to it, and the
least line that none has taken leads the next one, until none is left. Positions in which a template's lines differ are
variable.

A template that occurs in ``min_docs`` or more different texts recurs: the text of the least document that has it keeps
its lines, all others lose them. Lines of more than ``long_words`` tokens, which do not repeat by chance, recur from two
texts on. Equal texts count once and stay equal. The other lines, blank ones too, stay as they are.

Leaders of large leaves are drawn in rounds, which thin out groups of like lines in parallel. Of what is left in a large
leaf, lines that share no segment of positions with another one agree with none (of two lines that differ in d
positions at most, cut into d + 1 segments, one segment is equal) and lead alone. A fold over the rest of each leaf ends it.

Defined results: a null text stays null, has no lines and loses none; an empty text stays empty. A text that loses
all of its lines becomes empty and its row stays. Equal rows get equal results. Extra columns are carried along,
whatever their names, but columns named like a result (``counted``, ``dropped``) are replaced. Where no document of a
template has a key that is not null, a null key counts as the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import checkpointed, unused

#: What stands for a variable field.
ANY = "<*>"
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
#: Lines that a leaf may have left before those that agree with no other are parted from it.
LARGE_LEAF = 1000


def tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def agreement(a: Column, b: Column) -> Column:
    """Positions in which two lines of as many tokens agree."""
    return F.size(F.filter(F.zip_with(tokens(a), tokens(b), lambda x, y: x == y), lambda same: same))


def template_lines(docs: DataFrame, depth: int) -> DataFrame:
    """(_key, _text, _pos, _line, _h, _n, _leaf) of every line with a token, of (_key, _body); _text and _h are hashes."""
    masked = F.when(F.col("_body").rlike("[0-9]"), F.regexp_replace("_body", VARIABLE, ANY)).otherwise(F.col("_body"))
    lines = docs.select("_key", F.xxhash64("_body").alias("_text"), F.posexplode(F.split(masked, "\n")).alias("_pos", "_line")).filter(F.col("_line").rlike(r"\S"))
    lines = lines.withColumn("_line", F.trim(F.regexp_replace("_line", r"\s+", " ")))
    n = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(" "))) + 1
    return lines.withColumn("_n", n).withColumn("_leaf", F.xxhash64(n, F.substring_index("_line", " ", depth))).withColumn("_h", F.xxhash64("_line"))


def with_a_like(left: DataFrame, similarity: float) -> DataFrame:
    """(_leaf, _h) of the lines that share a segment of their positions with another line of the leaf."""
    differ = F.col("_n") - F.ceil(similarity * F.col("_n") - 1e-9).cast("int")
    cut = lambda k: (k * F.col("_n") / (F.col("_d") + 1)).cast("int")
    segments = left.withColumn("_d", differ).withColumn("_t", F.split("_line", " "))
    segments = segments.select("_leaf", "_h", F.explode(F.transform(F.sequence(F.lit(0), F.col("_d")), lambda k: F.xxhash64(k, F.array_join(F.slice("_t", cut(k) + 1, cut(k + 1) - cut(k)), " ")))).alias("_s"))
    shared = segments.groupBy("_leaf", "_s").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).filter("_a <> _b").select("_leaf", "_s")
    return segments.join(checkpointed(shared), ["_leaf", "_s"], "left_semi").select("_leaf", "_h").distinct()


def templates(lines: DataFrame, similarity: float, rounds: int = 2) -> DataFrame:
    """(_leaf, _h, _template) of each distinct line: that of the first leader that it agrees with, in the order of lines."""
    line = F.col("_line")
    left = checkpointed(lines.select("_leaf", "_n", "_h", "_line").distinct())
    # where no line can agree with another in enough positions
    alone = F.col("_n") - 1 < similarity * F.col("_n")
    named = left.filter(alone).select("_leaf", "_h", line.alias("_lead"))
    left = left.filter(~alone)
    for _ in range(rounds):
        # written first, so that Spark can split a large leaf in the join
        leaders = checkpointed(left.groupBy("_leaf").agg(F.min("_line").alias("_lead")))
        led = checkpointed(left.join(leaders, "_leaf").withColumn("_near", agreement(line, F.col("_lead")) >= similarity * F.col("_n")))
        named = named.unionByName(led.filter("_near").select("_leaf", "_h", "_lead"))
        left = led.filter("NOT _near").select("_leaf", "_n", "_h", "_line")
    large = checkpointed(left.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > LARGE_LEAF).select("_leaf"))
    if large.limit(1).count():
        inside = checkpointed(left.join(large, "_leaf", "left_semi"))
        like = checkpointed(with_a_like(inside, similarity))
        named = named.unionByName(inside.join(like, ["_leaf", "_h"], "left_anti").select("_leaf", "_h", line.alias("_lead")))
        left = left.join(large, "_leaf", "left_anti").unionByName(inside.join(like, ["_leaf", "_h"], "left_semi"))
    near = lambda a, b: agreement(a, b) >= similarity * F.col("_n")
    leaves = left.groupBy("_leaf", "_n").agg(F.array_sort(F.collect_list(F.struct("_line", "_h"))).alias("_lines"))
    leaders = F.aggregate("_lines", F.array().cast("array<string>"), lambda found, x: F.when(F.exists(found, lambda lead: near(x["_line"], lead)), found).otherwise(F.concat(found, F.array(x["_line"]))))
    leaves = leaves.withColumn("_leads", leaders).select("_leaf", F.explode(F.transform("_lines", lambda x: F.struct(x["_h"].alias("_h"), F.filter("_leads", lambda lead: near(x["_line"], lead))[0].alias("_lead")))).alias("_x"))
    named = named.unionByName(leaves.select("_leaf", "_x._h", "_x._lead"))
    return named.select("_leaf", "_h", F.xxhash64("_leaf", "_lead").alias("_template"))


def template_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 3, similarity: float = 0.85, min_docs: int = 3, long_words: int = 20, counted: str = "n_lines", dropped: str = "dropped_lines") -> DataFrame:
    """The documents without their recurring lines, with the columns ``counted`` (lines with a word before) and ``dropped`` (positions from 0)."""
    columns = [c for c in docs.columns if c.lower() not in {counted.lower(), dropped.lower()}]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    own_key, own_hash, own_text, gone = unused(columns, "line_key", "line_hash", "line_text", "line_gone")
    lines = template_lines(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body")), depth)
    shared = lines.groupBy("_leaf").agg(F.min("_text").alias("_a"), F.max("_text").alias("_b")).filter("_a <> _b").select("_leaf")
    # written first, so that the join has an exchange on either side, whose large partitions Spark can split
    shared = checkpointed(shared)
    held = checkpointed(lines.join(shared, "_leaf", "left_semi"))
    # the lines themselves stay behind from here on
    named = held.select("_key", "_text", "_pos", "_n", "_leaf", "_h").join(checkpointed(templates(held, similarity)), ["_leaf", "_h"])
    named = checkpointed(named.select("_key", "_text", "_pos", "_n", "_template"))
    # a row for each template and text before the texts are counted, so a frequent line is no one task's work
    enough = F.when(F.col("_n") > long_words, F.least(F.lit(2), F.lit(min_docs))).otherwise(min_docs)
    recurring = named.groupBy("_template", "_text").agg(F.min("_key").alias("_key"), F.min("_n").alias("_n")).groupBy("_template").agg(F.count(F.lit(1)).alias("_docs"), F.min("_n").alias("_n"), F.min(F.struct("_key", "_text")).alias("_first")).filter(F.col("_docs") >= enough).select("_template", F.col("_first._text").alias("_keeper"))
    recurring = checkpointed(recurring)
    drops = named.join(recurring, "_template").filter("_text <> _keeper").groupBy("_key", "_text").agg(F.array_sort(F.collect_set("_pos")).alias(gone)).withColumnsRenamed({"_key": own_key, "_text": own_text})
    whole = docs.withColumn(own_hash, F.xxhash64(F.col(f"`{text}`")))
    out = whole.join(drops, F.col(f"`{key}`").eqNullSafe(F.col(own_key)) & (F.col(own_hash) == F.col(own_text)), "left")
    split = F.split(F.col(f"`{text}`"), "\n")
    left = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.filter(split, lambda line, at: ~F.array_contains(F.col(gone), at)), "\n"))
    count = F.coalesce(F.size(F.filter(split, lambda line: line.rlike(r"\S"))), F.lit(0)).cast("long")
    return out.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in columns], count.alias(counted), F.coalesce(F.col(gone), F.array().cast("array<int>")).alias(dropped))


SQL = r"""
WITH l AS (
  SELECT doc_id, text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc_id, text, pos, list_transform(list_filter(regexp_split_to_array(raw, '\s+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l
), m AS (
  SELECT *, len(w) AS n, array_to_string(w, ' ') AS line, array_to_string(w[1:3], ' ') AS head FROM t WHERE len(w) > 0
), shared AS (
  SELECT n, head FROM m GROUP BY 1, 2 HAVING count(DISTINCT text) > 1
), held AS (
  SELECT m.* FROM m JOIN shared USING (n, head)
), leads AS (
  SELECT n, head, list_reduce(list_transform(list_sort(list(DISTINCT line)), lambda x: [x]), lambda found, x:
    CASE WHEN len(list_filter(found, lambda lead: list_sum(list_transform(list_zip(string_split(lead, ' '), string_split(x[1], ' ')), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) >= 0.85::DOUBLE * n)) > 0 THEN found ELSE list_concat(found, x) END) AS found
  FROM held GROUP BY 1, 2
), named AS (
  SELECT held.*, list_filter(found, lambda lead: list_sum(list_transform(list_zip(held.w, string_split(lead, ' ')), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) >= 0.85::DOUBLE * n)[1] AS template
  FROM held JOIN leads USING (n, head)
), recurring AS (
  SELECT n, head, template, arg_min(text, doc_id) AS keeper FROM named GROUP BY 1, 2, 3 HAVING count(DISTINCT text) >= CASE WHEN n > 20 THEN 2 ELSE 3 END
), dropped AS (
  SELECT doc_id, named.text, list_sort(list(DISTINCT pos)) AS gone FROM named JOIN recurring USING (n, head, template) WHERE named.text <> keeper GROUP BY 1, 2
), lines AS (
  SELECT d.doc_id, d.text, x.gone, string_split(d.text, chr(10)) AS all_lines FROM documents d LEFT JOIN dropped x ON d.doc_id = x.doc_id AND d.text = x.text
)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(all_lines)), lambda k: NOT list_contains(gone, CAST(k AS INTEGER))), lambda k: all_lines[k + 1]), chr(10)) END AS text,
  CAST(coalesce(len(list_filter(all_lines, lambda x: regexp_matches(x, '\S'))), 0) AS BIGINT) AS n_lines,
  coalesce(array_to_string(gone, ','), '') AS dropped_lines
FROM lines
"""
