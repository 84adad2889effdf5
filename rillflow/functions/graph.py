"""Knowledge-graph reshaping: Wikidata items, triples, relations, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.base import Op
from rillflow.operators.edit import lookup
from rillflow.records import kind_of, plain

#: Languages of names in the order of preference, and sites of which one link is kept: fixed values.
LANGUAGES = ["zh-cn", "zh-hans", "zh", "zh-hk", "zh-tw", "zh-hant", "en"]
SITES = ["zhwiki", "enwiki"]
DROPPED = ["type", "title", "ns", "pageid"]


def get_name(labels: Column, kind: T.DataType) -> Column:
    """The label in the preferred language, else any. labels: MAP<lang, STRUCT<value>> or MAP<lang, STRING>; text passes."""
    if not isinstance(kind, T.MapType):
        return labels
    value = (lambda c: c["value"]) if isinstance(kind.valueType, T.StructType) else lambda c: F.transform(c, lambda x: x["value"]) if isinstance(kind.valueType, T.ArrayType) else c
    return F.coalesce(*[value(F.try_element_at(labels, F.lit(k))) for k in LANGUAGES], value(F.get(F.map_values(labels), F.lit(0))))


class IDNameMap(Op):
    def __call__(self, df):
        return df.select("id", get_name(plain("labels"), kind_of(df, "labels")).alias("name"))


class Simplify(Op):
    """Names in one language, one site link, without page columns."""

    def __call__(self, df):
        for c in ("labels", "descriptions", "aliases"):
            if c in df.columns:
                df = df.withColumn(c, get_name(plain(c), kind_of(df, c)))
        if isinstance(kind_of(df, "sitelinks"), T.MapType):
            df = df.withColumn("sitelinks", F.coalesce(*[F.try_element_at("sitelinks", F.lit(s)) for s in SITES]))
        return df.drop(*DROPPED)


def snak_value(snak: Column) -> Column:
    """The value of a snak as text: an entity's id, or the value itself; null for no or an unknown value."""
    return F.when(snak["snaktype"] == "value", F.coalesce(snak["datavalue"]["value"]["id"], F.to_json(snak["datavalue"]["value"])))


def claim_rows(df: DataFrame) -> DataFrame:
    """(id, pid, claim) of each claim of MAP<pid, ARRAY<claim>>."""
    return df.select("id", F.explode("claims").alias("pid", "all")).select("id", "pid", F.explode("all").alias("claim"))


class Property(Op):
    """Rows for the values of claims and for those of their qualifiers."""

    def __call__(self, df):
        rows = claim_rows(df)
        item = rows.select(F.lit("item_property").alias("_type"), F.col("claim.id").alias("id"), F.col("id").alias("qid"), "pid", F.lit(None).cast("string").alias("ppid"), snak_value(F.col("claim.mainsnak")).alias("datavalue"))
        if "qualifiers" not in rows.schema["claim"].dataType.names:
            return item.filter("datavalue IS NOT NULL")
        inner = rows.select("claim.id", F.col("id").alias("qid"), "pid", F.explode("claim.qualifiers").alias("ppid", "snaks")).select("id", "qid", "pid", "ppid", F.explode("snaks").alias("snak"))
        prop = inner.select(F.lit("property_property").alias("_type"), "id", "qid", "pid", "ppid", snak_value(F.col("snak")).alias("datavalue"))
        return item.unionByName(prop).filter("datavalue IS NOT NULL")


class SimplifyProps(Op):
    """claims as MAP<pid, ARRAY<STRUCT<id, datatype, datavalue>>>."""

    def __call__(self, df):
        def simple(_, claims):
            kept = F.filter(claims, lambda c: snak_value(c["mainsnak"]).isNotNull())
            return F.transform(kept, lambda c: F.struct(c["id"].alias("id"), c["mainsnak"]["datavalue"]["type"].alias("datatype"), snak_value(c["mainsnak"]).alias("datavalue")))

        return df.withColumn("claims", F.transform_values("claims", simple))


class PropsFilter(Op):
    """Keep claims of the listed properties."""

    def __init__(self, props_set=None, props_set_file: str | None = None):
        self.props = set(props_set or ())
        if props_set_file:
            with open(props_set_file, encoding="utf8") as f:
                self.props |= {line.split(",")[0].strip() for line in f if line.strip()}

    def __call__(self, df):
        props = sorted(self.props)
        return df.withColumn("claims", F.map_filter("claims", lambda k, _: k.isin(props)))


class ValuesFilter(PropsFilter):
    """Keep claims whose entity is listed, and items that have such a claim."""

    def __call__(self, df):
        values = sorted(self.props)
        keep = F.map_filter(F.transform_values("claims", lambda _, v: F.filter(v, lambda c: (c["datatype"] == "wikibase-entityid") & c["datavalue"].isin(values))), lambda _, v: F.size(v) > 0)
        return df.withColumn("claims", keep).filter(F.size("claims") > 0)


class ObjectNameInject(Op):
    """Names of the entities in claims, from a dictionary or a (id, name) table: one join, then the claims again."""

    def __init__(self, cache: dict | DataFrame | None = None, **kwargs):
        self.cache = cache if cache is not None else kwargs

    def __call__(self, df):
        rows = df.select("id", F.explode("claims").alias("pid", "all")).select("id", "pid", F.posexplode("all").alias("at", "claim"))
        named = lookup(rows, F.when(F.col("claim.datatype").isin("item", "wikibase-entityid"), F.col("claim.datavalue").cast("string")), self.cache, "_name")
        claims = named.groupBy("id", "pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("claim").withField("labels", F.col("_name")).alias("c")))), lambda x: x["c"]).alias("all"))
        claims = claims.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pid", "all"))).alias("claims"))
        return df.drop("claims").join(claims, "id", "left")


class ItemAbstractInject(Op):
    """The abstract of (site, title), from {site: {title: abstract}} or a (site, title, abstract) table."""

    def __init__(self, cache: dict | DataFrame, target_key: str = "abstract", source_key: str = "sitelinks"):
        self.cache, self.target, self.source = cache, target_key, source_key

    def __call__(self, df):
        side = self.cache if isinstance(self.cache, DataFrame) else df.sparkSession.createDataFrame([(s, t, a) for s, x in self.cache.items() for t, a in x.items()], "site string, title string, abstract string")
        side = side.toDF("_site", "_title", self.target)
        at = plain(self.source)
        return df.drop(self.target).join(side, (at["site"] == F.col("_site")) & (at["title"] == F.col("_title")), "left").drop("_site", "_title")


class ChineseSimple(Op):
    """Simplified characters in some fields; pairs of characters are a parameter."""

    def __init__(self, keys=("labels", "descriptions", "abstract"), pairs: tuple[str, str] = ("", "")):
        self.keys, self.pairs = keys, pairs

    def __call__(self, df):
        return df.withColumns({k: F.translate(plain(k), *self.pairs) for k in self.keys if k in df.columns and isinstance(kind_of(df, k), T.StringType)})


class Entity(Op):
    """A summary of items that have labels and descriptions."""

    def __call__(self, df):
        name, desc = (get_name(plain(c), kind_of(df, c)) for c in ("labels", "descriptions"))
        return df.filter(F.col("labels").isNotNull() & F.col("descriptions").isNotNull()).select(F.substring("id", 2, 20).try_cast("long").alias("_id"), F.when(F.startswith("id", F.lit("P")), "property").otherwise("item").alias("_type"), "id", name.alias("name"), desc.alias("desc"))


class Relation(Op):
    """Edges from simplified claims: every entity that a claim names."""

    def __call__(self, df):
        rows = df.select("id", "labels", F.explode("claims").alias("relation", "all")).select("id", "labels", "relation", F.explode("all").alias("c")).filter(F.col("c.datatype").isin("item", "wikibase-entityid"))
        labelled = "labels" in rows.schema["c"].dataType.names
        return rows.select(F.concat_ws("-", "id", "relation", "c.datavalue").alias("_id"), F.col("id").alias("subject_id"), F.col("labels").alias("subject_name"), "relation", F.col("c.datavalue").alias("object_id"), (F.col("c.labels") if labelled else F.lit(None).cast("string")).alias("object_name"))


# --- triples


def compress_triples(df: DataFrame, e: str = "e", a: str = "a", v: str = "v", order: str | None = None) -> DataFrame:
    """One map of attributes for each entity; the last value of an attribute wins."""
    last = df.groupBy(e, a).agg((F.max_by(plain(v), plain(order)) if order else F.last(plain(v))).alias("_v"))
    return last.groupBy(e).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(plain(a), F.col("_v"))))).alias("attributes"))


def group2dict(df: DataFrame, subject: str = "h", predicate: str = "r", obj: str = "t", order: str | None = None) -> DataFrame:
    """For each subject a map of predicates to the list of their objects; triples without either are left out."""
    real = df.filter((F.length(plain(predicate)) > 0) & (F.length(plain(obj).cast("string")) > 0))
    o = plain(order) if order else F.lit(0)
    values = real.groupBy(subject, predicate).agg(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), plain(obj).alias("v")))), lambda x: x["v"]).alias("_all"))
    return values.groupBy(subject).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(plain(predicate), F.col("_all"))))).alias("properties"))


def triplets2dict(df: DataFrame, name: str, prop: str, value: str, order: str) -> DataFrame:
    """Runs of triples of one name: {_name, properties}."""
    from rillflow.ordered import runs

    return group2dict(runs(df, plain(name), [plain(order)], "_run").withColumn("_subject", F.struct("_run", plain(name).alias("name"))), "_subject", prop, value, order).select(F.col("_subject.name").alias("_name"), "properties")


def json_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """A left join in which the right side's fields win; rows of the right without a match are left out."""
    side = right.dropDuplicates([right_key]).select(*[plain(c).alias(f"_r_{c}") for c in right.columns])
    out = left.join(side, plain(left_key) == F.col(f"_r_{right_key}"), "left")
    cols = [F.when(F.col(f"_r_{right_key}").isNotNull(), F.col(f"_r_{c}")).otherwise(plain(c)).alias(c) if c in right.columns else plain(c) for c in left.columns]
    return out.select(*cols, *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns and c != right_key])


def dict2entity(df: DataFrame, name_key: str = "name", types_key: str = "type") -> DataFrame:
    """{name, types, properties} with the other fields as {values: [...]} under their names."""
    rest = [c for c in df.columns if c not in (name_key, types_key)]
    types = plain(types_key) if isinstance(kind_of(df, types_key), T.ArrayType) else F.array(plain(types_key))
    return df.select(plain(name_key).alias("name"), types.alias("types"), F.struct(*[F.struct((plain(c) if isinstance(kind_of(df, c), T.ArrayType) else F.array(plain(c))).alias("values")).alias(c) for c in rest]).alias("properties"))


# --- vectors


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_topk(df: DataFrame, query: list[float], k: int = 10, column: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k rows nearest to a query vector: a scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(plain(column), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    score = cosine(plain(column), q) if metric == "cosine" else dot if metric == "dot" else -F.sqrt(F.aggregate(F.zip_with(plain(column), q, lambda a, b: F.pow(a.cast("double") - b, 2)), F.lit(0.0), lambda s, v: s + v))
    return df.withColumn("score", score).orderBy(F.desc("score")).limit(k)


