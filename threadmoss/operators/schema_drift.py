"""Records whose fields drift from file to file: one consistent table and a report of every change.

Tagged-union inference: payloads are parsed as variants inside the JVM; per path, into objects and lists of any depth, the
kinds of value that occur are kept side by side as alternatives (whole, fraction, text, truth, object, list).  The table has
each field's value in the typed branch it came in, next to one canonical conversion, and the reports name each alternative
that appears.  Schemas of files are fused by map-side aggregation, so a file or station of any size reduces to a few rows
before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .neighbours import with_previous

Names = dict[str, tuple[str, ...]]

#: other names stations use for catalogued fields, compared without case and punctuation
ALIASES: Names = {
    "shift_x": ("shiftx", "xshift", "offsetx", "xoffset", "dx", "deltax"),
    "crop_t": ("cropt", "croptop", "roitop", "top"),
    "image": ("image", "img", "rawimage", "frameimage", "imageblob"),
}
KINDS = ("whole", "fraction", "text", "truth", "list", "object")


def folded(name: Column) -> Column:
    """A name without case and punctuation."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def field_names(catalogue: DataFrame, aliases: Names = ALIASES) -> DataFrame:
    """folded name -> catalogued field; a field's own folded name wins over an alias of another."""
    own = catalogue.select(folded(F.col("field")).alias("_folded"), "field", F.lit(0).alias("rank"))
    other = F.create_map(F.lit(""), F.array(F.lit("")), *[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    more = catalogue.select(F.explode(other[F.col("field")]).alias("_folded"), "field", F.lit(1).alias("rank"))
    return own.unionByName(more).groupBy("_folded").agg(F.min_by("field", F.struct("rank", "field")).alias("field"))


def value_kind(type_text: Column) -> Column:
    """One of KINDS from a variant's type, null for a JSON null."""
    big = type_text.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return (
        F.when(type_text.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$") | big, "whole").when(type_text.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "fraction")
        .when(type_text == "STRING", "text").when(type_text == "BOOLEAN", "truth").when(type_text.startswith("ARRAY"), "list").when(type_text.startswith("OBJECT"), "object")
    )


def entries(records: DataFrame, catalogue: DataFrame, aliases: Names = ALIASES) -> DataFrame:
    """One row per record and key: record_id, file_no, station, written_at, line_no, name, field, kind, value (variant).

    Only payloads that are valid JSON objects count; nulls, broken and non-object payloads give no row.
    """
    v = records.select("record_id", "file_no", "station", "written_at", "line_no", F.try_parse_json("payload").alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    v = v.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(
        "record_id", "file_no", "station", "written_at", "line_no", F.col("key").alias("name"), value_kind(F.schema_of_variant("value")).alias("kind"), "value"
    )
    return v.withColumn("_folded", folded(F.col("name"))).join(field_names(catalogue, aliases), "_folded", "left").withColumn("field", F.coalesce("field", "name")).drop("_folded")


def file_schemas(records: DataFrame, catalogue: DataFrame, aliases: Names = ALIASES) -> DataFrame:
    """Per file and field: station, written_at, the spellings and the kinds that occur, both sorted."""
    e = entries(records, catalogue, aliases).groupBy("station", "file_no", "written_at", "field", "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("station", "file_no", "field").agg(
        F.min("written_at").alias("written_at"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n_values")
    )


def schema_changes(records: DataFrame, catalogue: DataFrame, aliases: Names = ALIASES) -> DataFrame:
    """file_no, field, change (added, removed, renamed, retyped), old, new: each file against its station's file before.

    Files of a station are ordered by written_at, then file_no.  A file with no valid record has an empty schema; a
    station's first file has no changes.  retyped compares with the last earlier file that shows a non-null value.
    """
    fields = Scratch(records.sparkSession, "drift").save(file_schemas(records, catalogue, aliases), "schemas")  # read three times
    files = records.where("station is not null and file_no is not null and written_at is not null").groupBy("station", "file_no").agg(F.min("written_at").alias("written_at"))
    day = F.floor(F.unix_micros(F.col("written_at").cast("timestamp")) / F.lit(7 * 86_400_000_000))
    chain = with_previous(files, ["station"], ["written_at", "file_no"], day, ["file_no"]).where("previous is not null").select("station", "file_no", "written_at", F.col("previous.file_no").alias("before_no"))
    now = chain.join(fields.drop("written_at"), ["station", "file_no"]).select("file_no", "field", "names", "kinds")
    old = chain.join(fields.select("station", F.col("file_no").alias("before_no"), "field", F.col("names").alias("old_names")), ["station", "before_no"]).select("file_no", "field", "old_names")
    shown = fields.where(F.size("kinds") > 0)
    last = with_previous(shown, ["station", "field"], ["written_at", "file_no"], day, ["kinds"]).select("file_no", "field", F.col("previous.kinds").alias("old_kinds"))
    both = now.join(old, ["file_no", "field"], "full").join(last, ["file_no", "field"], "left")
    text = lambda c: F.array_join(c, "|")
    one = lambda cond, change, a, b: F.when(cond, F.struct(F.lit(change).alias("change"), a.alias("old"), b.alias("new")))
    none = F.lit(None).cast("string")
    there = F.col("names").isNotNull() & F.col("old_names").isNotNull()
    found = F.array_compact(F.array(
        one(F.col("old_names").isNull(), "added", none, text(F.col("names"))), one(F.col("names").isNull(), "removed", text(F.col("old_names")), none),
        one(there & (F.col("names") != F.col("old_names")), "renamed", text(F.col("old_names")), text(F.col("names"))),
        one(there & (F.size("kinds") > 0) & F.col("old_kinds").isNotNull() & (F.col("kinds") != F.col("old_kinds")), "retyped", text(F.col("old_kinds")), text(F.col("kinds"))),
    ))
    return both.select("file_no", "field", F.explode(found).alias("c")).select("file_no", "field", "c.*")


def _number(v: Column) -> Column:
    """The number a value stands for: itself, the first of a list, an object's value or id, or the digits of a text."""
    text = F.try_variant_get(v, "$", "string")
    digits = F.regexp_extract(F.regexp_replace(text, ",", "."), r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0)
    from_text = F.when(digits != "", digits.try_cast("double"))
    return F.coalesce(*[F.try_variant_get(v, p, "double") for p in ("$[0]", "$.value", "$.id")], from_text)


#: alternatives that an object or list can't hold apart are kept as JSON text
_BRANCHES = {"whole": "bigint", "fraction": "double", "text": "string", "truth": "boolean"}


def _branch() -> Column:
    """The value in the typed branch of its kind: whole, fraction, text, truth, or json for a list or object."""
    kind = F.col("kind")
    typed = [F.when(kind == k, F.try_variant_get("value", "$", t)).alias(k) for k, t in _BRANCHES.items()]
    return F.struct(*typed, F.when(kind.isin("list", "object"), F.to_json("value")).alias("json"))


def unified_table(records: DataFrame, catalogue: DataFrame, aliases: Names = ALIASES) -> DataFrame:
    """One row per valid record with every catalogued field in its catalogued type, ``<field>_kind``, the alternative it came in, and ``<field>_branch``.

    ``<field>_branch`` has one typed column per alternative (whole, fraction, text, truth, and json for lists and objects), of
    which the one that occurred is filled; it is null where the field is absent or null.  A value that can't be converted (a bare truth value, a text without digits) is null with its kind kept.  Fields that the
    catalogue doesn't know are kept as JSON text in the map ``other``.  If a record has a catalogued field in several
    spellings, its column holds the largest value, and ``other`` every spelling with its own.  Repeated lines stay repeated.
    """
    e = entries(records, catalogue, aliases).withColumn("_branch", F.when(F.col("kind").isNotNull(), _branch()))
    # the catalogue is fixed and small: eleven rows of names and types
    wanted = [(r["field"], r["data_type"]) for r in catalogue.select("field", "data_type").orderBy("field").collect()]
    kind_of = lambda f: F.max(F.when(F.col("field") == f, F.col("kind")))
    value = {"string": lambda v: F.try_variant_get(v, "$", "string")}
    outs = []
    for f, kind in wanted:
        got = value.get(kind, _number)(F.col("value"))
        cast = {"int": lambda c: F.round(c).cast("bigint"), "double": lambda c: c.cast("double")}.get(kind, lambda c: c)
        outs += [F.max(F.when((F.col("field") == f) & (F.col("kind") != "truth"), cast(got))).alias(f), kind_of(f).alias(f"{f}_kind"), F.max(F.when(F.col("field") == f, F.col("_branch"))).alias(f"{f}_branch")]
    known = [f for f, _ in wanted]
    every = F.array_sort(F.collect_list(F.struct("name", "field", F.to_json("value").alias("v"))))
    left = lambda x: ~x["field"].isin(known) | (F.size(F.filter("_every", lambda y: y["field"] == x["field"])) > 1)
    other = F.map_from_entries(F.transform(F.filter("_every", left), lambda x: F.struct(x["name"], x["v"])))
    return e.groupBy("record_id", "file_no", "station", "line_no").agg(*outs, every.alias("_every")).withColumn("other", other).drop("_every")


def path_alternatives(records: DataFrame, catalogue: DataFrame, aliases: Names = ALIASES) -> DataFrame:
    """station, path, kind, n_values, n_files, first_file_no: every alternative of every path of a station, and the file that showed it first.

    A path is the field, then ``.key`` for a key of an object and ``[]`` for the entries of a list, to any depth.  Nulls are no
    alternative.  The first file is the earliest by written_at, then file_no.
    """
    scratch = Scratch(records.sparkSession, "paths")
    level = entries(records, catalogue, aliases).select("station", "file_no", "written_at", F.col("field").alias("path"), "kind", "value")
    counted, depth = [], 0
    while True:
        # values below a level are few: those of objects and lists
        counted.append(level.where("kind is not null").groupBy("station", "path", "kind", "file_no").agg(F.count(F.lit(1)).alias("n"), F.min("written_at").alias("written_at")))
        nested = level.where("kind in ('object', 'list')").select("station", "file_no", "written_at", "path", "kind", "value")
        nested = scratch.save(nested, f"nested-{depth}")
        if nested.isEmpty():
            break
        inner = nested.withColumnRenamed("value", "v")
        inner = inner.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("kind") == "list", F.lit("[]")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select("station", "file_no", "written_at", F.concat("path", step).alias("path"), value_kind(F.schema_of_variant("value")).alias("kind"), "value")
        depth += 1
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    return every.groupBy("station", "path", "kind").agg(F.sum("n").alias("n_values"), F.count_distinct("file_no").alias("n_files"), F.min_by("file_no", F.struct("written_at", "file_no")).alias("first_file_no"))


def as_json(other: Column) -> Column:
    """A map of JSON texts as one JSON object, its keys in the map's order."""
    key = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(other), lambda x: F.concat(key(x["key"]), F.lit(":"), F.coalesce(x["value"], F.lit("null")))), ","), F.lit("}"))
