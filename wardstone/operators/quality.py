"""Schema validation, constraints, keys, JSON limits, statistics and quality metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import bind


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, integer, float, boolean, timestamp, date, json, binary, array<kind>, struct, enum
    nullable: bool = True
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    one_of: tuple | None = None


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    strict: bool = False


def _error(test: Column, name: str, constraint: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(constraint).alias("constraint")))


def constraint_errors(field: Field, text: Column, number: Column) -> list[Column]:
    """``text`` is null unless the value is a string, ``number`` unless it is a number."""
    out = []
    if field.min_length is not None:
        out.append(_error(F.length(text) < field.min_length, field.name, "min_length"))
    if field.max_length is not None:
        out.append(_error(F.length(text) > field.max_length, field.name, "max_length"))
    if field.pattern is not None:
        out.append(_error(~text.rlike(field.pattern), field.name, "pattern"))
    if field.min_value is not None:
        out.append(_error(number < field.min_value, field.name, "min_value"))
    if field.max_value is not None:
        out.append(_error(number > field.max_value, field.name, "max_value"))
    if field.one_of is not None:
        out.append(_error(~F.coalesce(text, number.cast("string")).isin([str(x) for x in field.one_of]), field.name, "one_of"))
    return out


#: RFC 3339: a time without an offset names no instant.
OFFSET_TIME = r"^[0-9-]+[Tt ][0-9:.]+([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def _kind_ok(field: Field, kind: Column, node: Column) -> Column:
    text = F.try_variant_get(node, "$", "string")
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    base = field.kind.split("<")[0]
    if base == "array":
        items = F.try_variant_get(node, "$", "array<variant>")
        inner = Field(field.name, field.kind[6:-1], one_of=field.one_of)
        return kind.startswith("ARRAY") & F.forall(items, lambda x: _kind_ok(inner, F.schema_of_variant(x), x))
    return {
        "string": kind == "STRING", "binary": kind == "STRING", "integer": kind == "BIGINT", "float": number,
        "boolean": kind == "BOOLEAN", "json": kind.startswith("OBJECT"), "struct": kind.startswith("OBJECT"),
        "timestamp": (kind == "STRING") & text.rlike(OFFSET_TIME) & F.try_to_timestamp(text).isNotNull(),
        "date": (kind == "STRING") & text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & text.try_cast("date").isNotNull(),
        "enum": (kind == "STRING") & text.isin([str(x) for x in field.one_of or ()]),
    }[base]


def validate_json(df: DataFrame, column: str, schema: Schema) -> DataFrame:
    """Add ``errors``: array of (field, constraint) for a JSON text column.

    The text is parsed once into a map of its top-level fields (null unless it is an object),
    and every checked field is typed once."""
    members = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")
    parsed = bind(df, "__m", members)

    def cell(f: Field) -> Column:
        node = F.try_element_at("__m", F.lit(f.name))
        return F.struct(node.alias("node"), F.schema_of_variant(node).alias("kind"), F.map_contains_key("__m", f.name).alias("present"))

    typed = bind(parsed, "__f", F.struct(*[cell(f).alias(f"f{i}") for i, f in enumerate(schema.fields)]))
    checks: list[Column] = []
    for i, f in enumerate(schema.fields):
        node, kind, present = (F.col(f"__f.f{i}.{x}") for x in ("node", "kind", "present"))
        null = present & (node.isNull() | (kind == "VOID"))
        text = F.when(kind == "STRING", F.try_variant_get(node, "$", "string"))
        number = F.when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT"), F.try_variant_get(node, "$", "double"))
        if not f.nullable:
            checks.append(_error(~present, f.name, "required"))
            checks.append(_error(null, f.name, "nullable"))
        filled = present & ~null
        checks.append(_error(filled & ~_kind_ok(f, kind, node), f.name, "type"))
        checks += [F.when(filled, e) for e in constraint_errors(f, text, number)]
    found = F.array_compact(F.array(*checks))
    if schema.strict:
        known = [f.name for f in schema.fields]
        extra = F.transform(F.filter(F.map_keys("__m"), lambda n: ~n.isin(known)), lambda n: F.struct(n.alias("field"), F.lit("unknown_field").alias("constraint")))
        found = F.concat(found, extra)
    whole = F.array(F.struct(F.lit("").alias("field"), F.lit("type").alias("constraint")))
    errors = F.when(F.col("__m").isNotNull(), found).otherwise(whole)
    return bind(typed, "errors", errors).drop("__m", "__f")


def validate_columns(df: DataFrame, schema: Schema) -> DataFrame:
    """The same checks on typed columns."""
    kinds = dict(df.dtypes)
    types = {"string": ("string",), "binary": ("string", "binary"), "integer": ("bigint", "int", "smallint", "tinyint"),
             "float": ("double", "float", "bigint", "int"), "boolean": ("boolean",), "timestamp": ("timestamp", "timestamp_ntz"),
             "date": ("date",), "enum": ("string",)}
    checks: list[Column] = []
    for f in schema.fields:
        if f.name not in kinds:
            if not f.nullable:
                checks.append(_error(F.lit(True), f.name, "required"))
            continue
        c, kind = F.col(f.name), kinds[f.name]
        if not f.nullable:
            checks.append(_error(c.isNull(), f.name, "nullable"))
        if f.kind in types and kind not in types[f.kind]:
            checks.append(_error(c.isNotNull(), f.name, "type"))
        text = c if kind == "string" else F.lit(None).cast("string")
        number = c.cast("double") if kind in ("bigint", "int", "double", "float", "smallint") else F.lit(None).cast("double")
        checks += constraint_errors(f, text, number)
    if schema.strict:
        known = {f.name for f in schema.fields}
        checks += [_error(F.lit(True), c, "unknown_field") for c in df.columns if c not in known]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def error_rows(validated: DataFrame, keys: list[str]) -> DataFrame:
    return validated.select(*keys, F.explode("errors").alias("e")).select(*keys, "e.field", "e.constraint")


def constraint_counts(validated: DataFrame) -> DataFrame:
    return error_rows(validated, []).groupBy("field", "constraint").agg(F.count("*").alias("violations"))


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def check_foreign_key(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def delete_parents(child: DataFrame, key: str, doomed: DataFrame, action: str) -> DataFrame:
    """The child table after deleting parents: cascade drops rows, set_null clears the key,
    restrict and no_action report the blocking rows."""
    gone = doomed.select(F.col(doomed.columns[0]).alias(key)).distinct()
    if action == "cascade":
        return child.join(gone, key, "left_anti")
    if action == "set_null":
        flagged = child.join(gone.withColumn("__gone", F.lit(True)), key, "left")
        return flagged.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone").select(*child.columns)
    return child.join(gone, key, "left_semi")


def json_nodes(df: DataFrame, column: str, keys: list[str], max_depth: int) -> DataFrame:
    """Every node of a JSON document: path, depth, kind. One generator per nesting level."""
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("node"))
    out = None
    for depth in range(max_depth + 1):
        kind = F.schema_of_variant("node")
        here = level.select(*keys, "path", F.lit(depth).alias("depth"), kind.alias("kind"), "node").filter(F.col("kind").isNotNull())
        out = here if out is None else out.unionByName(here)
        inner = here.filter(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        step = inner.select(*keys, F.col("path").alias("__p"), "node").lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        name = F.coalesce(F.col("key"), F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        level = step.select(*keys, F.concat(F.when(F.col("__p") == "", "").otherwise(F.concat("__p", F.lit("."))), name).alias("path"), F.col("value").alias("node"))
    return out


def json_limits(df: DataFrame, column: str, keys: list[str], max_depth: int = 32, max_array: int = 10_000, max_string: int = 1_000_000) -> DataFrame:
    """Violations of depth, array length and string length, one row per node at fault.

    Levels are walked one past the limit; what lies deeper is already in violation."""
    nodes = json_nodes(df, column, keys, max_depth + 1)
    text = F.try_variant_get("node", "$", "string")
    size = F.size(F.try_variant_get("node", "$", "array<variant>"))
    rule = (F.when(F.col("depth") > max_depth, "max_depth")
            .when(F.col("kind").startswith("ARRAY") & (size > max_array), "max_array_length")
            .when((F.col("kind") == "STRING") & (F.octet_length(text) > max_string), "max_length"))
    return nodes.select(*keys, "path", "depth", rule.alias("rule")).filter(F.col("rule").isNotNull())


def dataset_stats(df: DataFrame, dataset: str, size: Column, entities: str) -> DataFrame:
    return df.groupBy(dataset).agg(
        F.count("*").alias("records"), F.sum(size).alias("bytes"), F.round(F.avg(size), 6).alias("mean_bytes"),
        F.max(size).alias("max_bytes"), F.count_if(F.col(entities) > 0).alias("pii_records"))


def access_stats(log: DataFrame, dataset: str, time_col: str, now: Column) -> DataFrame:
    return log.groupBy(dataset).agg(
        F.max(time_col).alias("last_access"), F.count("*").alias("queries"),
        F.count_if(F.col(time_col) > now - F.expr("INTERVAL 24 HOURS")).alias("queries_24h"))


def field_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Per column: filled, null, distinct, min, max, mean. The numbers of all columns come from
    one aggregate; exact distinct counts from one aggregate over (column, value) pairs."""
    kinds = dict(df.dtypes)
    numeric = {c for c in columns if kinds[c] in ("bigint", "int", "double", "float", "smallint")}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v"),
                 (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")) for c in columns])).alias("r")).select("r.*")
    distinct = F.approx_count_distinct("v") if not exact else F.count_distinct("v")
    return long.groupBy("field").agg(
        F.count("v").alias("non_null"), F.count_if(F.col("v").isNull()).alias("nulls"), distinct.alias("distinct_values"),
        F.min("v").alias("min_text"), F.max("v").alias("max_text"), F.min("x").alias("min_value"), F.max("x").alias("max_value"),
        F.round(F.avg("x"), 4).alias("mean_value"))


def quality_metrics(df: DataFrame, required: list[str], schema: Schema, key: str, parent: DataFrame, parent_key: str,
                    time_col: str, fresh_after: Column) -> DataFrame:
    """Completeness, validity, consistency (keys that resolve), timeliness and their mean."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in required), F.lit(0)) / len(required)
    checked = validate_columns(df, schema)
    known = parent.select(F.col(parent_key).alias(key), F.lit(1).alias("__ok")).distinct()
    joined = checked.join(known, key, "left")
    out = joined.agg(
        F.avg(filled).alias("c"), F.avg((F.size("errors") == 0).cast("int")).alias("v"),
        F.avg(F.coalesce("__ok", F.lit(0))).alias("k"), F.avg((F.col(time_col) >= fresh_after).cast("int")).alias("t"))
    return out.select(
        F.round("c", 6).alias("completeness"), F.round("v", 6).alias("validity"), F.round("k", 6).alias("consistency"),
        F.round("t", 6).alias("timeliness"), F.round((F.col("c") + F.col("v") + F.col("k") + F.col("t")) / 4, 6).alias("overall"))
