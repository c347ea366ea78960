"""Readers, writers and ingestion jobs."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordering import along, join_same
from ..operators import content as C, detect as D, quality as Q
from ..operators import privacy as K
from ..functions import strategies as R
from ..functions.spans import lookup
from ..session import cut

FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "orc": "orc", "avro": "avro",
           "text": "text", "binary": "binaryFile"}
COMPRESSIONS = {"none", "gzip", "zstd", "lz4", "snappy", "brotli"}


def read_dataset(spark: SparkSession, path: str, fmt: str, schema: str | None = None, **options) -> DataFrame:
    """Open a dataset in a declared format; compression is recognised from the files."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; supported: {sorted(FORMATS)}")
    reader = spark.read.format(FORMATS[fmt]).options(**options)
    if schema and FORMATS[fmt] not in ("text", "binaryFile"):
        reader = reader.schema(schema)
    return reader.load(path)


def write_dataset(df: DataFrame, path: str, fmt: str, compression: str = "none", partition_by: list[str] = (), mode: str = "errorifexists", **options) -> None:
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression!r}")
    writer = df.write.format(FORMATS[fmt]).mode(mode).options(**options)
    if compression != "none":
        writer = writer.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def import_jsonl(spark: SparkSession, path: str, continue_on_error: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of non-blank lines, and the malformed lines with file and 1-based line number.

    Lines are numbered per file from the line counts of its blocks, so a huge file stays split.
    Without ``continue_on_error`` a malformed line fails the job that reads the good part."""
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    numbered = along(raw, ["file"], ["seq"], F.col("block"), position="line_number").drop("seq", "block")
    # parsed inside brackets, so that text after the first value makes a line malformed
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit("]")))
    single = F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 1
    parsed = numbered.filter(F.trim("line") != "").withColumn("payload", F.when(single, F.try_variant_get(wrapped, "$[0]", "variant")))
    bad = parsed.filter(F.col("payload").isNull()).select("file", "line_number", "line", F.lit("malformed JSON").alias("error"))
    good = parsed.filter(F.col("payload").isNotNull()) if continue_on_error else parsed.withColumn(
        "payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("malformed JSON at line "), F.col("line_number").cast("string")))))
    return good.select("file", "line_number", "line", "payload"), bad


def ingest_validated(df: DataFrame, column: str, schema: Q.Schema) -> tuple[DataFrame, DataFrame]:
    checked = Q.validate_json(df, column, schema)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def ingest_counts(df: DataFrame, column: str, schema: Q.Schema, by: list[str]) -> DataFrame:
    checked = Q.validate_json(df, column, schema)
    bad = F.size("errors") > 0
    return checked.groupBy(*by).agg(F.count_if(~bad).alias("added"), F.count_if(bad).alias("rejected"),
                                    F.sum(F.size("errors")).alias("errors"))


def ingest_idempotent(df: DataFrame, keys: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The first record per key that the dataset does not hold yet. ``min_by`` combines before
    the shuffle, so a key with many repeats costs one row per partition."""
    fresh = df if existing is None else join_same(df, existing.select(*keys).distinct(), keys, "left_anti")
    row = F.struct(*[c for c in df.columns if c not in keys])
    first = fresh.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return first.select(*keys, "r.*").select(*df.columns)


def _listed(spark: SparkSession, path: str, include: str, exclude: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(path)
    if exclude:
        name = F.substring_index("path", "/", -1)
        files = files.filter(~name.rlike(fnmatch.translate(exclude).replace(r"\Z", "$").replace("(?s:", "(?:")))
    return files


def _capped(max_mb: int | None) -> Column:
    return F.lit(True) if max_mb is None else F.col("length") <= max_mb * 1024 * 1024


def scan_files(spark: SparkSession, path: str, include: str = "*", exclude: str | None = None, max_mb: int | None = 10,
               config: D.DetectConfig = D.DetectConfig()) -> DataFrame:
    """Detections in files below a folder, by name globs and size cap (None: every file). The cap is applied to
    the listing, before contents are read; ``file_report`` lists what it leaves out. Bytes that
    are no UTF-8 become U+FFFD."""
    files = _listed(spark, path, include, exclude).filter(_capped(max_mb))
    return D.detect(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")), "text", ["path"], config)


def file_report(spark: SparkSession, path: str, include: str = "*", exclude: str | None = None, max_mb: int | None = 10,
                config: D.DetectConfig = D.DetectConfig()) -> DataFrame:
    """One row per file: path, length, scanned, hits, error ("too large", "not UTF-8" or null).
    Without a cap (None) every file is scanned."""
    small = _capped(max_mb)
    files = _listed(spark, path, include, exclude)
    read = files.filter(small).select("path", "length", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    hits = D.with_spans(read, "text", config).select("path", "length", F.lit(True).alias("scanned"), F.size("spans").cast("bigint").alias("hits"), F.when(~F.col("valid"), "not UTF-8").alias("error"))
    large = files.filter(~small).select("path", "length", F.lit(False).alias("scanned"), F.lit(0).cast("bigint").alias("hits"), F.lit("too large").alias("error"))
    return hits.unionByName(large)


def export(df: DataFrame, path: str, fields: list[str], where: str | Column, order: list, fmt: str = "parquet", compression: str = "none") -> None:
    write_dataset(df.filter(where).select(*fields).orderBy(*order), path, fmt, compression)


def put_content(df: DataFrame, payload: str, store_path: str) -> DataFrame:
    """Append unknown payloads to the store, partitioned by hash shard; returns the rows added."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(store_path).select("hash")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "hash string")
    fresh = C.new_content(df, payload, known)
    # ranges of the hash are even, touch few folders each and give files narrow hash bounds; a
    # folder is one digit wide, the four-character shard is a column
    folders = fresh.withColumn("folder", F.substring("hash", 1, 1)).repartitionByRange("hash").sortWithinPartitions("hash")
    added = cut(folders)  # what is new must not be asked again once it is stored
    added.write.mode("append").partitionBy("folder").parquet(store_path)
    return added.drop("folder")


def write_audit(df: DataFrame, path: str, time_col: str, mode: str = "append") -> None:
    """Rows partitioned by month. Ranges of time keep files few, and split a busy month."""
    dated = df.withColumn("month", F.date_format(time_col, "yyyy-MM")).repartitionByRange("month", time_col)
    dated.write.mode(mode).partitionBy("month").parquet(path)


def read_audit(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Months in a range; other partitions are not listed for reading."""
    return spark.read.parquet(path).filter(F.col("month").between(first, last))


def locate_hits(df: DataFrame, text: str, keys: list[str], config: D.DetectConfig = D.DetectConfig()) -> DataFrame:
    """Detections with 1-based line and column."""
    spans = D.with_spans(df.select(*keys, text), text, config).select(*keys, text, F.explode("spans").alias("s"))
    before = F.substring(F.col(text), F.lit(1), F.col("s.start"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    p = config.patterns
    return spans.select(*keys, lookup(p, "pii_type", F.col("s.ord")).alias("pii_type"), line.alias("line"), column.alias("column"),
                        F.col("s.value").alias("value"), lookup(p, "risk", F.col("s.ord")).alias("risk"))


def scan_report(hits: DataFrame, fmt: str, path: str | None = None) -> DataFrame:
    """Summary per type and over all (type "*", a row also for a clean corpus) with the fail flag,
    or the hits themselves written as JSON or CSV (``read_report`` reads them back)."""
    if fmt == "summary":
        counts = [F.count("*").alias("hits"), F.max("risk").alias("max_risk")]
        whole = hits.groupBy("pii_type").agg(*counts).unionByName(hits.agg(*counts).withColumn("pii_type", F.lit("*")))
        return whole.withColumn("failed", F.col("hits") > 0)
    hits.write.mode("errorifexists").format(fmt).options(**(_CSV if fmt == "csv" else {})).save(path)
    return hits


#: Values may hold quotes, line ends and blanks at either end; an empty value is no null.
_CSV = {"header": True, "escape": '"', "quoteAll": True, "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def read_report(spark: SparkSession, fmt: str, path: str, keys: str = "doc_id bigint") -> DataFrame:
    """The hits of a written scan report."""
    schema = f"{keys}, pii_type string, line int, column int, value string, risk int"
    return spark.read.schema(schema).format(fmt).options(**(_CSV if fmt == "csv" else {})).load(path)


def anonymized_export(df: DataFrame, fields: list[str], cohort: Column, time_col: str, precision: str, pseudonym: str, key: str,
                      hierarchies: dict[str, list[Callable]], k: int, max_suppress: float = 0.05) -> DataFrame:
    """Cohort filter, field minimisation, coarse times, pseudonyms, then k-anonymity."""
    slim = df.filter(cohort).select(*fields).withColumn(time_col, F.date_trunc(precision, time_col))
    hidden = slim.withColumn(pseudonym, R.hmac_sha256(F.col(pseudonym), key))
    return K.k_anonymise(hidden, hierarchies, k, max_suppress)
