"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of each source are put in a seeded random order; a row's fractional rank is its rank over
the size of its source. All rows sorted by fractional rank are a sequence in which every stretch
holds the sources in proportion, so equal cuts give shards with the mixture of the whole.

No source and no sequence is ever ranked in one task. Ranks count inside (source, leading hex
digits of the random key); what lies before comes from a summary of at most `16^digits` rows per
source. The second ranking needs no second pass: how many rows of a source of n rows fall below
a fraction follows from n alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Cells of the unit interval for the second ranking (a fixed number, so the cumulated summary
#: stays at this many rows whatever the input).
CELLS = 4096
#: Leading hex digits of the random key that bucket the first ranking.
DIGITS = 3


def random_key(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def shard(docs: DataFrame, shards: int, *, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard,
    slot (gapless from 0 inside the shard), grown_shard (null: the law is "rows").

    Law "rows": shard sizes differ by at most one row. A null source is a stratum of its own. A
    null text counts no bytes and has the CRC of the empty string; null ids are drawn like any
    other. Rows with equal ids are ordered by size and CRC; rows equal in all of these are
    interchangeable. An empty table gives an empty result; with fewer rows than shards some
    shards stay empty. Other input columns are not looked at, so their names cannot clash."""
    raw = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        random_key(seed, F.col(id_col)).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, DIGITS))
    tie = ["key", "doc_id", "size", "text_crc32"]

    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        F.substring(random_key(seed, F.col(id_col)), 1, DIGITS).alias("bucket"),
    )
    counts = own.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    along = W.partitionBy("stratum").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("stratum", "bucket", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("stratum")).alias("total"))
    ranked = rows.withColumn("local", F.row_number().over(W.partitionBy("stratum", "bucket").orderBy(*tie))).join(before, ["stratum", "bucket"])
    # rank r of n lies at (2r - 1) / 2n
    odd = 2 * (F.col("local") + F.col("before")) - 1
    placed = ranked.withColumn("odd", odd).withColumn("cell", F.expr(f"(odd * {CELLS}) div (2 * total)")).withColumn("at", F.col("odd") / (2 * F.col("total")))

    # rows of a source of n rows in cells before b: the r with (2r - 1) * CELLS < 2bn
    totals = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    below = totals.select("n", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    cells = below.groupBy(F.col("cell").cast("bigint").alias("cell")).agg(
        F.sum(F.expr(f"(2 * cell * n + {CELLS} + {2 * CELLS - 1}) div {2 * CELLS} - 1")).alias("cell_before"), F.sum("n").alias("rows"))
    local = F.row_number().over(W.partitionBy("cell").orderBy("at", "stratum", *tie))
    out = placed.withColumn("in_cell", local).join(cells, "cell")
    out = out.withColumn("position", F.col("in_cell") + F.col("cell_before") - 1)
    out = out.withColumn("shard", F.expr(f"(position * {shards}) div rows"))
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.substring("stratum", 2, 2**31 - 1).alias("stratum"),
    )


def shard_sql(shards: int, seed: str = "mix-1") -> str:
    """The same in DuckDB SQL, over `documents`. CRC-32 is computed bit by bit over the bytes."""
    return f"""
    WITH bits(c, k) AS (
      SELECT range::BIGINT, range::BIGINT FROM range(256)
    ), t8 AS (
      SELECT c, list_reduce(list_prepend(k, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
               lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM bits
    ), tab AS (SELECT list(v ORDER BY c) AS t FROM t8),
    h AS (
      SELECT d.doc_id, d.source, coalesce(octet_length(encode(d.text)), 0) AS n, hex(encode(coalesce(d.text, ''))) AS x, row_number() OVER () AS rid
      FROM documents d
    ), crc AS (
      SELECT rid, doc_id, source, n, xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda b: ('0x' || b)::BIGINT)),
               lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
      FROM h, tab
    ), r AS (
      SELECT *, coalesce('=' || source, '') AS stratum, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM crc
    ), k AS (
      SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, n, crc) AS rk, count(*) OVER (PARTITION BY stratum) AS total FROM r
    ), p AS (
      SELECT *, row_number() OVER (ORDER BY (2 * rk - 1)::DOUBLE / (2 * total)::DOUBLE, stratum, key, doc_id, n, crc) - 1 AS pos, count(*) OVER () AS rows FROM k
    )
    SELECT doc_id, (n + 16)::BIGINT AS size, crc AS text_crc32, 'rows' AS law, ((pos * {shards}) // rows)::INT AS shard,
      (pos - (((pos * {shards}) // rows) * rows + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, substr(stratum, 2) AS stratum
    FROM p"""
