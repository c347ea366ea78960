"""Content addresses, deduplication, chunks and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import along
from ..functions.spans import bind


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def content_address(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), content_hash(payload))


def storage_key(address: Column) -> Column:
    """``algo/abcd/rest`` from ``algo:hash``."""
    algo, h = F.substring_index(address, ":", 1), F.substring_index(address, ":", -1)
    return F.concat_ws("/", algo, F.substring(h, 1, 4), F.substring(h, 5, 128))


def parse_key(key: Column) -> Column:
    p = F.split(key, "/")
    return F.concat(F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1)), F.get(p, F.lit(2)))


def dedup_content(df: DataFrame, payload: str) -> DataFrame:
    """One row per distinct payload: hash, size, reference count, bytes saved. Only hashes and
    sizes are shuffled, pre-aggregated per partition."""
    slim = df.select(content_hash(F.col(payload)).alias("hash"), F.octet_length(payload).cast("bigint").alias("size"))
    return slim.groupBy("hash").agg(F.max("size").alias("size"), F.count("*").alias("ref_count")).withColumn(
        "bytes_saved", F.col("size") * (F.col("ref_count") - 1))


def new_content(df: DataFrame, payload: str, store: DataFrame) -> DataFrame:
    """Payloads not in the store yet, once each, with their storage key."""
    hashed = df.select(content_hash(F.col(payload)).alias("hash"), F.col(payload).alias("payload"))
    # the anti join comes first, so that known payloads never reach the exchange of the dedup
    fresh = hashed.join(store.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    return fresh.withColumn("shard", F.substring("hash", 1, 4))


def chunk_fixed(df: DataFrame, payload: str, object_id: str, size: int) -> DataFrame:
    """Pieces of ``size`` bytes with index, offset, size and hash."""
    raw = F.col(payload).cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(raw) - 1, F.lit(0)), F.lit(size))
    cut = df.select(object_id, F.octet_length(raw).alias("total_size"), F.posexplode(
        F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(raw, s + 1, F.lit(size)).alias("data")))).alias("idx", "c"))
    return cut.select(object_id, "idx", F.col("c.offset").alias("offset"), F.octet_length("c.data").alias("size"),
                      F.sha2("c.data", 256).alias("hash"), "total_size", F.col("c.data").alias("data"))


def chunk_by_content(df: DataFrame, payload: str, object_id: str, min_size: int = 200, max_size: int = 2000, divisor: int = 4) -> DataFrame:
    """Runs of whole lines: a chunk ends at a line whose hash says so (once it has the minimum
    size) or before it would pass the maximum, so equal passages give equal chunks."""
    lines = F.split(F.col(payload), "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def ends(line: Column) -> Column:
        return F.conv(F.substring(F.sha2(line, 256), 1, 8), 16, 10).cast("bigint") % divisor == 0

    def step(acc: Column, line: Column) -> Column:
        full = acc["open"].isNotNull() & (F.length(acc["open"]) + 1 + F.length(line) > max_size)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        text = F.when(full | acc["open"].isNull(), line).otherwise(F.concat(acc["open"], F.lit("\n"), line))

        def close(b: Column) -> Column:
            closing = (F.length(b["text"]) >= min_size) & ends(line)
            return F.struct(F.when(closing, F.concat(b["done"], F.array(b["text"]))).otherwise(b["done"]).alias("done"),
                            F.when(~closing, b["text"]).alias("open"))

        return F.element_at(F.transform(F.array(F.struct(done.alias("done"), text.alias("text"))), close), 1)

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    made = bind(df.select(object_id, payload), "pieces", F.aggregate(lines, start, step, finish)).drop(payload)
    return made.select(object_id, F.posexplode("pieces").alias("idx", "chunk")).select(
        object_id, "idx", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("hash"), "chunk")


def validate_manifest(chunks: DataFrame, object_id: str) -> DataFrame:
    """Per object: are indexes contiguous, offsets running sums and the total as declared?"""
    seen = along(chunks.select(object_id, "idx", "offset", "size", "total_size"), [object_id], ["idx"], F.floor(F.col("idx") / 10000),
                 position="__pos", sums={"__upto": F.col("size")})
    ok_index = F.col("idx") == F.col("__pos") - 1
    ok_offset = F.col("offset") == F.col("__upto") - F.col("size")
    per = seen.groupBy(object_id).agg(
        F.bool_and(ok_index).alias("contiguous"), F.bool_and(ok_offset).alias("offsets_ok"),
        (F.sum("size") == F.max("total_size")).alias("total_ok"))
    return per.withColumn("valid", F.col("contiguous") & F.col("offsets_ok") & F.col("total_ok"))


def reassemble(chunks: DataFrame, object_id: str, data: str = "data") -> DataFrame:
    """Objects again from their pieces; one object is one value, so its pieces fit a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", data))), lambda c: F.hex(c[data].cast("binary")))
    joined = chunks.groupBy(object_id).agg(F.unhex(F.array_join(parts, "")).alias("payload"))
    return joined.withColumn("checksum", F.sha2("payload", 256))


def orphans(store: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stored hashes that no manifest refers to."""
    return store.join(manifests.select("hash").distinct(), "hash", "left_anti")


def storage_stats(objects: DataFrame, prefix: Column, size: str, stored_size: str) -> DataFrame:
    return objects.groupBy(prefix.alias("prefix")).agg(
        F.count("*").alias("objects"), F.sum(size).alias("bytes"), F.sum(stored_size).alias("stored_bytes")).withColumn(
        "ratio", F.round(F.col("stored_bytes") / F.col("bytes"), 6)).withColumn("savings", F.col("bytes") - F.col("stored_bytes"))


def checksum(payload: Column, algo: str = "sha256") -> Column:
    return F.lpad(F.hex(F.crc32(payload)), 8, "0") if algo == "crc32" else F.sha2(payload, {"sha256": 256, "sha512": 512}[algo])
