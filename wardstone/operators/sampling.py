"""Repeatable samples, splits, corpora, paging and top-k.

All randomness is a hash of a seed and the row's key: it does not depend on partitioning, and
a lost task recomputes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import along, first_n, grouped_index, hash_bucket, hash_key, join_same, sorted_slice

UNIT = float(16**13)


def unit_hash(seed: str, key: Column) -> Column:
    return F.conv(F.substring(hash_key(seed, key), 1, 13), 16, 10).cast("double") / UNIT


def sample_random(df: DataFrame, key: str, seed: str, n: int | None = None, ratio: float | None = None) -> DataFrame:
    if ratio is not None:
        return df.filter(unit_hash(seed, F.col(key)) < ratio)
    h = df.withColumn("__h", hash_key(seed, F.col(key)))
    return first_n(h, [], ["__h", key], hash_bucket(F.col("__h")), n, "__pos").select(*df.columns)


def sample_stratified(df: DataFrame, stratum: str, key: str, seed: str, n: int | None = None, ratio: float | None = None) -> DataFrame:
    if ratio is not None:
        return sample_random(df, key, seed, ratio=ratio)
    h = df.withColumn("__h", hash_key(seed, F.col(key)))
    return first_n(h, [stratum], ["__h", key], hash_bucket(F.col("__h")), n, "__pos").select(*df.columns)


def sample_systematic(df: DataFrame, order: str, bucket: Column | None, interval: int, offset: int = 0) -> DataFrame:
    """Every ``interval``-th row of the whole order."""
    placed = grouped_index(df, [], [order], bucket, "__pos")
    return placed.filter((F.col("__pos") - 1 - offset) % interval == 0).select(*df.columns)


def sample_reservoir(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """Uniform n rows: the n smallest hashes, which merge across partitions and batches."""
    return sample_random(df, key, seed, n=n)


def split_corpus(df: DataFrame, content: str, ratios: dict[str, float], seed: str = "split") -> DataFrame:
    """Label rows by a hash of their content, so that exact copies share a split."""
    u = unit_hash(seed, F.sha2(F.col(content), 256))
    out, upto, label = None, 0.0, None
    for label, share in ratios.items():
        upto += share
        out = F.when(u < upto, label) if out is None else out.when(u < upto, label)
    return df.withColumn("split", out.otherwise(label))


def corpus_entries(turns: DataFrame, conv: str, turn: str, role: str, text: str, truth: DataFrame | None = None) -> DataFrame:
    """User turns with the assistant's next turn: prompt-response, or prompt only; with reference
    answers (``truth``: conv, turn, ground_truth) also prompt with ground truth. An entry is
    complete if it holds all that its type asks for."""
    nxt = F.struct(F.col(role).alias("role"), F.col(text).alias("text"))
    seen = along(turns, [conv], [turn], leads={"__next": nxt})
    answered = F.coalesce(F.col("__next.role") == "assistant", F.lit(False))
    asked = seen.filter(F.col(role) == "user")
    if truth is None:
        asked = asked.withColumn("ground_truth", F.lit(None).cast("string"))
    else:
        asked = join_same(asked, truth.select(conv, turn, "ground_truth"), [conv, turn], "left")
    known = F.col("ground_truth").isNotNull()
    kind = F.when(known, "ground_truth").when(answered, "prompt_response").otherwise("prompt_only")
    has_prompt, has_answer = F.coalesce(F.trim(text) != "", F.lit(False)), F.coalesce(F.trim(F.col("__next.text")) != "", F.lit(False))
    complete = has_prompt & F.when(known, F.trim("ground_truth") != "").when(answered, has_answer).otherwise(F.lit(True))
    return asked.select(conv, turn, F.col(text).alias("prompt"), F.when(answered, F.col("__next.text")).alias("response"), "ground_truth", kind.alias("entry_type"), complete.alias("complete"))


def join_annotations(df: DataFrame, labels: DataFrame, key: str, min_quality: int) -> DataFrame:
    return df.join(labels, key, "left").filter(F.col("quality").isNull() | (F.col("quality") >= min_quality))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def score_exact_match(predictions: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    hit = (normalised(F.col(predicted)) == normalised(F.col(expected))).cast("int")
    return predictions.groupBy(key).agg(F.count("*").alias("pairs"), F.round(F.avg(hit), 6).alias("exact_match"))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(k)


def page(df: DataFrame, order: list, number: int = 1, size: int = 20, largest: int = 100) -> DataFrame:
    """A page of a sorted table plus page facts (size 0 means 20; page 0 means 1). No page is
    larger than ``largest``: a larger size gives pages of that many rows, and says so."""
    number, size = max(number, 1), min(size or 20, largest)
    rows = sorted_slice(df, order, (number - 1) * size, size)
    total = df.agg(F.count("*").alias("total_items"))
    pages = F.ceil(F.col("total_items") / size)
    facts = total.select(
        F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total_items", pages.alias("total_pages"),
        F.lit(number > 1).alias("has_previous"), (F.lit(number) < pages).alias("has_next"))
    return rows.crossJoin(F.broadcast(facts))  # one row of facts


def cursor_page(df: DataFrame, columns: tuple[str, str], cursor: tuple | None, limit: int = 20, backward: bool = False, largest: int = 100) -> DataFrame:
    """Keyset paging on (value, key): rows after the cursor, and whether more follow. No page is
    larger than ``largest``; a larger limit gives that many rows, and has_more says so."""
    a, b = (F.col(c) for c in columns)
    limit = min(limit, largest)
    rows = df
    if cursor is not None:
        x, y = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.filter(((a < x) | ((a == x) & (b < y))) if backward else ((a > x) | ((a == x) & (b > y))))
    order = [a.desc(), b.desc()] if backward else [a, b]
    ahead = rows.orderBy(*order).limit(limit + 1)
    more = ahead.agg((F.count("*") > limit).alias("has_more"))
    return ahead.orderBy(*order).limit(limit).crossJoin(F.broadcast(more))  # one row
