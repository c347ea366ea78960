"""Codes for vectors: one codebook per position, fitted by Lloyd rounds whose members stay put.

A vector is cut into equal parts. A part lives with the entry it is assigned to: rows are
partitioned by (position, entry, salt), where the salt spreads a crowded entry. In a round each
owner sums its resident members, the sums (a bounded number) give the next codebooks, owners
assign their members anew, and only parts whose entry changes move in the next shuffle. Stayers
are not shuffled again: a round's newcomers stand beside them in partitions of their own, as few
as adaptive execution finds fit, and the sums of an owner's partitions meet when they are added
up. All arithmetic is in integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardstone.llm.store import kept, kept_rows

#: Owners of a crowded entry, and the bound of an integer component.
SALTS, CLIP = 16, 1 << 24
OWNER = ["pos", "entry", "salt"]


def integers(rows: DataFrame, scale: int, parts: int, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """rid, vec_id, label, v (integer components) of the rows that take part: vectors without
    null or non-finite components, as long as the vector of the smallest id, in equal parts."""
    whole = F.transform(vector_col, lambda x: x.cast("double"))
    floors = F.transform(whole, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-CLIP))), F.lit(float(CLIP)))).cast("int"))
    sound = F.coalesce(~F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    found = rows.filter(sound & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0)).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), floors.alias("v"))
    first = found.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("v").alias("n"))).alias("x")).first()["x"]
    return found.filter(F.size("v") == (first["n"] if first else 0))


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (ties: the lower) and squared distance of each member; exact."""
    top = int(max(np.abs(members).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * book.shape[1] < 1 << 53:  # every sum of products is a whole number in a double
        x, c = members.astype(np.float64), book.astype(np.float64)
        away = (c * c).sum(1) - 2 * (x @ c.T)
        entry = away.argmin(1)
        return entry, (away[np.arange(len(x)), entry] + (x * x).sum(1)).astype(np.int64)
    entry, least = np.zeros(len(members), np.int64), np.full(len(members), np.iinfo(np.int64).max)
    for k, c in enumerate(book):
        away = ((members - c) ** 2).sum(1)
        closer = away < least
        entry[closer], least[closer] = k, away[closer]
    return entry, least


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """`parts` with `at`: the nearest entry of its position's codebook and the squared distance."""

    @F.arrow_udf("struct<entry: int, error: bigint>")
    def near(pos: pa.Array, part: pa.Array) -> pa.Array:
        where, rows = pos.to_numpy(zero_copy_only=False), matrix(part, books.shape[2])
        entry, error = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        for p in np.unique(where):
            own = np.flatnonzero(where == p)
            for lot in np.split(own, range(4096, len(own), 4096)):
                entry[lot], error[lot] = nearest(rows[lot], books[p])
        return pa.StructArray.from_arrays([pa.array(entry.astype(np.int32)), pa.array(error)], names=["entry", "error"])

    return parts.withColumn("at", near("pos", "part"))


def member_sums(members: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the members of every entry: owners add up what lives with them, and one
    row per owner leaves a task. At most positions * entries rows come back."""
    width = shape[2]

    def work(batches):
        sums, counts = np.zeros((shape[0] * shape[1], width), np.int64), np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            rows = matrix(batch.column(2), width)
            at = batch.column(0).to_numpy().astype(np.int64) * shape[1] + batch.column(1).to_numpy()
            order = np.argsort(at, kind="stable")
            owner, start = np.unique(at[order], return_index=True)
            if len(owner):
                sums[owner] += np.add.reduceat(rows[order], start, axis=0)
                counts[owner] += np.diff(np.r_[start, len(at)])
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), *map(pa.array, sums[own].T.copy())], names=names)

    names = ["owner", "n", *(f"s{k}" for k in range(width))]
    local = members.select("pos", "entry", "part").mapInArrow(work, ", ".join(f"{c} bigint" for c in names))
    out = np.zeros((shape[0] * shape[1], width + 1), np.int64)
    for owner, n, *total in local.groupBy("owner").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():
        out[owner] = [*total, n]
    return out[:, :width].reshape(shape), out[:, width].reshape(shape[:2])


def moved(members: DataFrame) -> DataFrame:
    """Members with column `at` after migration: who keeps the entry stays in its partition, the
    others are shuffled to their new owner's."""
    rest = ["rid", "vec_id", "label", "part"]
    stay = members.filter(F.col("at.entry") == F.col("entry")).select(*OWNER, *rest)
    go = members.filter(F.col("at.entry") != F.col("entry")).select("pos", F.col("at.entry").alias("entry"), "salt", *rest)
    return stay.union(go.repartition(*OWNER))


def compress(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of every vector that takes part, and the codebooks (position,
    entry, component; integers). `codes` holds one entry number per part; `error` sums the squared
    distances to the entries.

    Codebooks start from the `entries` smallest ids (ties by components; fewer rows: fewer
    entries); rows without an id come after all others. Each round assigns all parts and replaces
    an entry by the floor of its members' mean; unused entries stay; last, parts are assigned
    again. Rows whose vector is null, holds null or non-finite components, can't be cut into equal
    parts or is not as long as the vector of the smallest id take no part. Components beyond
    2^24 after scaling count as 2^24. Repeated rows are coded each; an empty table gives no row
    and no codebook; other columns are not looked at."""
    spark = rows.sparkSession
    base = integers(rows, scale, parts, id_col=id_col, vector_col=vector_col, label_col=label_col)
    seeds = [r["v"] for r in base.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    if not seeds:
        return spark.createDataFrame([], f"{kinds}, codes array<int>, error bigint"), np.zeros((parts, 0, 0), np.int64)
    width = len(seeds[0]) // parts
    books = np.array(seeds, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("v", k * width + 1, width))
    loose = base.select("rid", "vec_id", "label", F.posexplode(pieces).alias("pos", "part"))
    coded = assigned(loose, books)
    owned = coded.select("pos", F.col("at.entry").alias("entry"), F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"), "rid", "vec_id", "label", "part")
    for k in range(rounds):
        # a round's assignment is written once: stayers and movers are read from it
        members = moved(kept_rows(coded)) if k else kept_rows(owned.repartition(*OWNER))
        sums, counts = member_sums(members, books.shape)
        used, books = counts > 0, books.copy()
        books[used] = sums[used] // counts[used][:, None]
        coded = assigned(members, books)
    each = coded.groupBy("rid", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("at.entry").alias("entry")))).alias("codes"), F.sum("at.error").alias("error"))
    return kept(each.select("vec_id", "label", F.transform("codes", lambda c: c["entry"]).alias("codes"), "error"), "codes"), books


def decompress(codes: DataFrame, books: np.ndarray, *, scale: int = 1024) -> DataFrame:
    """`codes` with the vector (array<double>) that its entries stand for as column `vector`."""

    @F.arrow_udf("array<double>")
    def spelled(entries: pa.Array) -> pa.Array:
        rows = matrix(entries, books.shape[0])
        whole = books[np.arange(books.shape[0]), rows].reshape(len(rows), -1) / scale
        return pa.array(whole.tolist(), pa.list_(pa.float64()))

    return codes.withColumn("vector", spelled("codes"))


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """`codes` with label_error: the error summed over rows of the same label, nulls together.
    Sums are few, so each is repeated for every salt and a crowded label is no hot key."""
    by = codes.withColumn("__salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return by.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__of"))).drop("__salt", "__label", "__of")


def compress_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The digest of the query in DuckDB, round by round; vectors of one length."""
    ctes = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""p AS (SELECT vec_id, label, pos, v[pos * len(v) // {parts} + 1 : (pos + 1) * len(v) // {parts}] AS part FROM v, range({parts}) r(pos))""",
            f"""b0 AS (SELECT pos, entry, part FROM (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, pos, part, m % {entries} AS entry, m // {entries} AS error FROM (
          SELECT vec_id, label, p.pos, any_value(p.part) AS part, min((list_inner_product(p.part, p.part) - 2 * list_inner_product(p.part, b.part)
            + list_inner_product(b.part, b.part))::BIGINT * {entries} + entry) AS m
          FROM p JOIN b{k} b ON p.pos = b.pos GROUP BY vec_id, label, p.pos))""")
        if k < rounds:
            ctes.append(f"""s{k} AS (SELECT pos, entry, i, sum(x)::BIGINT AS s, count(*) AS c FROM (
              SELECT pos, entry, unnest(part)::BIGINT AS x, unnest(range(len(part))) AS i FROM a{k}) GROUP BY pos, entry, i)""")
            ctes.append(f"""u{k} AS (SELECT pos, entry, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY i) AS part FROM s{k} GROUP BY pos, entry)""")
            ctes.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(u.part, b.part) AS part FROM b{k} b LEFT JOIN u{k} u ON b.pos = u.pos AND b.entry = u.entry)""")
    return f"""WITH {", ".join(ctes)},
    c AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY pos) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
    h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (
      SELECT pos, entry, unnest(part) AS x, unnest(range(len(part))) AS i FROM b{rounds}))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"""
