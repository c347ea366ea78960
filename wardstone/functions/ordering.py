"""Ordered computations over groups of any size: a distributed prefix scan.

A window over a whole group runs in one task, so a dominant key would decide the run time.
Instead the table is cut along (group, order) into cells of about equal size, at bounds sampled
from the table itself (``cut_points``). Windows run inside (group, cell). A group that lies in
several cells must hold a bound, so there are no more such groups than bounds: their cells, a
bounded number, are summed up to a row each, scanned, and the results go back to the rows by a
broadcast. Rows are shuffled once.

A coarse order known beforehand (leading digits of a hash, a segment number) can take the place of
the cells, as *bucket*; its summaries are then joined back, since there may be any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Rows looked at for each cell when bounds are chosen.
SAMPLES = 32
LEAST = -(2**63)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Null-safe equi-join of two frames that may share their origin; keys appear once. ``small``
    says that the right side is bounded, whatever the size of the data."""
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(F.broadcast(renamed) if small else renamed, test, how).drop(*[f"__right_{k}" for k in keys])


def group_name(key: str) -> Column:
    """A key as a string that is never null, so that rows without a key are one group everywhere."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def group_key(name: str, kind: str) -> Column:
    """The key that ``group_name`` was made of."""
    return F.when(F.col(name) != "", F.substring(name, 2, 2**31 - 1)).cast(kind)


def order_key(kind: T.DataType, name: str) -> tuple[list[Column], bool]:
    """Whole numbers that never fall while the column rises (nulls first), and whether they rise
    whenever it does."""
    c = F.col(name)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [c.cast("bigint")], True
    if isinstance(kind, T.DateType):
        return [F.unix_date(c).cast("bigint")], True
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(c)], True
    if isinstance(kind, T.TimestampNTZType):  # without a detour over a time zone, where hours repeat
        seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return [seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")], True
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        x = c.cast("double")
        near = F.greatest(F.least(F.signum(x) * F.log1p(F.abs(x)) * 1e15, F.lit(1e18)), F.lit(-1e18))
        return [F.when(F.isnan(x), F.lit(2**62)).when(c.isNotNull(), near.cast("bigint"))], False
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 14)), 28, "0")
        return [F.conv(F.substring(raw, k, 14), 16, 10).cast("bigint") for k in (1, 15)], False
    return [F.lit(0).cast("bigint")], False


@dataclass(frozen=True)
class Cells:
    """Where a table is cut along (group, order)."""

    group: list[str]
    keys: list[Column]
    bounds: np.ndarray  # of (hash of the group, two keys of the order) as 24 bytes that sort alike
    hashes: list[int]  # of groups that hold a bound

    def hash(self) -> Column:
        return F.xxhash64(*self.group) if self.group else F.lit(0).cast("bigint")

    def column(self) -> Column:
        if not len(self.bounds):
            return F.lit(0)
        bounds = self.bounds

        @F.arrow_udf("int")
        def cell(*keys: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(bounds, sortable(*(k.to_numpy(zero_copy_only=False) for k in keys)), "right").astype(np.int32))

        return cell(self.hash(), *self.keys)

    def spanning(self) -> Column:
        """Whether a row's group can lie in several cells."""
        return self.hash().isin(self.hashes) if self.hashes else F.lit(False)


def sortable(*keys: np.ndarray) -> np.ndarray:
    out = np.empty((len(keys[0]), len(keys)), ">u8")
    for k, key in enumerate(keys):
        out[:, k] = key.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(keys)}").reshape(-1)


def cut_points(df: DataFrame, group: list[str], order: list[str], falling: tuple[str, ...] = ()) -> Cells:
    """Bounds for as many cells as a shuffle has partitions, from a sample of SAMPLES rows a cell.
    The rows of a sample are those of least hash, so it is the same whenever it is taken. Columns
    of ``falling`` are ordered from the largest down, nulls last."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys: list[Column] = []
    for name in order:
        more, exact = order_key(df.schema[name].dataType, name)
        full = [F.coalesce(k, F.lit(LEAST)) for k in more]
        if keys:  # null and the least number are one to the key before: rows of either stay together
            full = [F.when(first == LEAST, F.lit(0)).otherwise(k) for k in full]
        first = full[0]
        keys += [F.bitwise_not(k) for k in full] if name in falling else full
        if not exact or len(keys) >= 2:
            break
    keys = (keys + [F.lit(0).cast("bigint")] * 2)[:2]
    cells = Cells(group, keys, np.zeros(0, "S24"), [])
    row = F.xxhash64(*group, *order)
    narrow = df.select(cells.hash().alias("h"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], row.alias("r"))
    cell = F.pmod(F.col("r"), F.lit(SAMPLES * parts))
    sample = narrow.groupBy(cell.alias("c")).agg(F.min(F.struct("r", "h", "k0", "k1")).alias("x")).select("x.h", "x.k0", "x.k1").collect()
    if not sample:
        return cells
    found = sorted(map(tuple, sample))
    picked = [found[len(found) * k // parts] for k in range(1, parts)]
    bounds = np.unique(sortable(*(np.array(c, np.int64) for c in zip(*picked)))) if picked else cells.bounds
    return Cells(group, keys, bounds, sorted({h for h, *_ in picked}))


def along(
    df: DataFrame,
    group: list[str],
    order: list[str],
    bucket: Column | None = None,
    *,
    cells: Cells | None = None,
    position: str | None = None,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    minima: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values in ``order`` (a unique order inside the group):

    position  1-based row number          sums    running totals, own row included
    maxima, minima  running extremes, own row included
    lags, leads     value of the previous / next row

    Several calls over one table and order can share ``cells``; if their column is already there,
    it is given as ``bucket``, and the rows stay where the first call has put them."""
    if bucket is None:
        cells = cells or cut_points(df, group, order)
        bucket = cells.column()
    sums, maxima, minima = sums or {}, maxima or {}, minima or {}
    lags, leads = lags or {}, leads or {}
    named = {**sums, **maxima, **minima, **{f"__lag_{k}": v for k, v in lags.items()},
             **{f"__lead_{k}": v for k, v in leads.items()}}
    base = df.select("*", bucket.alias("__bucket"), *[v.alias(f"__v_{k}") for k, v in named.items()])
    keys = [*group, "__bucket"]
    at = F.struct(*order)
    aggs = [F.count("*").alias("__n")]
    aggs += [F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums]
    aggs += [F.max(f"__v_{k}").alias(f"__s_{k}") for k in maxima]
    aggs += [F.min(f"__v_{k}").alias(f"__s_{k}") for k in minima]
    aggs += [F.max_by(F.struct(F.col(f"__v___lag_{k}").alias("x")), at).alias(f"__s___lag_{k}") for k in lags]
    aggs += [F.min_by(F.struct(F.col(f"__v___lead_{k}").alias("x")), at).alias(f"__s___lead_{k}") for k in leads]
    summary = (base if cells is None else base.filter(cells.spanning())).groupBy(*keys).agg(*aggs)
    near = W.partitionBy(*(group or [F.lit(0)])).orderBy("__bucket")
    before = near.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__c_n")]
    carried += [F.sum(f"__s_{k}").over(before).alias(f"__c_{k}") for k in sums]
    carried += [F.max(f"__s_{k}").over(before).alias(f"__c_{k}") for k in maxima]
    carried += [F.min(f"__s_{k}").over(before).alias(f"__c_{k}") for k in minima]
    carried += [F.lag(f"__s___lag_{k}").over(near).alias(f"__c___lag_{k}") for k in lags]
    carried += [F.lead(f"__s___lead_{k}").over(near).alias(f"__c___lead_{k}") for k in leads]
    offsets = summary.select(*keys, *carried)
    inside = W.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = [F.row_number().over(inside).alias("__l_n")]
    local += [F.sum(f"__v_{k}").over(upto).alias(f"__l_{k}") for k in sums]
    local += [F.max(f"__v_{k}").over(upto).alias(f"__l_{k}") for k in maxima]
    local += [F.min(f"__v_{k}").over(upto).alias(f"__l_{k}") for k in minima]
    local += [F.lag(F.struct(F.col(f"__v___lag_{k}").alias("x"))).over(inside).alias(f"__l___lag_{k}") for k in lags]
    local += [F.lead(F.struct(F.col(f"__v___lead_{k}").alias("x"))).over(inside).alias(f"__l___lead_{k}") for k in leads]
    rows = base.select("*", *local)
    if cells is None:
        joined = join_same(rows, offsets, keys)
    elif cells.hashes:  # at most two rows for each bound
        joined = join_same(rows, offsets, keys, "left", small=True)
    else:
        joined = rows.select("*", *[F.lit(None).alias(c) for c in offsets.columns if c not in keys])
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.col("__l_n") + F.coalesce("__c_n", F.lit(0))).cast("bigint").alias(position))
    for k in sums:
        total = F.coalesce(f"__l_{k}", F.lit(0)) + F.coalesce(f"__c_{k}", F.lit(0))
        out.append(total.alias(k))
    out += [F.greatest(f"__l_{k}", f"__c_{k}").alias(k) for k in maxima]
    out += [F.least(f"__l_{k}", f"__c_{k}").alias(k) for k in minima]
    out += [F.coalesce(f"__l___lag_{k}", f"__c___lag_{k}")["x"].alias(k) for k in lags]
    out += [F.coalesce(f"__l___lead_{k}", f"__c___lead_{k}")["x"].alias(k) for k in leads]
    return joined.select(*out)


def in_cells(df: DataFrame, group: list[str], order: list[str], bucket: Column | None) -> tuple[DataFrame, Column, Cells | None]:
    """For several ``along`` calls over one order: the frame, the bucket and the cells to give to
    each. Without a bucket the frame gets the column __cell, and the first call's shuffle serves all."""
    if bucket is not None:
        return df, bucket, None
    cells = cut_points(df, group, order)
    return df.withColumn("__cell", cells.column()), F.col("__cell"), cells


def grouped_index(df: DataFrame, group: list[str], order: list[str], bucket: Column | None = None, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row of its group in ``order``."""
    return along(df, group, order, bucket, position=name)


def sorted_slice(df: DataFrame, order: list[str | Column], offset: int, limit: int, few: int = 100_000) -> DataFrame:
    """Rows offset .. offset + limit - 1 of the whole order. Names rise; a minus before a name means
    falling, nulls last.

    A slice that ends within the first ``few`` rows comes from each task's first rows. For a deeper
    one the rows are counted by sampled cells of the order, and only the cells that the slice
    touches are kept, until what lies before it in them is small; no task and no driver holds the
    rows before the slice. Orders given as expressions take the plain way."""
    if any(isinstance(c, Column) for c in order):
        return df.orderBy(*order).offset(offset).limit(limit)
    names, falling = [c.removeprefix("-") for c in order], tuple(c[1:] for c in order if c.startswith("-"))
    sort = [F.desc(n) if n in falling else F.asc(n) for n in names]
    while offset + limit > few:
        cells = cut_points(df, [], names, falling)
        counts = dict(df.groupBy(cells.column().alias("c")).count().collect())  # a row for each cell
        before, first, last = 0, None, None
        for cell in sorted(counts):
            if first is None and before + counts[cell] > offset:
                first, skipped = cell, before
            if before < offset + limit:
                last = cell
            before += counts[cell]
        if first is None:
            return df.limit(0)
        if sum(counts[c] for c in counts if first <= c <= last) == before:
            break  # equal keys or a slice of everything: no cell can be left out
        df, offset = df.filter(cells.column().between(first, last)), offset - skipped
    return df.orderBy(*sort).offset(offset).limit(limit)


def first_n(df: DataFrame, group: list[str], order: list[str], bucket: Column | None, n: int, name: str = "position", descending: bool = False) -> DataFrame:
    """The first n rows per group in ``order`` with their position.

    Without a bucket every task keeps its own first n rows of a group before any are shuffled,
    which suits small n. With one, row counts per bucket tell which leading buckets hold n rows;
    only those are ranked."""
    if bucket is None:
        sort = [(F.desc if descending else F.asc)(c) for c in order]
        place = F.row_number().over(W.partitionBy(*(group or [F.lit(0)])).orderBy(*sort))
        ranked = df.withColumn("__rank", place).filter(F.col("__rank") <= n)
        return ranked.select(*df.columns, F.col("__rank").cast("bigint").alias(name))
    b = df.withColumn("__bucket", bucket)
    keys = [*group, "__bucket"]
    first = F.desc if descending else F.asc
    before = W.partitionBy(*group).orderBy(first("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    counts = b.groupBy(*keys).agg(F.count("*").alias("__n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")).filter(F.col("__offset") < n)
    near = join_same(b, offsets, keys)
    ranked = near.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*[first(c) for c in order])))
    position = F.col("__rn") + F.col("__offset")
    return ranked.filter(position <= n).select(*df.columns, position.cast("bigint").alias(name))


def fold_hashes(rows: DataFrame, group: list[str], h: str, line: str, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """One order-independent digest per group from its lines, folded in steps along leading
    digits of ``h``: a group with very many lines becomes 16^6 small lists, then 16^3, then one
    list of at most 16^3 digests. ``entries`` counts the lines."""
    cells = rows.select(*group, F.col(h).alias("__h"), F.col(line).alias("__x"), F.lit(1).cast("bigint").alias("__n"))
    for digits in (*levels, 0):
        cell = F.substring("__h", 1, digits) if digits else F.lit("")
        text = F.array_join(F.array_sort(F.collect_list("__x")), "\n")
        cells = cells.groupBy(*group, cell.alias("__cell")).agg(F.sha2(text, 256).alias("__d"), F.sum("__n").alias("__n"))
        cells = cells.select(*group, F.col("__cell").alias("__h"), F.concat_ws(":", "__cell", "__d").alias("__x"), "__d", "__n")
    return cells.select(*group, F.col("__d").alias("hash"), F.col("__n").alias("entries"))


def hash_key(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def hash_bucket(h: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of a hex hash: its leading digits."""
    return F.substring(h, 1, digits)
