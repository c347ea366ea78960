"""Privacy models over tables: k-anonymity, diversity, closeness, risk, differential privacy.

Class sizes come from aggregates joined back on the quasi-identifiers, never from a window over
a class: partial aggregation shrinks a dominant class before anything is shuffled."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import along, in_cells, join_same
from ..functions.strategies import unit_noise
from ..session import cut


def equivalence_classes(df: DataFrame, qi: list[str]) -> DataFrame:
    return df.groupBy(*qi).agg(F.count("*").alias("class_size"))


def with_class_size(df: DataFrame, qi: list[str]) -> DataFrame:
    return join_same(df, equivalence_classes(df, qi), qi)


def k_anonymity(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """Rows with their class size and whether it reaches k."""
    return with_class_size(df, qi).withColumn("safe", F.col("class_size") >= k)


def achieved_k(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    c = F.col("class_size")
    return equivalence_classes(df, qi).agg(
        F.min(c).alias("achieved_k"), F.count("*").alias("classes"),
        F.coalesce(F.sum(F.when(c >= k, c)), F.lit(0)).alias("safe_rows"),
        F.coalesce(F.sum(F.when(c < k, c)), F.lit(0)).alias("unsafe_rows"))


def lattice(hierarchies: dict[str, list]) -> list[tuple[int, ...]]:
    """Generalisation nodes, least general first."""
    levels = [range(len(h)) for h in hierarchies.values()]
    return sorted(product(*levels), key=lambda n: (sum(n), n))


def generalise_to(df: DataFrame, hierarchies: dict[str, list], node: tuple[int, ...]) -> DataFrame:
    made = {c: h[lvl](F.col(c)) for (c, h), lvl in zip(hierarchies.items(), node)}
    return df.withColumns(made)


def suppressed_rows(df: DataFrame, hierarchies: dict[str, list], k: int) -> dict[tuple[int, ...], int]:
    """Rows in classes below k for every lattice node, from one aggregate over the distinct
    combinations: all levels of all columns are computed side by side, and the nodes are its
    grouping sets (of at most 64 levels in all)."""
    qi = list(hierarchies)
    made = {(i, lvl): h[lvl](F.col(c)).alias(f"__{i}_{lvl}") for i, (c, h) in enumerate(hierarchies.items()) for lvl in range(len(h))}
    wide = equivalence_classes(df, qi).select(*made.values(), "class_size")
    names = {at: f"__{at[0]}_{at[1]}" for at in made}
    nodes = lattice(hierarchies)
    sets = [[F.col(names[at]) for at in enumerate(node)] for node in nodes]
    classes = wide.groupingSets(sets, *names.values()).agg(F.grouping_id().alias("__set"), F.sum("class_size").alias("c"))
    small = dict(classes.groupBy("__set").agg(F.coalesce(F.sum(F.when(F.col("c") < k, F.col("c"))), F.lit(0))).collect())  # a row a node
    bit = {at: 1 << (len(names) - 1 - n) for n, at in enumerate(names)}  # set where a column is left out
    return {node: small.get(sum(bit.values()) - sum(bit[at] for at in enumerate(node)), 0) for node in nodes}


def choose_node(df: DataFrame, hierarchies: dict[str, list], k: int, max_suppress: float) -> tuple[int, ...]:
    """The first lattice node that needs at most the allowed share of suppressed rows: two jobs,
    whatever the lattice."""
    small = suppressed_rows(df, hierarchies, k)
    total = df.count()
    return next((node for node, n in small.items() if n <= max_suppress * total), lattice(hierarchies)[-1])


def k_anonymise(df: DataFrame, hierarchies: dict[str, list], k: int, max_suppress: float = 0.05) -> DataFrame:
    """Full-domain generalisation, then suppression of the rows in classes still below k."""
    node = choose_node(df, hierarchies, k, max_suppress)
    out = with_class_size(generalise_to(df, hierarchies, node), list(hierarchies))
    return out.filter(F.col("class_size") >= k)


def l_diversity(df: DataFrame, qi: list[str], sensitive: str, l: float) -> DataFrame:
    """Distinct and entropy diversity per class."""
    per = df.groupBy(*qi, sensitive).agg(F.count("*").alias("c"))
    c = F.col("c")
    # entropy = ln N - (sum c ln c) / N, from one aggregate
    out = per.groupBy(*qi).agg(
        F.sum(c).alias("class_size"), F.count("*").alias("distinct_values"), F.sum(c * F.ln(c)).alias("clnc"))
    entropy = F.ln("class_size") - F.col("clnc") / F.col("class_size")
    return out.select(
        *qi, "class_size", "distinct_values", F.round(F.exp(entropy), 6).alias("entropy_diversity"),
        (F.col("distinct_values") >= l).alias("distinct_ok"), (F.exp(entropy) >= l - 1e-9).alias("entropy_ok"))


def t_closeness(df: DataFrame, qi: list[str], sensitive: str, t: float) -> DataFrame:
    """Total variation distance of each class's distribution from the whole table's."""
    per = df.groupBy(*qi, sensitive).agg(F.count("*").alias("c"))
    whole = per.groupBy(sensitive).agg(F.sum("c").alias("g"))
    total = whole.agg(F.sum("g").alias("n"))
    sizes = per.groupBy(*qi).agg(F.sum("c").alias("class_size"))
    seen = join_same(join_same(per, sizes, qi), whole, [sensitive]).crossJoin(F.broadcast(total))  # one row
    p, base = F.col("c") / F.col("class_size"), F.col("g") / F.col("n")
    # values absent from the class contribute the rest of the whole distribution
    out = seen.groupBy(*qi).agg(F.max("class_size").alias("class_size"),
                                ((F.sum(F.abs(p - base)) + 1 - F.sum(base)) / 2).alias("d"))
    return out.select(*qi, "class_size", F.round("d", 6).alias("distance"), (F.col("d") <= t + 1e-9).alias("close"))


def t_closeness_ordered(df: DataFrame, qi: list[str], bin_of: Column, bins: int, t: float) -> DataFrame:
    """Earth mover's distance over ``bins`` ordered bins (a fixed number of counters)."""
    counted = df.select(*qi, bin_of.alias("__b"))
    counters = [F.count_if(F.col("__b") == i).alias(f"b{i}") for i in range(bins)]
    classes = counted.groupBy(*qi).agg(F.count("*").alias("class_size"), *counters)
    whole = classes.agg(F.sum("class_size").alias("n"), *[F.sum(f"b{i}").alias(f"w{i}") for i in range(bins)])
    both = classes.crossJoin(F.broadcast(whole))  # one row
    gap, moved = F.lit(0.0), F.lit(0.0)
    for i in range(bins):
        gap = gap + F.col(f"b{i}") / F.col("class_size") - F.col(f"w{i}") / F.col("n")
        moved = moved + F.abs(gap)
    d = moved / (bins - 1)
    return both.select(*qi, "class_size", F.round(d, 6).alias("distance"), (d <= t + 1e-9).alias("close"))


def information_loss(released: DataFrame, qi: list[str], total_rows: DataFrame, levels: dict[str, tuple[int, int]]) -> DataFrame:
    """Discernibility (squared class sizes plus N per suppressed row) and the precision kept.

    ``total_rows``: one row, column ``n``; ``levels``: column -> (level used, highest level)."""
    precision = 1 - sum(used / top for used, top in levels.values()) / len(levels)
    c = F.col("class_size")
    kept = equivalence_classes(released, qi).agg(
        F.coalesce(F.sum(c * c), F.lit(0)).alias("sq"), F.coalesce(F.sum(c), F.lit(0)).alias("kept"))
    both = kept.crossJoin(F.broadcast(total_rows))  # one row
    gone = F.col("n") - F.col("kept")
    return both.select((F.col("sq") + gone * F.col("n")).alias("discernibility"), gone.alias("suppressed"),
                       F.lit(round(precision, 6)).alias("precision"))


def reid_risk(df: DataFrame, qi: list[str]) -> DataFrame:
    """Prosecutor: sum of 1/class size over N. Journalist: share of unique rows.
    Marketer: mean of 1/class size over the classes."""
    c = F.col("class_size")
    a = equivalence_classes(df, qi).agg(
        F.sum(1 / c).alias("inv"), F.sum(c).alias("n"), F.count("*").alias("classes"), F.count_if(c == 1).alias("uniq"))
    return a.select(
        F.round(F.col("inv") / F.col("n"), 9).alias("prosecutor"),
        F.round(F.col("uniq") / F.col("n"), 9).alias("journalist"),
        F.round(F.col("inv") / F.col("classes"), 9).alias("marketer"))


# ------------------------------------------------------------------ differential privacy
def laplace(key: Column, scale) -> Column:
    u = unit_noise(key) - 0.5
    return -F.signum(u) * F.ln(1 - 2 * F.abs(u)) * scale


def gaussian(key: Column, sigma) -> Column:
    u1 = 1 - unit_noise(F.concat(key.cast("string"), F.lit("|a")))
    u2 = unit_noise(F.concat(key.cast("string"), F.lit("|b")))
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.lit(3.141592653589793) * u2) * sigma


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    from math import log, sqrt

    return sensitivity * sqrt(2 * log(1.25 / delta)) / epsilon


def dp_aggregate(df: DataFrame, keys: list[str], measure: str, epsilon: float, bounds: tuple[float, float],
                 seed: str, mechanism: str = "laplace", delta: float = 1e-5) -> DataFrame:
    """Noisy count, sum and mean of a clamped measure; the budget is split over count and sum.

    ``seed`` is the secret of the release: the same seed repeats the same noise."""
    lo, hi = bounds
    half = epsilon / 2
    clamped = F.greatest(F.least(F.col(measure), F.lit(hi)), F.lit(lo))
    agg = df.groupBy(*keys).agg(F.count("*").alias("c"), F.sum(clamped).alias("s"))
    name = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])

    def noise(tag: str, sensitivity: float) -> Column:
        key = F.concat(name, F.lit("|" + tag))
        if mechanism == "laplace":
            return laplace(key, sensitivity / half)
        return gaussian(key, gaussian_sigma(sensitivity, half, delta / 2))

    c, s = F.col("c") + noise("count", 1.0), F.col("s") + noise("sum", max(abs(lo), abs(hi)))
    mean = F.greatest(F.least(s / F.greatest(c, F.lit(1.0)), F.lit(hi)), F.lit(lo))
    return agg.select(*keys, F.round(c, 4).alias("noisy_count"), F.round(s, 2).alias("noisy_sum"), F.round(mean, 4).alias("noisy_mean"))


def dp_value(value: Column, pii_type: Column, key: Column, epsilon: float, sensitivity: float = 1.0) -> Column:
    """Noisy whole age (not negative) or 5-digit postal code; other types are protected."""
    number = value.try_cast("double")
    shifted = number + laplace(key, sensitivity / epsilon)
    age = F.format_string("%.0f", F.greatest(shifted, F.lit(0.0)))
    code = F.lpad(F.greatest(shifted.cast("bigint"), F.lit(0)).cast("string"), 5, "0")
    return (
        F.when((pii_type == "age") & number.isNotNull(), age)
        .when((pii_type == "zip_code") & number.isNotNull(), code)
        .when(pii_type.isin("age", "zip_code"), value)
        .otherwise(F.lit("[DP_PROTECTED]")))


def charge(epsilon: Column, k: Column, composition: str, delta: float = 1e-5) -> Column:
    """Cost of the k-th accepted request in millionths. Zero-concentrated budgets add up linearly in
    the parameter itself, so the request's own value is charged, as in basic composition."""
    if composition in ("basic", "zero_concentrated"):
        return F.round(epsilon * 1e6).cast("bigint")
    from math import log

    return F.round(epsilon * F.sqrt(2 * k * log(1 / delta)) * 1e6).cast("bigint")


def privacy_ledger(requests: DataFrame, dataset: str, order: list[str], epsilon: str, bucket: Column | None, budget: float,
                   composition: str = "basic") -> DataFrame:
    """Charge requests in order; a request is accepted while the total stays within budget.

    What is left only shrinks and costs only grow, so once a request is refused every later one
    of the same dataset with an equal or larger epsilon is refused as well. Each round takes
    the open requests as if all were accepted (a running sum along the order), settles those
    before the first overrun and those the overrun rules out; the rounds are at most the number
    of distinct epsilons, and every round works on all datasets at once."""
    limit = int(round(budget * 1e6))
    at = F.struct(*order)
    requests_in, bucket, cells = in_cells(requests, [dataset], order, bucket)
    todo = requests_in.select("*", bucket.alias("__b"), F.lit(0).cast("bigint").alias("__spent"), F.lit(0).cast("bigint").alias("__k"))
    settled = None
    while True:
        placed = along(todo, [dataset], order, F.col("__b"), cells=cells, position="__pos")
        priced = placed.withColumn("__cost", charge(F.col(epsilon), F.col("__k") + F.col("__pos"), composition))
        summed = along(priced, [dataset], order, F.col("__b"), cells=cells, sums={"__run": F.col("__cost")})
        summed = cut(summed.withColumn("__total", F.col("__run") + F.col("__spent")))
        over = F.col("__total") > limit
        stops = summed.filter(over).groupBy(dataset).agg(
            F.min(at).alias("__stop"), F.min_by(epsilon, at).alias("__eps"), F.min_by("__pos", at).alias("__stop_pos"),
            F.min_by(F.struct((F.col("__total") - F.col("__cost")).alias("t"), (F.col("__k") + F.col("__pos") - 1).alias("k")), at).alias("__state"))
        marked = join_same(summed, stops, [dataset], "left")
        ok = F.col("__stop").isNull() | (F.col("__pos") < F.col("__stop_pos"))
        out = F.col("__stop").isNotNull() & (F.col("__pos") >= F.col("__stop_pos")) & (F.col(epsilon) >= F.col("__eps"))
        done = marked.filter(ok | out).select(
            *requests.columns, ok.alias("accepted"), F.when(ok, F.col("__cost")).otherwise(0).alias("charged_micro"))
        settled = done if settled is None else settled.unionByName(done)
        todo = cut(marked.filter(~(ok | out)).select(
            *requests.columns, "__b", F.col("__state.t").alias("__spent"), F.col("__state.k").alias("__k")))
        if todo.isEmpty():
            return settled
