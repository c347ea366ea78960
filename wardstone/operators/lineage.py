"""Lineage graphs: closure, paths, impact, admission of edges.

Graph loops run over levels. Every round is one distributed join; its result is written to
the checkpoint folder, so a plan never grows with the number of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, dealt

#: Starts of a block: the bits of a whole number.
BLOCK = 64
#: Rows of a front that go to the edges by a broadcast.
FEW = 50_000
#: Rounds up to which edges are read again instead of written.
BRIEF = 3


def _onward(front: DataFrame, hop: DataFrame) -> DataFrame:
    """Rows of a front (materialised, with a column node) with the edges (__a, __b) out of their nodes."""
    near = F.broadcast(front) if front.limit(FEW + 1).count() <= FEW else front
    return near.join(hop, F.col("node") == F.col("__a"))


def closure(edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): nodes reachable from each start, each once at its least depth,
    the start itself left out. ``edges``: source, target; ``starts``: node."""
    a, b = ("source", "target") if direction == "down" else ("target", "source")
    hop = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    if max_depth is None or max_depth > BRIEF:
        # written once, grouped by the join key, and read by every round
        hop = cut(hop.distinct().repartition("__a"))
    front = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = _onward(front, hop).select("start", F.col("__b").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def neighbours(edges: DataFrame, node: DataFrame, direction: str) -> DataFrame:
    a, b = ("target", "source") if direction == "parents" else ("source", "target")
    return edges.join(node.select(F.col("node").alias(a)), a, "left_semi").select(F.col(a).alias("node"), F.col(b).alias("neighbour"), *[c for c in edges.columns if c not in (a, b)])


def find_paths(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """All simple paths of each pair (source, target) of at most ``max_depth`` edges.

    A search from the targets up keeps, for each target, the edges that lead to it within the edges
    left. Partial paths grow along the edges of their own target only, so no round has more rows
    than there are partial paths that can still arrive."""
    hop = edges.select(F.col("target").alias("__a"), F.col("source").alias("__b"))
    if max_depth > BRIEF:
        hop = cut(hop.distinct().repartition("__a"))
    front = cut(pairs.select(F.col("target").alias("__t"), F.col("target").alias("node")).distinct())
    seen, ways = front, None
    for left in range(max_depth):
        step = _onward(front, hop).select("__t", F.col("__b").alias("__from"), F.col("node").alias("__to")).distinct()
        if left == max_depth - 1:  # only a first edge may have so many after it
            step = step.join(pairs.select(F.col("target").alias("__t"), F.col("source").alias("__from")), ["__t", "__from"], "left_semi")
        step = cut(step.withColumn("__left", F.lit(left)))
        ways = step if ways is None else ways.unionByName(step)
        if left < max_depth - 1:
            front = cut(step.select("__t", F.col("__from").alias("node")).distinct().join(seen, ["__t", "node"], "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
    front = pairs.select("source", "target", F.col("source").alias("node"), F.array("source").alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        step = front.join(ways, (F.col("target") == F.col("__t")) & (F.col("node") == F.col("__from")) & (F.col("__left") <= max_depth - depth))
        step = step.filter(~F.array_contains("path", F.col("__to")))
        step = cut(step.select("source", "target", F.col("__to").alias("node"), F.concat("path", F.array("__to")).alias("path")))
        arrived = step.filter(F.col("node") == F.col("target")).select("source", "target", "path")
        out = arrived if out is None else out.unionByName(arrived)
        front = step.filter(F.col("node") != F.col("target"))
        if front.isEmpty():
            break
    return out.withColumn("length", F.size("path") - 1)


def _apart(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """Nodes that are no such end of an edge."""
    ends = edges.select(F.col(end).alias("node"))
    rows = nodes.count() + ends.count()
    return dealt(nodes, rows, "node").join(dealt(ends, rows, "node"), "node", "left_anti")


def graph_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _apart(nodes, edges, "target")


def graph_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _apart(nodes, edges, "source")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.concat(F.lit("node:"), "type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "kind").alias("kind")).agg(F.count("*").alias("n")))


def reach_counts(edges: DataFrame, starts: DataFrame, nodes: DataFrame, label: str, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(start, label, depth, n): how many nodes of each label (a column of ``nodes``) are reached
    from each start, by their least depth; the start itself is left out, and nodes that are not in
    ``nodes`` don't count.

    A breadth-first search from all starts at once, BLOCK of them to a number: a node carries the
    starts that reach it as bits, a round sends new bits along the edges, joins them by OR and
    keeps what was not there. No (start, node) pair is ever a row; a round moves at most a number
    for each edge and block, and totals are sums of bits."""
    a, b = ("source", "target") if direction == "down" else ("target", "source")
    first = cut(starts.select("node").distinct().withColumn("at", F.monotonically_increasing_id()))
    hop = cut(edges.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct().repartition("from"))
    bit = F.pmod(F.col("at"), F.lit(BLOCK)).cast("int")
    front = first.select("node", F.floor(F.col("at") / BLOCK).alias("block"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    none = F.lit(0).cast("bigint")
    seen, found, depth = front, None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(hop, F.col("node") == F.col("from")).select(F.col("to").alias("node"), "block", "bits", none.alias("old"))
        both = step.union(seen.select("node", "block", none.alias("bits"), F.col("bits").alias("old")))
        joined = both.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        now = cut(joined.select("node", "block", F.col("bits").bitwiseOR(F.col("old")).alias("bits"), F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("fresh")))
        seen = now.select("node", "block", "bits")
        front = now.filter("fresh <> 0").select("node", "block", F.col("fresh").alias("bits"))
        if front.isEmpty():
            break
        new = front.withColumn("depth", F.lit(depth))
        found = new if found is None else found.union(new)
    if found is None:
        found = front.withColumn("depth", F.lit(0)).limit(0)
    ones = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"n{k}") for k in range(BLOCK)]
    totals = found.join(nodes.select("node", label), "node").groupBy("block", label, "depth").agg(*ones)
    each = F.posexplode(F.array(*[f"n{k}" for k in range(BLOCK)])).alias("bit", "n")
    counted = totals.select((F.col("block") * BLOCK).alias("__at"), label, "depth", each).filter("n > 0")
    return counted.join(first, F.col("__at") + F.col("bit") == F.col("at")).select(F.col("node").alias("start"), label, "depth", "n")


def impact_analysis(nodes: DataFrame, edges: DataFrame, starts: DataFrame, types=("dataset", "model", "output")) -> DataFrame:
    """Downstream totals by type for every start, by ``reach_counts``. The nodes themselves are
    rows of ``closure``, for starts whose impact is to be listed."""
    reached = reach_counts(edges, starts, nodes, "type")
    per = reached.groupBy("start").agg(F.sum("n").alias("affected"), F.max("depth").alias("max_depth"),
                                       *[F.sum(F.when(F.col("type") == t, F.col("n"))).alias(f"{t}s") for t in types])
    zero = F.lit(0)
    return starts.select(F.col("node").alias("start")).join(per, "start", "left").select(
        "start", *[F.coalesce(c, zero).alias(c) for c in ("affected", "max_depth", *[f"{t}s" for t in types])])


def chain_places(edges: DataFrame, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chains of a graph (``edges``: distinct source, target, none of them null). An inner node has one edge in, one
    out, and is not in ``ends`` (node).

    Returns the place of inner nodes (node, head, off: edges from the chain's first inner node),
    and the inner nodes of lone rings, which have no first (node). Pointers along a chain double
    in every round, so rounds grow with the logarithm of the longest chain; no two open pointers
    have one target, so no key is hot."""
    one, none = F.lit(1), F.lit(0)
    ways = edges.select(F.col("source").alias("node"), one.alias("out"), none.alias("into"), F.lit(None).cast(dict(edges.dtypes)["source"]).alias("before")).unionByName(
        edges.select(F.col("target").alias("node"), none.alias("out"), one.alias("into"), F.col("source").alias("before")))
    inner = ways.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.max("before").alias("before")).filter("out = 1 AND into = 1")
    if ends is not None:
        inner = inner.join(ends.select("node"), "node", "left_anti")
    inner = cut(inner.select("node", "before"))
    linked = inner.join(inner.select(F.col("node").alias("before"), F.lit(True).alias("linked")), "before", "left")
    open_ = F.col("linked").isNotNull()
    places = cut(linked.select("node", F.when(open_, F.col("before")).otherwise(F.col("node")).alias("at"), F.when(open_, 1).otherwise(0).cast("bigint").alias("off"), open_.alias("open")))
    for _ in range(inner.count().bit_length() + 1):
        left = places.filter("open")
        if left.isEmpty():
            break
        onward = places.select(F.col("node").alias("__n"), F.col("at").alias("__at"), F.col("off").alias("__off"), F.col("open").alias("__open"))
        moved = left.join(onward, F.col("at") == F.col("__n")).select("node", F.col("__at").alias("at"), (F.col("off") + F.col("__off")).alias("off"), F.col("__open").alias("open"))
        places = cut(places.filter("NOT open").unionByName(moved))
    return places.filter("NOT open").select("node", F.col("at").alias("head"), "off"), places.filter("open").select("node")


def contract_chains(edges: DataFrame, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A graph whose chains are single edges: (source, target, len, head), head null for edges that
    are no chain; the way into each chain (source, head), also of chains that lead nowhere; the
    places of inner nodes; the nodes of lone rings."""
    edges = edges.filter("source IS NOT NULL AND target IS NOT NULL")
    place, rings = chain_places(edges, ends)
    a = place.select(F.col("node").alias("source"), F.col("head").alias("__from"), F.col("off").alias("__off"))
    b = place.select(F.col("node").alias("target"), F.col("head").alias("__into"))
    tagged = cut(edges.join(a, "source", "left").join(b, "target", "left").join(rings.select(F.col("node").alias("source")), "source", "left_anti"))
    into = tagged.filter("__from IS NULL AND __into IS NOT NULL").select("source", F.col("__into").alias("head"))
    out = tagged.filter("__from IS NOT NULL AND __into IS NULL").select(F.col("__from").alias("head"), "target", (F.col("__off") + 2).alias("len"))
    plain = tagged.filter("__from IS NULL AND __into IS NULL").select("source", "target", F.lit(1).cast("bigint").alias("len"), F.lit(None).cast(dict(place.dtypes)["head"]).alias("head"))
    return plain.unionByName(into.join(out, "head").select("source", "target", "len", "head")), into, place, rings


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: edges into nodes without outgoing edges and edges out of
    nodes without incoming edges are peeled off until nothing changes. Chains are one edge each,
    so a round peels a whole chain."""
    whole = cut(edges.select("source", "target").distinct())
    left, _, places, rings = contract_chains(whole)
    left = cut(left)
    count = left.count()
    while count:
        inner = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = cut(inner.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select(*left.columns))
        now = left.count()
        if now == count:
            break
        count = now
    # an edge of a chain has an inner node at one end at least
    heads = left.filter("head IS NOT NULL").select("head").distinct()
    nodes = places.join(heads, "head", "left_semi").select("node").unionByName(rings)
    touched = whole.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").unionByName(whole.join(nodes.select(F.col("node").alias("target")), "target", "left_semi"))
    return cut(left.filter("head IS NULL").select("source", "target").unionByName(touched.select("source", "target")).distinct())


def admit_edges(nodes: DataFrame, edges: DataFrame, new_edges: DataFrame, order: str | None = None) -> DataFrame:
    """Verdict per new edge in proposal order (column ``order``; else by source and target): an
    unknown endpoint, or a cycle, which is a self loop or a target that already reaches its source
    over old edges and those accepted before.

    Only edges inside the cyclic core need the reachability test. They settle in rounds: what old
    and accepted edges close is refused; what all open edges together cannot close is accepted; of
    the rest, the first proposal of each group of nodes that reach one another is accepted. Groups
    settle side by side, so the rounds are at most the proposals of the largest group."""
    known = nodes.select("node").distinct()
    n = new_edges.join(known.select(F.col("node").alias("source"), F.lit(True).alias("__s")), "source", "left").join(
        known.select(F.col("node").alias("target"), F.lit(True).alias("__t")), "target", "left")
    checked = cut(n.withColumn("__bad", F.col("__s").isNull() | F.col("__t").isNull()).drop("__s", "__t"))
    at = F.struct(*([F.col(order)] if order else []), F.col("source"), F.col("target"))
    valid = checked.filter(~F.col("__bad")).groupBy("source", "target").agg(F.min(at).alias("__at"))
    base = edges.select("source", "target").distinct()
    core = cyclic_core(base.unionByName(valid.select("source", "target")))
    refused = valid.filter("source = target").select("source", "target")
    open_ = cut(valid.filter("source <> target").join(core, ["source", "target"], "left_semi").join(base, ["source", "target"], "left_anti"))
    taken = cut(base.join(core, ["source", "target"], "left_semi"))
    while not open_.isEmpty():
        starts = open_.select(F.col("target").alias("node")).distinct()
        back = closure(taken, starts).select(F.col("start").alias("target"), F.col("node").alias("source"))
        closed = cut(open_.join(back, ["source", "target"], "left_semi"))
        refused = refused.unionByName(closed.select("source", "target"))
        left = cut(open_.join(closed.select("source", "target"), ["source", "target"], "left_anti"))
        whole = taken.unionByName(left.select("source", "target"))
        reach = cut(closure(whole, left.select(F.col("target").alias("node")).unionByName(left.select(F.col("source").alias("node"))).distinct()))
        both = reach.alias("a").join(reach.alias("b"), (F.col("a.start") == F.col("b.node")) & (F.col("a.node") == F.col("b.start")))
        group = both.groupBy(F.col("a.start").alias("source")).agg(F.min("b.start").alias("__other"))
        group = group.select("source", F.least("source", "__other").alias("__group"))
        tied = left.join(reach.select(F.col("start").alias("target"), F.col("node").alias("source")), ["source", "target"], "left_semi").join(group, "source")
        first = tied.groupBy("__group").agg(F.min(F.struct("__at", "source", "target")).alias("x")).select("x.source", "x.target")
        free = left.join(tied.select("source", "target"), ["source", "target"], "left_anti").select("source", "target")
        now = cut(free.unionByName(first))
        taken = cut(taken.unionByName(now))
        open_ = cut(left.join(now, ["source", "target"], "left_anti"))
    loops = refused.distinct().withColumn("__cycle", F.lit(True))
    reason = F.when(F.col("__bad"), "unknown_node").when(F.col("__cycle"), "cycle")
    return checked.join(loops, ["source", "target"], "left").select(*new_edges.columns, reason.isNull().alias("accepted"), reason.alias("reason"))


def lineage_query(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "both", max_depth: int | None = None,
                  rel_types: list[str] | None = None, node_types: list[str] | None = None) -> DataFrame:
    """Depth-limited neighbourhood over chosen relations; node types filter the report, not the walk."""
    used = edges if rel_types is None else edges.filter(F.col("kind").isin(rel_types))
    out = None
    for way in ("down", "up") if direction == "both" else (direction,):
        part = closure(used, starts, way, max_depth).withColumn("direction", F.lit(way))
        out = part if out is None else out.unionByName(part)
    found = out.join(nodes.select("node", "type"), "node")
    return found if node_types is None else found.filter(F.col("type").isin(node_types))


def lineage_nodes(nodes: DataFrame, types: list[str] | None = None, tags: list[str] | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    out = nodes
    if types:
        out = out.filter(F.col("type").isin(types))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if since is not None:
        out = out.filter(F.col("created") >= since)
    return out if until is None else out.filter(F.col("created") <= until)


def remove_node(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = doomed.select("node").distinct()
    kept = edges.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti")
    return nodes.join(gone, "node", "left_anti"), kept


def lineage_from_runs(runs: DataFrame) -> DataFrame:
    """Edges (source, target, kind) from a job-run log with input and output arrays."""
    return runs.select("kind", F.explode("inputs").alias("source"), "outputs").select("kind", "source", F.explode("outputs").alias("target")).select("source", "target", "kind").distinct()
