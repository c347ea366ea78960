"""Snapshot diffs, merges, record history and commit graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordering import along, fold_hashes, grouped_index, hash_bucket, join_same
from ..session import cut, dealt
from .lineage import contract_chains


def row_hash(columns: list[str]) -> Column:
    """Hash of a row: every value is prefixed with its length, nulls are marked."""
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        parts.append(F.when(v.isNull(), "n").otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat_ws("|", *parts), 256)


def snapshot(df: DataFrame, key: str, columns: list[str], kind: Column | None = None, size: Column | None = None) -> DataFrame:
    """(key, hash, kind, size) of a table version: what diffs and merges compare."""
    text = F.concat_ws("", *[F.col(c).cast("string") for c in columns])
    return df.select(F.col(key).alias("key"), row_hash(columns).alias("hash"), (kind if kind is not None else F.lit("blob")).alias("kind"),
                     (size if size is not None else F.octet_length(text).cast("bigint")).alias("size"))


def snapshot_diff(old: DataFrame, new: DataFrame, unchanged: bool = False) -> DataFrame:
    """added / deleted / modified / type_changed (and unchanged) per key."""
    a = old.select("key", *[F.col(c).alias(f"old_{c}") for c in ("hash", "kind", "size")])
    b = new.select("key", *[F.col(c).alias(f"new_{c}") for c in ("hash", "kind", "size")])
    both = a.join(b, "key", "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_kind") != F.col("new_kind"), "type_changed").when(F.col("old_hash") != F.col("new_hash"), "modified")
        .otherwise("unchanged"))
    out = both.select("key", change.alias("change"), "old_hash", "new_hash", "old_kind", "new_kind", "old_size", "new_size")
    return out if unchanged else out.filter("change <> 'unchanged'")


def detect_renames(diff: DataFrame) -> DataFrame:
    """Pair deleted and added entries of equal content, by rank of their key; the rest of the
    diff stays. Ranks inside one content hash are taken along leading digits of the key's hash,
    so that a content with very many copies is not ranked in one task."""
    plain = diff.select("key", "change", "old_hash", "new_hash", "old_size", "new_size",
                        *[F.coalesce(c, F.lit("blob")).alias(c) for c in ("old_kind", "new_kind")])
    order = F.sha2(F.col("key").cast("string"), 256)
    gone = plain.filter("change = 'deleted' AND old_kind = 'blob'").select(F.col("old_hash").alias("hash"), F.col("key").alias("old_key"), order.alias("o"))
    come = plain.filter("change = 'added' AND new_kind = 'blob'").select(F.col("new_hash").alias("hash"), F.col("key").alias("new_key"), F.col("new_size").alias("size"), order.alias("o"))
    a = grouped_index(gone, ["hash"], ["o"], hash_bucket(F.col("o"), 2), "r").drop("o")
    b = grouped_index(come, ["hash"], ["o"], hash_bucket(F.col("o"), 2), "r").drop("o")
    pairs = a.join(b, ["hash", "r"])
    renamed = pairs.select(F.col("new_key").alias("key"), F.lit("renamed").alias("change"), F.col("old_key").alias("from_key"), F.lit(100).alias("similarity"),
                           F.col("size").alias("old_size"), F.col("size").alias("new_size"))
    used = pairs.select(F.col("old_key").alias("key"), F.lit("deleted").alias("change")).unionByName(
        pairs.select(F.col("new_key").alias("key"), F.lit("added").alias("change")))
    rest = plain.join(used, ["key", "change"], "left_anti")
    return renamed.unionByName(rest.select("key", "change", F.lit(None).cast(dict(diff.dtypes)["key"]).alias("from_key"),
                                           F.lit(None).cast("int").alias("similarity"), "old_size", "new_size"))


def diff_stats(diff: DataFrame, by: list[str] = ()) -> DataFrame:
    c, old, new = F.col("change"), F.coalesce("old_size", F.lit(0)), F.coalesce("new_size", F.lit(0))
    changed = c.isin("modified", "type_changed")
    plus = F.when(c == "added", new).when(changed, F.greatest(new - old, F.lit(0))).otherwise(0)
    minus = F.when(c == "deleted", old).when(changed, F.greatest(old - new, F.lit(0))).otherwise(0)
    return diff.groupBy(*by).agg(
        F.count_if(c == "added").alias("added"), F.count_if(c == "deleted").alias("deleted"), F.count_if(changed).alias("modified"),
        F.count_if(c == "renamed").alias("renamed"), F.coalesce(F.sum(plus), F.lit(0)).alias("insertions"), F.coalesce(F.sum(minus), F.lit(0)).alias("deletions"),
        F.count_if(c != "unchanged").alias("total_changed"), F.coalesce(F.sum(plus - minus), F.lit(0)).alias("size_change"))


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Outcome per key: the merged hash (null = deleted) or the kind of conflict.

    The snapshots are stacked and grouped by key: one shuffle for all three versions."""
    stacked = base.withColumn("side", F.lit("b")).unionByName(ours.withColumn("side", F.lit("o"))).unionByName(theirs.withColumn("side", F.lit("t")))
    # keys are unique inside a snapshot, so a group holds at most three rows
    def pick(side: str, col: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col))).alias(f"{side}_{col}")

    g = stacked.groupBy("key").agg(*[pick(s, c) for s in "bot" for c in ("hash", "kind")])
    b, o, t = F.col("b_hash"), F.col("o_hash"), F.col("t_hash")
    conflict = (
        F.when(o.eqNullSafe(t) | o.eqNullSafe(b) | t.eqNullSafe(b), F.lit(None).cast("string"))
        .when((F.col("o_kind") != F.col("t_kind")) & o.isNotNull() & t.isNotNull(), "type_conflict")
        .when(b.isNull(), "both_added").when(o.isNull(), "delete_modify").when(t.isNull(), "modify_delete").otherwise("both_modified"))
    merged = F.when(o.eqNullSafe(t), o).when(o.eqNullSafe(b), t).when(t.eqNullSafe(b), o)
    out = g.withColumn("conflict", conflict)
    source = (F.when(F.col("conflict").isNotNull(), "conflict").when(o.eqNullSafe(t), F.when(o.eqNullSafe(b), "base").otherwise("both"))
              .when(o.eqNullSafe(b), "theirs").otherwise("ours"))
    return out.select("key", "conflict", F.when(F.col("conflict").isNull(), merged).alias("merged_hash"), source.alias("source"))


def merge_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], prefer: str | None = None) -> DataFrame:
    """Rows of a three-way merge: the side that changed wins, equal changes are one.

    All three have the same columns; ``keys`` (null is a value) are unique inside each. Returns the keys, the
    other columns as merged, source ('base', 'both', 'ours', 'theirs' or 'conflict') and conflict
    (null, 'both_added', 'delete_modify' if ours deleted, 'modify_delete' if theirs did, or
    'both_modified'). Rows deleted without conflict are left out. The columns of a conflict are
    null and the three versions stand in base_row, our_row and their_row (null for clean rows);
    with ``prefer`` ('ours' or 'theirs') that side's row is taken instead, source names it,
    conflict still tells the kind, and a row which that side deleted is left out.

    One shuffle: the versions are stacked and grouped by key, at most three rows each."""
    cols = [c for c in ours.columns if c not in keys]
    sides = {"b": base, "o": ours, "t": theirs}
    # the constant tells a row whose columns are all null from a missing one
    stacked = reduce(DataFrame.unionByName, [
        df.select(*keys, F.lit(side).alias("__side"), F.struct(F.lit(True).alias("__there"), *[F.col(c) for c in cols]).alias("__row")) for side, df in sides.items()])
    g = stacked.groupBy(*keys).agg(*[F.first(F.when(F.col("__side") == s, F.col("__row")), ignorenulls=True).alias(f"__{s}") for s in sides])
    b, o, t = F.col("__b"), F.col("__o"), F.col("__t")
    g = g.select("*", o.eqNullSafe(t).alias("__ot"), o.eqNullSafe(b).alias("__ob"), t.eqNullSafe(b).alias("__tb"))
    same, kept, left = F.col("__ot"), F.col("__ob"), F.col("__tb")
    conflict = (F.when(same | kept | left, F.lit(None).cast("string")).when(b.isNull(), "both_added").when(o.isNull(), "delete_modify")
                .when(t.isNull(), "modify_delete").otherwise("both_modified"))
    source = F.when(same, F.when(kept, "base").otherwise("both")).when(kept, "theirs").when(left, "ours").otherwise(prefer or "conflict")
    g = g.select("*", conflict.alias("__conflict"), source.alias("__source"))
    row = F.when(F.col("__source").isin("base", "both", "ours"), o).when(F.col("__source") == "theirs", t)
    open_ = F.col("__source") == "conflict"
    out = g.withColumn("__merged", row).filter(open_ | F.col("__merged").isNotNull())
    return out.select(
        *keys, *[F.col("__merged")[c].alias(c) for c in cols], F.col("__source").alias("source"), F.col("__conflict").alias("conflict"),
        *[F.when(open_, F.col(f"__{s}").dropFields("__there")).alias(n) for s, n in (("b", "base_row"), ("o", "our_row"), ("t", "their_row"))])


# ------------------------------------------------------------------------------- history
def number_versions(changes: DataFrame, key: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    return grouped_index(changes, [key], order, bucket, "version")


def record_at_version(versions: DataFrame, version: int) -> DataFrame:
    return versions.filter(F.col("version") == version)


def record_as_of(changes: DataFrame, key: str, order: list[str], time_col: str, at: Column) -> DataFrame:
    """The last state per key at a time; combined before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    last = changes.filter(F.col(time_col) <= at).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(key, "r.*")


def apply_updates(current: DataFrame, updates: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Optimistic locking: of the updates of a key, in ``order``, the first that expects the
    current version applies; it makes a new version, so all others conflict. One row per key.

    ``updates``: key, expected_version, the columns of ``order``, and the new value under the same
    column name. An update without an expected version conflicts."""
    known = current.select(key, F.col("version").alias("__version"))
    fits = join_same(updates, known, [key]).withColumn("__fits", F.coalesce(F.col("expected_version") == F.col("__version"), F.lit(False)))
    per = fits.groupBy(key).agg(
        F.count("*").alias("__asked"), F.max("__fits").alias("__hit"),
        F.min_by(F.struct(F.col(value).alias("new")), F.when(F.col("__fits"), F.struct(*order))).alias("__win"))
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    asked = F.coalesce(F.col("__asked"), F.lit(0))
    return join_same(current, per, [key], "left").select(
        key, F.when(hit, F.col("__win.new")).otherwise(F.col(value)).alias(value), (F.col("version") + hit.cast("int")).alias("version"),
        F.when(asked == 0, "kept").when(hit, "updated").otherwise("conflict").alias("outcome"), (asked - hit.cast("int")).alias("conflicts"))


def blame(versions: DataFrame, key: str, order: list[str], bucket: Column | None, fields: list[str], version_col: str) -> DataFrame:
    """Last version that changed each field of each record."""
    seen = along(versions, [key], order, bucket, lags={f"__p_{f}": F.col(f) for f in fields}, position="__n")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"),
                      ((F.col("__n") == 1) | ~F.col(f).eqNullSafe(F.col(f"__p_{f}"))).alias("changed")) for f in fields]
    at = F.struct(*order)
    long = seen.select(key, *order, *([version_col] if version_col not in order else []), F.explode(F.array(*cells)).alias("c")).filter("c.changed")
    return long.groupBy(key, F.col("c.field").alias("field")).agg(
        F.max_by(version_col, at).alias("last_changed"), F.max_by("c.value", at).alias("value"), F.count("*").alias("changes"))


# ------------------------------------------------------------------------------- content ids
def dataset_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent content id: row hashes collapse to (hash, copies), which are folded."""
    rows = df.select(row_hash(columns).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    lines = rows.withColumn("line", F.concat_ws("x", "h", F.col("n").cast("string")))
    return fold_hashes(lines, [], "h", "line").select(F.col("hash").alias("fingerprint"), F.col("entries").alias("distinct_rows"))


def commit_id(tree: Column, parents: Column, author: Column, time: Column, dataset: Column, message: Column) -> Column:
    """Id of a commit from its content; ``parents`` is an array of ids in order."""
    parent_lines = F.transform(parents, lambda p: F.concat(F.lit("parent "), p.cast("string"), F.lit("\n")))
    secs = F.unix_seconds(time.cast("timestamp")).cast("string")
    body = F.concat(F.lit("tree "), tree, F.lit("\n"), F.array_join(parent_lines, ""), F.lit("author "), author, F.lit(" "), secs, F.lit("\n"),
                    F.lit("dataset "), dataset.cast("string"), F.lit("\n\n"), message)
    return F.sha2(body, 256)


def tree_hash(files: DataFrame, path: str, file_hash: str) -> DataFrame:
    """Directory hashes bottom-up over sorted (mode, name, hash) entries, all files included.

    One fold per level; the loop runs over the path depths that the files have. Files that share
    a path are one entry with the smallest hash; ``tree_clashes`` lists them."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    level = files.select(F.array_join(parts, "/").alias("path"), F.lit("100644").alias("mode"), F.col(file_hash).alias("hash"), F.size(parts).alias("depth"))
    level = cut(level.groupBy("path", "mode", "depth").agg(F.min("hash").alias("hash")))
    max_depth = level.agg(F.max("depth")).first()[0] or 1
    done = None
    for depth in range(max_depth, 0, -1):
        here = level.filter(F.col("depth") == depth)
        deeper_dirs = here if done is None else here.unionByName(done)
        parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
        name = F.substring_index("path", "/", -1)
        entries = deeper_dirs.select(parent.alias("dir"), F.sha2(name, 256).alias("nh"), F.concat_ws(" ", "mode", name, "hash").alias("line"))
        dirs = fold_hashes(entries, ["dir"], "nh", "line")
        as_entries = dirs.select(F.col("dir").alias("path"), F.lit("040000").alias("mode"), F.lit(depth - 1).alias("depth"), "hash")
        found = dirs.select(F.col("dir"), F.lit(depth - 1).alias("depth"), "hash", "entries")
        out = found if depth == max_depth else out.unionByName(found)
        done = as_entries
    return out


def tree_clashes(files: DataFrame, path: str, file_hash: str) -> DataFrame:
    """Paths that stand for files of different content."""
    name = F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/")
    per = files.groupBy(name.alias("path")).agg(F.min(file_hash).alias("first"), F.max(file_hash).alias("last"), F.count("*").alias("files"))
    return per.filter("first <> last").select("path", "files")


# ------------------------------------------------------------------------------- commit graph
def history_walk(edges: DataFrame, starts: DataFrame, stops: DataFrame | None = None, first_parent: bool = False, doublings: int = 3) -> DataFrame:
    """Breadth-first walk from start commits to parents: (root, commit, depth).

    ``edges``: commit, parent, ord. All roots advance together. A stop commit is neither reported
    nor passed. Chains of commits with one parent and one child are single steps of their length
    (``contract_chains``), and steps are extended to paths of up to 2^doublings steps, so the
    rounds grow with the logarithm of the longest chain and with the branches and merges on the
    way; the commits of a chain get their depths from its first one at the end."""
    up = edges.filter("ord = 0") if first_parent else edges
    hop = up.select(F.col("commit").alias("source"), F.col("parent").alias("target"))
    front = starts.select("root", "commit")
    if stops is not None:
        hop = hop.join(stops.select(F.col("commit").alias("target")), "target", "left_anti")
        front = front.join(stops.select("commit"), "commit", "left_anti").select("root", "commit")
    front = cut(front.distinct().withColumn("depth", F.lit(0).cast("bigint")))
    steps, into, places, _ = contract_chains(cut(hop.select("source", "target").distinct()), front.select(F.col("commit").alias("node")).distinct())
    hop = cut(steps.groupBy(F.col("source").alias("__c"), F.col("target").alias("__p")).agg(F.min("len").alias("__len")))
    for _ in range(doublings):
        onward = hop.select(F.col("__c").alias("__m"), F.col("__p").alias("__q"), F.col("__len").alias("__more"))
        longer = hop.join(onward, F.col("__p") == F.col("__m")).select("__c", F.col("__q").alias("__p"), (F.col("__len") + F.col("__more")).alias("__len"))
        hop = cut(hop.unionByName(longer).groupBy("__c", "__p").agg(F.min("__len").alias("__len")))
    seen = layer = front
    old = F.lit(None).cast("bigint").alias("old")
    while not layer.isEmpty():
        step = layer.join(hop, F.col("commit") == F.col("__c")).select("root", F.col("__p").alias("commit"), (F.col("depth") + F.col("__len")).alias("depth"), old)
        both = step.unionByName(seen.select("root", "commit", "depth", F.col("depth").alias("old")))
        now = cut(both.groupBy("root", "commit").agg(F.min("depth").alias("depth"), F.min("old").alias("old")))
        seen, layer = now.drop("old"), now.filter("old IS NULL OR depth < old").drop("old")
    entered = seen.join(into.withColumnRenamed("source", "commit"), "commit").select("root", "head", (F.col("depth") + 1).alias("__at"))
    inside = entered.join(places, "head").select("root", F.col("node").alias("commit"), (F.col("__at") + F.col("off")).alias("depth"))
    return seen.unionByName(inside).withColumn("depth", F.col("depth").cast("int"))


def commit_filter(commits: DataFrame, author: str | None = None, message: str | None = None, since: Column | None = None,
                  before: Column | None = None, merges: bool = True, path_commits: DataFrame | None = None) -> DataFrame:
    """Filters do not stop a walk, they only choose what is reported. ``path_commits``: ids of
    commits that touch the wanted path."""
    out = commits
    if not merges:
        out = out.filter(F.size("parents") <= 1)
    if author is not None:
        out = out.filter(F.col("author").contains(author) | F.col("email").contains(author))
    if message is not None:
        out = out.filter(F.col("message").contains(message))
    if since is not None:
        out = out.filter(F.col("time") >= since)
    if before is not None:
        out = out.filter(F.col("time") <= before)
    return out if path_commits is None else out.join(path_commits, "commit", "left_semi")


def history(commits: DataFrame, edges: DataFrame, starts: DataFrame, stops: DataFrame | None = None, first_parent: bool = False,
            skip: int = 0, limit: int | None = None, sort: str | None = None, **filters) -> DataFrame:
    """Filtered walk with paging per root: skip and limit count in walk order (depth, then
    commit). ``sort`` then adds ``rank`` to the chosen entries of a root: 'topological' (walk
    order), 'chronological' (oldest first) or 'reverse' (newest first). Entries of one time keep
    walk order; those without a time stand first in both orders of time."""
    walk = history_walk(edges, starts, stops, first_parent)
    found = walk.join(commit_filter(commits, **filters), "commit")
    if skip or limit is not None:
        placed = grouped_index(found, ["root"], ["depth", "commit"], F.col("depth"), "__pos")
        found = placed.filter(F.col("__pos") > skip)
        if limit is not None:
            found = found.filter(F.col("__pos") <= skip + limit)
        found = found.drop("__pos")
    if sort is None:
        return found
    at = F.unix_micros(F.col("time").cast("timestamp"))
    at = {"topological": F.lit(0).cast("bigint"), "chronological": at, "reverse": -at}[sort]
    return grouped_index(found.withColumn("__at", at), ["root"], ["__at", "depth", "commit"], None, "rank").drop("__at")


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return history_walk(edges, starts)


def merge_base(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (pair, a, b): the nearest commit to b among the ancestors of a."""
    starts = pairs.select(F.struct(F.col("pair"), F.lit("a").alias("side")).alias("root"), F.col("a").alias("commit")).unionByName(
        pairs.select(F.struct(F.col("pair"), F.lit("b").alias("side")).alias("root"), F.col("b").alias("commit")))
    walk = history_walk(edges, starts)
    sides = walk.select(F.col("root.pair").alias("pair"), F.col("root.side").alias("side"), "commit", "depth")
    both = sides.groupBy("pair", "commit").agg(F.max(F.when(F.col("side") == "a", F.col("depth"))).alias("da"),
                                               F.max(F.when(F.col("side") == "b", F.col("depth"))).alias("db"))
    base = both.filter("da IS NOT NULL AND db IS NOT NULL").groupBy("pair").agg(F.min_by("commit", F.struct("db", "commit")).alias("merge_base"))
    counts = both.groupBy("pair").agg(F.count_if(F.col("db").isNull()).alias("behind"), F.count_if(F.col("da").isNull()).alias("ahead"))
    return pairs.join(base, "pair", "left").join(counts, "pair")


def history_stats(commits: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    totals = commits.agg(F.count("*").alias("commits"), F.count_if(F.size("parents") > 1).alias("merges"), F.count_distinct("author").alias("authors"),
                         F.min("time").alias("first"), F.max("time").alias("last"))
    by_author = commits.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(top)
    return totals, by_author


def roots(commits: DataFrame) -> DataFrame:
    return commits.filter(F.size("parents") == 0)


def leaves(commits: DataFrame, edges: DataFrame) -> DataFrame:
    return commits.join(edges.select(F.col("parent").alias("commit")).distinct(), "commit", "left_anti")


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent").alias("commit")).agg(F.count("*").alias("children"))


def version_stats(snapshots: DataFrame, dataset: str | None = None) -> DataFrame:
    """Per version and the one before it that exists: counts and sizes. ``snapshots``: version,
    key, hash, kind, size. Version numbers may have gaps.

    What follows each version, a row for each, goes to the rows by a broadcast: a join by version
    would gather a whole snapshot in one task."""
    keys = [dataset] if dataset else []
    numbers = snapshots.select(*keys, "version").distinct()
    follow = W.partitionBy(*keys, F.lit(0)).orderBy("version")
    steps = numbers.select(*keys, "version", F.lead("version").over(follow).alias("__next")).filter("__next IS NOT NULL")
    nxt = join_same(snapshots.select(*keys, "version", "key", "hash"), steps, [*keys, "version"], small=True).withColumn("version", F.col("__next"))
    at = F.struct(*keys, "version", "key").alias("__at")  # structs are equal where both lack a key
    rows = snapshots.count()
    old = dealt(nxt.select(at, F.col("hash").alias("old_hash")), rows, "__at")
    new = dealt(snapshots.select(at, F.col("hash").alias("new_hash"), F.col("size").alias("new_size")), rows, "__at")
    change = (F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged"))
    joined = old.join(new, "__at", "full_outer").select(*[F.col("__at")[k].alias(k) for k in [*keys, "version"]], "new_hash", "new_size", change.alias("change"))
    per = joined.groupBy(*keys, "version").agg(
        F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "modified").alias("modified"),
        F.count_if(F.col("change") == "deleted").alias("deleted"), F.count("new_hash").alias("records"), F.coalesce(F.sum("new_size"), F.lit(0)).alias("size"))
    return per
