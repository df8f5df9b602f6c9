"""Relational operators beyond plain joins: containment, as-of, overlap, paging, multiset and set differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained(inner: DataFrame, outer: DataFrame, on: list[str], start: str, end: str, o_start: str, o_end: str, width: int = 1024) -> DataFrame:
    """Pairs of inner and outer rows of the same key whose span holds the inner one.

    Outer spans are dealt into bins of ``width`` on top of the equality keys, inner spans look in the bin of their start, so
    a key with many spans is many small joins.
    """
    bins = F.explode(F.sequence(F.floor(F.col(o_start) / width).cast("long"), F.floor(F.greatest(o_start, o_end) / width).cast("long")))
    o = outer.withColumn("_bin", bins)
    i = inner.withColumn("_bin", F.floor(F.col(start) / width).cast("long"))
    return i.join(o, [*on, "_bin"]).filter((F.col(o_start) <= F.col(start)) & (F.col(o_end) >= F.col(end))).drop("_bin")


def innermost(pairs: DataFrame, key: list[str], o_start: str, o_end: str, o_id: str) -> DataFrame:
    """The smallest container of each key; none where two of the smallest size tie."""
    size = F.col(o_end) - F.col(o_start)
    best = pairs.groupBy(*key).agg(F.min(size).alias("_s"))
    tied = pairs.join(best, key).filter(size == F.col("_s")).groupBy(*key).agg(F.count("*").alias("_n"), F.min(o_id).alias(o_id))
    return tied.filter("_n = 1").select(*key, o_id)


def as_of(left: DataFrame, right: DataFrame, on: list[str], l_order: list[str], r_order: list[str], take: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the columns of the latest right row before it (or at it, if not strict).

    One union and one window: a shuffle of both sides by the key, and never a product of a key's rows.
    """
    order = F.struct(*(F.col(f"_o{i}") for i in range(len(l_order))))
    a = left.select(*on, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(l_order)), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"), F.lit(0 if strict else 1).alias("_side"))
    b = right.select(*on, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(r_order)), F.lit(None).alias("_left"), F.struct(*take).alias("_right"), F.lit(1 if strict else 0).alias("_side"))
    both = a.unionByName(b)
    w = Window.partitionBy(*on).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter(F.col("_left").isNotNull()).select("_left.*", "_found.*")


def overlapping(df: DataFrame, first: str, last: str, start: Column, end: Column) -> DataFrame:
    """Rows whose interval overlaps the closed one from start to end."""
    return df.filter((F.col(first) <= end) & (F.col(last) >= start))


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the ordered rows; a limit below 1 is refused."""
    if limit < 1:
        raise ValueError("limit must be positive")
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def keyset_page(df: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """Rows with a key below ``before``, the largest first, 1 to 200 of them."""
    rows = df if before is None else df.filter(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(max(1, min(200, limit)))


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with side and surplus; empty for equal multisets."""
    ca = a.groupBy(*a.columns).agg(F.count("*").alias("_n"))
    both = ca.withColumn("_s", F.col("_n")).unionByName(b.groupBy(*a.columns).agg((-F.count("*")).alias("_n")).withColumn("_s", F.col("_n")))
    net = both.groupBy(*a.columns).agg(F.sum("_s").alias("_net")).filter("_net != 0")
    return net.select(*a.columns, F.when(F.col("_net") > 0, "left").otherwise("right").alias("side"), F.abs("_net").alias("surplus"))


def append_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and the source rows whose keys it doesn't have."""
    return target.unionByName(source.join(target.select(*keys).distinct(), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key of both, by the order column; of equal ones the new row."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_p")).alias("_r")).select(*keys, "_r.*").select(*old.columns)


def retained(df: DataFrame, ts: str, cutoff: Column, used: Column) -> DataFrame:
    """Rows that a prune keeps: it deletes those older than both cutoff and watermark, and nothing without a watermark."""
    return df.filter(F.coalesce(F.col(ts) >= F.when(used.isNotNull(), F.least(cutoff, used)), F.lit(True)))


def fit_budget(df: DataFrame, section: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of one section that fit the budget in order: the longest prefix whose cost it covers."""
    w = Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def suffix_matches(path: Column, query: str) -> Column:
    """The path is the query or ends with it after a separator."""
    return (path == query) | path.endswith("/" + query) | path.endswith("\\" + query)


#: Patterns that may meet any path are compared so many at a time.
BLOCK = 1000


def glob_overlaps(left: DataFrame, right: DataFrame, key: str, glob: str) -> DataFrame:
    """a and b: the keys of path patterns that can name one path; * and ? stand for characters of one part, ** for any parts.

    Different patterns are compared, each pair once, and the keys of those that overlap are joined to them.  Patterns are joined on their depth
    and their first part, those without wildcards before the last part on all of these; only what has a wildcard in front, or ** anywhere,
    is compared with all.  Whether two patterns overlap is decided by walking both.
    """
    keyed = lambda df, name: df.select(F.col(key).alias(name), F.col(glob).alias(f"_{name}")).filter(F.col(f"_{name}").isNotNull()).distinct()

    def prepared(df, name):
        parts = F.split(F.regexp_replace(glob, r"^\./", ""), "/")
        deep = F.contains(F.col(glob), F.lit("**"))
        head = F.get(parts, 0)
        return df.select(glob).filter(F.col(glob).isNotNull()).distinct().select(F.col(glob).alias(f"_{name}"), F.when(deep, -1).otherwise(F.size(parts)).alias("_size"), F.when(head.rlike(r"[*?\[]"), F.lit(None)).otherwise(head).alias("_head"))

    @F.pandas_udf("boolean")
    def overlap(xs: pd.Series, ys: pd.Series) -> pd.Series:
        from functools import lru_cache

        @lru_cache(None)
        def text(a, b):
            if not a or not b:
                return all(c == "*" for c in a + b)
            if a[0] == "*" or b[0] == "*":
                return text(a[1:], b) if a[0] == "*" and text(a[1:], b) else text(a, b[1:]) if a[0] == "*" else text(a, b[1:]) or text(a[1:], b)
            return (a[0] == b[0] or "?" in (a[0], b[0])) and text(a[1:], b[1:])

        @lru_cache(None)
        def parts(a, b):
            if not a or not b:
                return all(p == "**" for p in a + b)
            if a[0] == "**":
                return parts(a[1:], b) or parts(a, b[1:])
            if b[0] == "**":
                return parts(a, b[1:]) or parts(a[1:], b)
            return text(a[0], b[0]) and parts(a[1:], b[1:])

        return pd.Series([parts(tuple(x.split("/")), tuple(y.split("/"))) for x, y in zip(xs, ys)])

    a, b = prepared(left, "a"), prepared(right, "b").select("_b", F.col("_size").alias("_bs"), F.col("_head").alias("_bh"))
    plain = lambda df, s, h: df.filter(F.col(h).isNotNull() & (F.col(s) >= 0))
    # a pattern without wildcards but in its last part meets only those that are equal up to there
    fixed = lambda c: ~F.regexp_replace(c, r"[^/]*$", "").rlike(r"[*?\[]")
    directory = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    fa, fb = plain(a, "_size", "_head").withColumn("_fixed", fixed("_a")), plain(b, "_bs", "_bh").withColumn("_fixed", fixed("_b"))
    fa, fb = fa.withColumn("_dir", directory("_a")), fb.withColumn("_bdir", directory("_b"))
    both = fa.filter("_fixed").join(fb.filter("_fixed"), (F.col("_dir") == F.col("_bdir")) & (F.col("_size") == F.col("_bs")))
    some = fa.join(fb, (F.col("_head") == F.col("_bh")) & (F.col("_size") == F.col("_bs"))).filter(~(fa["_fixed"] & fb["_fixed"]))
    take = lambda df: df.select("_a", "_b")
    out = take(both).union(take(some))
    # patterns with a wildcard in front can meet any path: a stated set against all rows, in blocks
    for one, other, name, head, size in ((a, b, "_a", "_head", "_size"), (b, a.filter(F.col("_head").isNotNull() & (F.col("_size") >= 0)), "_b", "_bh", "_bs")):
        open_ = [r[0] for r in one.filter(F.col(head).isNull() | (F.col(size) < 0)).select(name).toLocalIterator()]
        for i in range(0, len(open_), BLOCK):
            out = out.union(take(other.select("*", F.explode(F.lit(open_[i : i + BLOCK])).alias(name))))
    met = out.filter(overlap("_a", "_b"))
    pairs = met.join(keyed(left, "a"), "_a").join(keyed(right, "b"), "_b").select("a", "b")
    # a pair of keys comes from one pair of patterns only, unless a key has several
    once = lambda df: not df.select(key, glob).distinct().groupBy(key).count().filter("count > 1").head(1)
    return pairs if once(left) and once(right) else pairs.distinct()


def limited_to_changed(findings: DataFrame, changed: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """Findings without those of the given rules in files that aren't changed; without any changed file all of these go."""
    kept = changed.select(path).distinct().withColumn("_in", F.lit(True))
    return findings.join(kept, path, "left").filter(~F.col("rule_id").isin(rules) | F.col("_in")).drop("_in")


def capped_by_language(findings: DataFrame, validated: DataFrame, language: str) -> DataFrame:
    """Findings of languages that aren't validated count as info and are marked as capped."""
    ok = validated.select(language).distinct().withColumn("_ok", F.lit(True))
    marked = findings.join(F.broadcast(ok), language, "left").withColumn("capped", F.col("_ok").isNull())
    return marked.withColumn("severity", F.when(F.col("capped"), "info").otherwise(F.col("severity"))).drop("_ok")


def compact(df: DataFrame, root: str, paths: list[str]) -> DataFrame:
    """Paths below the root without it, and no fields of byte and column spans."""
    spans = ("start_byte", "end_byte", "start_col", "end_col")
    prefix = root.rstrip("/") + "/"
    return df.drop(*spans).withColumns({p: F.when(F.startswith(p, F.lit(prefix)), F.substring(F.col(p), len(prefix) + 1, 1 << 30)).otherwise(F.col(p)) for p in paths})


def without_folders(df: DataFrame, path: str, folders: list[str]) -> DataFrame:
    """Rows whose path is in none of the folders."""
    inside = F.lit(False)
    for f in folders:
        inside = inside | F.startswith(path, F.lit(f.rstrip("/") + "/")) | (F.col(path) == f.rstrip("/"))
    return df.filter(~inside)


def pack_page(files: DataFrame, symbols: DataFrame, key: str, order: list, path: str, symbol: str, cost: Column, limit: int, offset: int, budget: int) -> DataFrame:
    """rank, path and symbol: a page of files by their order, and their symbols in that order while their cost fits the budget."""
    first = files.orderBy(*order).limit(offset + limit)  # a page has a fixed bound
    page = first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)
    rows = F.broadcast(page).join(symbols, key).withColumn("_cost", cost)
    used = F.sum("_cost").over(Window.orderBy("rank", symbol).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", used).filter(F.col("_used") <= budget).select("rank", path, symbol)


def unique_suffix(files: DataFrame, wanted: DataFrame, path: str, key: str) -> DataFrame:
    """wanted, key and error: the one file whose path is, or ends with, the wanted one; several or none are an error."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    f = files.select(key, path, last(F.col(path)).alias("_last"))
    hits = wanted.select("wanted", last(F.col("wanted")).alias("_last")).join(f, "_last").filter((F.col(path) == F.col("wanted")) | F.endswith(path, F.concat(F.lit("/"), F.col("wanted"))))
    counts = hits.groupBy("wanted").agg(F.count("*").alias("_n"), F.min(key).alias(key))
    found = wanted.join(counts, "wanted", "left")
    return found.select("wanted", F.when(F.col("_n") == 1, F.col(key)).alias(key), F.when(F.col("_n").isNull(), "file_not_found").when(F.col("_n") > 1, "ambiguous_path").alias("error"))


def planned_rewrites(targets: DataFrame, file: str, start: str, end: str) -> DataFrame:
    """Adds applied: by start, then end, a target is applied unless it begins before the end of one applied before it in its file.

    Files are sorted within partitions and streamed: a task holds a batch and the last end, however many targets a file has.
    """

    def choose(batches):
        import pyarrow as pa

        at, last = None, 0
        for batch in batches:
            kept = []
            for f, s, e in zip(*(batch.column(c).to_pylist() for c in (file, start, end))):
                if at is None or at[0] != f:
                    at, last = (f,), 0
                kept.append(s >= last)
                last = max(last, e) if kept[-1] else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], [*batch.schema.names, "applied"])

    from pyspark.sql.types import BooleanType, StructType

    schema = StructType(list(targets.schema.fields)).add("applied", BooleanType())
    return targets.repartition(file).sortWithinPartitions(file, start, end).mapInArrow(choose, schema)


def fenced(events: DataFrame, slot: str, order: list[str], claim: Column, epoch: Column) -> DataFrame:
    """Adds current, the number of claims of a slot so far, and accepted: whether an event's epoch is that number."""
    w = Window.partitionBy(slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("current", F.count_if(claim).over(w)).withColumn("accepted", claim | (epoch == F.col("current")))


def append_only_violations(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows that an append-only table lost (deleted) or that have other values now (updated)."""
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*values).alias("_old")).join(new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_in")), keys, "left")
    status = F.when(F.col("_in").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return both.select(*keys, status.alias("violation")).filter("violation IS NOT NULL")


def refreshed(index: DataFrame, old: DataFrame, new: DataFrame, sources: DataFrame, build, key: str, value: str) -> DataFrame:
    """An index after its sources changed: entries of deleted and changed keys go, and ``build`` runs over new and changed sources only."""
    from ..sources import manifest_diff

    diff = manifest_diff(old, new, key, value)
    kept = index.join(diff.filter("status = 'unchanged'").select(key), key, "left_semi")
    return kept.unionByName(build(sources.join(diff.filter("status IN ('new', 'changed')").select(key), key, "left_semi")))
