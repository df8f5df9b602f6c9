"""Graph operators over edge tables (src, dst): closures, rankings, layers, levels, paths, fingerprints.

Closures are iterative: each round joins the frontier with the edges and drops what is known, so a round's cost
follows the frontier.  Every round's frontier is written to the shared folder (``cut``), so lineage
stays one round deep.  What follows from all that leads to a node is found by ``peeled``, which uses every edge once.  Order-dependent algorithms run per component or module in ``applyInPandas``.
"""

from __future__ import annotations

import atexit
import contextlib
import heapq
import tempfile
import uuid
from array import array
from collections import Counter, defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own_dir: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage by a Parquet table in the shared folder the session names; a local master, which has one machine, may do without."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="lodestar-"))
        named = "file://" + _own_dir[0]
    path = f"{named.rstrip('/')}/lodestar/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _release() -> None:
    """Deletes the tables when the driver ends, as results may be read until then."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be over, and its JVM gone
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: About so many rows that are compared or counted by keys are one task's.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *by: str | Column) -> DataFrame:
    """The rows by their keys in as many parts as hold about ``ROWS`` each, so that what a task holds doesn't follow the input; few rows are left to adaptive execution."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *by) if rows > ROWS else df


def side(df: DataFrame, n: int | None = None) -> DataFrame:
    """A side of a join by its n rows: few are broadcast; more, or rows not counted, never, as Spark takes a compressed file's size for what the rows take on the driver."""
    return F.broadcast(df) if n is not None and n <= FEW else df.hint("merge")


def _closed(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> tuple[DataFrame, int]:
    """start, node and depth of the seeds and everything reachable, each pair once, and the number of these rows."""
    edges = cut(edges.select("src", "dst").distinct())
    known = frontier = cut(seeds.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    n_edges, n_known, depth = edges.count(), frontier.count(), 0
    last, ways = n_known, n_edges / max(1, edges.agg(F.approx_count_distinct("src")).head()[0])
    while last and (max_depth is None or depth < max_depth):
        depth += 1
        far, near = frontier.select("start", "node"), edges
        if last > ROWS:
            rows = max(last, n_edges)
            far, near = spread(far, rows, "node"), spread(near, rows, "src")
        step = far.join(near, far["node"] == near["src"]).select("start", F.col("dst").alias("node"))
        rows = max(int(last * ways), n_known)
        step = spread(step, rows, "start", "node").distinct().join(spread(known.select("start", "node"), rows, "start", "node"), ["start", "node"], "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        last = frontier.count()
        known, n_known = known.unionByName(frontier), n_known + last
    return known, n_known


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, node and depth of everything reachable from the seeds (start), without the starts themselves."""
    return _closed(edges, seeds, max_depth)[0].filter(F.col("node") != F.col("start"))


def closure_sizes(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start and size: how many nodes other than itself each seed (start) reaches; those that reach none are left out."""
    known, rows = _closed(edges, seeds, max_depth)
    return spread(known.select("start", "node"), rows, "start").filter(F.col("node") != F.col("start")).groupBy("start").agg(F.count("*").alias("size"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 50) -> DataFrame:
    """start, node and path: a shortest path to each reachable node, of several the smallest."""
    edges = edges.select("src", "dst").distinct()
    known = seeds.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    frontier = known
    for _ in range(max_depth):
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("start", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).withColumnRenamed("dst", "node")
        frontier = cut(step.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        if not frontier.head(1):
            break
        known = known.unionByName(frontier)
    return known


def leaderboard(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes (id, path, data_only) by distinct dependents: code before data, then most dependents, fan-in and path."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("dependents"), F.count("*").alias("fan_in"))
    order = ["data_only", F.desc("dependents"), F.desc("fan_in"), "path"]
    ranked = counts.join(nodes, "id").orderBy(*order).select("id", "path", "dependents", "fan_in")
    return ranked.limit(limit) if limit else ranked


def caller_leaderboard(calls: DataFrame, excluded: DataFrame, limit: int | None = None) -> DataFrame:
    """Symbols (target) by distinct calling files, then calls, path and name; exclusions come before the limit."""
    out = cut(excluded.select("target").distinct())
    left = cut(calls.select("target", "path", "name", "from_file").join(F.broadcast(out) if out.count() <= FEW else out, "target", "left_anti"))
    # a caller's calls are summed first, in parts of bounded size, then its symbols' callers
    rows, symbol = left.count(), ["target", "path", "name"]
    callers = spread(left, rows, *symbol, "from_file").groupBy(*symbol, "from_file").agg(F.count("*").alias("_n"))
    if rows > ROWS:
        callers = cut(callers)
        callers = spread(callers, callers.count(), *symbol)
    # a null file is no caller, its calls count
    ranked = callers.groupBy(*symbol).agg(F.count("from_file").alias("breadth"), F.sum("_n").alias("total")).orderBy(F.desc("breadth"), F.desc("total"), *["path", "name", "target"])
    return ranked.limit(limit) if limit else ranked


def module_layers(edges: DataFrame, src_dir: Column, dst_dir: Column, least: int = 3) -> DataFrame:
    """Directory pairs that at least ``least`` distinct file pairs cross."""
    d = edges.select(src_dir.alias("from_dir"), dst_dir.alias("to_dir"), "src", "dst").filter("from_dir != to_dir")
    return d.groupBy("from_dir", "to_dir").agg(F.countDistinct("src", "dst").alias("pairs")).filter(F.col("pairs") >= least)


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in (resolved edges to it) and fan_out (all edges from it)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    into = edges.filter(F.col("dst").isNotNull()).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def unique_targets(candidates: DataFrame, site: list[str], priority: str, target: str) -> DataFrame:
    """Per site the target of the first pass that has exactly one candidate."""
    each = candidates.groupBy(*site, priority).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).filter("_n = 1")
    return each.groupBy(*site).agg(F.min_by(target, priority).alias(target), F.min(priority).alias("resolved_by"))


def trimmed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that are left when those from nodes that nothing leads to, and to nodes that lead nowhere, go again and again; and their nodes.

    Only nodes are shuffled to find what goes, and without such a node the edges stay as they are.
    """
    edges = edges.select("src", "dst").dropna()
    while True:
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("_out"), F.lit(0).alias("_in")).union(edges.select("dst", F.lit(0), F.lit(1)))
        ends = cut(ends.groupBy("node").agg(F.max("_out").alias("_out"), F.max("_in").alias("_in")))
        dead = ends.filter("_out + _in < 2").select("node")
        n = dead.count()
        if not n:
            return edges, ends.select("node")
        edges = cut(_without(edges, dead, n))


def _without(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The edges that touch none of the n nodes."""
    return edges.join(side(nodes.withColumnRenamed("node", "src"), n), "src", "left_anti").join(side(nodes.withColumnRenamed("node", "dst"), n), "dst", "left_anti").select("src", "dst")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: loops, and nodes of strongly connected parts of several.

    Each round trims what is on no cycle, gives every node the largest number that reaches it, and takes, of the nodes
    with one number, those that reach the node of that number: a strongly connected part, which then leaves.  Edges between numbers are
    on no cycle and leave, too.  No node's closure is made, and only nodes whose number grew send it on.
    """
    edges = cut(edges.select("src", "dst").distinct())
    found = edges.filter("src = dst").select(F.col("src").alias("node"))
    edges = edges.filter("src != dst")
    while True:
        edges, nodes = trimmed(edges)
        if not edges.head(1):
            return found.distinct()
        colour = grown = nodes.select("node", F.col("node").alias("c"))
        n = n_nodes = colour.count()
        while n:
            grown = grown.select(F.col("node").alias("src"), "c")
            sent = edges.join(side(grown, n), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("_in"))
            after = cut(colour.join(sent, "node", "left").select("node", F.greatest("c", F.coalesce("_in", "c")).alias("c"), (F.col("_in") > F.col("c")).alias("_new")))
            colour, grown = after.select("node", "c"), after.filter("_new").select("node", "c")
            n = grown.count()
        own = edges.join(side(colour.select(F.col("node").alias("src"), F.col("c").alias("_c1")), n_nodes), "src").join(side(colour.select(F.col("node").alias("dst"), F.col("c").alias("_c2")), n_nodes), "dst").filter("_c1 = _c2").select("src", "dst", F.col("_c1").alias("c"))
        own = cut(own)
        # backward from each colour's root, inside its colour
        part = cut(own.filter("src = c").select(F.col("c").alias("node"), "c").distinct())
        frontier = part
        while True:
            back = own.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            frontier = cut(back.join(part.select("node"), "node", "left_anti"))
            if not frontier.head(1):
                break
            part = cut(part.union(frontier.select("node", "c")))
        several = part.join(part.groupBy("c").agg(F.count("*").alias("_n")).filter("_n > 1"), "c").select("node")
        found = cut(found.union(several))
        gone = part.count()
        if gone == n_nodes:
            return found.distinct()
        # a root without an edge of its colour is on no cycle, and in no edge of own
        edges = cut(_without(own, part.select("node"), gone))


#: So many edges are peeled in one task, and a frontier of so many nodes is broadcast.
LOCAL, FEW = 500_000, 200_000
#: So many rows of a result leave a task at once.
BATCH = 50_000
#: After so many small frontiers the edges that are used up are left behind.
ROUNDS = 10


def peeled(nodes: DataFrame, edges: DataFrame, how: str = "add", by: tuple[str, ...] = (), most_ways: int = 1) -> DataFrame:
    """by, node, total and ways of each node (by, node, own) all that leads to which are such nodes, by edges (by, src, dst); those on or behind a cycle are left out.

    total: the own value and the largest total of the nodes before it, added ("add") or the larger of the two ("max"); ways: the paths
    that end in the node, itself included, at most ``most_ways``.  Nodes wait until all their edges have been used: a large frontier is
    joined to the edges, of which its own then go; a small one is broadcast to them.  The last LOCAL edges are peeled in one task.
    """
    by, most = list(by), F.lit(most_ways).cast("long")
    key, src, dst = [*by, "node"], [*by, "src"], [*by, "dst"]
    kind = nodes.schema["own"].dataType
    nodes = nodes.groupBy(*key).agg(F.max("own").alias("own"))
    edges = edges.select(*src, "dst").distinct()
    need = edges.groupBy(*dst).agg(F.count("*").alias("need"))
    left = cut(edges.join(side(need), dst).join(side(nodes.withColumnRenamed("node", "dst")), dst).select(*src, "dst", "need", "own"))
    total = F.greatest("own", "best") if how == "max" else F.col("own") + F.col("best")
    waiting = left.sparkSession.createDataFrame([], left.withColumnRenamed("dst", "node").select(*key, F.lit(0).cast("long").alias("got"), "need", "own", F.col("own").alias("best"), F.lit(0).cast("long").alias("ways")).schema)
    frontier = cut(nodes.join(side(need.withColumnRenamed("dst", "node")), key, "left_anti").select(*key, F.col("own").alias("total"), F.least(F.lit(1).cast("long"), most).alias("ways")))
    done, used = frontier, []
    n, edges_left = frontier.count(), left.count()
    while n:
        if edges_left <= LOCAL:
            return done.union(_peeled_rest(frontier, waiting, left, how, by, most_ways, kind))
        used.append(frontier)
        near = frontier.withColumnRenamed("node", "src")
        hit = left.join(side(near, n), src)
        sent = hit.select(*by, F.col("dst").alias("node"), F.lit(1).cast("long").alias("got"), "need", "own", F.col("total").alias("best"), "ways")
        both = waiting.union(sent).groupBy(*key).agg(F.sum("got").alias("got"), F.max("need").alias("need"), F.max("own").alias("own"), F.max("best").alias("best"), F.least(F.sum("ways"), most).alias("ways"))
        both = cut(both)
        waiting = both.filter("got < need")
        frontier = both.filter("got = need").select(*key, total.alias("total"), F.least(F.col("ways") + 1, most).alias("ways"))
        done = done.union(frontier)
        if n > FEW or len(used) == ROUNDS:
            gone = used[0]
            for f in used[1:]:
                gone = gone.union(f)
            left = cut(left.join(side(gone.select(*by, F.col("node").alias("src"))), src, "left_anti"))
            used, edges_left = [], left.count()
        n = frontier.count()
    return done


def _peeled_rest(frontier: DataFrame, waiting: DataFrame, left: DataFrame, how: str, by: list[str], most_ways: int, kind) -> DataFrame:
    """What ``peeled`` finds after the frontier, by one task."""
    zero = F.lit(0).cast("long")
    shape = lambda i, df, node, dst, got, need, own, best, ways: df.select(F.lit(0).alias("_k"), F.lit(i).alias("_i"), *by, F.col(node).alias("node"), F.col(dst).alias("dst"), got.alias("got"), need.alias("need"), own.alias("own"), best.alias("best"), ways.alias("ways"))
    c = F.col
    rows = shape(0, frontier, "node", "node", zero, zero, c("total"), c("total"), c("ways")).union(shape(1, waiting, "node", "node", c("got"), c("need"), c("own"), c("best"), c("ways"))).union(shape(2, left, "src", "dst", zero, c("need"), c("own"), c("own"), zero))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, after, todo, out = {}, defaultdict(list), [], []
        groups = list(zip(*(pdf[k] for k in by))) if by else [()] * len(pdf)
        order = pdf["_i"].to_numpy().argsort(kind="stable")
        columns = [pdf[k].tolist() for k in ("_i", "node", "dst", "got", "need", "own", "best", "ways")]
        for at in order.tolist():
            i, node, dst, got, need, own, best, ways = (x[at] for x in columns)
            g = groups[at]
            if i == 0:
                todo.append(((*g, node), best, ways))
            elif i == 1:
                state[(*g, node)] = [got, need, own, best, ways]
            else:
                after[(*g, node)].append((*g, dst))
                state.setdefault((*g, dst), [0, need, own, None, 0])
        while todo:
            v, total, ways = todo.pop()
            for d in after[v]:
                s = state[d]
                s[0] += 1
                s[3] = total if s[3] is None else max(s[3], total)
                s[4] = min(s[4] + ways, most_ways)
                if s[0] == s[1]:
                    new = (d, max(s[2], s[3]) if how == "max" else s[2] + s[3], min(s[4] + 1, most_ways))
                    todo.append(new)
                    out.append((*d, *new[1:]))
        return pd.DataFrame(out, columns=[*by, "node", "total", "ways"])

    kinds = {f.name: f.dataType.simpleString() for f in frontier.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*by, "node")) + f", total {kind.simpleString()}, ways long"
    return rows.groupBy("_k").applyInPandas(run, schema)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and level: the longest chain of edges that leads to it; nodes on or behind a cycle have none."""
    known = peeled(nodes.select("node", F.lit(1).cast("long").alias("own")), edges)
    return nodes.join(side(known.select("node", (F.col("total") - 1).cast("int").alias("level"))), "node", "left")


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The largest total duration along dependencies (one row, null on a cycle or without durations); nodes: node, duration."""
    known = peeled(nodes.select("node", F.coalesce("duration", F.lit(0.0)).cast("double").alias("own")), edges)
    if not nodes.filter("duration is not null").head(1) or known.count() < nodes.select("node").distinct().count():
        return nodes.sparkSession.createDataFrame([(None,)], "critical_s double")
    return known.agg(F.max("total").alias("critical_s"))


def is_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: whether the dependencies order every pair of nodes, which is so if each level has one node."""
    order = levels(nodes.select("node"), edges)
    counts = order.agg(F.count("*").alias("n"), F.countDistinct("level").alias("levels"), F.count_if(F.col("level").isNull()).alias("_on"))
    return counts.select(((F.col("levels") == F.col("n")) & (F.col("_on") == 0)).alias("is_chain"), "n", "levels")


def fingerprints(nodes: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """node and digest: a node's key, then for each hop the digest of its own and its neighbours' digests."""
    now = nodes.select("node", F.sha2(F.col("key").cast("string"), 256).alias("digest"))
    edges = edges.select("src", "dst").distinct()
    for _ in range(hops):
        near = edges.join(now.select(F.col("node").alias("dst"), F.col("digest").alias("_d")), "dst").groupBy(F.col("src").alias("node")).agg(F.concat_ws(",", F.sort_array(F.collect_list("_d"))).alias("_n"))
        now = now.join(near, "node", "left").select("node", F.sha2(F.concat_ws("|", "digest", F.coalesce("_n", F.lit(""))), 256).alias("digest"))
    return now


def blockers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and kind of what keeps it back: a missing, an incomplete or a cyclic dependency; nodes: node, done."""
    d = edges.join(nodes.select(F.col("node").alias("dst"), "done"), "dst", "left")
    kinds = d.select(F.col("src").alias("node"), F.when(F.col("done").isNull(), "dependency_missing").when(~F.col("done"), "dependency_incomplete").alias("kind")).filter("kind is not null")
    return kinds.unionByName(on_cycles(edges).withColumn("kind", F.lit("dependency_cycle"))).distinct()


def _grouped(edges: DataFrame, group: str):
    return edges.groupBy(group)


def communities(edges: DataFrame, group: str = "component") -> DataFrame:
    """node and community by one level of local moving in each component, nodes in order, ties to the smaller label.

    Each move depends on all before it, so a component is one task.  It gets the neighbours sorted by node, and holds of them 4 bytes
    each: their places in the component's order.
    """
    edges = cut(edges.filter("src != dst").select(group, "src", "dst"))
    places = cut(_numbered(edges.select(group, F.col("src").alias("node")).union(edges.select(group, "dst")).distinct(), group, ["node"]))
    n = places.count()
    at = lambda name: side(places.select(group, F.col("node").alias(name), F.col("position").alias(f"_{name}")), n)
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(f"_{a}").alias("at"), F.col(f"_{b}").alias("near"))
    both = edges.join(at("src"), [group, "src"]).join(at("dst"), [group, "dst"]).select(group, F.inline(F.array(way("src", "dst"), way("dst", "src"))))

    def run(batches):
        name, nodes, near, ends = None, array("q"), array("i"), array("q")
        for batch in batches:
            table = [batch[k].to_numpy(zero_copy_only=False) for k in ("at", "node", "near")]
            names = batch[group].to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if names[start] != name:
                    yield from _moved(nodes, near, ends)
                    name, nodes, near, ends = names[start], array("q"), array("i"), array("q")
                places, ids, neighbours = (x[start:end] for x in table)
                last = np.flatnonzero(np.append(places[1:] != places[:-1], True))
                if len(nodes) > places[0]:  # the batch before ended within this node
                    ends.pop(), nodes.pop()
                nodes.frombytes(ids[last].astype(np.int64).tobytes())
                ends.frombytes((last + (len(near) + 1)).astype(np.int64).tobytes())
                near.frombytes(neighbours.astype(np.int32).tobytes())
        yield from _moved(nodes, near, ends)

    return both.repartition(group).sortWithinPartitions(group, "at").select(group, "at", "node", "near").mapInArrow(run, "node long, community long")


def _moved(nodes: array, near: array, ends: array):
    """Batches of node and community of a component: its nodes in order, and the places of all neighbours, node by node; one listed twice weighs 2."""
    degree = np.diff(np.frombuffer(ends, np.int64), prepend=0).astype(float)
    mass, total = degree.tolist(), float(degree.sum()) or 1.0
    label, around = np.arange(len(nodes), dtype=np.int32), np.frombuffer(near, np.int32)
    for _ in range(50):
        moved, start = False, 0
        for v, end in enumerate(ends):
            old, own = int(label[v]), float(end - start)
            mass[old] -= own
            links = Counter(label[around[start:end]].tolist())
            best, gain = old, links.get(old, 0.0) - own * mass[old] / total
            for c in sorted(links):
                g = links[c] - own * mass[c] / total
                if g > gain + 1e-9 or (abs(g - gain) <= 1e-9 and c < best):
                    best, gain = c, max(g, gain)
            mass[best] += own
            if best != old:
                label[v], moved = best, True
            start = end
        if not moved:
            break
    used, first = np.unique(label, return_index=True)
    least, ids = np.zeros(len(nodes), np.int32), np.frombuffer(nodes, np.int64)
    least[used] = first
    for i in range(0, len(nodes), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + BATCH]), pa.array(ids[least[label[i : i + BATCH]]])], ["node", "community"])


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with their position in their group by the order's columns; no group is gathered."""
    order = [group, *order]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_piece", F.shiftright("_id", 33))
    starts = rows.groupBy(group, "_piece").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = starts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = cut(starts)
    return rows.join(side(starts, starts.count()), [group, "_piece"]).withColumn("position", (F.col("_id") - F.col("_first") + F.col("_base")).cast("int")).drop("_piece", "_id", "_n", "_first", "_base")


def module_depths(edges: DataFrame, hop_limit: int = 12, expansion_cap: int = 20_000, group: str = "module") -> DataFrame:
    """node, depth and capped: the longest simple path from each node within its module; capped where the hop limit or the expansion cap ended the walk.

    Where no cycle is reached, lengths and numbers of paths follow from those of the nodes after it.  Only nodes that reach a cycle are walked from, a module in one task.
    """
    edges = edges.select(group, "src", "dst").distinct()
    nodes = cut(edges.select(group, F.col("src").alias("node")).union(edges.select(group, "dst")).distinct())
    edges = cut(edges.filter("src != dst"))
    back = edges.select(group, F.col("dst").alias("src"), F.col("src").alias("dst"))
    known = peeled(nodes.withColumn("own", F.lit(1).cast("long")), back, by=(group,), most_ways=expansion_cap + 1)
    known = cut(known.select(group, "node", F.least(F.col("total") - 1, F.lit(hop_limit)).cast("int").alias("depth"), "ways"))
    over = (F.col("depth") >= hop_limit) | (F.col("ways") > expansion_cap)
    plain = known.select("node", F.when(over, hop_limit).otherwise(F.col("depth")).alias("depth"), over.alias("capped"))
    rest = cut(nodes.join(known, [group, "node"], "left_anti"))
    if not rest.head(1):
        return plain
    on = edges.join(rest.withColumnRenamed("node", "src"), [group, "src"], "left_semi").join(known.withColumnRenamed("node", "dst"), [group, "dst"], "left")
    on = on.select(group, "src", "dst", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("ways", F.lit(0)).alias("ways"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after, leaf = defaultdict(set), {}
        for a, b, depth, ways in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["depth"].tolist(), pdf["ways"].tolist()):
            after[a].add(b)
            if depth >= 0:
                leaf[b] = depth, ways
        rows = []
        for start in sorted(after):
            best, spent, capped = 0, 0, False
            stack = [(start, frozenset([start]))]
            while stack:
                at, seen = stack.pop()
                spent += 1
                best = max(best, len(seen) - 1)
                for n in after[at] - seen:
                    if n in leaf:
                        best, spent = max(best, len(seen) + leaf[n][0]), spent + leaf[n][1]
                    else:
                        stack.append((n, seen | {n}))
                if best >= hop_limit or spent > expansion_cap:
                    capped, best = True, hop_limit
                    break
            rows.append((start, best, capped))
        return pd.DataFrame(rows, columns=["node", "depth", "capped"])

    return plain.union(on.groupBy(group).applyInPandas(walk, "node long, depth int, capped boolean"))


def immediate_dominators(after: dict, starts: list) -> dict:
    """For each node reachable from the starts, the last node before it that every way to it passes; None where there is no single one."""
    order, seen = [], set()
    for start in starts:
        stack = [(start, iter(sorted(after.get(start, ()))))] if start not in seen else []
        seen.add(start)
        while stack:
            at, rest = stack[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(sorted(after.get(n, ())))))
                    break
            else:
                order.append(at)
                stack.pop()
    place = {v: i for i, v in enumerate(order)}
    place[None] = len(order)  # the start of all starts
    before = defaultdict(list)
    for v in order:
        for n in after.get(v, ()):
            before[n].append(v)
    for v in starts:
        before[v].append(None)
    above: dict = {}

    def meet(x, y):
        while x != y:
            if place[x] < place[y]:
                x = above[x]
            else:
                y = above[y]
        return x

    changed = True
    while changed:
        changed = False
        for v in reversed(order):
            known = [p for p in before[v] if p is None or p in above]
            now = known[0]
            for p in known[1:]:
                now = meet(now, p)
            if above.get(v, v) != now:
                above[v], changed = now, True
    return above


def _dominator_chains(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """group, node and chain of nodes (group, node, private) that are on no cycle and behind none, by edges (group, src, dst) to private ones.

    chain: the nodes that every way from an entry to the node passes, in order, itself last; null where no entry reaches it.  It is what the chains of those
    before it begin with alike, as the first and the last of them in the order of arrays do.  A node waits until all its edges have been used.
    """
    need = edges.groupBy(group, "dst").agg(F.count("*").alias("need"))
    left = cut(edges.join(need, [group, "dst"]))
    frontier = nodes.join(need.withColumnRenamed("dst", "node"), [group, "node"], "left_anti").select(group, "node", F.when(F.col("private"), None).otherwise(F.array("node")).alias("chain"))
    frontier = cut(frontier)
    done, waiting = frontier, None
    n = frontier.count()
    while n:
        near = frontier.withColumnRenamed("node", "src")
        hit = left.join(side(near, n), [group, "src"])
        sent = hit.select(group, F.col("dst").alias("node"), F.lit(1).cast("long").alias("got"), "need", F.col("chain").alias("low"), F.col("chain").alias("high"))
        both = cut((waiting.union(sent) if waiting is not None else sent).groupBy(group, "node").agg(F.sum("got").alias("got"), F.max("need").alias("need"), F.min("low").alias("low"), F.max("high").alias("high")))
        waiting = both.filter("got < need")
        differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        alike = F.slice("low", 1, F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int"))
        frontier = both.filter("got = need").select(group, "node", F.concat(alike, F.array("node")).alias("chain"))
        done = done.union(frontier)
        n = frontier.count()
    return done


def dominated(edges: DataFrame, group: str = "module") -> DataFrame:
    """root and node: private nodes that no entry reaches without the root; edges: src, dst, src_private, dst_private.

    Roots are read off chains of dominators, found in rounds; for what no entry reaches they are all that lead to it.  Only a module with a cycle
    that passes no entry is one task, whose work is its edges and its result.
    """
    edges = cut(edges.select(group, "src", "dst", "src_private", "dst_private").distinct())
    nodes = cut(edges.select(group, F.col("src").alias("node"), F.col("src_private").alias("private")).union(edges.select(group, "dst", "dst_private")).groupBy(group, "node").agg(F.max("private").alias("private")))
    inner = cut(edges.filter("dst_private AND src != dst").select(group, "src", "dst"))  # ways to an entry decide nothing
    chains = cut(_dominator_chains(nodes, inner, group))
    cyclic = cut(nodes.join(chains, [group, "node"], "left_anti").select(group).distinct())
    chains = chains.join(F.broadcast(cyclic), group, "left_anti")
    above = chains.filter("chain IS NOT NULL").select(F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("root"), "node")
    apart = cut(chains.filter("chain IS NULL").select(group, F.col("node").alias("dst")))
    named = lambda name: F.struct(group, F.col(name).alias("node"))
    up = inner.join(apart, [group, "dst"], "left_semi").select(named("dst").alias("src"), named("src").alias("dst"))
    leading = closure(up, up.select(F.col("src").alias("start"))).select(F.col("node.node").alias("root"), F.col("start.node").alias("node"))
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after, before, private = defaultdict(set), defaultdict(set), {}
        for a, b, pa_, pb in zip(pdf["src"], pdf["dst"], pdf["src_private"], pdf["dst_private"]):
            after[a].add(b)
            before[b].add(a)
            private[a], private[b] = bool(pa_), bool(pb)
        above = immediate_dominators(after, sorted(v for v in private if not private[v]))
        rows = []
        for v in sorted(v for v in private if private[v]):
            if v in above:
                at = above[v]
                while at is not None:
                    rows.append((at, v))
                    at = above[at]
            else:
                todo, seen = deque(before[v]), set()
                while todo:
                    x = todo.popleft()
                    if x not in seen:
                        seen.add(x)
                        todo.extend(before[x] - seen)
                rows += [(x, v) for x in sorted(seen - {v})]
        return pd.DataFrame(rows, columns=["root", "node"]).astype("int64")

    rows = above.union(leading).select(F.col("root").cast("long").alias("root"), F.col("node").cast("long").alias("node"))
    if not cyclic.head(1):
        return rows
    return rows.union(edges.join(F.broadcast(cyclic), group, "left_semi").groupBy(group).applyInPandas(run, "root long, node long"))


def first_entries(edges: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """group, node and owner: the smallest entry that reaches the node (by edges: group, src, dst), by rounds in which only what changed is sent on."""
    known = cut(entries.select(group, "node", F.col("node").alias("owner")).distinct())
    frontier, n = known, known.count()
    while n:
        near = frontier.withColumnRenamed("node", "src")
        sent = edges.join(side(near, n), [group, "src"]).select(group, F.col("dst").alias("node"), F.col("owner").alias("_in"))
        sent = sent.groupBy(group, "node").agg(F.min("_in").alias("_in"))
        known = cut(known.select(group, "node", "owner").join(sent, [group, "node"], "full").select(group, "node", F.least("owner", "_in").alias("owner"), F.coalesce(F.col("_in") < F.col("owner"), F.col("_in").isNotNull()).alias("_new")))
        frontier = known.filter("_new").select(group, "node", "owner")
        n = frontier.count()
    return known.select(group, "node", "owner")


def flow_trees(edges: DataFrame, entries: DataFrame, group: str = "module", cap: int = 1000) -> DataFrame:
    """entry, seq, node, depth and backref: depth-first call trees, each callee expanded once in its module, cycles cut.

    A node is expanded in the tree of the smallest entry that reaches it, as long as no tree gets as deep as the cap.  So what has one such entry is a task's piece;
    only a module that has such a piece of ``cap`` nodes or more is one task.
    """
    edges = cut(edges.select(group, "src", "dst").distinct())
    owned = cut(first_entries(edges, entries, group))
    deep = owned.groupBy(group, "owner").count().filter(F.col("count") >= cap).select(group).distinct()
    owned = cut(owned.join(F.broadcast(deep.withColumn("_whole", F.lit(True))), group, "left").select(group, "node", F.when(F.col("_whole"), None).otherwise(F.col("owner")).alias("owner"), F.col("owner").alias("first")))
    calls = edges.join(owned.withColumnRenamed("node", "src"), [group, "src"])
    calls = calls.join(owned.select(group, F.col("node").alias("dst"), F.col("first").alias("_dst")), [group, "dst"]).select(group, "owner", "src", "dst", F.lit(False).alias("_entry"), (F.col("_dst") < F.col("first")).alias("_back"))
    starts = entries.select(group, "node").distinct().join(owned, [group, "node"]).select(group, F.when(F.col("owner").isNotNull(), F.col("node")).alias("owner"), F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("_entry"), (F.col("first") < F.col("node")).alias("_back"))

    def trees(entries: list, calls: list, whole: bool) -> list:
        """Rows of the entries, by calls (src, dst, whether an entry before has expanded dst, if not all are here)."""
        after, expanded, rows = defaultdict(list), set(), []
        for a, b, back in sorted(calls):
            after[a].append(b)
            if back and not whole:
                expanded.add(b)
        for entry, back in sorted(entries):
            if back and not whole:
                expanded.add(entry)
            seq, stack = 0, [(entry, 0, frozenset())]
            while stack:
                v, depth, path = stack.pop()
                back = v in expanded
                rows.append((entry, seq, v, depth, back))
                seq += 1
                if not back and depth < cap:
                    expanded.add(v)
                    stack += [(n, depth + 1, path | {v}) for n in reversed(after[v]) if n not in path and n != v]
        return rows

    def run(batches):
        """Pieces come sorted; only one of them is held."""
        name, starts, calls, rows = None, [], [], []
        for batch in batches:
            for g, owner, src, dst, entry, back in zip(*(batch[k].to_pylist() for k in (group, "owner", "src", "dst", "_entry", "_back"))):
                if (g, owner) != name:
                    rows += trees(starts, calls, name is not None and name[1] is None)
                    name, starts, calls = (g, owner), [], []
                    if len(rows) >= BATCH:
                        yield from shaped(rows)
                        rows = []
                (starts if entry else calls).append((src, back) if entry else (src, dst, back))
        yield from shaped(rows + trees(starts, calls, name is not None and name[1] is None))

    def shaped(rows: list):
        kinds = {"entry": pa.int64(), "seq": pa.int32(), "node": pa.int64(), "depth": pa.int32(), "backref": pa.bool_()}
        for i in range(0, len(rows), BATCH):
            some = zip(*rows[i : i + BATCH])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(some, kinds.values())], list(kinds))

    pieces = calls.unionByName(starts).repartition(group, "owner").sortWithinPartitions(group, "owner")
    return pieces.mapInArrow(run, "entry long, seq int, node long, depth int, backref boolean")


def waves(tasks: DataFrame, workers: int, group: str = "plan") -> DataFrame:
    """The tasks of each plan that may run together: ready ones in order, none whose reach meets one taken before; alone if fewer than two.

    A round takes the first task of every plan that meets none taken; what does is out for good, so there are as many rounds as workers and no plan is gathered.
    """
    open_ = cut(tasks.select(group, "task", F.sort_array("reach").alias("reach"), F.monotonically_increasing_id().alias("_id")))
    taken = []
    for _ in range(workers):
        least = open_.groupBy(group).agg(F.min("task").alias("task"))
        now = cut(open_.join(least, [group, "task"]).groupBy(group, "task").agg(F.min(F.struct("reach", "_id")).alias("_b")).select(group, "task", "_b.*"))
        if not now.head(1):
            break
        taken.append(now.select(group, "task"))
        free = ~F.arrays_overlap("reach", "_used") & (F.col("_id") != F.col("_gone"))
        open_ = open_.join(now.select(group, F.col("reach").alias("_used"), F.col("_id").alias("_gone")), group).filter(free).select(group, "task", "reach", "_id")
    out = taken[0] if taken else open_.select(group, "task")
    for more in taken[1:]:
        out = out.union(more)
    out = cut(out)
    return out.join(out.groupBy(group).agg((F.count("*") < 2).alias("single")), group).select(F.col(group).cast("long").alias(group), F.col("task").cast("long").alias("task"), "single")


def topological_order(edges: DataFrame, nodes: DataFrame, group: str = "plan") -> DataFrame:
    """plan, node and position: a stable order by dependencies, then id; what a cycle holds back comes last, by id.

    A plan of at most LOCAL rows is one task.  In a larger one the order's running maximum at a node is the largest id that leads to it, itself
    included (before a larger one is taken, all that is smaller and ready has been).  So nodes go by that id, and those that share one, of which it is the first, by
    the same order among themselves: in one task where they are at most LOCAL, else by the largest id of the rest that leads to them, and so on.
    """
    both = nodes.select(group, F.col("node").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(edges.select(group, "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {int(x) for x in pdf["src"][pdf["dst"].isna()]}
        before = defaultdict(list)
        for a, b in zip(pdf["src"], pdf["dst"]):
            if b == b and b is not None and int(b) in ids and int(a) in ids:
                before[int(b)].append(int(a))
        out = _stable(ids, before)
        return pd.DataFrame({group: int(pdf[group].iloc[0]), "node": out, "position": range(len(out))})

    large = cut(both.groupBy(group).count().filter(F.col("count") > LOCAL).select(group))
    small = both.join(F.broadcast(large), group, "left_anti").groupBy(group).applyInPandas(run, f"{group} long, node long, position int")
    if not large.head(1):
        return small
    return small.unionByName(_ordered(edges.join(F.broadcast(large), group, "left_semi"), nodes.join(F.broadcast(large), group, "left_semi"), group))


def _stable(ids: set, before: dict) -> list:
    """The ids by dependencies, then id; those a cycle holds back last."""
    needs, feeds = {i: set(before.get(i, ())) for i in ids}, defaultdict(set)
    for i, some in needs.items():
        for b in some:
            feeds[b].add(i)
    ready = [i for i in ids if not needs[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        v = heapq.heappop(ready)
        out.append(v)
        for n in feeds[v]:
            needs[n].discard(v)
            if not needs[n]:
                heapq.heappush(ready, n)
    return out + sorted(ids - set(out))


def _ordered(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """``topological_order`` of large plans."""
    nodes = cut(nodes.select(group, "node").distinct())
    at = lambda df, name: df.withColumnRenamed("node", name)
    inside = cut(edges.select(group, "src", "dst").distinct().join(at(nodes, "src"), [group, "src"], "left_semi").join(at(nodes, "dst"), [group, "dst"], "left_semi"))
    first = cut(peeled(nodes.withColumn("own", F.col("node")), inside, "max", (group,)).select(group, "node", F.col("total").alias("m")))
    held = nodes.join(first, [group, "node"], "left_anti")
    todo, placed = first.withColumn("path", F.array("m")), held.select(group, "node", F.lit(True).alias("held"), F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("rank"))
    while True:
        near = lambda name: todo.select(group, F.col("node").alias(name), F.col("m").alias(f"_{name}"))
        inside = cut(inside.join(near("src"), [group, "src"]).join(near("dst"), [group, "dst"]).filter("_src = _dst").select(group, F.col("_src").alias("m"), "src", "dst"))
        large = cut(todo.groupBy(group, "m").count().filter(F.col("count") > LOCAL).select(group, "m"))
        placed = placed.unionByName(_ranked(todo.join(large, [group, "m"], "left_anti"), inside.join(large, [group, "m"], "left_anti"), group))
        if not large.head(1):
            break
        todo, inside = todo.join(large, [group, "m"], "left_semi"), inside.join(large, [group, "m"], "left_semi").filter("src != m AND dst != m")
        placed = placed.unionByName(todo.filter("node = m").select(group, "node", F.lit(False).alias("held"), "path", F.lit(0).alias("rank")))
        todo = cut(todo.filter("node != m"))
        deeper = peeled(todo.select(group, "m", "node", F.col("node").alias("own")), inside, "max", (group, "m")).select(group, "node", F.col("total").alias("_m"))
        todo = cut(todo.join(deeper, [group, "node"]).select(group, "node", F.col("_m").alias("m"), F.concat("path", F.array("_m")).alias("path")))
        inside = inside.drop("m")
    rows = _numbered(cut(placed), group, ["held", "path", "rank", "node"])
    return rows.select(F.col(group).cast("long").alias(group), "node", "position")


def _ranked(todo: DataFrame, inside: DataFrame, group: str) -> DataFrame:
    """Adds each node's rank in the stable order of its plan and m; sorted by these, nodes stream past, and only those of one m are held."""
    before = inside.groupBy(group, F.col("dst").alias("node")).agg(F.collect_list("src").alias("before"))
    rows = todo.join(before, [group, "node"], "left").repartition(group, "m").sortWithinPartitions(group, "m", "node")

    def ranks(table: pa.Table) -> pa.Table:
        """The ranks of whole groups."""
        m, g, node = table["m"].to_numpy(), table[group].to_numpy(), table["node"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (g[1:] != g[:-1])]))
        ends, rank = np.append(starts[1:], len(m)), np.zeros(len(m), np.int32)
        for a, b in zip(starts, ends):
            if b - a > 1:
                ids = node[a:b].tolist()
                place = {v: i for i, v in enumerate(_stable(set(ids), {v: x or () for v, x in zip(ids, table["before"].slice(a, b - a).to_pylist())}))}
                rank[a:b] = [place[v] for v in ids]
        return table.drop_columns(["before", "m"]).append_column("rank", pa.array(rank))

    def run(batches):
        parts: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch[k][-1].as_py() for k in (group, "m"))
            same = np.flatnonzero((batch["m"].to_numpy(zero_copy_only=False) != last[1]) | (batch[group].to_numpy(zero_copy_only=False) != last[0]))
            size = int(same[-1]) + 1 if len(same) else 0  # rows before the last group
            known = tuple(parts[-1][k][-1].as_py() for k in (group, "m")) if parts else last
            if size or known != last:
                whole = pa.Table.from_batches([*parts, batch.slice(0, size)] if size else parts)
                yield from ranks(whole).to_batches()
                parts = []
            parts.append(batch.slice(size))
        if parts:
            yield from ranks(pa.Table.from_batches(parts)).to_batches()

    kind = todo.schema[group].dataType.simpleString()
    out = rows.select(group, "m", "node", "path", "before").mapInArrow(run, f"{group} {kind}, node long, path array<bigint>, rank int")
    return out.withColumn("held", F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node connected with it, by rounds of minimum labels and pointer jumps."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    n = labels.count()
    while True:
        near = both.join(side(labels.select(F.col("node").alias("dst"), "component"), n), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_n"))
        low = side(labels, n).join(near, "node").select("node", F.col("component").alias("_was"), F.least("component", "_n").alias("_via"))
        after = cut(low.join(side(labels.select(F.col("node").alias("_via"), F.col("component").alias("_far")), n), "_via").select("node", "_was", F.least("_via", "_far").alias("component")))
        labels = after.select("node", "component")
        if not after.filter("_was != component").head(1):
            return labels


def subsystem_names(members: DataFrame, share: float = 2 / 3) -> DataFrame:
    """community and name: its directory if that holds at least ``share`` of it, else its largest top directory; names are made unique."""
    n = Window.partitionBy("community")
    counts = members.groupBy("community", "dir").agg(F.count("*").alias("c"), F.min("stem").alias("_s")).withColumn("_t", F.sum("c").over(n)).withColumn("_least", F.min("_s").over(n))
    best = counts.withColumn("_r", F.row_number().over(n.orderBy(F.desc("c"), "dir"))).filter("_r = 1")
    named = best.withColumn("base", F.when(F.col("c") >= F.col("_t") * share - 1e-9, F.col("dir")).otherwise(F.split("dir", "/")[0]))
    w = Window.partitionBy("base")
    unique = named.withColumn("_n", F.count("*").over(w)).withColumn("_first", F.concat_ws(":", "base", "_least"))
    again = Window.partitionBy("_first")
    out = unique.withColumn("_m", F.count("*").over(again))
    return out.select("community", F.when(F.col("_n") == 1, F.col("base")).when(F.col("_m") == 1, F.col("_first")).otherwise(F.concat_ws("#", "_first", "community")).alias("name"))


def file_graph(edges: DataFrame) -> DataFrame:
    """src, dst and n: the resolved edges between files, of all kinds, and how many there are of each."""
    known = edges.filter((F.col("resolved") == 1) & F.col("to_file_id").isNotNull())
    return known.groupBy(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst")).agg(F.count("*").alias("n"))


def symbol_impact(references: DataFrame, seeds: DataFrame) -> DataFrame:
    """file and owner of everything that calls, extends or implements a seed, directly or through others.

    references: owner (null where no callable encloses it), file and target.  A reference without an owner reports its file and
    leads no further.
    """
    owned = references.filter("owner IS NOT NULL").select(F.col("target").alias("src"), F.col("owner").alias("dst"))
    reached = closure(owned, seeds).select("node").distinct()
    targets = cut(reached.union(seeds.select("start")).distinct())
    hits = references.join(targets.select(F.col("node").alias("target")), "target", "left_semi")
    start = seeds.select(F.col("start").alias("owner"))
    return hits.select("file", "owner").distinct().join(start, "owner", "left_anti").select("file", "owner")


def rolled_up(tree: DataFrame) -> DataFrame:
    """root, total and done: of every node, all that stands below it and itself; tree: node, parent, done."""
    below = closure(tree.select(F.col("parent").alias("src"), F.col("node").alias("dst")), tree.select(F.col("node").alias("start"))).select(F.col("start").alias("root"), "node")
    every = below.union(tree.select("node", "node"))
    return every.join(tree.select("node", "done"), "node").groupBy("root").agg(F.count("*").alias("total"), F.count_if("done").alias("done"))


def route_costs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, pointers (other nodes reached), depth of the farthest and tokens of all of them with the root, for every node (node, tokens)."""
    reached = closure(edges, nodes.select(F.col("node").alias("start"))).unionByName(nodes.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")))
    costed = reached.join(nodes, "node")
    return costed.groupBy(F.col("start").alias("root")).agg((F.count("*") - 1).alias("pointers"), F.max("depth").alias("depth"), F.sum("tokens").cast("long").alias("tokens"))
