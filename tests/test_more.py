"""Scalars and operators that SQL can't check, against plain computations; and graph operators on small graphs."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from lodestar import functions as X
from lodestar.operators import graph, relational, sequence, stats


def test_finding_ids(spark):
    def fnv(*parts):
        value = 14695981039346656037
        for p in parts:
            for byte in [*p.encode(), None]:
                value = (value if byte is None else value ^ byte) * 1099511628211 % 2**64
        return format(value, "016x")

    rows = [("r", "a/b.py", 0, 5), ("r", "ü", 12, 345678), ("", "", 0, 0)]
    got = spark.createDataFrame(rows, "r string, f string, s long, e long").select(X.finding_id(*map(F.col, "rfse")).alias("i")).collect()
    assert [r.i for r in got] == [fnv(*map(str, r)) for r in rows]


def test_scalars_at_their_edges(spark):
    one = lambda *c: tuple(spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(c))).first())
    assert one(*(X.purge_seconds(F.lit(x)) for x in ("2weeks", " 5 ", "x", "9999999999999999999", "3 fortnights"))) == (1209600, 5, None, None, None)
    assert one(*(X.looks_binary(F.lit(x)) for x in (b"", b"text\n", b"a\0", bytes([1] * 6 + [65] * 94), bytes([1] * 5 + [65] * 95), b"\x1b\x08ok"))) == (False, False, True, True, False, False)
    assert one(*(X.yaml_scalar(F.lit(x))["kind"] for x in ("1e3", "0x1", "'5'", "TRUE", "yes", "", ".5", "2024-01-01"))) == ("float", "str", "str", "bool", "str", "null", "float", "str")
    assert one(X.day_bucket(F.lit("2024-05-01T03:00:00"), "week"), X.day_bucket(F.lit("no"))) == ("2024-04-29", "unknown")
    assert one(X.flat_json(F.lit('{"a": [1, {"b": null}], "c": "x"}')), X.flat_json(F.lit("{"))) == ("1  x", None)


def test_running_counts_and_rank_intervals(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 30), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v long, n long")
    assert {r.i: r.x for r in stats.running(df, "v", "n", "x").collect()} == {i: sum(n for _, w, n in rows if w < v) for i, v, _ in rows}
    spans = [(i, float(lo), float(lo + rng.randint(0, 9))) for i, lo, _ in rows]
    got = {r.i: (r.best, r.worst) for r in stats.rank_intervals(spark.createDataFrame(spans, "i long, lo double, hi double"), "i", "lo", "hi").collect()}
    assert got == {i: (1 + sum(a > hi for _, a, _ in spans), len(spans) - sum(b < lo for _, _, b in spans)) for i, lo, hi in spans}


def test_kendall_equals_all_pairs(spark):
    rng = random.Random(2)
    for n, ties in ((1, 5), (2, 1), (40, 6), (90, 1000)):
        rows = [(i, rng.randint(0, ties), rng.randint(0, ties)) for i in range(n)]
        sign = [(a[1] - b[1]) * (a[2] - b[2]) for a, b in combinations(rows, 2)]
        r = stats.kendall(spark.createDataFrame(rows, "i long, a long, b long"), "a", "b", "i").first()
        assert (r.pairs, r.concordant, r.discordant) == (len(sign), sum(s > 0 for s in sign), sum(s < 0 for s in sign))


def test_cycles_and_chains_equal_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((8, 10), (25, 30), (25, 60)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        assert {r.node for r in graph.on_cycles(df).collect()} == {a for a, b in reach if a == b}
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    chain = lambda e: graph.is_chain(nodes, spark.createDataFrame(e, "src long, dst long")).first().is_chain
    assert chain([(0, 1), (1, 2), (2, 3)]) and chain([(3, 1), (1, 0), (0, 2), (3, 2)]) and not chain([(0, 1), (1, 2), (1, 3)]) and not chain([(0, 1), (1, 0), (2, 3)])


def test_glob_overlaps(spark):
    globs = ["a/*.py", "a/x.py", "a/?.py", "b/**/x.py", "b/c/d/x.py", "**/x.py", "*/y.ts", "b/y.ts", "a/x.pyc"]
    df = spark.createDataFrame(list(enumerate(globs)), "id long, glob string")
    got = {(globs[r.a], globs[r.b]) for r in relational.glob_overlaps(df, df, "id", "glob").filter("a < b").collect()}
    want = {("a/*.py", "a/x.py"), ("a/*.py", "a/?.py"), ("a/x.py", "a/?.py"), ("b/**/x.py", "b/c/d/x.py"), ("b/**/x.py", "**/x.py"), ("b/c/d/x.py", "**/x.py"), ("a/*.py", "**/x.py"), ("a/x.py", "**/x.py"), ("a/?.py", "**/x.py"), ("*/y.ts", "b/y.ts")}
    assert got == want


def test_results_pair_with_the_next_of_their_key(spark):
    rng = random.Random(4)
    calls, results = [(i, rng.randrange(3), rng.randrange(50)) for i in range(60)], [(rng.randrange(3), rng.randrange(50)) for _ in range(40)]
    at = lambda c: F.timestamp_seconds(c)
    c = spark.createDataFrame(calls, "i long, k long, s long").select("i", "k", at("s").alias("ts"))
    r = spark.createDataFrame(results, "k long, s long").select("k", at("s").alias("ts"))
    got = {x.i: x.seconds for x in sequence.paired(c, r, "k", "ts").collect()}
    assert got == {i: min((b - s for q, b in results if q == k and b >= s), default=None) for i, k, s in calls}


def test_symbol_impact_and_unique_suffixes(spark):
    refs = spark.createDataFrame([(2, 10, 1), (3, 11, 2), (None, 12, 3), (1, 13, 3), (9, 14, 8)], "owner long, file long, target long")
    got = {(r.file, r.owner) for r in graph.symbol_impact(refs, spark.createDataFrame([(1,)], "start long")).collect()}
    assert got >= {(10, 2), (11, 3)} and (14, 9) not in got
    files = spark.createDataFrame([(1, "a/x.py"), (2, "b/x.py"), (3, "b/y.py"), (4, "xy.py")], "id long, path string")
    asked = spark.createDataFrame([("x.py",), ("b/x.py",), ("y.py",), ("z.py",)], "wanted string")
    assert {r.wanted: r.id or r.error for r in relational.unique_suffix(files, asked, "path", "id").collect()} == {"x.py": "ambiguous_path", "b/x.py": 2, "y.py": 3, "z.py": "file_not_found"}


def test_dominated_and_depths_equal_brute_force(spark):
    rng = random.Random(9)

    def reach(starts, edges, without=None):
        seen, todo = set(), [s for s in starts if s != without]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b for a, b in edges if a == v and b != without]
        return seen

    def longest(at, edges, seen):
        return max((1 + longest(b, edges, seen | {b}) for a, b in edges if a == at and b not in seen), default=0)

    for n, m in ((7, 9), (12, 16), (12, 30)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        private = {v: rng.random() < 0.7 for v in range(n)}
        nodes = {v for e in edges for v in e}
        df = spark.createDataFrame([(a, b, private[a], private[b], 0) for a, b in sorted(edges)], "src long, dst long, src_private boolean, dst_private boolean, module int")
        entries = [v for v in nodes if not private[v]]
        want = {(r, v) for r in nodes for v in reach([r], edges) - {r} if private[v] and v not in reach([e for e in entries if e != r], edges, r)}
        assert {(r.root, r.node) for r in graph.dominated(df).collect()} == want
        depth = {v: longest(v, edges, {v}) for v in nodes}
        got = {r.node: (r.depth, r.capped) for r in graph.module_depths(df, hop_limit=5).collect()}
        assert got == {v: (min(d, 5), d >= 5) for v, d in depth.items()}
