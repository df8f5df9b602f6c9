"""Fits, tuning, rewrites, blocks, packs, modes and profiles against plain computations."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import code, relational, stats
from lodestar.operators import text as T
from lodestar.plans import packs
from lodestar.plans.rules import Rule


def test_preference_fit_equals_newton_in_numpy(spark):
    rng = random.Random(5)
    items = [(i, rng.gauss(3, 2), rng.gauss(0, 1), 7.0) for i in range(12)]
    matches = [(rng.randrange(12), rng.randrange(12), rng.choice("xyyxt").replace("t", "tie")) for _ in range(200)]
    z = np.array([r[1:3] for r in items])
    z = (z - z.mean(0)) / z.std(0)
    d, t = np.array([z[x] - z[y] for x, y, _ in matches]), np.array([{"x": 1, "y": 0, "tie": 0.5}[o] for *_, o in matches])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        h = np.eye(2) + (d * (p * (1 - p))[:, None]).T @ d
        w = w + np.linalg.solve(h, d.T @ (t - p) - w)
    got, _ = stats.preference_fit(spark.createDataFrame(matches, "x int, y int, outcome string"), spark.createDataFrame(items, "i int, a double, b double, same double"), "i", ["a", "b", "same"])
    assert np.allclose([g["weight"] for g in got], [*w, 0], atol=1e-8)
    assert np.allclose([g["standard_error"] for g in got[:2]], np.sqrt(np.diag(np.linalg.inv(h))), atol=1e-8)
    empty, _ = stats.preference_fit(spark.createDataFrame([], "x int, y int, outcome string"), spark.createDataFrame([], "i int, a double"), "i", ["a"])
    assert empty[0]["weight"] == 0


def test_tuned_strengths(spark):
    rng = random.Random(6)
    rows = [(s, v == 0, rng.randint(0, 9), rng.randint(0, 9)) for s in range(30) for v in range(3)]
    failing = lambda a, b: sum(min(a * r[2] + b * r[3] for r in rows if r[0] == s and not r[1]) < max(a * r[2] + b * r[3] for r in rows if r[0] == s and r[1]) + 1 for s in range(30))
    now, left = stats.tuned_strengths(spark.createDataFrame(rows, "sample int, target boolean, a int, b int"), ["a", "b"], [1, 2, 4, 8], {"a": 4, "b": 4}, margin=1)
    assert left == failing(now["a"], now["b"]) <= failing(4, 4)
    assert all(left <= failing(x, now["b"]) and left <= failing(now["a"], x) for x in (1, 2, 4, 8))


def test_planned_rewrites(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(0, 200), s + rng.randint(0, 30), i) for i in range(300)]
    got = {r.i: r.applied for r in relational.planned_rewrites(spark.createDataFrame(rows, "f string, s int, e int, i int"), "f", "s", "e").collect()}
    for f in ("a", "b", None):
        kept = sorted((s, e) for g, s, e, i in rows if g == f and got[i])
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(kept))
        assert all(any(s < e2 and s2 <= s for s2, e2 in kept) for g, s, e, i in rows if g == f and not got[i])


def test_line_blocks(spark):
    texts = [(1, "a\nb\r\nc"), (2, ""), (3, None), (4, "xxxx\ny\nz\n"), (5, "ok\n" + "l" * 50), (6, "\n\n")]
    got = {}
    for r in T.line_blocks(spark.createDataFrame(texts, "k int, t string"), "k", "t", most_lines=2, most_bytes=5, longest=20).collect():
        got.setdefault(r.k, []).append((r.base, r.lines, r.too_long))
    assert got == {1: [(0, ["a", "b"], False), (2, ["c"], False)], 4: [(0, ["xxxx"], False), (1, ["y", "z"], False)], 5: [(1, [], True)], 6: [(0, ["", ""], False)]}


def test_fenced_and_append_only(spark):
    e = spark.createDataFrame([("s", 1, True, None), ("s", 2, False, 1), ("s", 3, True, None), ("s", 4, False, 1), ("s", 5, False, 2), ("q", 1, False, 1)], "slot string, n int, claim boolean, epoch int")
    assert [r.accepted for r in relational.fenced(e, "slot", ["n"], F.col("claim"), F.col("epoch")).orderBy("slot", "n").collect()] == [False, True, True, True, False, True]
    old, new = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, v string")
    assert {r.k: r.violation for r in relational.append_only_violations(old, new, ["k"]).collect()} == {1: "updated", 3: "deleted"}


PACK = """
[[rule]]
id = "too-long"
sql = "SELECT path, n FROM files WHERE n > :most"
message = "{path} has {n}"
parameters = {most = 3}
[[rule.test]]
tables = {files = [["a", 5], ["b", 2], ["a", 5]]}
rows = [{path = "a"}, {path = "a"}]
[[rule.test]]
rows = [{path = "z"}]
[[rule.test]]
parameters = {most = 9}
tables = {files = [["a", 5]]}
[[rule]]
id = "too-long"
sql = "SELECT 1"
[[rule]]
id = "Bad Name"
sql = "SELECT 1"
[[rule]]
id = "writes"
sql = "DELETE FROM files"
[[rule]]
id = "loud"
severity = "panic"
sql = "SELECT 1"
"""


def test_packs(spark):
    rules, tests, wrong = packs.read_pack(PACK)
    assert [r.id for r in rules] == ["too-long"] and len(wrong) == 4
    results = packs.run_tests(spark, rules[0], tests["too-long"], {"files": "path string, n int"})
    assert results[0] is None and "not found" in results[1] and results[2] is None
    assert packs.read_pack("= no")[2] and packs.read_pack("")[0] == []
    again = Rule("too-long", "SELECT 2")
    assert packs.merged(rules, [again]) == (rules, ["too-long"])
    assert "nothing" in packs.run_tests(spark, Rule("x", "SELECT nothing FROM files"), [{}], {"files": "path string"})[0]


def test_modes_and_profiles(spark):
    modes = packs.Modes()
    modes.register("first", lambda n: spark.range(n))
    for bad in ("first", "no-name", "batch", ""):
        try:
            modes.register(bad, lambda: None)
        except ValueError:
            continue
        raise AssertionError(bad)
    a, b, c, d = modes.batch([{"mode": "first", "n": 2}, {"mode": "none"}, {"mode": "batch", "calls": []}, {"mode": "first"}])
    assert a.count() == 2 and "unknown mode" in b["error"] and "batch" in c["error"] and "error" in d
    ours, mine = [{"name": "b", "glob": "*.log"}, {"name": "a", "glob": "a/*.log"}], [{"name": "c", "glob": "a/b/?.log"}]
    assert [(packs.profile_for(p, ours, mine) or {}).get("name") for p in ("x.log", "a/x.log", "a/b/x.log", "a/b/xy.log", "x.txt")] == ["b", "a", "c", "a", None]


def test_places_are_bytes_and_words_stay_apart(spark):
    files = spark.createDataFrame([("a.py", "python", "# \u00fc\u20ac\U0001f600\ndef f():\n    g(1)\n\n\ndefg = 2\n")], "path string, language string, text string")
    body = files.first().text.encode()
    assert [body[r.start_byte :][:5] for r in code.extract(files).orderBy("kind").collect()] == [b"def f", b"g(1)\n"]
    assert [(body[r.start_byte :][:5], r.text) for r in code.find_pattern(files, "def $F ( )").collect()] == [(b"def f", "def f()")]
    assert code.find_pattern(files, "def $X").count() == 1


def test_rendered(spark):
    one = lambda t: spark.range(1).select(T.rendered(t, {"a": F.lit(True), "b": F.lit(None).cast("int"), "c": F.lit(1.5)}).alias("x")).first().x
    assert [one(t) for t in ("{a}-{b}-{c}-{d}", "", "{a", "x{c}")] == ["true-{b}-1.5-{d}", "", "{a", "x1.5"]
