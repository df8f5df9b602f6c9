"""Small cases of the operators: boundaries, ties, nulls, empty input."""

import math
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar import functions as X
from lodestar import sources
from lodestar.operators import graph, relational, sequence, stats, text
from lodestar.plans import rules

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def test_retry_needs_the_latest_prior_failure_and_a_key(spark):
    rows = [(1, "a", at(0), True), (2, "a", at(60), False), (3, "a", at(120), False), (4, "a", at(121), False), (5, None, at(0), True), (6, None, at(1), False)]
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp, f boolean")
    got = {r.event_id: r.is_retry for r in sequence.mark_retries(df, ["k"], ["ts", "event_id"], F.col("f")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_streaks_and_empty_input(spark):
    df = spark.createDataFrame([(i, 1, at(i), i in (1, 2, 3, 5, 6)) for i in range(8)], "event_id long, k long, ts timestamp, f boolean")
    assert [r.length for r in sequence.streaks(df, ["k"], ["ts", "event_id"], F.col("f")).collect()] == [3]
    assert sequence.streaks(df.filter("false"), ["k"], ["ts", "event_id"], F.col("f")).count() == 0


def test_day_streak_ends_at_a_gap_and_at_a_bad_day(spark):
    day = lambda n: (T0 + timedelta(days=n)).date()
    rows = [("gap", day(n), True) for n in (1, 3, 4)] + [("bad", day(1), True), ("bad", day(2), False), ("bad", day(3), True), ("none", day(3), False)]
    df = spark.createDataFrame(rows, "k string, d date, ok boolean")
    assert {r.k: r.streak for r in sequence.day_streak(df, ["k"], "d", "ok").collect()} == {"gap": 2, "bad": 1, "none": 0}


def test_as_of_is_strict_and_takes_the_latest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 5, "z")], "k string, t long, v string")
    got = {(r.k, r.t): r.v for r in relational.as_of(left, right, ["k"], ["t"], ["t"], ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_containment_over_bins_and_innermost_ties(spark):
    inner = spark.createDataFrame([(1, "f", 300, 310), (2, "f", 20, 30)], "id long, k string, s long, e long")
    outer = spark.createDataFrame([(7, "f", 0, 1000), (8, "f", 290, 320), (9, "f", 10, 40), (10, "f", 15, 45)], "o long, k string, os long, oe long")
    pairs = relational.contained(inner, outer, ["k"], "s", "e", "os", "oe", 64)
    assert sorted((r.id, r.o) for r in pairs.collect()) == [(1, 7), (1, 8), (2, 7), (2, 9), (2, 10)]
    assert [(r.id, r.o) for r in relational.innermost(pairs, ["id"], "os", "oe", "o").collect()] == [(1, 8)]


def test_multiset_difference(spark):
    a, b = (spark.createDataFrame(x, "v long") for x in ([(1,), (1,), (2,)], [(1,), (2,), (2,)]))
    assert sorted((r.v, r.side, r.surplus) for r in relational.multiset_difference(a, b).collect()) == [(1, "left", 1), (2, "right", 1)]


def test_retention_without_watermark_deletes_nothing(spark):
    df = spark.createDataFrame([(at(0),), (at(100),)], "ts timestamp")
    kept = lambda used: relational.retained(df, "ts", F.lit(at(50)), used).count()
    assert kept(F.lit(None).cast("timestamp")) == 2 and kept(F.lit(at(99))) == 1 and kept(F.lit(at(-1))) == 2


def test_page_refuses_no_rows(spark):
    with pytest.raises(ValueError):
        relational.page(spark.range(3), [F.col("id")], 0)


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    s = spark.createDataFrame([(1,)], "start long")
    assert {(r.node, r.depth) for r in graph.closure(e, s).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {r.node for r in graph.on_cycles(e).collect()} == {1, 2, 3}


def test_levels_and_critical_path_of_a_cycle(spark):
    n = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 1.0)], "node long, duration double")
    e = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    assert graph.critical_path(n, e).first()[0] == 6.0
    loop = spark.createDataFrame([(1, 3), (3, 1)], "src long, dst long")
    assert graph.critical_path(n, loop).first()[0] is None


def test_flow_tree_expands_once_and_topological_order(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (3, 2, 0), (2, 1, 0)], "src long, dst long, module long")
    n = spark.createDataFrame([(0, 1)], "module long, node long")
    got = [(r.node, r.depth, r.backref) for r in graph.flow_trees(e, n).orderBy("seq").collect()]
    assert got == [(1, 0, False), (2, 1, False), (3, 1, False), (2, 2, True)]
    nodes = spark.createDataFrame([(0, i) for i in (1, 2, 3)], "plan long, node long")
    order = graph.topological_order(spark.createDataFrame([(0, 3, 1)], "plan long, src long, dst long"), nodes)
    assert [r.node for r in order.orderBy("position").collect()] == [2, 3, 1]


def test_kappa_and_wilson(spark):
    p = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "l string, r string")
    assert math.isclose(stats.kappa(p, "l", "r").first().kappa, 0.4)
    same = spark.createDataFrame([("a", "a")] * 3, "l string, r string")
    assert stats.kappa(same, "l", "r").first().kappa == 1.0
    low, high = stats.wilson(F.lit(0), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert r.l == 0.0 and math.isclose(r.h, 0.27753, rel_tol=1e-4)


def test_density_score_rounds_down(spark):
    want = lambda d: next((100 * 10**6 if d <= 0 else y0 * 10**6 + ((d - x0 * 10**6) * (y1 - y0)) // (x1 - x0) for (x0, y0), (x1, y1) in zip(stats.ANCHORS, stats.ANCHORS[1:]) if d < x1 * 10**6), 0)
    values = [0, 1, 999_999, 1_000_000, 1_000_001, 4_999_999, 7_654_321, 10**7, 29_999_999, 3 * 10**7, 10**9]
    got = {r.id: r.s for r in spark.createDataFrame([(v,) for v in values], "id long").select("id", stats.density_score(F.col("id")).alias("s")).collect()}
    assert got == {v: want(v) for v in values}


def test_bradley_terry_orders_and_centres(spark):
    m = spark.createDataFrame([("g", 1, 2, 1.0)] * 8 + [("g", 2, 3, 1.0)] * 8 + [("g", 1, 3, 0.5)], "g string, x long, y long, score double")
    r = {x.item: x.rating for x in stats.bradley_terry(m, "g").collect()}
    assert r[1] > r[2] > r[3] and abs(sum(r.values())) < 1e-9


def test_minhash_equals_a_plain_computation():
    words = "alpha beta gamma delta epsilon zeta eta".split()
    mask = (1 << 64) - 1
    seeds = [0xCBF29CE484222325 ^ (((i + 1) * 0x9E3779B97F4A7C15) & mask) for i in range(16)]

    def fnv(v, data):
        for b in data:
            v = ((v ^ b) * 0x100000001B3) & mask
        return v

    minima = [min(fnv(s, " ".join(words[i : i + 5]).encode()) for i in range(3)) for s in seeds]
    bands = [fnv(seeds[b], b"".join(m.to_bytes(8, "little") for m in minima[4 * b : 4 * b + 4])) for b in range(4)]
    assert [x & mask for x in text.minhash_of(" ".join(words).upper())] == bands
    assert text.minhash_of("too few words here") is None and text.minhash_of(None) is None


def test_redaction_extends_overlaps_in_bytes():
    pats = [("one", re.compile("abc")), ("two", re.compile("bcd+"))]
    assert text.redaction("é abcddd x", pats) == ("é [redacted:one] x", [(3, 9, "one")])
    assert text.redaction("", pats) == ("", [])


def test_markdown_prefers_a_long_article():
    body = "word " * 60
    out = text.markdown_of(f"<nav>menu</nav><article><h1>T</h1><p>{body}<a href='/x'>link</a></p></article><footer>f</footer>")
    assert out.startswith("# T") and "[link](/x)" in out and "menu" not in out
    assert text.markdown_of("<nav>menu</nav><p>short &amp; plain</p>") == "short & plain"
    assert text.title_of("<title> a\n &lt;b </title>") == "a <b" and text.title_of(None) is None


def test_globs():
    match = lambda p, s: bool(re.match(text.glob_to_regex(p), s))
    assert match("src/*.py", "src/a.py") and not match("src/*.py", "src/b/a.py") and match("src/**/a.py", "src/b/c/a.py") and match("src/**/a.py", "src/a.py")


def test_scalar_functions(spark):
    one = lambda *c: spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(c))).first()
    assert tuple(one(X.duration_seconds(F.lit("30d")), X.duration_seconds(F.lit("0h")), X.duration_seconds(F.lit("5")), X.loose_duration(F.lit("5")), X.loose_duration(F.lit("2hr")))) == (2592000, None, None, 5, 7200)
    assert tuple(one(X.trunc_div(F.lit(-7), F.lit(2)), X.to_micro(F.lit("1.25")), X.to_micro(F.lit("1.1234567")), X.from_micro(F.lit(1250000), 1))) == (-3, 1250000, None, "1.3")
    assert tuple(one(X.is_past(F.lit("2024-01-01"), F.lit("2024-01-02").cast("date")), X.is_past(F.lit("x"), F.lit("2024-01-02").cast("date")))) == (True, False)
    assert tuple(one(X.css_px(F.lit("1.5rem")), X.css_px(F.lit("em")), X.css_ms(F.lit("0.3s")))) == (24.0, None, 300.0)
    assert one(X.rgb(F.lit("rgba(1, 2, 3, 0.5)")))[0] == [1.0, 2.0, 3.0, 0.5]


def test_rule_parameters_and_isolation(spark):
    assert rules.parameter_names("SELECT ':no', :yes -- :comment\n/* :none */ FROM x::int") == {"yes"}
    spark.range(3).createOrReplaceTempView("numbers")
    good = rules.Rule("good", "SELECT id AS file, 1 AS line FROM numbers WHERE id >= :least", "{file} of {other}", parameters={"least": 2})
    rows, failed = rules.run_all(spark, [good, rules.Rule("bad", "SELECT nothing FROM nowhere"), rules.Rule("off", "x", severity=None)])
    assert [r.message for r in rows["good"].collect()] == ["2 of {other}"] and list(failed) == ["bad"]
    kept, off = rules.with_overrides([good], {"good": {"severity": "error"}}, {"good": {"severity": None}})
    assert not kept and off == ["good"]


def test_jsonl_keeps_valid_rows_and_reports_the_rest(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": "x"}\n\n{"a": 3}\n{"a": 4')
    good, bad = sources.jsonl(spark, str(tmp_path / "log.jsonl"), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 3] and bad.count() == 2


def test_source_tree_and_front_matter(spark, tmp_path):
    for p in ("a.py", "node_modules/b.py", ".git/c.py", "d/e.go"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    found = sources.source_tree(spark, str(tmp_path)).select("path", sources.language(F.col("path")).alias("l")).collect()
    assert sorted((r.path, r.l) for r in found) == [("a.py", "python"), ("d/e.go", "go")]
    fields, body = sources.front_matter(F.col("t"))
    df = spark.createDataFrame([("---\na: 1\n---\nbody",), ("plain",)], "t string").select(fields.alias("f"), body.alias("b"))
    assert [tuple(r) for r in df.collect()] == [("a: 1", "body"), (None, "plain")]
