"""Statistics and scoring: ranks, agreement, intervals, ratings, fixed-point costs and roll-ups."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054
#: Density and score anchors of the piecewise map.
ANCHORS = ((0, 100), (1, 90), (5, 70), (10, 40), (20, 10), (30, 0))
MICRO = 1_000_000


#: Ranges that a running count is dealt into.
PIECES = 256


def nearest_rank(value: str, percent: int) -> Column:
    """The value at rank ceil(n * percent / 100); null for no values."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down, also for negative numbers."""
    return F.floor_div(a, b) if hasattr(F, "floor_div") else ((a - F.pmod(a, b)) / b).cast("long")


def kappa(df: DataFrame, left: str, right: str) -> DataFrame:
    """Cohen's kappa of two label columns: one row with n, observed, expected and kappa (1 or 0 where chance is certain)."""
    pairs = df.groupBy(left, right).agg(F.count("*").alias("c"))
    total = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(left) == F.col(right), F.col("c")).otherwise(0)).alias("same"))
    a = pairs.groupBy(F.col(left).alias("k")).agg(F.sum("c").alias("a"))
    b = pairs.groupBy(F.col(right).alias("k")).agg(F.sum("c").alias("b"))
    chance = a.join(b, "k", "full").agg(F.sum(F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))).alias("ab"))
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; null without trials."""
    p, zz = hits / n, z * z
    mid, half, down = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    low, high = F.greatest(F.lit(0.0), (mid - half) / down), F.least(F.lit(1.0), (mid + half) / down)
    return F.when(n > 0, low), F.when(n > 0, high)


def precision_recall(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    both = df.select(F.count_if(truth & predicted).alias("tp"), F.count_if(predicted).alias("p"), F.count_if(truth).alias("t"))
    return both.select("tp", "p", "t", (F.col("tp") / F.nullif("p", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("t", F.lit(0))).alias("recall"))


def bootstrap(df: DataFrame, group: str, cluster: str, left: str, right: str, rounds: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """group, low and high: the interval of the share of equal labels over resamples of whole clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([cluster])
        same = (pdf[left] == pdf[right]).groupby(pdf[cluster], sort=True)
        hits, sizes = same.sum().tolist(), same.size().tolist()
        rng, out = random.Random(seed), []
        for _ in range(rounds):
            picked = [rng.randrange(len(hits)) for _ in hits]
            out.append(sum(hits[i] for i in picked) / sum(sizes[i] for i in picked))
        out.sort()
        tail = (1 - confidence) / 2
        at = lambda q: out[max(0, math.ceil(q * rounds) - 1)]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "low": [at(tail)], "high": [at(1 - tail)]})

    return df.groupBy(group).applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, low double, high double")


def bradley_terry(matches: DataFrame, group: str) -> DataFrame:
    """group, item, rating, se and matches: penalised maximum likelihood by Newton's method, centred; matches: x, y and score of x (1, 0.5, 0).

    The matches of a pair are summed first, so a group's task holds its pairs of items, however many matches there are.
    """
    sums = matches.groupBy(group, "x", "y").agg(F.sum(F.col("score").cast("double")).alias("score"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"], kind="stable")
        items = sorted({*pdf["x"], *pdf["y"]})
        at = {v: i for i, v in enumerate(items)}
        x, y, s = pdf["x"].map(at).to_numpy(), pdf["y"].map(at).to_numpy(), pdf["score"].to_numpy(float)
        n = pdf["n"].to_numpy(float)
        r = np.zeros(len(items))
        for _ in range(200):
            p = 1 / (1 + np.exp(-(r[x] - r[y])))
            g = -r.copy()
            np.add.at(g, x, s - n * p)
            np.add.at(g, y, n * p - s)
            h, w = np.eye(len(items)), n * p * (1 - p)
            for i, j, v in ((x, x, w), (y, y, w), (x, y, -w), (y, x, -w)):
                np.add.at(h, (i, j), v)
            step = np.linalg.solve(h, g)
            r += step
            if np.abs(step).max() < 1e-12:
                break
        met = np.bincount(np.concatenate([x, y]), np.concatenate([n, n]), len(items)).astype(np.int64)
        return pd.DataFrame({group: pdf[group].iloc[0], "item": items, "rating": r - r.mean(), "se": np.sqrt(np.diag(np.linalg.inv(h))), "matches": met})

    kind = matches.schema[group].dataType.simpleString()
    return sums.groupBy(group).applyInPandas(run, f"{group} {kind}, item {matches.schema['x'].dataType.simpleString()}, rating double, se double, matches long")


def win_probability(a: Column, b: Column) -> Column:
    return F.round(1 / (1 + F.exp(b - a)), 8)


def running(df: DataFrame, value: str, counted: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``counted`` over all rows with a smaller value, without ordering all rows in one task.

    Equal values are summed first.  The sums are dealt into ranges cut at quantiles, added up inside each, and what the
    ranges before hold is added, of which there are at most PIECES.
    """
    sums = df.groupBy(value).agg(F.sum(counted).alias("_sum"))
    cuts = sorted(set(sums.agg(F.percentile_approx(value, F.lit([k / PIECES for k in range(1, PIECES)]), 4 * PIECES).alias("c")).first()["c"] or ()))
    piece = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    dealt = sums.withColumn("_piece", piece)
    totals = dealt.groupBy("_piece").agg(F.sum("_sum").alias("_total"))
    before = totals.select("_piece", F.coalesce(F.sum("_total").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_sum").over(Window.partitionBy("_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_piece").select(value, (F.col("_inside") + F.col("_base")).alias(name))
    return df.join(below, value)


def rank_intervals(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """key, best and worst: the ranks an item may have, by the items whose whole interval is above, or not below, its own."""
    points = df.select(key, F.col(high).alias("v"), F.lit(0).alias("_low"), F.lit(1).alias("_high")).union(df.select(key, low, F.lit(1), F.lit(0)))
    marked = running(running(points, "v", "_low", "_lows"), "v", "_high", "_highs")
    n = df.count()
    same = points.groupBy("v").agg(F.sum("_low").alias("_same"))
    best = marked.filter("_high = 1").join(same, "v").select(key, (1 + n - F.col("_lows") - F.col("_same")).alias("best"))
    return best.join(marked.filter("_low = 1").select(key, (n - F.col("_highs")).alias("worst")), key)


def kendall(df: DataFrame, a: str, b: str, item: str) -> DataFrame:
    """pairs, concordant, discordant and tau of two rankings of the same items, counted by merging and not pair by pair.

    In rounds, as in a merge sort from above: by one bit of b's dense rank after the other, the items of a block (equal higher
    bits) with the bit set that have a smaller a than those without are discordant.  A round is a running count inside blocks, and there are log2(n) of them.
    """
    n = df.count()
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    ranks = running(rows.select("_b").distinct().withColumn("_one", F.lit(1)), "_b", "_one", "_r").select("_b", "_r")
    rows = rows.join(ranks, "_b").select("_a", "_r", "_n")
    top = rows.agg(F.max("_r")).first()[0] or 0
    parts = []
    for bit in range(int(top).bit_length()):
        set_ = F.shiftright("_r", bit) % 2 == 1
        sums = rows.groupBy(F.shiftright("_r", bit + 1).alias("_k"), "_a").agg(F.sum(F.when(set_, F.col("_n")).otherwise(0)).alias("_up"), F.sum(F.when(set_, 0).otherwise(F.col("_n"))).alias("_down"))
        sums = sums.withColumn("_ups", prefix_within(sums, "_k", "_a", "_up")) if bit + 1 < int(top).bit_length() else running(sums, "_a", "_up", "_ups")
        parts.append(sums.agg(F.sum(F.col("_ups") * F.col("_down")).alias("d")))
    pair = lambda x: x * (x - 1) / 2
    ties = [rows.groupBy(*k).agg(F.sum("_n").alias("_n")).agg(F.sum(pair(F.col("_n"))).alias("d")) for k in (["_a"], ["_r"], ["_a", "_r"])]
    tie_a, tie_b, both = (float(x.first()[0] or 0) for x in ties)
    discordant = sum(int(p.first()[0] or 0) for p in parts)
    pairs = n * (n - 1) // 2
    concordant = int(pairs - discordant - tie_a - tie_b + both)
    return df.sparkSession.createDataFrame([(pairs, concordant, discordant, (concordant - discordant) / pairs if pairs else None)], "pairs long, concordant long, discordant long, tau double")


def prefix_within(df: DataFrame, block: str, order: str, counted: str) -> Column:
    """The sum of ``counted`` over a block's rows before each."""
    return F.coalesce(F.sum(counted).over(Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.6) -> DataFrame:
    """Adds train: in each label the first round(share * n), halves to even, by digest of the key."""
    w = Window.partitionBy(label)
    r = F.row_number().over(w.orderBy(F.sha2(F.col(key).cast("string"), 256), key))
    return df.withColumn("train", r <= F.bround(F.count("*").over(w) * share))


def digest_fold(parts: list[Column], folds: int) -> Column:
    """A fold from the first eight bytes of the SHA-256 of the parts, joined by NUL."""
    text = F.concat_ws("\0", *(p.cast("string") for p in parts))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % folds).cast("int")


def largest_remainder(df: DataFrame, group: str, key: str, weight: str, total: int) -> DataFrame:
    """Adds share: whole parts of ``total`` by weight that sum to it exactly; what flooring leaves goes to the largest remainders, then the smaller keys."""
    w = Window.partitionBy(group)
    all_ = F.sum(weight).over(w)
    exact = F.col(weight).cast("decimal(38,0)") * F.lit(total)
    parts = df.withColumn("_rest", exact % all_).withColumn("share", ((exact - F.col("_rest")) / all_).cast("long"))
    left = F.lit(total) - F.sum("share").over(w)
    ranked = parts.withColumn("_left", left).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_rest"), key)))
    return ranked.withColumn("share", F.col("share") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).drop("_rest", "_left", "_r")


def standardized(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds z by the group's mean and population deviation; missing values count as 0, a deviation of 0 gives null."""
    w = Window.partitionBy(group)
    v = F.coalesce(F.col(value), F.lit(0.0))
    return df.withColumn("z", (v - F.avg(v).over(w)) / F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)))


def density_score(density: Column, anchors=ANCHORS) -> Column:
    """A score in millionths from a density in millionths: linear between anchors, rounded down, flat beyond them."""
    out = F.lit(anchors[-1][1] * MICRO)
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:]))):
        fall = floor_div((density - x0 * MICRO) * (y0 - y1) + (x1 - x0 - 1), F.lit(x1 - x0))
        out = F.when(density < x1 * MICRO, y0 * MICRO - fall).otherwise(out)
    return F.when(density <= anchors[0][0] * MICRO, anchors[0][1] * MICRO).otherwise(out).cast("long")


def excess_cost(value: Column, comfort: int, weight: int) -> Column:
    """weight * excess^2 / comfort, in whole millionths, of what a value has above its comfort."""
    over = F.greatest(value - comfort, F.lit(0)).cast("long")
    return floor_div(over * over * weight, F.lit(comfort)).cast("long")


def scope_score(df: DataFrame, scope: str, score: str, tokens: str) -> DataFrame:
    """scope, numerator and denominator: the token-weighted score as an exact fraction."""
    n = F.col(tokens).cast("decimal(38,0)")
    return df.groupBy(scope).agg(F.sum(F.col(score).cast("decimal(38,0)") * F.col(tokens)).alias("numerator"), F.sum(n).alias("denominator"))


def meets(numerator: Column, denominator: Column, threshold_micro: int) -> Column:
    """The fraction is at least the threshold, without rounding."""
    return numerator >= denominator * threshold_micro


def dominance(function_tokens: Column, file_tokens: Column, strength: int) -> Column:
    """1 + strength * max(0, 2f - t) / t in millionths, rounded down."""
    return MICRO + floor_div(F.greatest(2 * function_tokens - file_tokens, F.lit(0)) * F.lit(strength) * MICRO, file_tokens)


def shifted(default: int, anchor: Column, k: Column, low: Column, high: Column) -> Column:
    """default + k / (k + 2) * (anchor - default), halves up, kept between low and high."""
    moved = default + floor_div(2 * k * (anchor - default) + (k + 2), 2 * (k + 2))
    return F.least(F.greatest(moved, low), high)


def percentile_vs(scores: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Adds percentile: the floor of the percent of reference values below each value, by running counts."""
    both = scores.select(value).withColumn("_ref", F.lit(0)).union(reference.select(value, F.lit(1)))
    below = running(both.groupBy(value).agg(F.sum("_ref").alias("_ref")), value, "_ref", "_below")
    total = reference.agg(F.count("*").alias("_t"))
    return scores.join(below.select(value, "_below"), value).crossJoin(F.broadcast(total)).withColumn("percentile", F.floor(100 * F.col("_below") / F.col("_t")).cast("long")).drop("_below", "_t")


def spend(df: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Per key the sum of each weighted column, their weighted sum and the rows."""
    weighted = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in weights), F.sum(weighted).alias("weighted"), F.count("*").alias("calls"))


def held_out_accuracy(matches: DataFrame, coefficients: dict[str, float], outcome: str) -> DataFrame:
    """One row: how often the weighted differences (x minus y) foretell x or y, ties counting one half; null without matches."""
    delta = sum((F.col(c) * w for c, w in coefficients.items()), F.lit(0.0))
    right = F.when(F.col(outcome) == "tie", 0.5).otherwise(((delta >= 0) == (F.col(outcome) == "x")).cast("double"))
    return matches.agg(F.round(F.avg(right), 8).alias("accuracy"))


#: Items of a group meet in blocks of so many that are alike.
BLOCK = 100


def next_pairs(items: DataFrame, group: str, item: str, rating: str, error: str, played: DataFrame | Column, k: int) -> DataFrame:
    """group, x and y: in each group the k pairs not yet played that are worth most: uncertain and close.

    Pairs are made inside a group; played: group, x, y with x < y, or a condition on these columns.  Items are put into blocks by error, then by rating.
    The k-th best pair inside the blocks is a bound: two blocks meet only where the largest error of each and the least distance of their ratings could make a pair
    that comes before it.  A group with fewer than k such pairs, and a block with a value that isn't finite, meets all.
    """
    whole = Window.partitionBy(group)
    rows = items.select(group, F.col(item).alias("_i"), F.col(rating).alias("_r"), F.abs(error).alias("_e"))
    strip = F.floor((F.row_number().over(whole.orderBy("_e", "_r", "_i")) - 1) / F.ceil(F.sqrt(F.count("*").over(whole) * BLOCK)))
    rows = rows.withColumn("_strip", strip)
    block = F.floor((F.row_number().over(Window.partitionBy(group, "_strip").orderBy("_r", "_i")) - 1) / BLOCK)
    rows = rows.select(group, F.shiftleft("_strip", 32).bitwiseOR(block).alias("_b"), "_i", "_r", "_e")
    rows = rows.hint("merge")  # as many as items, so never broadcast
    named = lambda df, n: df.select(group, *(F.col(c).alias(c + n) for c in df.columns if c != group))
    worth = lambda apart: F.hypot("_e1", "_e2") / (1 + F.exp(apart))

    def best(pairs: DataFrame) -> DataFrame:
        """The first k of the pairs, as group, x, y, their rounded score and their place."""
        pairs = pairs.select(group, F.least("_i1", "_i2").alias("x"), F.greatest("_i1", "_i2").alias("y"), F.round(worth(F.abs(F.col("_r1") - F.col("_r2"))), 9).alias("_s"))
        left = pairs.filter(~F.coalesce(played, F.lit(False))) if isinstance(played, Column) else pairs.join(played.select(group, "x", "y"), [group, "x", "y"], "left_anti")
        return left.withColumn("_k", F.row_number().over(whole.orderBy(F.desc("_s"), "x", "y"))).filter(F.col("_k") <= k)

    inside = named(rows, "1").withColumnRenamed("_b1", "_b").join(named(rows, "2").withColumnRenamed("_b2", "_b"), [group, "_b"]).filter("_i1 < _i2")
    bound = best(inside).filter(F.col("_k") == k).select(group, F.col("_s").alias("_least"), F.col("x").alias("_x"))
    odd = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) >= float("inf"), F.lit(False))  # noqa: E731  NaN is above all
    blocks = rows.groupBy(group, "_b").agg(F.max("_e").alias("_e"), F.min("_r").alias("_low"), F.max("_r").alias("_high"), F.min("_i").alias("_first"), F.bool_or(odd("_r") | odd("_e")).alias("_odd"))
    two = named(blocks, "1").join(named(blocks, "2"), group).filter("_b1 <= _b2").join(bound, group, "left")
    apart = F.greatest(F.greatest(F.col("_low2") - F.col("_high1"), F.col("_low1") - F.col("_high2")).cast("double"), F.lit(0.0))
    top = F.round(worth(apart) * (1 + 1e-12), 9)  # functions of doubles err in the last places
    first = F.least("_first1", "_first2") <= F.col("_x")
    met = two.filter(F.col("_least").isNull() | F.col("_odd1") | F.col("_odd2") | (top > F.col("_least")) | ((top == F.col("_least")) & first)).select(group, "_b1", "_b2")
    pairs = met.join(named(rows, "1"), [group, "_b1"]).join(named(rows, "2"), [group, "_b2"]).filter("_i1 < _i2 OR (_b1 < _b2 AND _i1 > _i2)")
    return best(pairs).select(group, "x", "y")


def agreement_report(labels: DataFrame, unit: str, rater: str, choice: str) -> DataFrame:
    """left, right, n, observed, expected and kappa of every two raters over the units that both labelled.

    Labels are the latest of their rater and unit; pairs are made inside a unit, whose raters are a panel, and summed by choice
    before anything else is done.
    """
    a, b = (labels.select(F.col(unit).alias("u"), F.col(rater).alias(r), F.col(choice).alias(c)) for r, c in (("left", "a"), ("right", "b")))
    pairs = a.join(b, "u").filter("`left` < `right`").groupBy("left", "right", "a", "b").agg(F.count("*").alias("c"))
    rows, columns = (pairs.groupBy("left", "right", F.col(x).alias("k")).agg(F.sum("c").alias(f"n{x}")) for x in "ab")
    chance = rows.join(columns, ["left", "right", "k"]).groupBy("left", "right").agg(F.sum(F.col("na") * F.col("nb")).alias("ab"))
    total = pairs.groupBy("left", "right").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("ab", F.lit(0)) / (F.col("n") * F.col("n"))
    out = total.join(chance, ["left", "right"], "left").select("left", "right", "n", po.alias("observed"), pe.alias("expected"))
    po, pe = F.col("observed"), F.col("expected")
    return out.withColumn("kappa", F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)))


def validation_record(pairs: DataFrame, by: str, label: Column, predicted: Column, day: Column) -> DataFrame:
    """For each value of ``by``: labels, how many the scores foretell, the share with its Wilson bounds, and the last day of labels."""
    g = pairs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(label == predicted).alias("hits"), F.max(day).alias("last_day"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.select(by, "n", "hits", (F.col("hits") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"), "last_day")


def preference_fit(matches: DataFrame, items: DataFrame, item: str, components: list[str], l2: float = 1.0, rounds: int = 100) -> tuple[list[dict], DataFrame]:
    """Weights of items' components in who wins (matches: x, y, outcome x, y or tie), and the standardised items.

    Items are standardised once by their means and population deviations, constant components weigh nothing; then Newton's steps of the penalised
    logistic likelihood.  A step is one aggregate over all matches, of which only its sums reach the driver.
    Each weight has component, weight, standard_error, low, high (1.96 errors), mean and scale.
    """
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in components}
    seen = items.agg(*(F.avg(value[c]).alias(f"m{i}") for i, c in enumerate(components)), *(F.stddev_pop(value[c]).alias(f"s{i}") for i, c in enumerate(components))).first()
    mean = {c: seen[f"m{i}"] or 0.0 for i, c in enumerate(components)}
    scale = {c: seen[f"s{i}"] or 0.0 for i, c in enumerate(components)}
    active = [c for c in components if scale[c] > 0]
    scaled = items.select(item, *((value[c] - mean[c]).alias(c) if c not in active else ((value[c] - mean[c]) / scale[c]).alias(c) for c in components))
    side = lambda s: scaled.select(F.col(item).alias(s), *(F.col(c).alias(f"_{s}{i}") for i, c in enumerate(active)))
    target = F.when(F.col("outcome") == "tie", 0.5).otherwise((F.col("outcome") == "x").cast("double"))
    d = matches.join(side("x"), "x").join(side("y"), "y").select(target.alias("t"), *((F.col(f"_x{i}") - F.col(f"_y{i}")).alias(f"d{i}") for i in range(len(active))))
    k, w = len(active), np.zeros(len(active))

    def sums(w):
        z = sum((F.col(f"d{i}") * float(w[i]) for i in range(k)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        at = [F.sum((F.col("t") - p) * F.col(f"d{i}")) for i in range(k)]
        at += [F.sum(p * (1 - p) * F.col(f"d{i}") * F.col(f"d{j}")) for i in range(k) for j in range(i, k)]
        got = [x or 0.0 for x in d.agg(*(a.alias(f"a{n}") for n, a in enumerate(at))).first()]
        h, rest = l2 * np.eye(k), iter(got[k:])
        for i in range(k):
            for j in range(i, k):
                h[i, j] += next(rest)
                h[j, i] = h[i, j]
        return np.array(got[:k]) - l2 * w, h

    error = np.zeros(k)
    if k:
        for _ in range(rounds):
            g, h = sums(w)
            step = np.linalg.solve(h, g)
            w = w + step
            if np.abs(step).max() < 1e-10:
                break
        error = np.sqrt(np.diag(np.linalg.inv(sums(w)[1])))
    fitted = {c: (float(w[i]), float(error[i])) for i, c in enumerate(active)}
    out = []
    for c in components:
        b, e = fitted.get(c, (0.0, 0.0))
        out.append({"component": c, "weight": b, "standard_error": e, "low": b - 1.96 * e, "high": b + 1.96 * e, "mean": float(mean[c]), "scale": float(scale[c])})
    return out, scaled


def tuned_strengths(versions: DataFrame, components: list[str], grid: list[int], start: dict[str, int], margin: int = 0, rounds: int = 10) -> tuple[dict[str, int], int]:
    """Strengths of components, one coordinate after another, that leave the fewest samples whose target isn't ahead; and how many are left.

    versions: sample, target (boolean) and a cost for each component; a version's cost is the weighted sum, and a sample's target is ahead when
    every other version costs at least ``margin`` more.  One pass over the versions tries a whole grid, so the passes are components times rounds.
    Of equally good strengths the one nearest to the present stays, then the smaller.
    """
    now = dict(start)

    def failing(trials: list[dict[str, int]]) -> list[int]:
        cost = [sum((F.col(c).cast("decimal(38,0)") * s[c] for c in components), F.lit(0).cast("decimal(38,0)")) for s in trials]
        ahead = versions.groupBy("sample").agg(*(F.max(F.when(F.col("target"), c)).alias(f"t{i}") for i, c in enumerate(cost)), *(F.min(F.when(~F.col("target"), c)).alias(f"o{i}") for i, c in enumerate(cost)))
        return [int(x or 0) for x in ahead.agg(*(F.count_if(F.col(f"o{i}") < F.col(f"t{i}") + margin) for i in range(len(trials)))).first()]

    best = failing([now])[0]
    for _ in range(rounds):
        before = dict(now)
        for c in components:
            tried = sorted({*grid, now[c]}, key=lambda s: (abs(s - now[c]), s))
            found = failing([{**now, c: s} for s in tried])
            if min(found) < best:
                best, now = min(found), {**now, c: tried[found.index(min(found))]}
        if now == before:
            break
    return now, best
