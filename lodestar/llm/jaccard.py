"""N-gram Jaccard join with adaptive multi-match prefixes.

Method: a document is the set of its five-word shingles; equal sets are one class, and classes are
what is joined.  All tokens have one global order: by hash, but the common ones, found by counting
over all documents, come last.  Of n tokens, a class has to share at least l of its first
n - ceil(0.8 n) + l with every class it links with; each class gets the l, from 1 to LONGEST, for
which the candidates it is expected to verify cost least, and which exceeds the number of its prefix
tokens that more than CAP classes have, so that a link always shows in a token of few.  Tokens of one class
alone propose nothing.  Tokens of few classes propose all their pairs; a pair is verified if the
tokens it shares, and those it could still share, can reach the similarity, and if its classes
are not yet connected otherwise.  Classes whose prefixes are full of tokens of many, as those of large groups of
copies are, also meet in these, in rounds: a few pivots, more each round, are compared with all
full classes of the token that are not yet connected with them, then leave it.  No pair is left out except
between classes already known to be connected, so the components are exact, while a group of n
copies takes about n comparisons.

Defined results: a null, empty or blank text has an empty set and is a component of its own; a text of fewer than
five words is one shingle, the whole sequence; repeated rows are rows of one class; texts of any
length are taken whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, drop_shuffles, materialize, release, slices, texts
from .components import components

#: The similarity is at least TIMES / OF.
TIMES, OF = 4, 5
WORDS = 5
LONGEST = 16
CAP = 32
#: A slice's tokens are counted before they are summed; those in fewer of its documents are not.
SLICE, SLICE_LEAST = 8_000_000, 2
#: A common token is in at least so many documents, and in so many that COMMON is the most there can be.
COMMON_LEAST, COMMON = 32, 2_000_000
#: So many tokens before one go with it, so that a pair isn't proposed again by the tokens it shares further on.
EARLIER = 8
#: Keys that are broadcast to choose rows by; more of them are joined by shuffle.
BROADCAST = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of the text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < WORDS:
            x = np.array([len(words)], np.uint64)
            for v in h:
                x = x * _P + v
        else:
            n = len(words) - WORDS + 1
            x = h[:n].copy()
            for k in range(1, WORDS):
                x = x * _P + h[k : k + n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def class_of(tokens: np.ndarray) -> int | None:
    """A signed 64-bit name of a set."""
    from xxhash import xxh3_64_digest

    return int.from_bytes(xxh3_64_digest(tokens.tobytes()), "big", signed=True) if tokens.size else None


def base_prefix(n):
    """n - ceil(n * TIMES / OF) + 1, for numbers and columns alike."""
    if isinstance(n, Column):
        return (n - F.floor((n * TIMES + OF - 1) / OF) + 1).cast("int")
    return n - -(-TIMES * n // OF) + 1


def members(docs: DataFrame) -> DataFrame:
    """doc_id, n and cls of every row; and rows of token and hits, with the tokens that are common in a slice."""

    def work(batch):
        sets = list(map(shingles, batch.column("text").to_pylist()))
        seen = {class_of(s): s for s in sets}
        tokens, hits = np.unique(np.concatenate([np.empty(0, np.uint64), *(s for k, s in seen.items() if k is not None)]), return_counts=True)
        tokens, hits = tokens[hits >= SLICE_LEAST].view(np.int64), hits[hits >= SLICE_LEAST]
        none, blank = [None] * len(tokens), [None] * len(sets)
        return {
            "doc_id": batch.column("doc_id").to_pylist() + none,
            "n": [s.size for s in sets] + none,
            "cls": list(map(class_of, sets)) + none,
            "token": blank + tokens.tolist(),
            "hits": blank + hits.tolist(),
        }

    return arrow_rows(docs, lambda: work, "doc_id long, n int, cls long, token long, hits long", chars=SLICE)


def prefixes(docs: DataFrame, common) -> DataFrame:
    """token, cls and at (n and pos in one number) for the longest prefix of each document; common: broadcast, sorted."""

    def make():
        last = common.value

        def work(batch):
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
            had = set()
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                name = class_of(s)
                if name is None or name in had:
                    continue
                had.add(name)
                n = s.size
                if last.size:
                    at = np.minimum(np.searchsorted(last, s), last.size - 1)
                    late = last[at] == s
                    if late.any():
                        s = np.concatenate([s[~late], s[late]])
                s = s[: base_prefix(n) + LONGEST - 1].view(np.int64)
                for column, values in zip(out, (s, np.full(s.size, name, np.int64), (n << 32) + np.arange(s.size))):
                    column.append(values)
            return dict(zip(("token", "cls", "at"), map(np.concatenate, out)))

        return work

    return arrow_rows(docs, make, "token long, cls long, at long")


def adapted(index: DataFrame) -> DataFrame:
    """cls, l, len, big and full: each class's cheapest l and the length of its prefix; the tokens of many classes in it.

    A prefix of l extra tokens scans the lists of its tokens and verifies the classes found in l of them, at
    most the l-th part of what it scans; verifying costs as the set's size.  With fewer than l tokens of
    many classes in it, every class it links with also shares a token of few, so those of many need not be scanned at
    all.  Where even the longest prefix has too many, the class is full: it takes that prefix and scans all.
    """
    first = base_prefix(F.col("n"))
    few = F.when(F.col("df") <= CAP, F.col("df") - 1).otherwise(0)
    many = F.when(F.col("df") > CAP, 1).otherwise(0)
    sums = index.groupBy("cls").agg(
        F.min("n").alias("n"),
        *(F.sum(F.when(F.col("pos") < first + k - 1, few).otherwise(0)).alias(f"s{k}") for k in range(1, LONGEST + 1)),
        *(F.sum(F.when(F.col("pos") < first + k - 1, many).otherwise(0)).alias(f"b{k}") for k in range(1, LONGEST + 1)),
    )
    # l is at most ceil(0.8 n), with which the prefix is the whole set
    options = [F.when((F.col(f"b{k}") < k) & (first + k - 1 <= F.col("n")), F.struct((F.col(f"s{k}") * (1 + F.col("n") / 8 / k)).alias("cost"), F.lit(k).alias("l"), F.col(f"b{k}").alias("big"))) for k in range(1, LONGEST + 1)]
    best = sums.withColumn("_c", F.array_min(F.array_compact(F.array(*options))))
    l = F.coalesce(F.col("_c.l"), F.least(F.lit(LONGEST), F.col("n") - first + 1))
    return best.select("cls", l.alias("l"), F.least(F.col("n"), first + l - 1).alias("len"), F.coalesce(F.col("_c.big"), F.col(f"b{LONGEST}")).alias("big"), F.col("_c").isNull().alias("full"))


def enough(nx: Column, ny: Column) -> Column:
    """The least intersection of sets of these sizes that are similar enough."""
    return F.ceil((nx + ny) * TIMES / (OF + TIMES) - 1e-9)


def alike_in_size(nx: Column, ny: Column) -> Column:
    return F.least(nx, ny) * OF >= F.greatest(nx, ny) * TIMES


def candidates(index: DataFrame) -> DataFrame:
    """Pairs a < b of classes, and the tokens shared, that tokens of at most CAP classes propose."""
    side = index.filter(F.col("df") <= CAP).select("token", "cls", "n", "pos", "l", "len", "big")
    x, y = (side.select("token", *(F.col(c).alias(f"{c}_{s}") for c in side.columns[1:])) for s in "ab")
    pairs = x.join(y, "token").filter((F.col("cls_a") < F.col("cls_b")) & alike_in_size(F.col("n_a"), F.col("n_b")))
    facts = ["n_a", "n_b", "l_a", "l_b", "len_a", "len_b", "big_a", "big_b"]
    met = pairs.groupBy("cls_a", "cls_b").agg(F.count("*").alias("c"), F.max("pos_a").alias("at_a"), F.max("pos_b").alias("at_b"), *(F.min(f).alias(f) for f in facts))
    shared = F.col("c") + F.least("big_a", "big_b")
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    beyond = F.greatest(F.col("n_a") - F.col("len_a"), F.col("n_b") - F.col("len_b"))
    good = (shared >= F.least("l_a", "l_b")) & (shared + F.least(rest, beyond) >= enough(F.col("n_a"), F.col("n_b")))
    return met.filter(good).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "c")


def chosen(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df with a wanted key, and the other columns of wanted: broadcast if there are few enough, else joined by shuffle."""
    wanted = materialize(wanted, "wanted")
    return df.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, key)


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and set, its tokens' low 48 bits, of the wanted classes (doc_id and cls: one row of each)."""

    def work(batch):
        sets = list(map(shingles, batch.column("text").to_pylist()))
        right = [i for i, (s, cls) in enumerate(zip(sets, batch.column("cls").to_pylist())) if class_of(s) == cls]
        return {"cls": batch.column("cls").take(pa.array(right, pa.int64())), "set": [sets[i].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i in right]}

    return arrow_rows(chosen(docs, wanted.select("doc_id", "cls"), "doc_id"), lambda: work, "cls long, set binary")


def ends_of(pairs: DataFrame) -> DataFrame:
    """The classes in pairs, once each; either side is made distinct before they are put together."""
    return pairs.select(F.col("a").alias("cls")).distinct().union(pairs.select(F.col("b").alias("cls")).distinct()).distinct()


def promising(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough tokens of their prefixes to be similar enough."""
    own = index.groupBy("cls").agg(F.collect_set("token").alias("tokens"), F.min("n").alias("n"), F.min("l").alias("l"), F.min("len").alias("len"))
    own = chosen(own, ends_of(pairs), "cls")
    x, y = (own.select(*(F.col(c).alias(f"{c}_{s}") for c in own.columns)) for s in "ab")
    both = pairs.join(x, F.col("a") == F.col("cls_a")).join(y, F.col("b") == F.col("cls_b"))
    c = F.size(F.array_intersect("tokens_a", "tokens_b"))
    beyond = F.greatest(F.col("n_a") - F.col("len_a"), F.col("n_b") - F.col("len_b"))
    return both.filter((c >= F.least("l_a", "l_b")) & (c + beyond >= enough(F.col("n_a"), F.col("n_b")))).select("a", "b")


def unpacked(packed: bytes) -> np.ndarray:
    """The tokens of a set of token_sets."""
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def work(batches):
        for batch in slices(batches, "set", SLICE):
            keep = []
            for x, y in zip(batch.column("set").to_pylist(), batch.column("other").to_pylist()):
                x, y = unpacked(x), unpacked(y)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both * OF >= (x.size + y.size - both) * TIMES)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    sets = chosen(sets, ends_of(pairs), "cls")
    first = sets.select(F.col("cls").alias("a"), "set").join(F.broadcast(pairs) if pairs.count() <= BROADCAST else pairs, "a")
    both = first.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("other")), "b")
    return both.select("a", "b", "set", "other").mapInArrow(work, "a long, b long")


def label_of(df: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    """Adds the label known for a column of classes, the class itself where there is none."""
    if labels is None:
        return df.withColumn(name, F.col(column))
    return df.join(labels.select(F.col("node").alias(column), F.col("label").alias("_label")), column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and label after links more; only the labels they connect are worked on."""
    if labels is None:
        return components(links)
    if not links.head(1):
        return labels
    ends = label_of(label_of(links, labels, "a", "_la"), labels, "b", "_lb")
    fresh = components(ends.select(F.col("_la").alias("a"), F.col("_lb").alias("b")))
    old = labels.select("node", F.col("label").alias("_was")).join(fresh.select(F.col("node").alias("_was"), F.col("label").alias("_now")), "_was", "left")
    kept = old.select("node", F.coalesce("_now", "_was").alias("label"))
    new = fresh.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return materialize(kept.unionByName(new), "labels")


def full_rows(index: DataFrame, sets: DataFrame) -> DataFrame:
    """token, cls, n, pos, m and the EARLIER tokens before it, of full classes at their tokens of many.

    m is how many of a class's tokens another full class has, by counting all tokens of all full classes: no
    more can be shared with one, so classes for which it is too little need not be compared at all.
    """
    full = index.filter("full")
    own = materialize(full.groupBy("cls").agg(F.min("n").alias("n")), "full-classes")

    def work(batch):
        # combined here already: a token, and the first and last of the batch's classes that have it
        each = list(map(unpacked, batch.column("set").to_pylist()))
        t = np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)
        cls = np.repeat(batch.column("cls").to_numpy(), [e.size for e in each])
        order = np.lexsort((cls, t))
        t, at = np.unique(t[order], return_index=True)
        ends = np.append(at[1:], order.size) - 1
        return {"t": t, "low": cls[order][at], "high": cls[order][ends]}

    rows = arrow_rows(chosen(sets, own.select("cls"), "cls"), lambda: work, "t long, low long, high long", "set", SLICE)
    alone = rows.groupBy("t").agg(F.min("low").alias("cls"), F.max("high").alias("_high")).filter("cls = _high").groupBy("cls").agg(F.count("*").alias("u"))
    useful = own.join(alone, "cls", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).filter(F.col("m") * OF >= F.col("n") * TIMES)
    useful = materialize(useful.select("cls", "m"), "full-facts")
    before = F.collect_list("token").over(Window.partitionBy("cls").orderBy("pos").rowsBetween(-EARLIER, -1)).alias("before")
    many = full.filter((F.col("df") > CAP) & (F.col("pos") < base_prefix(F.col("n"))))
    return many.select("token", "cls", "n", "pos", before).join(useful, "cls")


def pivot_pairs(big: DataFrame, labels: DataFrame | None, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of pivots with the classes of their tokens that aren't connected with them; and big without what is settled.

    A token is settled when its classes have one label.  Its pivots are the class with the smallest share of tokens of
    its own, which most copies are alike to, and those of the smallest hashes, about ``pivots`` of them; compared
    with all others, they leave the token.  A pair is only proposed where the token may be the first that both
    have: if o tokens have to be shared, the first is among the n - o + 1 first of either class, and no token before it
    is shared.  Two pivots meet once.
    """
    place = F.struct((1 - F.col("m") / F.col("n")).alias("own"), F.pmod(F.xxhash64("cls", F.lit(pivots)), F.lit(1 << 40)).alias("h"))
    rows = materialize(label_of(big, labels, "cls", "label").withColumn("place", place), "big")
    stats = rows.groupBy("token").agg(F.count("*").alias("d"), F.min("place").alias("low"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1")
    stats = materialize(stats.select("token", "low", F.floor(F.lit(float(1 << 40)) * (pivots - 1) / F.col("d")).cast("long").alias("bar")), "tokens")
    taken = (F.col("place") == F.col("low")) | (F.col("place.h") < F.col("bar"))
    facts = ["cls", "n", "pos", "m", "label", "before"]
    open_ = materialize(rows.join(stats, "token").select("token", *facts, taken.alias("pivot")), "open")
    p = open_.filter("pivot").select("token", *(F.col(c).alias(f"p_{c}") for c in facts))
    o = enough(F.col("n"), F.col("p_n"))
    may = (F.col("label") != F.col("p_label")) & (F.least("m", "p_m") >= o) & (F.col("pos") <= F.col("n") - o) & (F.col("p_pos") <= F.col("p_n") - o)
    may &= (~F.col("pivot") | (F.col("cls") < F.col("p_cls"))) & ~F.arrays_overlap("before", "p_before")
    pairs = open_.join(p, "token").filter(may & alike_in_size(F.col("n"), F.col("p_n")))
    pairs = pairs.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b")).distinct()
    return pairs, open_.filter("not pivot").select("token", "cls", "n", "pos", "m", "before")


def join_documents(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = df.sparkSession
    docs = texts(df)
    counted = materialize(members(docs), "members")
    rows = counted.filter("n is not null").select("doc_id", "n", "cls")
    total = rows.agg(F.sum("n")).first()[0] or 0
    bar = max(COMMON_LEAST, total // COMMON)
    frequent = counted.filter("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= bar)
    common = spark.sparkContext.broadcast(np.sort(frequent.select("token").toArrow().column("token").to_numpy().view(np.uint64)))

    prefix = prefixes(docs, common)
    several = prefix.groupBy("token").agg(F.min("cls").alias("_low"), F.max("cls").alias("_high")).filter("_low != _high").select("token")
    several = materialize(several, "tokens")
    drop_shuffles(spark)
    found = prefix.join(several, "token").distinct()
    found = materialize(found.select("token", "cls", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")), "postings")
    df_of = materialize(found.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    drop_shuffles(spark)
    release(several)
    counted_index = materialize(found.join(df_of, "token"), "frequent-postings")
    choice = materialize(adapted(counted_index), "prefixes")
    index = materialize(counted_index.join(choice, "cls").filter("pos < len"), "index")
    drop_shuffles(spark)
    release(found, df_of, counted_index, choice)
    near = materialize(candidates(index), "candidates")
    drop_shuffles(spark)

    first = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    first = materialize(first, "classes")
    used = near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).union(index.filter("full").select("cls")).distinct()
    sets = materialize(token_sets(docs, first.join(used, "cls")), "sets")

    big = materialize(full_rows(index, sets), "full")
    drop_shuffles(spark)

    # each class's partner of most shared tokens and its smallest one connect most of what is alike
    ends = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "c").union(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "c"))
    best = ends.groupBy("x").agg(F.max(F.struct("c", "y")).alias("m"), F.min("y").alias("s"))
    best = best.select("x", F.explode(F.array(F.col("m.y"), F.col("s"))).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pivots, labels, rest = 2, None, near
    while True:
        pairs, big = pivot_pairs(big, labels, pivots)
        pairs = promising(materialize(pairs, "pivot-pairs"), index)
        if labels is None:
            pairs = pairs.union(best)
        elif rest is not None:
            both = label_of(label_of(rest, labels, "a", "_la"), labels, "b", "_lb").filter("_la != _lb").select("a", "b")
            pairs, rest = pairs.union(both), None
        links = materialize(verified(pairs, sets), "links")
        labels = merged(labels, links)
        drop_shuffles(spark)
        pivots *= 8
        if rest is None and not big.head(1):
            break
    named = label_of(first, labels, "cls", "label")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = materialize(named.join(lowest, "label").select("cls", "component_id"), "class-components")
    return rows.join(of_class, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
