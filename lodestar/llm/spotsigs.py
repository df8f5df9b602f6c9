"""Document fingerprints by SpotSigs, in DataFrame functions alone.

Method: a text is lower-cased and cut into runs of letters and digits.  Every common word is an anchor; the first
CHAIN content words among the SPAN words after it form, with it, one signature.  The beginning of the text is
an anchor too, so that texts without common words have a signature.  With ``stand_ins``, as the query has it, a word is an anchor
itself where neither it nor one of the SPAN words before it is common, so that all of a text without common words,
and of such a stretch, is in the fingerprint.  A fingerprint is the set of
signature hashes, written out as sorted hexadecimal numbers.

Likenesses of given pairs are compared by length first: sets are partitioned by their length, and a pair whose
partitions are so far apart that its similarity is certainly under FLOOR is 0 without being compared; the others get
their Jaccard similarity.

Near duplicates: sets are partitioned by their length, into ranges so wide that only sets of the same or
the next range can be similar enough; within them an inverted index on the rarest signatures of each
set proposes pairs, and the Jaccard similarity is only computed for pairs whose lengths allow the
threshold.

Defined results: a null or empty text has an empty fingerprint; two empty fingerprints are alike (1), an empty one and
another are not (0); very long texts are fingerprinted whole; repeated rows of a doc_id follow one
another; the next document of the last one is the first; rows without a doc_id have no place in the order and
are left out; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is it that this with was for on as by be are an at or from not have has but they "
    "der die das und ist ein eine in zu den von mit auf nicht für im sich dem des auch es als "
    "le la les de des du et en un une est que qui dans pour par avec sur pas au plus ce il elle "
    "el los las del y que en por con para una es se su al lo como no a"
).split()
CHAIN, SPAN = 2, 6
#: Documents are put in order in ranges of doc_id with about so many rows each; the table of ranges has a fixed bound.
RANGE_ROWS, RANGES = 500, 65_536
#: Likenesses under it count as none.
FLOOR = 0.02


def signatures(text: Column, stand_ins: bool = False) -> Column:
    """The sorted set of a text's signature hashes, of 32 bits each."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    content = lambda w: ~w.isin(ANCHORS)
    chain = lambda ws, i: F.slice(F.filter(F.slice(ws, i, SPAN), content), 1, CHAIN)

    short = lambda *parts: F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))

    def spots_of(ws: Column) -> Column:
        if not stand_ins:
            return F.transform(ws, lambda w, i: F.when(w.isin(ANCHORS), short(w, chain(ws, i + 2))))
        reach = lambda common, i: F.slice(common, F.greatest(F.lit(1), i + 1 - SPAN), F.least(F.lit(SPAN), i) + 1)
        marked = lambda common: F.transform(ws, lambda w, i: F.when(F.get(common, i) | ~F.array_contains(reach(common, i), True), short(w, chain(ws, i + 2))))
        return F.transform(F.array(F.transform(ws, lambda w: w.isin(ANCHORS))), marked)[0]

    def of(ws: Column) -> Column:
        spots = spots_of(ws)
        start = F.when(F.size(ws) > 0, F.array(short(F.lit(""), chain(ws, F.lit(1))))).otherwise(F.array().cast("array<bigint>"))
        return F.array_sort(F.array_distinct(F.concat(start, F.array_compact(spots))))

    # the words are computed once, as the only element of an array whose transform binds them
    return F.transform(F.array(words), of)[0]


def fingerprint(sigs: Column) -> Column:
    """A set as text: 8 hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def length_class(sigs: Column, least: float) -> Column:
    """The partition of a set by its length; sets of at least this similarity are in the same one or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / -F.log(F.lit(float(least)))).cast("long")


def likeness(a: Column, b: Column, least: float = FLOOR) -> Column:
    """Jaccard similarity of two sets, 1 for two empty ones; 0 where their lengths alone keep it under ``least``."""
    both = F.size(F.array_intersect(a, b))
    apart = (F.abs(length_class(a, least) - length_class(b, least)) > 1) | (F.least(F.size(a), F.size(b)) < F.greatest(F.size(a), F.size(b)) * F.lit(float(least)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds next_<column>s of the next row by descending doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id, cut at quantiles, as many as the rows ask for.  The first row of each range is also sent to the range
    before it in this order, so that every range finds all of its next rows by itself.
    """
    ranges = max(1, min(RANGES, docs.count() // RANGE_ROWS))
    cuts = F.percentile_approx("doc_id", F.lit([k / ranges for k in range(1, ranges)]), 4 * max(ranges, 2_500)) if ranges > 1 else F.array().cast("array<bigint>")
    bounds = sorted(set(docs.agg(cuts.alias("c")).first()["c"] or ()))
    # a literal: decoded once when the plan is made, not for each row
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else None
    steps = F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)])
    # how many bounds are at most the doc_id, by halving steps
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if bounds else F.lit(0)
    placed = docs.withColumn("_range", below.cast("long"))
    tops = placed.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    around = Window.orderBy("_range")  # at most RANGES rows
    first = F.min("_range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = tops.select("_range", "_top", F.coalesce(F.lead("_range").over(around), first).alias("_to"))
    marked = placed.join(F.broadcast(heads), "_range")
    order = ["_ghost", F.desc("doc_id"), *columns]
    # one of the rows with the range's largest doc_id is the head: the first in the order of columns
    sent = F.when(F.col("doc_id") == F.col("_top"), F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost")), F.struct(F.col("_to").alias("at"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost"))))
    dealt = marked.select(*docs.columns, F.explode(sent).alias("_s")).select(*docs.columns, F.col("_s.at").alias("_at"), F.col("_s.ghost").alias("_ghost"))
    w = Window.partitionBy("_at").orderBy(*order)
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).filter("_ghost = 0").drop("_at", "_ghost")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first code points of the following one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def document_fingerprints(df: DataFrame, stand_ins: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to the edited and to the next text."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    own = docs.withColumn("sigs", signatures(F.col("text"), stand_ins))
    pairs = with_next(own, "text", "sigs").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    done = pairs.withColumn("edited_sigs", signatures(F.col("edited"), stand_ins))
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of classes of equal fingerprints, by their smallest doc_ids, and of at least the threshold.

    A set of n signatures shares one of its n - ceil(threshold * n) + 1 rarest with every set that is similar
    enough.  Signatures held by one class alone propose nothing and are dropped before pairs are made.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    classes = materialize(docs.groupBy("sigs").agg(F.min("doc_id").alias("a")).filter(F.size("sigs") > 0).select("a", "sigs", F.size("sigs").alias("n")), "classes")
    base = F.lit(float(threshold))
    # lengths of one range differ by less than the threshold allows, so partners are in the same range or the next
    bucket = length_class(F.col("sigs"), threshold)
    flat = classes.select("a", "n", bucket.alias("range"), F.explode("sigs").alias("sig"))
    frequency = flat.groupBy("sig").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("a").orderBy("df", "sig")
    keep = F.col("n") - F.ceil(F.col("n") * base - 1e-9) + 1
    index = flat.join(frequency, "sig").withColumn("_r", F.row_number().over(rarest)).filter((F.col("_r") <= keep) & (F.col("df") > 1)).select("a", "n", "range", "sig")
    index = materialize(index, "index")
    left = index.select("a", "n", F.explode(F.array("range", F.col("range") + 1)).alias("range"), "sig")
    right = index.select(F.col("a").alias("b"), F.col("n").alias("m"), "range", "sig")
    longer = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") > F.col("a")))
    pairs = left.join(right, ["range", "sig"]).filter(longer & (F.col("n") >= base * F.col("m") - 1e-9)).select("a", "b").distinct()
    sets = classes.select("a", "sigs")
    both = pairs.join(sets, "a").join(sets.select(F.col("a").alias("b"), F.col("sigs").alias("other")), "b")
    return both.select("a", "b", likeness(F.col("sigs"), F.col("other")).alias("likeness")).filter(F.col("likeness") >= base)
