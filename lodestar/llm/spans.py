"""Substring deduplication by sliding sentence spans.

Method: each text is cut into sentences, at ends of sentences, lines and clauses and, where one
is long, at places that its own words decide, so that a repeated passage is cut alike wherever it stands.  From every
sentence a span runs over the following ones until it has MIN_SENTENCES sentences and MIN_WORDS words; its
hash is counted over all documents, the first occurrence (by doc_id and position) is kept, and
every sentence that a non-first occurrence covers is removed.  With ``both_ends``, as the query has it, the
shortest such spans that end at each sentence are hashed too.  Then every sentence of a repeated run long enough for a span
is covered: by the shortest span from it, or, where the run's rest is too short for one, by the one that ends with the run.

Counting combines on the map side, and only repeated spans are joined back, by a join that may
split a hot hash; a passage in a third of all documents is thus a sum, not a group.

Defined results: a null or empty text has no sentences and stays; texts shorter than a span stay;
of equal texts the one with the smallest doc_id stays whole; a passage repeated inside a
document keeps its first place; repeated rows of a doc_id are one document whose occurrences
coincide, and are cleaned alike; rows without a doc_id only lose what they repeat themselves; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, texts

MIN_SENTENCES, MIN_WORDS = 3, 20
#: A sentence of so many words is cut after words whose hash says so.
LONG_SENTENCE = 12
#: A fragment has at most so many words: where no hash says so, the least hash of so many words in a row does.
LONGEST = 16
_END = re.compile(r"(?<=[.!?;:,])\s+|\n+|(?<=[。！？])")
_SPACE = re.compile(r"\s+")


def cut_after(hashes: list[int]) -> list[bool]:
    """After which words of a long sentence it is cut; between two cuts are at most LONGEST words."""
    out = [h % 5 == 0 for h in hashes]
    out[-1] = True
    start = 0
    for end in [i + 1 for i, c in enumerate(out) if c]:
        if end - start > LONGEST:
            runs = np.lib.stride_tricks.sliding_window_view(np.array(hashes[start:end], np.uint64), LONGEST)
            last_least = LONGEST - 1 - runs[:, ::-1].argmin(1)
            for i in set((start + np.arange(len(runs)) + last_least).tolist()):
                out[i] = True
        start = end
    return out


def sentences(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each sentence with words, in code points, without the white space around it."""
    from xxhash import xxh3_64_intdigest

    out = []
    at = 0
    cuts = [m.span() for m in _END.finditer(text)]
    for stop, following in [*cuts, (len(text), len(text))]:
        words = text[at:stop].split()
        if len(words) < LONG_SENTENCE:
            if words:
                out.append((at, stop, len(words), xxh3_64_intdigest(" ".join(words).lower())))
        else:
            start = i = at
            run: list[str] = []
            for word, ends in zip(words, cut_after([xxh3_64_intdigest(w.lower()) for w in words])):
                i = text.index(word, i) + len(word)
                run.append(word)
                if ends:
                    out.append((start, i, len(run), xxh3_64_intdigest(" ".join(run).lower())))
                    start, run = i, []
        at = following
    return out


def spans(cut: list[tuple[int, int, int, int]], both_ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of the shortest span from each sentence, and to each, ordered by place."""
    n = len(cut)
    words = np.concatenate([[0], np.cumsum([c[2] for c in cut], dtype=np.int64)])
    first = np.arange(n)
    last = np.maximum(first + MIN_SENTENCES, np.searchsorted(words, words[:-1] + MIN_WORDS))
    first, last = first[last <= n], last[last <= n]
    if both_ends:
        end = np.arange(1, n + 1)
        start = np.minimum(end - MIN_SENTENCES, np.searchsorted(words, words[1:] - MIN_WORDS, "right") - 1)
        places = np.unique(np.concatenate([first * (n + 1) + last, (start * (n + 1) + end)[start >= 0]]))
        first, last = places // (n + 1), places % (n + 1)
    if not first.size:
        return first, first, first
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(n + 1, base, np.uint64))
        # the sum of hash * power, divided by the power of the first place: the same wherever the span stands
        inverse = np.cumprod(np.full(n + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(np.array([c[3] for c in cut], np.uint64) * power[:n])])
        h = (total[last] - total[first]) * inverse[first]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (last - first).astype(np.uint64)
        h ^= h >> np.uint64(32)
    return first, last - first, h.view(np.int64)


def span_rows(docs: DataFrame, both_ends: bool = False) -> DataFrame:
    """h and doc_id of the different spans of every document, and one row without h for a document that repeats one itself."""

    def work(batch):
        ids, hs, again = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            every = spans(sentences(text), both_ends)[2]
            h = np.unique(every)
            ids.append(np.full(h.size, doc, np.int64)), hs.append(h)
            if h.size < every.size:
                again.append(doc)
        return {"h": pa.chunked_array([pa.array(np.concatenate(hs)), pa.nulls(len(again), pa.int64())]).combine_chunks(), "doc_id": np.concatenate([*ids, np.array(again, np.int64)])}

    return arrow_rows(docs, lambda: work, "h long, doc_id long")


def repeated_spans(docs: DataFrame, both_ends: bool = False) -> DataFrame:
    """h, doc_id and origin (the first document with it) of the spans that an earlier document holds; null h and origin for documents that repeat a span themselves."""
    rows = materialize(span_rows(docs.filter("doc_id IS NOT NULL"), both_ends), "spans")
    common = rows.filter("h IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("_last")).filter("origin < _last")
    common = materialize(common.select("h", "origin"), "span-origins")
    own = rows.filter("h IS NULL").select("h", "doc_id", F.lit(None).cast("long").alias("origin"))
    return rows.join(common, "h").filter("doc_id > origin").select("h", "doc_id", "origin").union(own)


def covered(cut: list[tuple[int, int, int, int]], earlier: set[int], both_ends: bool = False) -> list[bool]:
    """Which sentences lie in a span of an earlier document, or in one that the document has had before."""
    first, n, h = spans(cut, both_ends)
    hit = np.ones(h.size, bool)
    hit[np.unique(h, return_index=True)[1]] = False
    if earlier:
        hit |= np.isin(h, np.fromiter(earlier, np.int64, len(earlier)))
    if not hit.any():
        return [False] * len(cut)
    edges = np.zeros(len(cut) + 1, np.int64)
    np.add.at(edges, first[hit], 1)
    np.add.at(edges, first[hit] + n[hit], -1)
    return (np.cumsum(edges)[:-1] > 0).tolist()


def without(text: str, cut: list[tuple[int, int, int, int]], gone: list[bool]) -> str:
    """The text without the sentences that are gone and the white space after each."""
    out, at = [], 0
    for i, (start, _, _, _) in enumerate(cut):
        if gone[i]:
            out.append(text[at:start])
            at = cut[i + 1][0] if i + 1 < len(cut) else len(text)
    return "".join([*out, text[at:]]) if out else text


def dedup_spans(df: DataFrame, both_ends: bool = False) -> DataFrame:
    """doc_id, text without repeated passages, n_removed (sentences), removed_chars and the documents they were first in.

    Texts that hold no span of an earlier document and repeat none of their own are known from the first pass and not cut again.
    """
    docs = texts(df)
    later = repeated_spans(docs, both_ends)
    known = later.groupBy("doc_id").agg(F.collect_set("h").alias("earlier"), F.sort_array(F.collect_set("origin")).alias("first_in"))

    def work(batch):
        names = ("doc_id", "text", "n_removed", "removed_chars", "first_in")
        out: dict[str, list] = {k: [] for k in names}
        for doc, text, drop, first_in in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "earlier", "first_in"))):
            kept, flags = text, []
            if drop is not None or doc is None:
                cut = sentences(text)
                flags = covered(cut, set(drop or ()), both_ends)
                kept = without(text, cut, flags)
            for k, v in zip(names, (doc, kept, sum(flags), len(text) - len(kept), first_in or [])):
                out[k].append(v)
        return out

    return arrow_rows(docs.join(known, "doc_id", "left"), lambda: work, "doc_id long, text string, n_removed long, removed_chars long, first_in array<long>")
