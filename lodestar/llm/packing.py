"""Best-fit packing with exact-complement hashing.

Method: everything is decided on the histogram of piece lengths, at most ``capacity`` numbers
however large the corpus is.  For each length, longest first, the gap it leaves is looked up
in an index of the sums of the available single lengths, pairs and triples, and the combination
that fills the gap exactly is consumed as often as the availability counts allow.  Counts only fall, so a combination
that is used up leaves the index for good.  What has no
exact complement goes best-fit decreasing, run by run of equal lengths.  The plan is a list of
patterns with multiplicities; pieces take their places in it by their rank among the pieces
of the same length, which is counted in buckets, so that no length is ranked in one task.

Defined results: a null text is the empty text, one piece holding the end mark alone;
documents longer than the capacity, however long, are cut into full pieces and a rest; repeated rows and
rows without a doc_id are packed one by one, and ties among equal pieces fall by the order of rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, texts

#: Bytes of chunks and their ids, with what Python adds to each, that a worker remembers before it starts anew.
REMEMBERED, ENTRY = 320_000_000, 200
#: Rows of one length that are ranked together, about.
RANKED_TOGETHER = 200_000


class _Known(dict):
    """Packed ids by chunk; a chunk that is not yet known is encoded when it is asked for."""

    #: Fixed value: the tokenizer's public pattern for what it encodes one by one.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, run):
        import regex

        self.run, self.pieces = run, regex.compile(self.PIECES).findall
        self.bytes = 0

    def __missing__(self, chunk: str) -> bytes:
        if self.bytes > REMEMBERED:
            self.clear()
            self.bytes = 0
        # below U+0250 lower case is a matter of single characters, and nothing is composed anew
        pieces = self.pieces(chunk.lower()) if max(chunk) < "\u0250" else None
        found = self.run(chunk) if pieces is None or pieces == [chunk] else b"".join(map(self.__getitem__, pieces))
        self[chunk] = found
        self.bytes += 4 * len(chunk) + len(found) + ENTRY
        return found


class ChunkTokenizer:
    """Whole-text ids of a tokenizer that drops white space: each chunk between white space is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts in which a special token is spelled out, or where Python and the tokenizer differ on white space, go whole.
        self.whole = ("\x1c", "\x1d", "\x1e", "\x1f", *special)
        self.known = _Known(self.run)

    def run(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known.__getitem__
        return [self.run(t) if any(w in t for w in self.whole) else b"".join(map(known, t.split())) for t in texts]


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> ChunkTokenizer:
    """One for each Python worker: what it remembers serves later tasks too."""
    return ChunkTokenizer(path)


def tokenized_pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces."""

    def make():
        coder = tokenizer_at(path)
        end = end_id.to_bytes(4, "little")

        def work(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for k, v in zip(out, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part))):
                        out[k].append(v)
            return out

        return work

    return arrow_rows(texts(df), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sums:
    """The sums of one, two and three available lengths, by total.

    A total's pairs, and the largest members of its triples, are listed when it is first asked for, and a mark
    says where the first one is that isn't used up yet.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.listed: tuple[dict, dict] = ({}, {})

    def members(self, total: int, triples: bool) -> list:
        """The larger members of a total's pairs, or all that may be the largest of its triples, falling; and the mark."""
        if total not in self.listed[triples]:
            low, high = (-(-total // 3), total - 2) if triples else (-(-total // 2), total - 1)
            a = np.arange(high, low - 1, -1) if high >= max(low, 1) else np.empty(0, int)
            a = a[self.left[a] > 0]
            self.listed[triples][total] = [a if triples else a[self.left[total - a] > 0], 0]
        return self.listed[triples][total]

    def has(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def pair(self, total: int, *used: int) -> list[int] | None:
        """The pair with the largest member, beside those used already."""
        found = self.members(total, False)
        for i in range(found[1], len(found[0])):
            a = int(found[0][i])
            if self.has(a, total - a, *used):
                return [a, total - a]
            if i == found[1] and not self.has(a, total - a):
                found[1] += 1
        return None

    def triple(self, total: int, *used: int) -> list[int] | None:
        """The triple with the largest member, beside those used already."""
        found = self.members(total, True)
        for i in range(found[1], len(found[0])):
            a = int(found[0][i])
            if self.has(a, *used) and (rest := self.pair(total - a, a, *used)):
                return [a, *rest]
            if i == found[1] and not (self.has(a) and self.pair(total - a, a)):
                found[1] += 1
        return None

    def complement(self, gap: int, *used: int) -> list[int] | None:
        """One, two or three available lengths, beside those used already, that fill the gap exactly."""
        if self.has(gap, *used):
            return [gap]
        return self.pair(gap, *used) or self.triple(gap, *used)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (how many sequences, the lengths in each) that use up all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        left[length] = n
    patterns: list[tuple[int, list[int]]] = []
    rest, sums = np.zeros_like(left), Sums(left)
    for length in range(capacity, 0, -1):
        while left[length]:
            found = sums.complement(capacity - length, length) if length < capacity else []
            if found is None:
                rest[length], left[length] = left[length], 0
                break
            used = [length, *found]
            times = min(int(left[x]) // used.count(x) for x in set(used))
            patterns.append((times, used))
            for x in used:
                left[x] -= times
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    for length in range(capacity, 0, -1):
        while n := int(rest[length]):
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                times, each = (n // fit, fit) if n >= fit else (1, n)
                used = [length] * each
                times_used, gap = times, capacity - length * each
            else:
                have, base = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                fit = min(gap // length, n)
                times_used = min(have, n // fit)
                if have > times_used:
                    open_.setdefault(gap, []).append((have - times_used, base))
                used, each, gap = base + [length] * fit, fit, gap - length * fit
            rest[length] -= times_used * each
            if gap:
                open_.setdefault(gap, []).append((times_used, used))
            else:
                patterns.append((times_used, used))
    return patterns + [x for group in open_.values() for x in group]


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of its slots, the first sequence of each slot, the offset in the sequence."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, used in patterns:
        offset = 0
        for length in used:
            rank = taken.get(length, 0)
            slots.setdefault(length, []).append((rank, first, offset))
            taken[length] = rank + times
            offset += length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}


def ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank, 0 to n - 1 among the rows of each length, without gathering a length in one task."""
    buckets = max(64, pieces.count() // RANKED_TOGETHER)
    spread = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = spread.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    by_length = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "_b", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order)) - 1
    return spread.withColumn("_inside", inside).join(before, ["length", "_b"]).withColumn("rank", F.col("_inside") + F.col("_before")).drop("_b", "_inside", "_before")


def pack(pieces: DataFrame, order: list[str], capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces, which have a length from 1 to capacity; ``order`` makes rows distinct.

    Pieces are read more than once: pass a written table.  The histogram and the plan hold at
    most ``capacity`` lengths and a few times as many slots, so the driver's share has a fixed bound.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = places(plan(counts, capacity))
    schema = pieces.schema.simpleString()[len("struct<") : -1]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                ranks, firsts, offsets = place[x]
                slot = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = firsts[slot] + rank[at] - ranks[slot], offsets[slot]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = ranked(pieces, order).select(*pieces.columns, "rank")
    return out.mapInArrow(assign, f"{schema.replace(':', ' ')}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """Tokenizes whole documents and packs their pieces into as few sequences as the plan finds."""
    pieces = materialize(tokenized_pieces(df, path, capacity), "pieces")
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)
