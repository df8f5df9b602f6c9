"""Line deduplication through a sharded minimal perfect hash.

Method: the distinct line hashes are dealt into shards by their high bits.  Each shard gets a
minimal perfect hash (levels of bit arrays; a key belongs to the first level where it alone
took its place, and its index is the rank of that bit) that indexes compact arrays of
fingerprints, document counts and holders, the largest doc_id with the line.  Documents send
the hashes of their lines to the shards and probe the arrays there; lines themselves are
never joined.  A shard's arrays come before its probes, which stream past them, so a task holds one shard and one batch.
The few most common lines, at most HOT_LINES however large the corpus is, are a shard of their own that is broadcast
and probed where the documents are, so that no task gets a common line's rows.

Defined results: a null or empty text is one empty line; repeated rows of a doc_id count as one
document, and each is cleaned (of a line they share with no other document, none goes); ties can't occur, as the largest doc_id keeps the line; very long
texts are split whole; rows without a doc_id stay as they are and don't count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, carried, materialize, texts

#: Fixed values of the key: white space stripped at both ends.
STRIPPED = " \t\n\x0b\x0c\r"
#: Distinct lines and probes in a shard, about.
SHARD_ROWS = 20_000
#: The most lines that the broadcast table may hold, and the documents a line needs to be in it.
HOT_LINES, HOT_DOCS = 100_000, 5_000
LEVELS = 24


def line_hashes(lines: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, 64-bit hashes and 32-bit fingerprints of the lines whose keys have min_chars code points."""
    from xxhash import xxh3_128_digest

    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(STRIPPED)) >= min_chars:
            at.append(i)
            digests.append(xxh3_128_digest(key.encode().lower()))
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.array(at, np.int64), both[:, 0].view("<i8"), (both[:, 1] & 0x7FFFFFFF).astype(np.int32)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of each key for each level."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: n distinct keys to 0 .. n - 1.  Keys that no level separates get the last indexes, by search."""

    def __init__(self, levels: list[np.ndarray], spare: np.ndarray):
        self.levels, self.spare = levels, spare
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - 1 + total)
            total += int(bits.sum())
        self.placed = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while keys.size and len(levels) < LEVELS:
            size = max(64, 2 * keys.size)
            at = (mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for keys it was not built with, any index or -1."""
        out = np.full(keys.size, -1, np.int64)
        left = np.arange(keys.size)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (mixed(keys[left], level) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        if self.spare.size and left.size:
            at = np.minimum(np.searchsorted(self.spare, keys[left]), self.spare.size - 1)
            hit = self.spare[at] == keys[left]
            out[left[hit]] = self.placed + at[hit]
        return out

    def pack(self) -> tuple[list[int], bytes, bytes]:
        return [b.size for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels), self.spare.tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], bits: bytes, spare: bytes) -> PerfectHash:
        levels, at, flat = [], 0, np.frombuffer(bits, np.uint8)
        for size in sizes:
            end = at + (size + 7) // 8
            levels.append(np.unpackbits(flat[at:end], count=size).astype(bool))
            at = end
        return cls(levels, np.frombuffer(spare, "<i8"))


class Shard:
    """A minimal perfect hash of distinct lines, and the arrays it indexes."""

    def __init__(self, hashed: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.hashed, self.fingerprints, self.counts, self.holders = hashed, fingerprints, counts, holders

    @classmethod
    def build(cls, table: pa.Table) -> Shard:
        """Of lines: h, fp, n and holder."""
        h, fp, n, holder = (table.column(k).to_numpy() for k in ("h", "fp", "n", "holder"))
        once, first = np.unique(h, return_index=True)
        hashed = PerfectHash.build(once)
        if once.size < h.size:  # two lines with one 64-bit hash: the more common one stays
            best = np.lexsort((-n, h))
            first = best[np.unique(h[best], return_index=True)[1]]
        order = np.empty_like(first)
        order[hashed.index(once)] = first
        return cls(hashed, fp[order].astype("<i4"), np.minimum(n[order], 2**32 - 1).astype("<u4"), holder[order].astype("<i8"))

    def drops(self, h: np.ndarray, fp: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes' lines are in min_docs documents, of which another one keeps them."""
        if not self.counts.size:
            return np.zeros(h.size, bool)
        at = self.hashed.index(h)
        return (at >= 0) & (self.fingerprints[at] == fp) & (self.counts[at] >= min_docs) & (self.holders[at] != doc)

    def pack(self) -> dict:
        sizes, bits, spare = self.hashed.pack()
        return {"sizes": sizes, "bits": bits, "spare": spare, "fingerprints": self.fingerprints.tobytes(), "counts": self.counts.tobytes(), "holders": self.holders.tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> Shard:
        return cls(PerfectHash.unpack(row["sizes"], row["bits"], row["spare"]), np.frombuffer(row["fingerprints"], "<i4"), np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["holders"], "<i8"))


PACKED = "sizes array<int>, bits binary, spare binary, fingerprints binary, counts binary, holders binary"


def packed_shard(table: pa.Table) -> pa.Table:
    """One shard's lines as a row of its hash and arrays."""
    row = {"shard": table.column("shard")[0].as_py()} | Shard.build(table).pack()
    kinds = {"shard": pa.int64(), "sizes": pa.list_(pa.int32())}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def probed(probes: DataFrame, arrays: DataFrame, min_docs: int) -> DataFrame:
    """doc_id and h of the probes (shard, h, fp, doc_id) whose line the shard's arrays say is to be dropped from that document.

    Both kinds of rows are dealt by shard and sorted, a shard's arrays first.  A task reads batch after batch and
    holds one shard's arrays at a time, however many probes there are.
    """
    both = probes.withColumn("late", F.lit(1)).unionByName(arrays.withColumn("late", F.lit(0)), allowMissingColumns=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shard, late = (batch.column(k).to_numpy() for k in ("shard", "late"))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (late[1:] != late[:-1])) + 1
            docs, hs = [], []
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                if not late[start]:
                    now, held = shard[start], Shard.unpack(batch.slice(start, 1).to_pylist()[0])
                elif shard[start] == now:
                    h, fp, doc = (batch.column(k).slice(start, end - start).to_numpy(zero_copy_only=False) for k in ("h", "fp", "doc_id"))
                    gone = held.drops(h.astype(np.int64), fp.astype(np.int32), doc.astype(np.int64), min_docs)
                    docs.append(doc[gone]), hs.append(h[gone])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (docs, hs)], names=["doc_id", "h"])

    return both.repartition("shard").sortWithinPartitions("shard", "late").mapInArrow(work, "doc_id long, h long")


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept: the text without the lines that a later document keeps; and the columns to carry."""
    docs = texts(df, *carry)

    def hashes():
        def work(batch):
            ids, hs, fps = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                _, h, fp = line_hashes(text.split("\n"), min_chars)
                if h.size:
                    h, first = np.unique(h, return_index=True)
                    ids.append(np.full(h.size, doc, np.int64)), hs.append(h), fps.append(fp[first])
            join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
            return {"doc_id": join(ids, np.int64), "h": join(hs, np.int64), "fp": join(fps, np.int32)}

        return work

    probes = materialize(arrow_rows(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), hashes, "doc_id long, h long, fp int").distinct(), "line-probes")
    rows = probes.count()
    lines = materialize(probes.groupBy("h", "fp").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")), "line-counts")
    hot_docs = max(HOT_DOCS, -(-rows // HOT_LINES))  # so that rows / hot_docs, the most there can be, is bounded
    hot = Shard.build(lines.filter(F.col("n") >= hot_docs).toArrow())
    shards = max(1, -(-rows // SHARD_ROWS))
    shard = F.pmod(F.shiftright("h", 20), F.lit(shards)).alias("shard")
    arrays = materialize(lines.select(shard, "h", "fp", "n", "holder").groupBy("shard").applyInArrow(packed_shard, f"shard long, {PACKED}"), "line-shards")
    common = df.sparkSession.sparkContext.broadcast(hot.pack() | {"hashes": np.sort(lines.filter(F.col("n") >= hot_docs).select("h").toArrow().column("h").to_numpy())})

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~np.isin(batch.column("h").to_numpy(), common.value["hashes"])))

    sent = (probes.mapInArrow(cold, "doc_id long, h long, fp int") if hot.counts.size else probes).select(shard, "h", "fp", "doc_id")
    by_doc = probed(sent, arrays, min_docs).groupBy("doc_id").agg(F.collect_set("h").alias("drop"))

    def strip():
        hot = Shard.unpack(common.value)

        def work(batch):
            ids, drops = batch.column("doc_id").to_pylist(), batch.column("drop").to_pylist()
            cut = [t.split("\n") for t in batch.column("text").to_pylist()]
            at = [line_hashes(x, min_chars) if doc is not None and (drop or hot.counts.size) else line_hashes([], min_chars) for x, doc, drop in zip(cut, ids, drops)]
            sizes = [h.size for _, h, _ in at]
            h, fp = (np.concatenate([np.empty(0, t), *(x[k] for x in at)]) for k, t in ((1, np.int64), (2, np.int32)))
            late = hot.drops(h, fp, np.repeat(np.array([d or 0 for d in ids], np.int64), sizes), min_docs)
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_lines", "n_dropped", "kept")}
            end = 0
            for doc, lines, drop, (places, own, _) in zip(ids, cut, drops, at):
                start, end = end, end + own.size
                gone = set(places[late[start:end]].tolist())
                if drop:
                    gone.update(places[np.isin(own, np.array(drop, np.int64))].tolist())
                kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
                for k, v in zip(out, (doc, len(lines), len(gone), "\n".join(kept))):
                    out[k].append(v)
            return out | {k: batch.column(k) for k in carry}

        return work

    return arrow_rows(docs.join(by_doc, "doc_id", "left"), strip, "doc_id long, n_lines long, n_dropped long, kept string" + carried(docs, carry))


#: The same rows in DuckDB.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND c.holder <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
