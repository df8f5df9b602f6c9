"""Byte-level BPE by prefix-sharing trie traversal, and its inverse.

Method: the distinct words of a slice, sorted as bytes, are the depth-first order of their
trie.  A stack holds, for every node on the current path, the last token of the BPE encoding
of that prefix.  A node's state follows from the states above it: it is the one token that is
a suffix of the prefix and that BPE keeps apart from the state where the token starts.  The
prefix that two words share is thus encoded once, and a word's ids are read back along its
path.  Words are remembered (up to a bound) between slices.

Defined results: a null text is the empty text, which has no ids; special tokens spelled out
in a text become their ids, as the tokenizers library does by default; repeated rows are
encoded one by one, rows without a doc_id like any other; very long texts are encoded whole; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows, texts

#: White space by the Unicode property, as the tokenizer's patterns see it.
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the public word pattern of byte-level BPE.
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Bytes of chunks and their ids, with what Python adds to each, that a worker remembers before it starts anew.
REMEMBERED, ENTRY = 320_000_000, 200


def byte_alphabet() -> dict[str, int]:
    """The public one-character names of bytes: printable Latin-1 bytes name themselves, others follow from 256."""
    named = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(named)]
    return {chr(c): b for b, c in [*((b, b) for b in named), *((b, 256 + i) for i, b in enumerate(rest))]}


class TrieBPE:
    """Encoder and decoder for a tokenizers file of a byte-level BPE model."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        raw = {name: bytes(alphabet[c] for c in name) for name in model["vocab"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for name, i in model["vocab"].items():
            self.bytes_of[i] = raw[name]
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.id_of = {raw[name]: i for name, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = self.id_of[raw[a]], self.id_of[raw[b]]
            self.rank.setdefault((left, right), rank)
            self.made.setdefault(self.id_of[raw[a] + raw[b]], (left, right, rank))
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            self.reach[b[-3:]] = max(len(b), self.reach.get(b[-3:], 2))
        self.edges: tuple[dict, dict] = ({}, {})
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.find = regex.compile(WORDS).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.white_runs = re.compile(f"[{WHITE}]{{2}}")

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end of ``token`` while BPE builds it, each with the rank at which it is used up."""
        if (found := self.edges[side].get(token)) is None:
            found, at, until = [], token, float("inf")
            while True:
                found.append((at, until))
                if at not in self.made:
                    break
                until, at = self.made[at][2], self.made[at][side]
            self.edges[side][token] = found
        return found

    def stays_apart(self, left: int, right: int) -> bool:
        """True if BPE over both tokens' bytes ends with exactly these two.

        No merge may cross the seam: such a merge would have to come before the left neighbour is
        used up (of equal ranks the left one goes first) and not after the right one is.
        """
        key = left << 20 | right
        if (known := self.apart.get(key)) is None:
            known = True
            for a, a_until in self.edge(left, 1):
                for b, b_until in self.edge(right, 0):
                    if (m := self.rank.get((a, b))) is not None and m < a_until and m <= b_until:
                        known = False
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            self.apart[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the given words, which must be distinct and sorted."""
        find, apart, known, reach = self.id_of.get, self.stays_apart, self.apart.get, self.reach.get
        last: list[int] = []
        before, out = b"", []
        for word in words:
            n, k = len(word), 0
            for a, b in zip(before, word):
                if a != b:
                    break
                k += 1
            del last[k:]
            for end in range(k + 1, n + 1):
                longest = reach(word[end - 3 : end], 2) if end > 2 else end
                for start in range(end - longest if end > longest else 0, end):
                    token = find(word[start:end])
                    if token is not None:
                        if start:
                            left = last[start - 1]
                            kept = known(left << 20 | token)
                            if not (apart(left, token) if kept is None else kept):
                                continue
                        last.append(token)
                        break
            ids, end = [], n
            while end:
                ids.append(token := last[end - 1])
                end -= len(self.bytes_of[token])
            out.append(ids[::-1])
            before = word
        return out

    def chunks(self, text: str) -> list[str]:
        """Pieces of the text at whose seams the word pattern always cuts, so that each can be remembered."""
        if self.white_runs.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are not yet remembered, all their distinct words in one traversal."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if self.size > REMEMBERED:
            known.clear()
            self.size, new = 0, list(chunks)
        split = [[w.encode() for w in self.find(c)] for c in new]
        words = sorted({w for ws in split for w in ws})
        ids = {w: np.array(x, "<u4").tobytes() for w, x in zip(words, self.encode_words(words))}
        for c, ws in zip(new, split):
            known[c] = b"".join(map(ids.__getitem__, ws))
        self.size += sum(4 * len(c) + len(known[c]) + ENTRY for c in new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [t for t in texts if not any(s in t for s in self.special)]
        rows = list(map(self.chunks, plain))
        self.learn(set().union(*rows))
        known = self.known.__getitem__
        if len(plain) == len(texts):
            return [b"".join(map(known, row)) for row in rows]
        of = dict(zip(plain, [b"".join(map(known, row)) for row in rows]))
        return [of[t] if t in of else self.encode_special(t) for t in texts]

    def encode_special(self, text: str) -> bytes:
        """The ids of a text that spells out special tokens, which end the words around them."""
        parts = self.split_special.split(text)
        between = self.encode(parts[::2])
        marks = [self.special[x].to_bytes(4, "little") for x in parts[1::2]]
        return b"".join(x for pair in zip(between, [*marks, b""]) for x in pair)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens spelled out."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder_at(path: str) -> TrieBPE:
    """One for each Python worker: what it remembers serves later tasks too."""
    return TrieBPE(path)


def encode_documents(df: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids (packed little-endian unsigned 32-bit) and the text decoded from them."""

    def make():
        coder = coder_at(path)

        def work(batch):
            packed = coder.encode(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "ids": packed, "decoded": [coder.decode(x) for x in packed]}

        return work

    return arrow_rows(texts(df), make, "doc_id long, ids binary, decoded string")


def bpe_digests(df: DataFrame, path: str) -> DataFrame:
    """encode_documents reduced, in the same pass, to counts and digests, so that ids and texts do not travel back."""

    def make():
        coder = coder_at(path)

        def work(batch):
            packed = coder.encode(batch.column("text").to_pylist())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in packed], "ids_sha256": list(map(sha, packed)), "decoded_sha256": [sha(coder.decode(x).encode()) for x in packed]}

        return work

    return arrow_rows(texts(df), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
