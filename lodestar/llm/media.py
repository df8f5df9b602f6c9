"""Media columns: interleaved document sequences.

Method: HTML parsing turns a page into an ordered array of text and media-reference structs;
references carry the digest of their media, and a join on the digest resolves them, so that
positions and captions stay aligned with what they resolve to.  A medium is stored as a
binary PGM image of 8-bit samples, 64 to a row, and every figure is computed from the stored
bytes after they are read back.  A document's page holds its own lines as text, and between the first half of them and
the rest a figure that refers to its medium, so that text and media are interleaved; web pages go the same way.

Defined results: a null or empty text is a payload of 64 zero bytes, on a page of the figure alone; a null page has an empty
sequence; references to unknown digests, and by other addresses, resolve to null and keep their place; repeated
rows and rows without a doc_id are kept; very long texts are one medium each; markup inside a document's text is text;
equal media are described alike and joined once to every reference; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, texts

#: Elements whose text is not content, and elements that break a run of text.
HIDDEN = frozenset(["script", "style", "noscript", "template", "nav"])
BLOCKS = frozenset("p div article section main header footer li ul ol table tr td th h1 h2 h3 h4 h5 h6 br figure figcaption blockquote pre".split())
#: Elements that refer to media by src, of which img alone is void.
MEDIA = frozenset(["img", "audio", "video", "source", "embed"])
#: Fixed value: what a reference by digest starts with.
SCHEME = "sha256:"
WIDTH = 64

SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def put(self, **item):
        self.items.append({"position": len(self.items), "kind": "", "text": None, "ref": None, "caption": None} | item)

    def flush(self):
        if words := " ".join("".join(self.run).split()):
            self.put(kind="text", text=words)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag in MEDIA and not self.hidden and (src := dict(attrs).get("src")):
            self.put(kind="media", ref=src, caption=dict(attrs).get("alt"))
        elif tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for item in self.items[self.figure :]:
                if item["kind"] == "media":
                    item["caption"] = words
            self.caption = None
        if tag == "figure":
            self.figure = None
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.run.append(data)


def sequence_of(page: str | None) -> list[dict]:
    """The page's ordered text and media-reference items; a figure's caption belongs to its media."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def interleave(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and sequence: the ordered structs of each page's html."""
    rows = pages.select(F.col(key).cast("long").alias("key"), "html")
    out = arrow_rows(rows, lambda: lambda b: {"key": b.column("key"), "sequence": [sequence_of(h) for h in b.column("html").to_pylist()]}, f"key long, sequence {SEQUENCE}", "html")
    return out.withColumnRenamed("key", key)


def references(sequences: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each media reference: key, position, caption, ref, the digest if it refers by one, and its sequence's items and characters of text."""
    item = F.explode(F.filter("sequence", lambda x: x["kind"] == "media"))
    chars = F.aggregate("sequence", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x["text"]), F.lit(0)))
    flat = sequences.select(key, F.size("sequence").alias("n_items"), chars.alias("text_chars"), item.alias("i")).select(key, "i.position", "n_items", "text_chars", "i.caption", "i.ref")
    return flat.withColumn("digest", F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64)))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """Joins references to media by digest; media may repeat, references without media stay."""
    columns = [c for c in media.columns if c != "digest"]
    # written, so that the join below is one of two exchanges and may split a digest that many refer to
    once = materialize(media.groupBy("digest").agg(*(F.min(c).alias(c) for c in columns)), "media-once")
    return refs.join(once, "digest", "left")


def stored_form(data: bytes) -> bytes:
    """A PGM image of the bytes, filled with zeros to a positive multiple of its width; a comment keeps their number."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n# %d\n%d %d\n255\n" % (len(data), WIDTH, rows) + data.ljust(rows * WIDTH, b"\0")


def samples_of(media: bytes) -> tuple[bytes, int]:
    """The samples of a stored form, and how many of them are data."""
    kind, note, size, depth, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored form")
    return samples, int(note[1:])


def describe(samples: bytes) -> str:
    """Mean, spread, entropy and coarse histogram of 8-bit samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / len(samples)
    level = np.arange(256)
    mean = float(share @ level)
    spread = float(share @ (level - mean) ** 2) ** 0.5
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1)))


def store_documents(df: DataFrame) -> DataFrame:
    """Writes each text as a medium; the written table of doc_id, digest and media."""

    def work(batch):
        media = [stored_form(t.encode()) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "digest": [hashlib.sha256(m).hexdigest() for m in media], "media": media}

    return materialize(arrow_rows(texts(df), lambda: work, "doc_id long, digest string, media binary"), "media")


def page_of(text: str) -> str:
    """A document as HTML: its lines as paragraphs, and in their middle a figure that refers to its medium by digest."""
    lines = [f"<p>{html.escape(x)}</p>" for x in text.split("\n")]
    half = len(lines) // 2
    figure = f'<figure><img src="{SCHEME}{hashlib.sha256(stored_form(text.encode())).hexdigest()}" alt=""><figcaption>{len(text)} code points</figcaption></figure>'
    return "<article>" + "".join([*lines[:half], figure, *lines[half:]]) + "</article>"


def document_pages(df: DataFrame) -> DataFrame:
    """doc_id and html of each document's page, which is made where it is read and not stored."""
    return arrow_rows(texts(df), lambda: lambda b: {"doc_id": b.column("doc_id"), "html": list(map(page_of, b.column("text").to_pylist()))}, "doc_id long, html string")


def described(media: DataFrame) -> DataFrame:
    """Figures of stored media, from their bytes alone: a row for each row read."""

    def work(batch):
        out: dict[str, list] = {k: [] for k in ("digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m in batch.column("media").to_pylist():
            (samples, size), sha = samples_of(m), hashlib.sha256(m).hexdigest()
            for k, v in zip(out, (sha, size, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(m), sha, describe(samples))):
                out[k].append(v)
        return out

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_rows(media.select("media"), lambda: work, schema, "media")


def document_media(df: DataFrame) -> DataFrame:
    """Every document's medium, found again through its page: parsed, referred to by digest, joined and described."""
    stored = store_documents(df)
    refs = references(interleave(document_pages(df), "doc_id"), "doc_id")
    facts = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return resolve(refs, described(stored)).select("doc_id", *facts, "position", "n_items", "text_chars", "caption")
