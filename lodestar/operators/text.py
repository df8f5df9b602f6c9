"""Text search and text scalars: postings and BM25, rank fusion, typo correction, chunks, Markdown, redaction, MinHash."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: BM25's and rank fusion's constants.
K1, B, RRF_K = 1.2, 0.75, 60
#: The built-in secret patterns, by name.
PATTERNS = (
    ("aws-key", r"AKIA[0-9A-Z]{16}"),
    ("aws-secret", r"(?i)aws_secret_access_key\s*[=:]\s*[\"']?[A-Za-z0-9/+=]{40}"),
    ("github", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b"),
    ("github-pat", r"\bgithub_pat_[A-Za-z0-9_]{80,}\b"),
    ("api-key", r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}\b"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9\-]{10,}\b"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]{16,}=*"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("env-assign", r"(?im)^[^\S\r\n]*(?:export[^\S\r\n]+)?[A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|APIKEY|PRIVATE_KEY)[A-Z0-9_]*[^\S\r\n]*=(?:[^\S\r\n]|\r?\n)*\S+"),
    ("url-creds", r"\b[a-z][a-z0-9+.\-]*://[^\s:/@]+:[^\s@/]+@"),
)


def terms(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """Lower-case words of a query without what isn't a word character, dot or dash at their ends."""
    words = F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w.\-]+|[^\w.\-]+$", ""))
    return F.filter(words, lambda w: w != "")


#: So many terms are looked up in a text before its words become rows; more are joined.
FEW_TERMS = 5_000
#: About so many texts' postings are one task's, and so many rows of queries' terms are broadcast.
TEXTS, FEW_WANTED = 8_000, 200_000


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """term, key, tf and len: the inverted index of a table; with ``only`` (term), of these terms alone.

    A text's other words are then dropped before anything is shuffled, and what is left of it travels once, as one string by its key,
    so that what is counted or summed per text later needs no other exchange.
    """
    words = docs.select(key, terms(F.col(text)).alias("_w")).withColumn("len", F.size("_w"))
    if only is not None:
        few = [r["term"] for r in only.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        if len(few) > FEW_TERMS:
            rows = words.select(key, "len", F.explode("_w").alias("term")).join(only.select("term").distinct(), "term", "left_semi")
            return rows.groupBy("term", key, "len").agg(F.count("*").alias("tf"))
        kept = words.select(key, "len", F.array_sort(F.filter("_w", lambda w: w.isin(few) if few else F.lit(False))).alias("_w")).filter(F.size("_w") > 0)
        # length and words in one column, so that whoever reads the index, and whatever of it, shares one exchange
        kept = kept.select(key, F.concat_ws(" ", F.col("len").cast("string"), "_w").alias("_w"))
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TEXTS))
        parts = kept.repartition(tasks, key).select(key, F.split("_w", " ").alias("_w"))
        rows = parts.select(key, F.col("_w")[0].cast("int").alias("len"), F.explode(F.slice("_w", 2, F.size("_w"))).alias("term"))
        return rows.groupBy("term", key, "len").agg(F.count("*").alias("tf"))
    return words.select(key, "len", F.explode("_w").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, totals: DataFrame, queries: DataFrame, key: str, query_key: str, limit: int | None = None, least: int = 3) -> DataFrame:
    """Scores of documents for queries (query_key, term): any term may match; terms shorter than ``least`` are ignored.

    totals: one row of n and avgdl.  Only the queries' terms are read from the index, by a semi-join.
    """
    wanted = queries.filter(F.length("term") >= least).select(query_key, "term").distinct()
    small = F.broadcast if wanted.limit(FEW_WANTED + 1).count() <= FEW_WANTED else lambda d: d
    df = index.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.countDistinct(key).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(df, "term").crossJoin(F.broadcast(totals)).select(query_key, "term", idf.alias("_idf"), "avgdl")
    t = index.join(small(weights), "term")
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = t.groupBy(query_key, key).agg(F.sum(part).alias("score"))
    if limit is None:
        return scored
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def index_totals(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(terms(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def trigrams(text: Column) -> Column:
    """The different three-character pieces of the lower-case text."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def fuse(rankings: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over rankings, ranks from 1."""
    return rankings.groupBy(*keys).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def rerank(df: DataFrame, path: str, exact: Column) -> DataFrame:
    """Fused scores less for tests, vendored and generated paths, more for an exact name."""
    p = F.col(path)
    change = F.when(is_test_path(p), -0.03).otherwise(0.0) + F.when(p.rlike("(^|/)(vendor|third_party|node_modules)/"), -0.05).otherwise(0.0) + F.when(p.rlike(r"(^|/)generated/|\.pb\.|_generated\."), -0.05).otherwise(0.0) + F.when(exact, 0.02).otherwise(0.0)
    return df.withColumn("score", F.col("score") + change)


def corrections(misses: DataFrame, words: DataFrame) -> DataFrame:
    """term and fix: the nearest known word within distance 1, or 2 from 8 characters on; ties to the smaller word.

    Candidates share a trigram with the term (or, for short ones, its first character) and have nearly its length.
    """
    grams = lambda c: F.array_union(trigrams(c), F.array(F.concat(F.lit("^"), F.substring(c, 1, 1))))
    m = misses.select("term", F.explode(grams(F.col("term"))).alias("g"))
    w = words.select("word", F.explode(grams(F.col("word"))).alias("g"))
    near = m.join(w, "g").select("term", "word").distinct().filter(F.abs(F.length("term") - F.length("word")) <= 2)
    d = near.withColumn("distance", F.levenshtein("term", "word"))
    good = d.filter(F.col("distance") <= F.when(F.length("term") >= 8, 2).otherwise(1))
    return good.groupBy("term").agg(F.min(F.struct("distance", "word")).alias("_b")).select("term", F.col("_b.word").alias("fix"), F.col("_b.distance").alias("distance"))


def distinctive(chunks: DataFrame, group: str, text: str, limit: int = 8) -> DataFrame:
    """The words that best set chunks of a group apart: in at least 2 of n and at most max(3, ceil(0.4 n)) of them."""
    words = chunks.select(group, F.monotonically_increasing_id().alias("_c"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_\-]{2,})")))).alias("word"))
    n = chunks.groupBy(group).agg(F.count("*").alias("n"))
    df = words.groupBy(group, "word").agg(F.countDistinct("_c").alias("df")).join(n, group)
    good = df.filter((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.4))))
    bonus = F.when(F.col("word").rlike("[_-]"), 1.5).when((F.length("word") >= 12) | F.col("word").rlike("[a-z][A-Z]"), 0.8).otherwise(0.0)
    scored = good.withColumn("score", F.log(F.col("n") / F.col("df")) + F.least(F.length("word") / 20, F.lit(0.5)) + bonus)
    once = scored.groupBy(group, F.lower("word").alias("_l")).agg(F.max(F.struct(F.round("score", 9).alias("score"), "word")).alias("_b")).select(group, "_b.*")
    w = Window.partitionBy(group).orderBy(F.desc("score"), "word")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def line_windows(docs: DataFrame, key: str, text: str, lines: int = 80, overlap: int = 10) -> DataFrame:
    """key, ordinal, line_start, line_end and body: windows of ``lines`` lines, each repeating ``overlap`` of the one before."""
    step = lines - overlap
    rows = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l")).withColumn("_n", F.size("_l"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - lines) / step)).cast("int")
    out = rows.select(key, "_l", "_n", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    start = F.col("ordinal") * step
    return out.select(key, "ordinal", (start + 1).alias("line_start"), F.least(start + lines, F.col("_n")).alias("line_end"), F.array_join(F.slice("_l", start + 1, F.lit(lines)), "\n").alias("body"))


def codeish(line: Column) -> Column:
    return line.rlike(r"[{};]\s*$|^\s*(def|class|import|from|return|if|for|while|func|fn|let|const|var|#include)\b|=>|->|\(\)")


def content_type(text: Column) -> Column:
    """code if more than 40 % of the lines that aren't blank look like code, else prose."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(F.filter(lines, codeish)) * 10 > F.size(lines) * 4, "code").otherwise("prose")


def truncate_middle(text: Column, most: int) -> Column:
    """The text, or its head and a third of its room as tail around an ellipsis."""
    tail = (most - 1) // 3
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1 - tail), F.lit("…"), F.right(text, F.lit(tail))))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b" + r"\[[0-?]*[ -/]*[@-~]", "")


def tidy(text: Column) -> Column:
    """Lines without blanks at their ends, at most one empty line between others."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\x1c-\x1f]+"), lambda w: w != ""))


def leading_documentation(body: Column) -> Column:
    """The first triple-quoted string, else the comment lines at the start; empty without either."""
    quoted = F.regexp_extract(body, r'("""|\'\'\')([\s\S]*?)\1', 2)
    comment = F.regexp_extract(body, r"\A\s*((?:(?:#|//)[^\n]*(?:\n|\z)\s*)+)", 1)
    text = F.when(quoted != "", quoted).otherwise(F.regexp_replace(comment, r"(?m)^\s*(?:#+|//+)\s?", ""))
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def accessor(name: Column) -> Column:
    return name.rlike("^(get|set|is|has)($|_|[A-Z])")


def is_test_path(path: Column) -> Column:
    """Paths that hold tests, by directory or file name, whatever the case of ASCII letters."""
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|specs?|fixtures?)/|\.(test|spec)\.|_test\.(go|py)$|(^|/)test_[^/]*\.py$|tests?\.(java|kt|cs)$")


def glob_to_regex(pattern: str) -> str:
    """A regular expression for a glob: * and ? stay in a directory, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def contrast(fr: Column, fg: Column, fb: Column, br: Column, bg: Column, bb: Column) -> Column:
    """The WCAG contrast ratio of two sRGB colours with channels from 0 to 255."""

    def light(*rgb: Column) -> Column:
        linear = [F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4)) for c in rgb]
        return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]

    a, b = light(fr, fg, fb), light(br, bg, bb)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


class _Markdown(HTMLParser):
    HIDDEN = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "template", "form"))
    BREAK = frozenset(("p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure"))

    def __init__(self, hidden: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth, self.hide, self.links = 0, hidden, []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN and self.hide:
            self.depth += 1
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in self.BREAK:
            self.out.append("\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hide and self.depth:
            self.depth -= 1
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in self.BREAK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    """The article or main part if it has 200 characters of text, else the page without its chrome."""
    html = html or ""

    def text(part: str, hidden: bool) -> str:
        p = _Markdown(hidden)
        p.feed(part)
        p.close()
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in "".join(p.out).split("\n"))).strip()

    for tag in ("article", "main"):
        if (m := re.search(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>", html, re.I)) and len(out := text(m[1], False)) >= 200:
            return out
    return text(re.sub(r"<head\b[\s\S]*?</head>", "", html, flags=re.I), True)


def title_of(html: str | None) -> str | None:
    m = re.search(r"<title\b[^>]*>([\s\S]*?)</title>", html or "", re.I)
    return " ".join(unescape(re.sub("<[^>]*>", "", m[1])).split()) or None if m else None


def plain_title(html: Column) -> Column:
    """The text of the first title tag that has neither attributes nor tags inside, or null: the five entities written out, blanks as one space."""
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(character))
    return F.nullif(F.regexp_replace(F.regexp_replace(title, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", ""), F.lit(""))


def page_text(html: Column | str) -> Column:
    """Title and Markdown text of pages."""

    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"title": html.map(title_of), "text": html.map(markdown_of)})

    return F.pandas_udf(read, "title string, text string")(html)


def redaction(text: str, rules: list[tuple[str, re.Pattern]], values: list[str] = ()) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with secrets replaced, and their spans in UTF-8 bytes.  Candidates go by start, then length, then rule; one that overlaps the span before extends it under that one's name."""
    found = [(m.start(), m.end(), i, name) for i, (name, p) in enumerate(rules) for m in p.finditer(text) if m.end() > m.start()]
    found += [(m.start(), m.end(), len(rules), "value") for v in values if v for m in re.finditer(re.escape(v), text)]
    spans: list[list] = []
    for start, end, _, name in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end, name])
    out, at, places, size = [], 0, [], 0
    for start, end, name in spans:
        size += len(text[at:start].encode())
        width = len(text[start:end].encode())
        places.append((size, size + width, name))
        size += width
        out += [text[at:start], f"[redacted:{name}]"]
        at = end
    return "".join([*out, text[at:]]), places


def redact(df: DataFrame, key: str, text: str, extra: tuple[tuple[str, str], ...] = (), values: tuple[str, ...] = (), patterns: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """key, text and notices (name, count) after redaction by the built-in (or other) patterns, further ones and literal values."""

    def run(batches):
        rules = [(n, re.compile(p)) for n, p in (*patterns, *extra)]
        for pdf in batches:
            done = [redaction(t or "", rules, list(values)) for t in pdf[text]]
            notices = [[{"name": n, "count": c} for n, c in sorted(pd.Series([s[2] for s in spans], dtype=object).value_counts().items())] for _, spans in done]
            yield pd.DataFrame({key: pdf[key], "text": [t for t, _ in done], "notices": notices})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, text string, notices array<struct<name:string,count:int>>")


_SEEDS = np.array([0xCBF29CE484222325 ^ (((i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) for i in range(16)], np.uint64)
_PRIME = np.uint64(0x100000001B3)
#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 2_000_000
#: So many shingles are hashed at once; their states stay in the cache.
SHINGLES = 1024


def minhash_of(text: str | None) -> list[int] | None:
    """Four band hashes of 16 seeded FNV-1a minima over five-token shingles; None below five tokens."""
    tokens = re.findall(r"[^\W_]+", text or "")
    if len(tokens) < 5:
        return None
    tokens = [t.lower() for t in tokens]
    shingles = sorted({" ".join(tokens[i : i + 5]).encode() for i in range(len(tokens) - 4)}, key=len)
    minima = np.full(16, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(shingles), SHINGLES):
            some = shingles[first : first + SHINGLES]
            size = np.array([len(x) for x in some])
            # a row for each place, so that a step reads neighbours
            wide = np.frombuffer(b"".join(x.ljust(size[-1], b"\0") for x in some), np.uint8).reshape(len(some), -1).T.astype(np.uint64)
            state = np.repeat(_SEEDS[:, None], len(some), 1)
            for at, live in enumerate(np.searchsorted(size, np.arange(size[-1]), side="right").tolist()):
                rest = state[:, live:]
                np.bitwise_xor(rest, wide[at, live:], out=rest)
                np.multiply(rest, _PRIME, out=rest)
            minima = np.minimum(minima, state.min(1))
        minima = minima.reshape(4, 4)
        out = _SEEDS[:4].copy()
        for row in range(4):
            for byte in range(8):
                out = (out ^ ((minima[:, row] >> np.uint64(8 * byte)) & np.uint64(255))) * _PRIME
    return out.view(np.int64).tolist()


def minhash(text: Column | str) -> Column:
    """The four band hashes of each text."""

    def of(text: pd.Series) -> pd.Series:
        return text.map(minhash_of)

    return F.pandas_udf(of, "array<bigint>")(text)


def minhashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and signature of each row, once; texts are worked on in slices of bounded size."""

    def run(batches):
        for batch in slices(batches, text):
            found = pa.array([minhash_of(x) for x in batch.column(text).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), found], [key, "signature"])

    # a table may be stored in fewer pieces than there are cores
    rows = df.select(key, text).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, signature array<bigint>")


def slices(batches, text: str, most: int = SLICE_BYTES):
    """Cuts Arrow batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start, base = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(start, end - start)
            start, base = end, int(sizes[end - 1])


def band_groups(df: DataFrame, key: str, signature: str) -> DataFrame:
    """band, hash, n and first: the buckets of at least two rows that a band's hash makes."""
    flat = df.filter(F.col(signature).isNotNull()).select(key, F.posexplode(signature).alias("band", "hash"))
    return flat.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def densest_window(positions: Column, width: int) -> Column:
    """The most of the sorted positions that lie within a window of the width."""
    return F.array_max(F.transform(positions, lambda p: F.size(F.filter(positions, lambda q: (q >= p) & (q <= p + width)))))


def snippet(text: Column, words: list[str], lines: int = 6, most: int = 600) -> Column:
    """The window of lines with the most of the words, the first of equal ones, cut to ``most`` characters."""
    rows = F.split(text, "\n")
    hits = lambda x: sum((F.lower(x).contains(w.lower()).cast("int") for w in words), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(rows) - lines + 1))
    scored = F.transform(starts, lambda i: F.struct((-F.aggregate(F.transform(F.slice(rows, i, lines), hits), F.lit(0), lambda a, b: a + b)).alias("s"), i.alias("i")))
    return F.substring(F.array_join(F.slice(rows, F.array_min(scored)["i"], lines), "\n"), 1, most)


def fused_candidates(indexes: list[DataFrame], key: str, score: str, most: int = 50, k: int = RRF_K) -> DataFrame:
    """key and score: the best ``most`` of every index, their reciprocal ranks summed."""
    ranked = None
    for df in indexes:
        top = df.orderBy(F.desc(score), key).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key))).select(key, "rank")
        ranked = top if ranked is None else ranked.union(top)
    return fuse(ranked, [key], k)


def line_blocks(df: DataFrame, key: str, text: str, most_lines: int = 80, most_bytes: int = 256 * 1024, longest: int = 1024 * 1024) -> DataFrame:
    """key, base (lines before it), lines and too_long: blocks that end once they hold ``most_lines`` lines or ``most_bytes`` bytes.

    Bytes are UTF-8 with line ends.  A text that has a line of more than ``longest`` bytes gives one row, too_long, without lines, as nothing
    of it may be kept; null and empty texts give none.
    """

    kind = to_arrow_type(df.schema[key].dataType)

    def blocks(k, t):
        block, size, n, mine = [], 0, 0, []
        for line in re.finditer(r"[^\n]*\n|[^\n]+\Z", t or ""):
            width = len(line[0].encode())
            if width > longest:
                return [(k, n, [], True)]
            block.append(line[0].rstrip("\r\n"))
            n, size = n + 1, size + width
            if len(block) >= most_lines or size >= most_bytes:
                mine.append((k, n - len(block), block, False))
                block, size = [], 0
        return [*mine, (k, n - len(block), block, False)] if block else mine

    def run(batches):
        for batch in slices(batches, text):
            rows: list[tuple] = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
                rows += blocks(k, t)
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, x_kind) for x, x_kind in zip(columns, (kind, pa.int32(), pa.list_(pa.string()), pa.bool_()))], [key, "base", "lines", "too_long"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, base int, lines array<string>, too_long boolean")


def rendered(template: str, evidence: dict[str, Column]) -> Column:
    """A template with the {names} of the evidence replaced by its values (booleans as true and false); other braces, and nulls' names, stay."""
    parts = re.split(r"(\{\w+\})", template)
    named = lambda p: F.coalesce(evidence[p[1:-1]].cast("string"), F.lit(p)) if p[1:-1] in evidence and p[:1] == "{" else F.lit(p)
    return F.concat(*(named(p) for p in parts if p)) if template else F.lit("")


def redacted_spans(df: DataFrame, key: str, text: str, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """key, start, end (UTF-8 bytes) and name of the secrets in texts."""

    def run(batches):
        rules = [(n, re.compile(p)) for n, p in (*PATTERNS, *extra)]
        for pdf in batches:
            rows = [(k, *span) for k, t in zip(pdf[key], pdf[text]) for span in redaction(t or "", rules)[1]]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "name"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, start long, end long, name string")
