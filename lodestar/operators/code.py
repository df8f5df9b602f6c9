"""A code index from files: extraction, import resolution, building, incremental refresh, freshness and pattern search.

Files are rows; each is extracted by itself in Arrow batches, so a build is one pass over the tree that scales with its
files.  An index is a folder of Parquet tables (files, entities, imports); a build writes beside it and then takes its place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import language, manifest_diff, source_tree

#: Kinds of entities, by number.
FUNCTION, CLASS, INTERFACE, CALL, IMPORT = 0, 1, 2, 6, 7
ENTITY = "path string, kind int, name string, owner_type string, start_byte long, end_byte long, start_line int, end_line int"
_WORD = r"[A-Za-z_$][\w$]*"
#: For languages with braces: what declares a function, a class, an interface, and what imports.
BRACES = {
    "go": (rf"^func\s+(?:\([^)]*\)\s*)?({_WORD})\s*\(", rf"^type\s+({_WORD})\s+struct\b", rf"^type\s+({_WORD})\s+interface\b", r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$'),
    "java": (rf"^\s+(?:[\w<>\[\],?]+\s+)+({_WORD})\s*\([^;{{]*\)\s*(?:throws [\w, .]+)?\{{", rf"^\s*(?:[a-z]+\s+)*class\s+({_WORD})", rf"^\s*(?:[a-z]+\s+)*interface\s+({_WORD})", r"^import\s+(?:static\s+)?([\w.]+)\s*;"),
    "typescript": (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({_WORD})", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORD})", rf"^\s*(?:export\s+)?interface\s+({_WORD})", r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]"""),
    "rust": (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+({_WORD})", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+({_WORD})", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({_WORD})", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
}
BRACES |= {"javascript": BRACES["typescript"], "tsx": BRACES["typescript"]}
_PYTHON = re.compile(rf"^([ \t]*)(?:(?:async[ \t]+)?(def)|(class))[ \t]+({_WORD})", re.M)
_PYTHON_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([\w.]+))", re.M)
_CALLS = re.compile(rf"({_WORD})\(")


def byte_at(text: str) -> Callable[[int], int]:
    """From a place in a text to its place in the text's UTF-8 bytes."""
    if text.isascii():
        return int
    ends = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    return ends.__getitem__


def entities_of(path: str, kind: str | None, text: str) -> Iterator[tuple]:
    """The entities of a file: declarations with their spans and owners, imports, and calls; none in an unknown language."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    found = []
    if kind == "python":
        lines = text.split("\n")
        for m in _PYTHON.finditer(text):
            first = text.count("\n", 0, m.start())
            last = first
            for i in range(first + 1, len(lines)):
                if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= len(m[1]):
                    break
                if lines[i].strip():
                    last = i
            found.append((FUNCTION if m[2] else CLASS, m[4], m.start() + len(m[1]), starts[last] + len(lines[last]), first + 1, last + 1))
        imports = [(m[1] or m[2], m) for m in _PYTHON_IMPORT.finditer(text)]
    elif kind in BRACES:
        function, class_, interface, import_ = BRACES[kind]
        for number, pattern in ((FUNCTION, function), (CLASS, class_), (INTERFACE, interface)):
            for m in re.finditer(pattern, text, re.M):
                end, depth = m.end(), 0
                for x in re.finditer("[{}]", text[m.start() :]):
                    depth += 1 if x[0] == "{" else -1
                    if depth == 0:
                        end = m.start() + x.end()
                        break
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                found.append((number, m[1], begin, end, text.count("\n", 0, begin) + 1, text.count("\n", 0, end) + 1))
        imports = [(m[1], m) for m in re.finditer(import_, text, re.M)]
    else:
        return
    types, byte = [f for f in found if f[0] in (CLASS, INTERFACE)], byte_at(text)
    declared = {f[2] for f in found}
    for number, name, start, end, first, last in sorted(found, key=lambda f: f[2]):
        around = [t for t in types if t[2] < start and t[3] >= end]
        yield path, number, name, (min(around, key=lambda t: t[3] - t[2])[1] if around else None), byte(start), byte(end), first, last
    for name, m in imports:
        line = text.count("\n", 0, m.start()) + 1
        yield path, IMPORT, name, None, byte(m.start()), byte(m.end()), line, line
    for m in _CALLS.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()].split()
        if m.start() not in declared and not (before and before[-1] in ("def", "func", "function", "class", "fn")):
            line = text.count("\n", 0, m.start()) + 1
            yield path, CALL, m[1], None, byte(m.start()), byte(m.end()), line, line


def extract(files: DataFrame) -> DataFrame:
    """The entities of files (path, language, text); null text has none, and a file is read whole."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in ENTITY.split(", ")]
        for batch in batches:
            rows = [r for p, k, t in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text"))) for r in entities_of(p, k, t or "")]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("path", "language", "text").mapInArrow(run, ENTITY)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, size, hash, language and text of the source files below a root."""
    tree = source_tree(spark, root)
    return tree.select("path", "size", F.sha2("content", 256).alias("hash"), language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text")).filter("language IS NOT NULL")


def normalized(path):
    """A path without . and .. parts and without its extension."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.array_join(up, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, to_path (null if unresolved) and resolved of each import (path, name).

    Relative specifiers are taken from the importing file's directory; others match the trailing parts of paths, with or
    without their extension.  Only an import with exactly one file of its own language is resolved.
    """
    stem = lambda p: F.regexp_replace(F.regexp_replace(p, r"\.[A-Za-z0-9+]+$", ""), r"/(__init__|index|mod|init)$", "")
    f = files.select(F.col("path").alias("to_path"), F.col("language").alias("to_language"), stem(F.col("path")).alias("stem"))
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    spec = F.regexp_replace("name", r"^\.*/*", "")
    python = F.col("language") == "python"
    parent = F.regexp_replace("path", r"[^/]*$", "")
    climbs = F.when(python, F.greatest(dots - 1, F.lit(0))).otherwise(F.lit(0))
    rest = F.when(python, F.replace(spec, F.lit("."), F.lit("/"))).otherwise(F.col("name"))
    relative = stem(normalized(F.concat(parent, F.repeat(F.lit("../"), climbs), rest)))
    absolute = stem(F.regexp_replace(F.regexp_replace(spec, "::", "/"), r"\.(?=[A-Za-z_])", "/"))
    i = imports.join(files.select("path", "language"), "path").withColumn("_rel", dots > 0).withColumn("_key", F.when(dots > 0, relative).otherwise(absolute))
    i = i.withColumn("_id", F.struct("path", "name"))
    near = i.filter("_rel").join(f, F.col("_key") == F.col("stem"))
    # trailing parts: the last part is joined on, so that a path meets only specifiers that end like it
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    far = i.filter("NOT _rel").withColumn("_last", last(F.col("_key"))).join(f.withColumn("_last", last(F.col("stem"))), "_last")
    far = far.filter((F.col("stem") == F.col("_key")) | F.col("stem").endswith(F.concat(F.lit("/"), F.col("_key"))))
    hits = near.select("_id", "language", "to_language", "to_path").union(far.select("_id", "language", "to_language", "to_path"))
    family = lambda c: F.when(c.isin("javascript", "tsx"), "typescript").otherwise(c)
    one = hits.filter(family(F.col("language")) == family(F.col("to_language"))).groupBy("_id").agg(F.min("to_path").alias("to_path"), F.countDistinct("to_path").alias("_n")).filter("_n = 1")
    return i.join(one, "_id", "left").select("path", "name", "to_path", F.col("to_path").isNotNull().alias("resolved"))


def _put(tables: dict[str, DataFrame], path: str) -> None:
    """Writes an index beside its place and then takes it; a reader sees the old one or the new one."""
    spark = next(iter(tables.values())).sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{fresh}/{name}")
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"the index could not be moved to {path}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("files", "entities", "imports")}


def build_index(spark: SparkSession, root: str, path: str) -> None:
    """Lists, extracts and resolves all source files below root into the index at path."""
    files = listed(spark, root)
    entities = extract(files)
    kept = files.drop("text")
    imports = resolve_imports(entities.filter(F.col("kind") == IMPORT).select("path", "name").distinct(), kept)
    _put({"files": kept, "entities": entities, "imports": imports}, path)


def changes(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path and status (new, deleted, changed, unchanged) of the files below root against the index."""
    return manifest_diff(spark.read.parquet(f"{path}/files"), listed(spark, root).drop("text"))


def stale(spark: SparkSession, root: str, path: str) -> bool:
    """Whether any file's content differs from what is indexed."""
    return bool(changes(spark, root, path).filter("status != 'unchanged'").head(1))


def refresh_index(spark: SparkSession, root: str, path: str) -> dict[str, int]:
    """Extracts new and changed files only, drops deleted ones, resolves imports anew; counts by status. Without changes nothing is written."""
    diff = changes(spark, root, path)
    counts = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if set(counts) <= {"unchanged"}:
        return counts
    old = load(spark, path)
    touched = diff.filter("status IN ('new', 'changed')").select("path")
    files = listed(spark, root)
    same = diff.filter("status = 'unchanged'").select("path")
    entities = old["entities"].join(same, "path", "left_semi").unionByName(extract(files.join(touched, "path", "left_semi")))
    kept = files.drop("text")
    imports = resolve_imports(entities.filter(F.col("kind") == IMPORT).select("path", "name").distinct(), kept)
    _put({"files": kept, "entities": entities, "imports": imports}, path)
    return counts


def symbols_in_files(files: DataFrame, entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted path its declarations in order, or an error of its own if the index has no such file."""
    declared = entities.filter(F.col("kind").isin(FUNCTION, CLASS, INTERFACE)).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_byte", "kind", "name"))).alias("symbols"))
    known = wanted.distinct().join(files.select("path", F.lit(True).alias("_known")), "path", "left").join(declared, "path", "left")
    return known.select("path", F.when(F.col("_known"), F.coalesce("symbols", F.array().cast("array<struct<start_byte:bigint,kind:int,name:string>>"))).alias("symbols"), F.when(F.col("_known").isNull(), "file_not_found").alias("error"))


def pattern_regex(pattern: str) -> str:
    """A pattern with $NAME (one expression) and $$$NAME (any number of them) as a regular expression with named groups; white space is free."""
    out, seen, gap, wordy = "", set(), False, False
    for part in re.split(r"(\$\$\$[A-Z_]*|\$[A-Z_]+|\s+)", pattern):
        if not part or part.isspace():
            gap = gap or bool(part)
            continue
        named = part.startswith("$")
        if out:
            # words apart stay apart, all other white space is free
            out += r"\s+" if gap and wordy and (named or re.match(r"\w", part)) else r"\s*"
        if named:
            name = part.strip("$") or "REST"
            body = r"[^\n]*?" if part.startswith("$$$") else r"[\w.\[\]'\"]+(?:\([^()\n]*\))?"
            out += f"(?P={name})" if name in seen else f"(?P<{name}>{body})"
            seen.add(name)
        else:
            out += r"\s*".join(map(re.escape, re.findall(r"\w+|[^\w\s]", part)))
        gap, wordy = False, named or bool(re.search(r"\w$", part))
    return out


def find_pattern(files: DataFrame, pattern: str, languages: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """path, start_byte, line, text and captures of a pattern's matches in files (path, language, text), by path and place; a page of them."""
    source = pattern_regex(pattern)

    def run(batches):
        import pyarrow as pa

        find = re.compile(source)
        for batch in batches:
            texts = [(p, t or "") for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())]
            rows = [(p, byte(m.start()), t.count("\n", 0, m.start()) + 1, m[0], sorted(m.groupdict().items())) for p, t in texts for byte in (byte_at(t),) for m in find.finditer(t)]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "start_byte", "line", "text", "captures"])

    chosen = files.filter(F.col("language").isin(languages)) if languages else files
    return chosen.select("path", "text").mapInArrow(run, "path string, start_byte long, line int, text string, captures map<string,string>").orderBy("path", "start_byte").offset(offset).limit(limit)
