"""Readers: tables, event logs, source trees, front matter and change manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Extensions and the languages they stand for.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h++": "cpp",
    "go": "go", "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
    "py": "python", "rb": "ruby", "php": "php", "lua": "lua",
    "scala": "scala", "sc": "scala", "sbt": "scala", "dart": "dart",
    "ex": "elixir", "exs": "elixir", "sol": "solidity", "hs": "haskell",
    "sh": "bash", "bash": "bash", "zsh": "bash", "ksh": "bash", "bats": "bash",
    "rs": "rust",
}
#: Directories that a listing doesn't enter at any depth.
PRUNED = (".git", "__pycache__", "node_modules")
#: Directories that a listing doesn't enter at the root.
PRUNED_AT_ROOT = (
    ".cache", ".mypy_cache", ".next", ".nox", ".nuxt", ".pytest_cache", ".ruff_cache", ".scratch", ".tox", ".uv-cache", ".venv",
    "bower_components", "build", "dist", "target", "venv",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Valid rows of a line-delimited JSON log, and the malformed lines as diagnostics; a torn last line is one of these."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("row", F.from_json("value", StructType(fields.fields).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.filter(~bad).select(*(F.col(f"row.{f.name}").alias(f.name) for f in fields)), parsed.filter(bad & (F.trim("value") != "")).select("file", "value")


def _unread(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """uri, path below the root, size and time of the files that Spark's readers pass over: those with a dot or underscore in front of a name."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = len(fs.makeQualified(root).toUri().getPath().rstrip("/")) + 1
    out, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        below = f.getPath().toUri().getPath()[top:]
        if any(x[:1] in "._" for x in below.split("/")):
            out.append((f.getPath().toString(), below, f.getLen(), f.getModificationTime()))
    return out


def source_tree(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path (below the directory), size, mtime and content of its files, those in pruned directories left out.

    The listing is the driver's, as any listing of Spark is; contents are read by the executors, those with a hidden name from their
    address.
    """
    from fnmatch import fnmatch

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    plain = lambda x: F.regexp_replace(x, "^[a-z]+:/+", "/")
    root = F.concat(F.rtrim(plain(F.lit(path)), F.lit("/")), F.lit("/"))
    below = F.regexp_replace(plain(F.col("path")), F.concat(F.lit("^\\Q"), root, F.lit("\\E")), F.lit(""))
    seen = files.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["uri"])
                with store.open_input_stream(at) as f:
                    yield pa.RecordBatch.from_pydict({"path": [row["path"]], "size": [row["size"]], "time": [row["time"]], "content": [f.read()]})

    rest = [x for x in _unread(spark, path) if not glob or fnmatch(x[1].rsplit("/", 1)[-1], glob)]
    hidden = spark.createDataFrame(rest, "uri string, path string, size long, time long").filter(~directory_pruned(F.col("path")))
    hidden = hidden.mapInArrow(read, "path string, size long, time long, content binary").select("path", "size", F.timestamp_millis("time").alias("mtime"), "content")
    return seen.filter(~directory_pruned(F.col("path"))).unionByName(hidden)


def directory_pruned(path: Column) -> Column:
    """True for relative paths through directories that aren't entered, at any depth or at the root."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(directories, F.lit(list(PRUNED))) | F.coalesce(F.get(directories, 0).isin(*PRUNED_AT_ROOT), F.lit(False))


def language(path: Column) -> Column:
    """The language of a path by its extension, null if none is known."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1)))


def minified(text: Column) -> Column:
    """True for generated text (marked in its first five lines) and for text of mostly very long lines."""
    lines = F.split(text, "\n")
    marked = F.exists(F.slice(lines, 1, 5), lambda x: x.contains("Code generated") & x.contains("DO NOT EDIT"))
    lengths = F.transform(lines, F.length)
    return marked | ((F.array_max(lengths) >= 2000) & (F.size(F.filter(lengths, lambda n: n >= 500)) * 2 >= F.size(lines)))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The front matter between lines of three dashes at the start of a text, null without one, and the body."""
    block = r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)"
    return F.when(text.rlike(block), F.regexp_extract(text, block, 1)), F.regexp_replace(text, block, "")


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """key and status of each entry of two manifests: new, deleted, changed or unchanged."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_a")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))
