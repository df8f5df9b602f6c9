"""Dependency facts by language: which file certainly depends on which.

Every language makes the paths or names that an import can mean, as a short array; these are joined by equality, and only an
import with exactly one target becomes a fact.  Imports have path, language and specifier, and may have guarded (inside a
condition: never a fact).  Facts have from_unit, to_unit, specifier and certainty: certified, or missing for a literal path
that no file has (then to_unit is null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code import normalized

JVM = ("java", "kotlin", "scala")
#: What a name may end with as a file, by language.
ENDINGS = {
    "python": (".py", "/__init__.py"),
    "ruby": (".rb", ""),
    "php": ("",),
    "c": ("",),
    "cpp": ("",),
    "lua": (".lua", "/init.lua"),
    "bash": ("", ".sh"),
    "go": ("",),
}


def directory(path: Column) -> Column:
    """The directory of a path with a slash behind it, empty at the root."""
    return F.regexp_replace(path, r"[^/]*$", "")


def climbs_out(path: Column) -> Column:
    """True where the .. parts of a path lead above the root."""
    step = lambda at, x: F.when(at < 0, at).otherwise(at + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1))
    return F.aggregate(F.split(path, "/"), F.lit(0), step) < 0


def _endings(base: Column, language: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, ends in ENDINGS.items():
        out = F.when(language == name, F.array(*(F.concat(base, F.lit(e)) for e in ends))).otherwise(out)
    return out


def literal_base(path: Column, language: Column, specifier: Column) -> Column:
    """The path that a relative specifier stands for, null where it isn't one or leads out of the tree.

    Python counts leading dots; C, C++, Ruby, PHP and Bash go from the file's directory; Lua's dots are slashes from the root.
    """
    dots = F.length(F.regexp_extract(specifier, r"^(\.+)", 1))
    slashed = specifier.rlike(r"^\.\.?/")
    module = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/")))
    literal = specifier.rlike(r"^[\w./+@-]+$")
    relative = (
        F.when((language == "python") & slashed, specifier)
        .when((language == "python") & (dots > 0), module)
        .when(language.isin("c", "cpp", "ruby", "php") & literal & ~specifier.startswith("/"), specifier)
        .when((language == "bash") & slashed & literal, specifier)
        .when((language == "lua") & slashed & literal, specifier)
    )
    whole = F.concat(directory(path), relative)
    lua = F.when((language == "lua") & specifier.rlike(r"^\w+(\.\w+)*$"), F.replace(specifier, F.lit("."), F.lit("/")))
    return F.coalesce(F.when(~climbs_out(whole), normalized(whole)), lua)


def _usable(imports: DataFrame) -> DataFrame:
    open_ = imports.filter(~F.coalesce(F.col("guarded"), F.lit(False))) if "guarded" in imports.columns else imports
    return open_.select("path", "language", "specifier").distinct()


def _only(hits: DataFrame) -> DataFrame:
    """Facts of the imports that meet exactly one other file."""
    one = hits.groupBy("path", "specifier").agg(F.countDistinct("to_unit").alias("n"), F.min("to_unit").alias("to_unit")).filter("n = 1 AND to_unit != path")
    return one.select(F.col("path").alias("from_unit"), "to_unit", "specifier", F.lit("certified").alias("certainty"))


def path_facts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of imports that name a file by a path: relative modules, quoted includes, required and sourced files.

    A Python file imports relatively only within a package.  An include with a directory in it that nothing matches is
    missing, unless some file has its last name; so is a path required or sourced by Ruby, PHP, Lua or Bash that starts with a dot.
    """
    i = _usable(imports).withColumn("base", literal_base(F.col("path"), F.col("language"), F.col("specifier"))).filter("base IS NOT NULL AND base != ''")
    packages = files.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select(directory(F.col("path")).alias("dir")).distinct()
    inside = i.withColumn("dir", directory(F.col("path"))).join(packages.withColumn("packaged", F.lit(True)), "dir", "left")
    i = inside.filter((F.col("language") != "python") | F.col("packaged")).drop("dir", "packaged")
    tried = i.withColumn("to_unit", F.explode(F.array_distinct(_endings(F.col("base"), F.col("language")))))
    paths = files.select(F.col("path").alias("to_unit")).distinct()
    found = tried.join(paths, "to_unit")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    lost = i.join(found.select("path", "specifier").distinct(), ["path", "specifier"], "left_anti")
    lost = lost.filter((F.col("language").isin("c", "cpp") & F.col("specifier").contains("/")) | (F.col("language").isin("ruby", "php", "lua", "bash") & F.col("specifier").startswith(".")))
    lost = lost.withColumn("name", F.element_at(F.split("specifier", "/"), -1)).join(names, "name", "left_anti")
    missing = lost.select(F.col("path").alias("from_unit"), F.lit(None).cast("string").alias("to_unit"), "specifier", F.lit("missing").alias("certainty"))
    return _only(found).unionByName(missing)


def package_facts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of absolute Python imports below packages whose name only one source root (the root, src, or any .../src) holds."""
    package = r"^(.*/)?([^/]+)/__init__\.py$"
    roots = files.filter(F.col("path").rlike(package)).select(F.regexp_extract("path", package, 1).alias("root"), F.regexp_extract("path", package, 2).alias("first"))
    roots = roots.filter(F.col("root").rlike(r"^$|(^|/)src/$")).groupBy("first").agg(F.countDistinct("root").alias("n"), F.min("root").alias("root")).filter("n = 1")
    i = _usable(imports).filter((F.col("language") == "python") & F.col("specifier").rlike(r"^[A-Za-z_]\w*([./][A-Za-z_]\w*)*$"))
    i = i.withColumn("slashed", F.replace("specifier", F.lit("."), F.lit("/"))).withColumn("first", F.substring_index("slashed", "/", 1)).join(roots, "first")
    tried = i.withColumn("to_unit", F.explode(_endings(F.concat("root", "slashed"), F.col("language"))))
    return _only(tried.join(files.select(F.col("path").alias("to_unit")).distinct(), "to_unit"))


def declared(files: DataFrame) -> DataFrame:
    """language family, name and path of what files (path, language, text) declare: types of the JVM by their full names, modules
    of Elixir and Haskell, packages of Go by their directories."""
    text, family = F.coalesce("text", F.lit("")), F.when(F.col("language").isin(*JVM), "jvm").otherwise(F.col("language"))
    package = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)", 1)
    types = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[a-z]+\s+)*(?:class|interface|enum|record|object|trait)\s+([A-Za-z_]\w*)"))
    full = F.transform(types, lambda n: F.when(package == "", n).otherwise(F.concat(package, F.lit("."), n)))
    modules = F.when(F.col("language") == "elixir", F.regexp_extract_all(text, F.lit(r"(?m)^\s*defmodule\s+([A-Z][\w.]*)")))
    modules = modules.when(F.col("language") == "haskell", F.regexp_extract_all(text, F.lit(r"(?m)^module\s+([A-Z][\w.]*)")))
    names = F.when(F.col("language").isin(*JVM), full).otherwise(modules)
    return files.select(family.alias("family"), "path", F.explode(names).alias("name")).distinct()


def name_facts(imports: DataFrame, declarations: DataFrame) -> DataFrame:
    """Facts of imports that name a declaration: types of the JVM (a static import names its type; wildcards give none),
    and modules of Elixir and Haskell.  A name that several files declare gives none."""
    jvm = F.col("language").isin(*JVM)
    i = _usable(imports).filter(jvm | F.col("language").isin("elixir", "haskell")).withColumn("family", F.when(jvm, "jvm").otherwise(F.col("language")))
    static = F.col("specifier").startswith("static ")
    plain = F.regexp_replace("specifier", r"^static\s+", "")
    i = i.filter(~plain.rlike(r"[*{}]")).withColumn("name", F.when(static, F.regexp_replace(plain, r"\.[^.]+$", "")).otherwise(plain))
    return _only(i.join(declarations.withColumnRenamed("path", "to_unit"), ["family", "name"]))


def unit_of(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """path and unit: the nearest directory above it that holds a mark, such as a crate's manifest; the root's is empty."""
    parts = F.split(directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = marks.select(F.rtrim(directory(F.col("path")), F.lit("/")).alias("unit")).distinct()
    near = paths.select("path").distinct().withColumn("unit", F.explode(above)).join(held, "unit")
    best = near.groupBy("path").agg(F.max_by("unit", F.length("unit")).alias("unit"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("unit", F.lit("")).alias("unit"))


def crate_facts(resolved: DataFrame, files: DataFrame, manifest: str = "Cargo.toml") -> DataFrame:
    """Facts of resolved Rust imports (path, specifier, to_path) between different crates; mod declarations and guarded ones give none."""
    open_ = resolved.filter("to_path IS NOT NULL")
    open_ = open_.filter(~F.coalesce(F.col("guarded"), F.lit(False))) if "guarded" in resolved.columns else open_
    i = open_.filter(~F.col("specifier").rlike(r"^mod\s")).select("path", "specifier", "to_path").distinct()
    units = unit_of(files.filter(F.col("path").endswith(".rs")), files.filter(F.col("path").rlike(rf"(^|/){manifest}$")))
    both = i.join(units, "path").join(units.select(F.col("path").alias("to_path"), F.col("unit").alias("to_crate")), "to_path")
    return both.filter("unit != to_crate").select(F.col("path").alias("from_unit"), F.col("to_path").alias("to_unit"), "specifier", F.lit("certified").alias("certainty")).distinct()


def go_facts(imports: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """Facts of Go imports below a module's path; the units are directories of packages."""
    units = files.filter(F.col("path").endswith(".go")).select(F.rtrim(directory(F.col("path")), F.lit("/")).alias("to_unit")).distinct()
    i = _usable(imports).filter((F.col("language") == "go") & F.startswith("specifier", F.lit(module)))
    i = i.withColumn("to_unit", F.ltrim(F.substring("specifier", len(module) + 1, 1 << 30), F.lit("/"))).withColumn("path", F.rtrim(directory(F.col("path")), F.lit("/"))).distinct()
    return _only(i.join(units, "to_unit"))
