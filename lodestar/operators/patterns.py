"""Line pattern rules for source text, and audits of Markdown text, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of rules, each a language (* for any) and a pattern that a line of code matches.
FAMILIES = {
    "debug_statement": (("rust", r"\bdbg!\s*\("), ("javascript", r"\bdebugger\b"), ("javascript", r"\bconsole\.log\s*\("), ("python", r"\bbreakpoint\s*\(\)"), ("python", r"\bpdb\.set_trace\s*\("), ("php", r"\bvar_dump\s*\("), ("php", r"\bdd\s*\("), ("elixir", r"\bIO\.inspect\s*\("), ("ruby", r"\bbinding\.pry\b")),
    "error_swallow_go": (("go", r"\b_\s*=\s*err\b"), ("go", r"\b_\s*,\s*_\s*:?="), ("go", r"if\s+err\s*!=\s*nil\s*\{\s*\}")),
    "error_swallow_rust": (("rust", r"\blet\s+_\s*=\s*[^;]*\("), ("rust", r"\.ok\(\)\s*;"), ("rust", r"Err\(_\)\s*=>\s*(\{\s*\}|\(\))")),
    "error_swallow_lua_bash": (("lua", r"\bpcall\s*\("), ("bash", r"\|\|\s*true\b")),
    "error_swallow_elixir_haskell": (("elixir", r"\brescue\s+_\s*->\s*(nil|:ok)"), ("haskell", r"\bcatch\w*\b.*\\_\s*->\s*(return|pure)\s*\(\)")),
    "error_swallow_c_scala_solidity": (("c", r"\(void\)\s*\w+\s*\("), ("scala", r"case\s+_\s*:\s*\w*Exception\s*=>\s*(\(\))?\s*$"), ("solidity", r"\bcatch\s*\{\s*\}")),
    "empty_catch": (("javascript", r"\bcatch\s*(\([^)]*\))?\s*\{\s*\}"), ("typescript", r"\bcatch\s*(\([^)]*\))?\s*\{\s*\}"), ("java", r"\bcatch\s*\([^)]*\)\s*\{\s*\}"), ("python", r"\bexcept\b[^:]*:\s*pass\b")),
    "eval_usage": (("python", r"(?<![\w.])(eval|exec)\s*\("), ("javascript", r"(?<![\w.])eval\s*\("), ("javascript", r"\bnew\s+Function\s*\("), ("php", r"(?<![\w>$])eval\s*\("), ("ruby", r"\b(instance|class)_eval\b"), ("bash", r"(^|[;&|]\s*)eval\s")),
}


def line_findings(df: DataFrame, key: str, text: str, language: str, families: list[str] | None = None, extra: dict | None = None) -> DataFrame:
    """key, line (from 1), rule and excerpt of every line that a rule of its language matches, one row for each rule."""
    rules = {**FAMILIES, **(extra or {})}
    table = [(name, lang, pattern) for name in (families or rules) for lang, pattern in rules[name]]
    lines = df.select(key, F.col(language).alias("_lang"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_i", "_line"))
    hits = F.array_compact(F.array(*(F.when((F.lit(lang == "*") | (F.col("_lang") == lang)) & F.col("_line").rlike(p), F.lit(f"{n}:{i}")) for i, (n, lang, p) in enumerate(table))))
    return lines.select(key, (F.col("_i") + 1).alias("line"), F.explode(hits).alias("rule"), F.trim(F.substring("_line", 1, 120)).alias("excerpt"))


def text_audit(text: Column, longest: int = 30) -> Column:
    """Words, sentences, words of the longest sentence, bullets and headings of a Markdown text, and whether it reads as a list."""
    prose = F.regexp_replace(text, r"(?s)```.*?```", " ")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    sentences = F.filter(F.split(prose, r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.trim(s) != "")
    lines = F.filter(F.split(prose, "\n"), lambda s: F.trim(s) != "")
    bullets = F.size(F.filter(lines, lambda s: s.rlike(r"^\s*([-*+]|\d+[.)])\s")))
    longest_ = F.coalesce(F.array_max(F.transform(sentences, words)), F.lit(0))
    return F.struct(
        words(prose).alias("words"), F.size(sentences).alias("sentences"), longest_.alias("longest"), (longest_ > longest).alias("too_long"),
        bullets.alias("bullets"), F.size(F.filter(lines, lambda s: s.rlike(r"^#{1,6}\s"))).alias("headings"), (bullets * 2 > F.size(lines)).alias("list_like"),
    )


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and target of the Markdown links in texts, without those to other sites."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\]\(([^)\s]+)\)"))
    return df.select(key, F.explode(found).alias("target")).filter(~F.col("target").rlike("^[a-z]+:"))


def dependency_facts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """from_unit, to_unit and certainty of imports (from_unit, specifier): certified if exactly one file's path ends with
    the specifier as a path, missing if none does; ambiguous imports give no fact.

    The join is on the last part of both, then on the rest, so it is an equality join.
    """
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    i = imports.withColumn("_p", F.translate(F.col("specifier"), ".", "/")).withColumn("_t", tail(F.col("_p")))
    f = files.select(F.col("path").alias("to_unit"), F.regexp_replace("path", r"\.[^./]+$", "").alias("_q")).withColumn("_t", tail(F.col("_q")))
    hit = i.join(f, "_t", "left").withColumn("_ok", (F.col("_q") == F.col("_p")) | F.col("_q").endswith(F.concat(F.lit("/"), F.col("_p"))))
    g = hit.groupBy("from_unit", "specifier").agg(F.count_if("_ok").alias("n"), F.min(F.when(F.col("_ok"), F.col("to_unit"))).alias("to_unit"))
    return g.filter("n < 2").select("from_unit", "specifier", "to_unit", F.when(F.col("n") == 1, "certified").otherwise("missing").alias("certainty"))


def constrained(rules: dict[str, str | list[str]]) -> Column:
    """True where every capture, a column, matches its expression, or all of several; a missing capture counts as empty."""
    out = F.lit(True)
    for name, patterns in rules.items():
        for p in [patterns] if isinstance(patterns, str) else patterns:
            out = out & F.rlike(F.coalesce(F.col(name), F.lit("")), F.lit(p))
    return out
