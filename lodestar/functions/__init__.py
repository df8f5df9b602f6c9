"""Scalar functions: durations, time buckets, fixed decimals, canonical JSON, statuses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of duration units.
UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "w": 604800}


#: Statuses that end a plan or task, and those before it starts.
TERMINAL = ("cancelled", "done", "complete", "completed", "dismissed", "stale", "archived")
BACKLOG = ("backlog", "draft", "proposed", "ready")
#: Seconds of the units that a purge takes.
PURGE_UNITS = {
    "": 1, "s": 1, "sec": 1, "secs": 1, "m": 60, "min": 60, "mins": 60, "h": 3600, "hr": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800,
}


def duration_seconds(text: Column) -> Column:
    """Seconds of a literal such as 30d or 12h; null for anything else and for zero."""
    n = F.regexp_extract(text, r"^([0-9]+)[dhms]$", 1)
    unit = F.create_map(*(F.lit(x) for k in "dhms" for x in (k, UNITS[k])))
    seconds = F.try_to_number(n, F.lit("9" * 18)).cast("long") * F.try_element_at(unit, F.right(text, F.lit(1)))
    return F.when((n != "") & (seconds > 0), seconds)


def loose_duration(text: Column) -> Column:
    """Seconds of a literal with any known unit, or none, which means seconds; null for anything else."""
    pattern = "^([0-9]+)(" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")?$"
    n, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.when(n != "", F.try_to_number(n, F.lit("9" * 18)).cast("long") * F.coalesce(F.try_element_at(known, unit), F.lit(1)))


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def instant(text: Column) -> Column:
    """A timestamp of ISO text, UTC where it names no zone; null if it is none."""
    return F.try_to_timestamp(text)


def is_past(text: Column, today: Column) -> Column:
    """True for a valid ISO date before today."""
    return F.coalesce(text.try_cast("date") < today, F.lit(False))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def trunc_div(a: Column, b: Column) -> Column:
    """Integer division toward zero."""
    return F.when(b != 0, (F.signum(a) * F.signum(b) * F.floor(F.abs(a) / F.abs(b))).cast("long"))


def to_micro(text: Column) -> Column:
    """Whole millionths of a decimal text with at most six places; null for anything else."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]{1,6})?$"), (text.try_cast("decimal(30,6)") * 1_000_000).cast("decimal(38,0)"))


def from_micro(value: Column, places: int = 6) -> Column:
    """Decimal text of millionths with ``places`` places, halves away from zero."""
    return F.round((value.cast("decimal(30,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(36,6)"), places).cast(f"decimal(36,{places})").cast("string")


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no spaces; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def saturated_u32(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(2**32 - 1))


def share_micros(part: Column, total: Column) -> Column:
    """Floor millionths of part / total, 0 where total is 0."""
    return F.when(total == 0, 0).otherwise(F.floor(part.cast("decimal(20,0)") * 1_000_000 / total)).cast("long")


def secret_name(name: Column) -> Column:
    return name.rlike(r"(?i)(pass(word|wd)?|secret|token|api_?key|private_?key|credential)")


def rgb(text: Column) -> Column:
    """Numbers of rgb() or rgba() text as an array of doubles, null if it is neither."""
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+)"))
    return F.when(text.rlike(r"^\s*rgba?\("), F.transform(numbers, lambda x: x.cast("double")))


def css_px(text: Column) -> Column:
    """Pixels of a px or rem length."""
    n = F.regexp_extract(text, r"^\s*(-?[0-9]*\.?[0-9]+)(px|rem)\s*$", 1)
    return F.when(n != "", n.try_cast("double") * F.when(F.trim(text).endswith("rem"), 16.0).otherwise(1.0))


def css_ms(text: Column) -> Column:
    """Milliseconds of an s or ms duration."""
    n = F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)(ms|s)\s*$", 1)
    return F.when(n != "", n.try_cast("double") * F.when(F.trim(text).endswith("ms"), 1.0).otherwise(1000.0))


def chained(previous: Column, digest: Column) -> Column:
    """The next link of a hash chain."""
    return F.sha2(F.concat(previous, digest), 256)


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """True from start to end, both included; null counts as outside."""
    return F.coalesce(ts.between(start, end), F.lit(False))


def window_start(ts: Column, days: int = 0, hours: int = 0) -> Column:
    return ts - F.make_dt_interval(F.lit(days), F.lit(hours))


def utc_day(ts: Column) -> Column:
    """The date in UTC, whatever the session's zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))


def purge_seconds(text: Column) -> Column:
    """Seconds of a count with a unit or none; null for anything else and for what 64 bits can't hold."""
    n, unit = F.regexp_extract(F.trim(text), r"^([0-9]+)\s*([a-z]*)$", 1), F.regexp_extract(F.trim(text), r"^([0-9]+)\s*([a-z]*)$", 2)
    known = F.create_map(*(F.lit(x) for pair in PURGE_UNITS.items() for x in pair))
    seconds = n.try_cast("decimal(38,0)") * F.try_element_at(known, unit)
    return F.when((n != "") & (seconds < F.lit(str(2**63)).cast("decimal(38,0)")), seconds.cast("long"))


def day_bucket(text: Column, by: str = "day") -> Column:
    """The ISO date of a time's text, for weeks that of their Monday; "unknown" for text that is no time."""
    day = F.to_date(F.try_to_timestamp(text))
    return F.coalesce((F.date_trunc("week", day) if by == "week" else day).cast("date").cast("string"), F.lit("unknown"))


def idle_bucket(state: Column, idle: Column, threshold: Column) -> Column:
    """How many thresholds a stale item has been idle, and of three thresholds one that is ready to merge; else 0."""
    at_least_one = F.greatest(threshold, F.lit(1))
    return F.when(state == "stale", F.floor(idle / at_least_one)).when(state == "merge-ready", F.floor(idle / (3 * at_least_one))).otherwise(0).cast("long")


def status_bucket(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), "terminal").when(status.isin(*BACKLOG), "backlog").otherwise("other")


def looks_binary(data: Column) -> Column:
    """True for a zero byte, or over 5 percent of control bytes, among the first 8192."""
    sample = F.decode(F.substring(data, 1, 8192), "ISO-8859-1")
    odd = F.regexp_count(sample, F.lit("[\\x01-\\x07\\x0b\\x0e-\\x1a\\x1c-\\x1f]"))
    return F.coalesce(F.contains(sample, F.lit("\0")) | ((F.length(sample) > 0) & (F.floor(odd * 100 / F.greatest(F.length(sample), F.lit(1))) > 5)), F.lit(False))


def yaml_scalar(text: Column) -> Column:
    """kind and value of a plain scalar by the core rules: null, bool, int (as its decimal text), float or str; quotes make text."""
    t = F.trim(text)
    quoted = t.rlike("^'.*'$") | t.rlike('^".*"$')
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    return (
        F.when(text.isNull() | (t == "") | t.isin("~", "null", "Null", "NULL"), made("null", F.lit(None)))
        .when(quoted, made("str", inner))
        .when(F.lower(t).isin("true", "false"), made("bool", F.lower(t)))
        .when(t.rlike(r"^[-+]?[0-9]+$") & (F.length(t) <= 37), made("int", t.try_cast("decimal(38,0)")))
        .when(t.rlike(r"^[-+]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"), made("float", t.try_cast("double")))
        .otherwise(made("str", t))
    )


def finding_id(*parts: Column) -> Column:
    """The 64-bit FNV-1a hash of the parts, each ended once more, as 16 hexadecimal digits."""
    @F.pandas_udf("string")
    def hashed(packed: pd.Series) -> pd.Series:
        import numpy as np

        data = [x.encode() for x in packed]
        sizes = np.array([len(x) for x in data], int)
        wide = np.zeros((len(data), sizes.max(initial=0)), np.uint64)
        for i, x in enumerate(data):
            wide[i, : len(x)] = np.frombuffer(x, np.uint8)
        value, prime = np.full(len(data), 0xCBF29CE484222325, np.uint64), np.uint64(0x100000001B3)
        with np.errstate(over="ignore"):
            for k in range(wide.shape[1]):
                byte = wide[:, k]
                # a part's end, written as a zero byte, multiplies without a byte of its own
                value = np.where(k < sizes, (value ^ byte) * prime, value)
        return pd.Series([f"{v:016x}" for v in value.tolist()])

    return hashed(F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("\0")))))


def flat_json(text: Column) -> Column:
    """Every scalar inside a JSON value, joined by spaces; nulls are empty, text that is no JSON is null."""
    @F.pandas_udf("string")
    def flat(values: pd.Series) -> pd.Series:
        import json

        def of(v):
            if isinstance(v, dict):
                return " ".join(map(of, v.values()))
            return " ".join(map(of, v)) if isinstance(v, list) else "" if v is None else str(v)

        def one(t):
            try:
                return of(json.loads(t))
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return flat(text)


def section_bullets(text: Column, title: str) -> Column:
    """How many bullets the section of a title has, to the next heading of its level; those in fences don't count."""
    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        import re

        heading, mark = re.compile(r"\s*(#{1,6})[ \t]+(.*?)\s*$"), re.compile(r"\s*(`{3,}|~{3,})(.*)$")

        def one(body):
            level = fence = None
            n = 0
            for line in (body or "").splitlines():
                if m := mark.match(line):
                    if fence is None:
                        fence = m[1]
                    elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                        fence = None
                    continue
                if fence is not None:
                    continue
                if h := heading.match(line):
                    if level is not None and len(h[1]) <= level:
                        break
                    if level is None and h[2].casefold() == title.casefold():
                        level = len(h[1])
                elif level is not None and line.startswith(("- ", "* ")):
                    n += 1
            return n

        return values.map(one)

    return count(text)
