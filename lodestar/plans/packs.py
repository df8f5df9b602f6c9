"""Rule packs in TOML, tests written in them, named query modes, batches of calls, and profiles chosen by path."""

from __future__ import annotations

import re
import tomllib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .rules import Rule, run

SEVERITIES = ("error", "warning", "info")
_ID = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*")
_MODE = re.compile(r"[A-Za-z_]\w*")


def read_pack(text: str, source: str = "pack") -> tuple[list[Rule], dict[str, list[dict]], list[str]]:
    """The SQL rules of a pack, the tests of each by its id, and what is wrong with the others.

    A bad rule never stops the good ones: text that is no TOML, a missing or doubled id, an unknown severity or a statement
    that doesn't select is a diagnostic.
    """
    try:
        entries = tomllib.loads(text).get("rule", [])
    except tomllib.TOMLDecodeError as e:
        return [], {}, [f"{source}: {e}"]
    rules, tests, wrong = {}, {}, []
    for n, entry in enumerate(entries if isinstance(entries, list) else [entries]):
        at = f"{source}: rule {n}"
        name, sql, severity = (entry.get(k) for k in ("id", "sql", "severity"))
        if not isinstance(name, str) or not _ID.fullmatch(name):
            wrong.append(f"{at}: an id is lower-case words joined by hyphens")
        elif name in rules:
            wrong.append(f"{at}: {name} is there twice")
        elif severity is not None and severity not in SEVERITIES:
            wrong.append(f"{at}: {name} has the unknown severity {severity}")
        elif not isinstance(sql, str) or not re.match(r"\s*(select|with)\b", sql, re.I):
            wrong.append(f"{at}: {name} doesn't select")
        else:
            rules[name] = Rule(name, sql, str(entry.get("message", "")), severity or "warning", dict(entry.get("parameters", {})))
            tests[name] = list(entry.get("test", []))
    return list(rules.values()), tests, wrong


def merged(*packs: list[Rule]) -> tuple[list[Rule], list[str]]:
    """Rules of several packs, and the ids that more than one has: the first one's stay."""
    seen: dict[str, Rule] = {}
    doubled = []
    for rule in (r for pack in packs for r in pack):
        if rule.id in seen:
            doubled.append(rule.id)
        seen.setdefault(rule.id, rule)
    return list(seen.values()), doubled


def run_tests(spark: SparkSession, rule: Rule, tests: list[dict], schemas: dict[str, str]) -> list[str | None]:
    """For each test None if the rule gives exactly its rows, repeats counted, else what differs.

    A test has tables (name: rows, lists in the order of the name's schema), rows (each a table of columns, of which only those named are
    compared) and perhaps parameters.  Tables without rows in the test are empty.
    """
    out = []
    for test in tests:
        for name, schema in schemas.items():
            spark.createDataFrame([tuple(r) for r in test.get("tables", {}).get(name, [])], schema).createOrReplaceTempView(name)
        wanted = test.get("rows", [])
        columns = sorted({c for r in wanted for c in r})
        try:
            found = run(spark, rule, **test.get("parameters", {}))
            got = Counter(tuple(str(r[c]) for c in columns) for r in (found.select(*columns) if columns else found).collect())
            want = Counter(tuple(str(r.get(c)) for c in columns) for r in wanted)
            out.append(None if got == want else f"not found: {sorted((want - got).elements())}, not wanted: {sorted((got - want).elements())}")
        except Exception as e:  # noqa: BLE001 - an error is the test's result
            out.append(str(e).split("\n")[0])
    return out


class Modes:
    """Query modes by name: each takes the parameters of a call and returns a DataFrame."""

    def __init__(self):
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, build: Callable[..., DataFrame]) -> None:
        if not _MODE.fullmatch(name) or name == "batch":
            raise ValueError(f"{name!r} can't name a mode")
        if name in self._known:
            raise ValueError(f"{name} is registered twice")
        self._known[name] = build

    def names(self) -> list[str]:
        return sorted(self._known)

    def call(self, mode: str, **parameters) -> DataFrame:
        if mode not in self._known:
            raise KeyError(f"unknown mode {mode!r}; there are {', '.join(self.names())}")
        return self._known[mode](**parameters)

    def batch(self, calls: list[dict]) -> list[DataFrame | dict]:
        """Each call's rows, or its error as {"error": text}: one failing call leaves the others alone, and a batch holds no batch."""
        out: list[DataFrame | dict] = []
        for call in calls:
            given = dict(call)
            mode = given.pop("mode", None)
            try:
                if mode == "batch":
                    raise ValueError("a batch can't hold a batch")
                out.append(self.call(str(mode), **given))
            except Exception as e:  # noqa: BLE001 - any error of a call is its result
                out.append({"error": str(e).strip("'\"").split("\n")[0]})
        return out


def profile_for(path: str, *scopes: list[dict]) -> dict | None:
    """The profile (a table with name and glob) that a path gets: later scopes go before earlier ones, and in one the first by name that fits.

    In these globs * stands for any characters, slashes too, and ? for one.
    """
    for scope in reversed(scopes):
        for p in sorted(scope, key=lambda p: p["name"]):
            if re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p["glob"]), path, re.S):
                return p
    return None
