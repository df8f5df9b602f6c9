"""The code index against a small tree."""

import shutil

from pyspark.sql import functions as F

from lodestar import sources
from lodestar.operators import code

TREE = {
    "app/main.py": "import app.util\nfrom .deep import thing\n\n\nclass A(Base):\n    def one(self):\n        return helper(1)\n\n    def two(self): pass\n\n\ndef helper(x):\n    return x\n",
    "app/util.py": "def util():\n    pass\n",
    "app/deep/__init__.py": "thing = 1\n",
    "web/a.ts": "import { b } from './b'\nexport class C { run() {} }\nexport interface I { x: number }\nexport function f(a) {\n  return g(a, b)\n}\n",
    "web/b.ts": "export function g(a, b) { return a == a }\n",
    "srv/m.go": 'package m\n\nimport "fmt"\n\ntype S struct {\n}\n\ntype R interface {\n}\n\nfunc (s *S) Do(x int) {\n\tfmt.Println(x)\n}\n',
    "build/x.py": "def gone(): pass\n", "src/build/y.py": "def kept(): pass\n", "a/node_modules/z.ts": "function no() {}", "notes.txt": "no code",
}


def laid(tmp_path):
    root = tmp_path / "tree"
    for p, text in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    return root


def names(index, kind):
    return {(r.path, r.name, r.owner_type) for r in index["entities"].filter(F.col("kind") == kind).collect()}


def test_build_refresh_and_freshness(spark, tmp_path):
    root, at = laid(tmp_path), str(tmp_path / "index")
    code.build_index(spark, str(root), at)
    index = code.load(spark, at)
    assert {r.path for r in index["files"].collect()} == set(TREE) - {"build/x.py", "a/node_modules/z.ts", "notes.txt"}
    assert names(index, code.FUNCTION) == {("app/main.py", "one", "A"), ("app/main.py", "two", "A"), ("app/main.py", "helper", None), ("app/util.py", "util", None), ("web/a.ts", "f", None), ("web/b.ts", "g", None), ("srv/m.go", "Do", None), ("src/build/y.py", "kept", None)}
    assert names(index, code.CLASS) == {("app/main.py", "A", None), ("web/a.ts", "C", None), ("srv/m.go", "S", None)}
    assert names(index, code.INTERFACE) == {("web/a.ts", "I", None), ("srv/m.go", "R", None)}
    spans = {r.name: (r.start_line, r.end_line) for r in index["entities"].filter("kind IN (0, 1)").collect()}
    assert spans["A"] == (5, 9) and spans["one"] == (6, 7) and spans["helper"] == (12, 13) and spans["f"] == (4, 6) and spans["Do"] == (11, 13)
    assert {(r.path, r.name): r.to_path for r in index["imports"].collect()} == {("app/main.py", "app.util"): "app/util.py", ("app/main.py", ".deep"): "app/deep/__init__.py", ("web/a.ts", "./b"): "web/b.ts", ("srv/m.go", "fmt"): None}
    assert not code.stale(spark, str(root), at) and set(code.refresh_index(spark, str(root), at)) == {"unchanged"}
    (root / "app/util.py").write_text("def other():\n    pass\n")
    (root / "app/new.py").write_text("from . import util\n")
    shutil.rmtree(root / "web")
    assert code.stale(spark, str(root), at)
    assert code.refresh_index(spark, str(root), at) == {"unchanged": 4, "changed": 1, "new": 1, "deleted": 2}
    fresh = tmp_path / "fresh"
    code.build_index(spark, str(root), str(fresh))
    for name, df in code.load(spark, at).items():
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, code.load(spark, str(fresh))[name].select(df.columns).collect()), key=repr)


def test_symbols_of_several_files(spark, tmp_path):
    root, at = laid(tmp_path), str(tmp_path / "index")
    code.build_index(spark, str(root), at)
    index = code.load(spark, at)
    wanted = spark.createDataFrame([("app/main.py",), ("app/deep/__init__.py",), ("none.py",)], "path string")
    got = {r.path: ([s.name for s in r.symbols] if r.symbols is not None else None, r.error) for r in code.symbols_in_files(index["files"], index["entities"], wanted).collect()}
    assert got == {"app/main.py": (["A", "one", "two", "helper"], None), "app/deep/__init__.py": ([], None), "none.py": (None, "file_not_found")}


def test_patterns(spark, tmp_path):
    files = code.listed(spark, str(laid(tmp_path)))
    got = [(r.path, r.line, r.text, r.captures) for r in code.find_pattern(files, "return $F($$$ARGS)").collect()]
    assert got == [("app/main.py", 7, "return helper(1)", {"F": "helper", "ARGS": "1"}), ("web/a.ts", 5, "return g(a, b)", {"F": "g", "ARGS": "a, b"})]
    assert [r.text for r in code.find_pattern(files, "$A == $A").collect()] == ["a == a"]
    assert [r.path for r in code.find_pattern(files, "return $F($$$ARGS)", limit=1, offset=1).collect()] == ["web/a.ts"]
    assert code.find_pattern(files, "return $F($$$ARGS)", ["go"]).count() == 0


def test_pruned_directories(spark):
    paths = {"a.py": 0, "src/build/a.py": 0, "build/a.py": 1, "x/node_modules/a.js": 1, ".git/c": 1, "x/.git/c": 1, "target/a.rs": 1, "build": 0, "a/.venv/b.py": 0, ".venv/b.py": 1}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", sources.directory_pruned(F.col("path")).alias("p")).collect()
    assert {r.path: int(r.p) for r in got} == paths


def test_languages(spark):
    want = {"a.mts": "typescript", "a.TSX": "tsx", "a.h++": "cpp", "a.c++": "cpp", "a.bats": "bash", "a.sbt": "scala", "a.dart": "dart", "a.py": "python", "a.pyi": None, "a.svelte": None, "Makefile": None}
    got = spark.createDataFrame([(p,) for p in want], "path string").select("path", sources.language(F.col("path")).alias("l")).collect()
    assert {r.path: r.l for r in got} == want
