"""Dependency facts by language, CSS and HTML rules, on small trees and sheets."""

from pyspark.sql import functions as F

from lodestar.operators import dependencies as D
from lodestar.operators import markup as M


def _facts(df):
    return sorted(((r.from_unit, r.to_unit, r.certainty) for r in df.collect()), key=str)


def _imports(spark, *rows):
    return spark.createDataFrame([(*r, False)[:4] if len(r) == 3 else r for r in rows], "path string, language string, specifier string, guarded boolean")


def _files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_paths(spark):
    files = _files(spark, "p/__init__.py", "p/a.py", "p/b.py", "p/q/__init__.py", "p/q/c.py", "free.py", "inc/x.h", "src/m.c", "l/a.rb", "l/b.rb", "m/n.lua", "m/o/init.lua", "s/lib.sh", "s/run")
    i = _imports(
        spark,
        ("p/a.py", "python", ".b"), ("p/q/c.py", "python", "..a"), ("p/a.py", "python", ".q"), ("free.py", "python", ".b"), ("p/a.py", "python", "....x"), ("p/b.py", "python", ".a", True),
        ("src/m.c", "c", "../inc/x.h"), ("src/m.c", "c", "gone/y.h"), ("src/m.c", "c", "else/x.h"), ("src/m.c", "c", "stdio.h"),
        ("l/a.rb", "ruby", "./b"), ("l/a.rb", "ruby", "./gone"), ("m/n.lua", "lua", "m.o"), ("s/run", "bash", "./lib.sh"), ("s/run", "bash", "$HOME/x"),
    )
    assert _facts(D.path_facts(i, files)) == sorted([
        ("p/a.py", "p/b.py", "certified"), ("p/q/c.py", "p/a.py", "certified"), ("p/a.py", "p/q/__init__.py", "certified"), ("src/m.c", "inc/x.h", "certified"), ("src/m.c", None, "missing"),
        ("l/a.rb", "l/b.rb", "certified"), ("l/a.rb", None, "missing"), ("m/n.lua", "m/o/init.lua", "certified"), ("s/run", "s/lib.sh", "certified"),
    ], key=str)


def test_packages(spark):
    files = _files(spark, "src/p/__init__.py", "src/p/a.py", "x/src/two/__init__.py", "y/src/two/__init__.py", "deep/in/q/__init__.py", "deep/in/q/z.py", "main.py")
    i = _imports(spark, ("main.py", "python", "p.a"), ("main.py", "python", "two"), ("main.py", "python", "q.z"), ("main.py", "python", "p"), ("main.py", "python", "os.path"))
    assert _facts(D.package_facts(i, files)) == [("main.py", "src/p/__init__.py", "certified"), ("main.py", "src/p/a.py", "certified")]


def test_names(spark):
    files = spark.createDataFrame(
        [("a/A.java", "java", "package x.y;\npublic class A {}\n"), ("b/B.kt", "kotlin", "package x.y\nclass B\nobject C"), ("c/B.scala", "scala", "package x.y\nclass C"),
         ("e.ex", "elixir", "defmodule My.E do\nend"), ("h.hs", "haskell", "module My.E where"), ("n.java", "java", None)], "path string, language string, text string")
    i = _imports(spark, ("n.java", "java", "x.y.A"), ("n.java", "java", "static x.y.B.f"), ("n.java", "java", "x.y.C"), ("n.java", "java", "x.y.*"), ("a/A.java", "java", "x.y.A"), ("f.ex", "elixir", "My.E"), ("g.hs", "haskell", "My.E"))
    assert _facts(D.name_facts(i, D.declared(files))) == [("f.ex", "e.ex", "certified"), ("g.hs", "h.hs", "certified"), ("n.java", "a/A.java", "certified"), ("n.java", "b/B.kt", "certified")]


def test_crates_and_go(spark):
    files = _files(spark, "Cargo.toml", "src/main.rs", "k/Cargo.toml", "k/src/lib.rs", "k/src/deep/m.rs", "cmd/a.go", "lib/b.go", "lib/c.go")
    r = spark.createDataFrame([("src/main.rs", "k::f", "k/src/lib.rs"), ("k/src/lib.rs", "deep::m", "k/src/deep/m.rs"), ("k/src/deep/m.rs", "mod up", "src/main.rs"), ("src/main.rs", "z", None)], "path string, specifier string, to_path string")
    assert _facts(D.crate_facts(r, files)) == [("src/main.rs", "k/src/lib.rs", "certified")]
    i = _imports(spark, ("cmd/a.go", "go", "ex.org/m/lib"), ("cmd/a.go", "go", "fmt"), ("lib/b.go", "go", "ex.org/m/lib"), ("lib/c.go", "go", "ex.org/m/none"))
    assert _facts(D.go_facts(i, files, "ex.org/m")) == [("cmd", "lib", "certified")]


def test_css(spark):
    css = """/* p{font-size:1px} */ .h{background:linear-gradient(red,blue);-webkit-background-clip:text}
      .card{border-left:4px solid rgb(1, 2, 3)} .soft{border-right: 2px solid #0af; border-radius:8px} .thin{border-left:3px solid red} .gray{border-left:9px solid #777}
      @media x { p { font-size:11px } button{font-size:11px} .b{font-size:0.5rem} } li{font-size:9px;font-size:14px}"""
    df = spark.createDataFrame([(1, css), (2, None), (3, "")], "id int, css string")
    got = sorted((r.id, r.selector, r.finding) for r in M.css_findings(M.css_rules(df, "id", "css"), "id").collect())
    assert got == sorted([(1, ".h", "gradient_text"), (1, ".card", "side_border"), (1, ".soft", "side_border"), (1, "p", "tiny_text"), (1, ".b", "tiny_text")])
    sheet = spark.createDataFrame([(1, "a{color:#ABC;background:var(--x, #123456);border-top-color:RGB(1, 2, 3);border-radius:#fff;--own:#999999} b{fill:#f00}")], "id int, css string")
    rules = M.css_rules(sheet, "id", "css")
    tokens = spark.createDataFrame([("#aabbcc",), (" 4px ",)], "value string")
    assert sorted(r.colour for r in M.colour_findings(rules, "id", tokens).collect()) == ["#ff0000", "rgb(1,2,3)"]
    assert M.colour_findings(rules, "id", tokens.filter("value = ' 4px '")).count() == 0


def test_html(spark):
    bad = '<HTML><head><title> </title></head><body><img src="placeholder.png"><img alt="" src=""  srcset="a 1x"><img alt=x src=#><p>Lorem ipsum by John Doe</p><!-- TODO --><a href="http://example.com/">x</a></body>'
    good = '<html lang="en"><head><title>t</title><meta name="viewport" content="x"></head><img alt="a" src="b.png">'
    df = spark.createDataFrame([(1, bad), (2, good), (3, "<p>bare"), (4, None)], "id int, html string")
    got = {(r.id, r.finding): r.n for r in M.html_findings(df, "id", "html").collect()}
    assert got == {(1, "no_lang"): 1, (1, "no_title"): 1, (1, "no_viewport"): 1, (1, "image_without_alt"): 1, (1, "image_without_source"): 2, (1, "copy: lorem ipsum"): 1, (1, "copy: placeholder name"): 1, (1, "copy: example.com"): 1}


def test_kickers(spark):
    style = F.create_map(*map(F.lit, ("font-size", "12px", "letter-spacing", "0.1em", "font-family", "JetBrains Mono")))
    none = F.create_map(F.lit("x"), F.lit("y"))
    r = spark.range(1).select(M.kicker_signals(F.lit("NEW Here"), style).alias("a"), M.kicker_signals(F.lit("Plain text"), none).alias("b"), M.kicker_signals(F.lit(""), none).alias("c"), M.kicker_signals(F.lit("ABC"), none).alias("d")).first()
    assert tuple(r) == (3, 0, 0, 1)
