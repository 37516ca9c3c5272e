from __future__ import annotations

from sieveloom.operators import graph

ROWS = [
    ("a/b/x.py","from .y import z\nfrom ..c.w import q\nimport os\nfrom . import k\n"),
    ("a/b/y.py",""),
    ("a/c/w.py","import a.b\nfrom a.b.x import t"),
    ("a/b/__init__.py",None),
    ("ui/App.ts","import { Q } from './lib';\nimport r from \"../core/run\"\n"),
    ("ui/lib/index.ts",""),
    ("core/run.js",""),
    ("n/m.c",'#include "m.h"\n#include "sub/k.h"'),
    ("n/m.h",""),
    ("n/sub/k.h",""),
    ("src/org/p/Foo.java","import org.p.Bar.baz;\nimport org.q.Foo;\nimport org.p.*;"),
    ("src/org/p/Bar.kt","package org.p\nimport org.p.Foo.Inner"),
    ("lib/org/p/Bar.java",""),
]
WANTED = {
    ("a/b/x.py", "a/b/__init__.py"),
    ("a/b/x.py", "a/b/y.py"),
    ("a/b/x.py", "a/c/w.py"),
    ("a/c/w.py", "a/b/__init__.py"),
    ("a/c/w.py", "a/b/x.py"),
    ("n/m.c", "n/m.h"),
    ("n/m.c", "n/sub/k.h"),
    ("src/org/p/Bar.kt", "src/org/p/Foo.java"),
    ("src/org/p/Foo.java", "lib/org/p/Bar.java"),
    ("src/org/p/Foo.java", "src/org/p/Bar.kt"),
    ("ui/App.ts", "core/run.js"),
    ("ui/App.ts", "ui/lib/index.ts"),
}


def test_imports_name_files(spark):
    df = spark.createDataFrame(ROWS, "path string, content string")
    assert {(r.src, r.dst) for r in graph.import_edges(df).collect()} == WANTED
    assert graph.import_edges(df.limit(0)).count() == 0


def test_calls_go_to_imported_files_first(spark):
    rows = [("a/m.py", "python", "from .u import f\nf(1)\ng(2)\nown(3)\ndef own(x): pass"), ("a/u.py", "python", "def f(): pass"), ("a/a.py", "python", "def f(): pass\ndef own(x): pass"), ("z.py", "python", "def g(): pass"), ("n.py", "python", None)]
    df = spark.createDataFrame(rows, "path string, code_language string, content string")
    found = {(r.src, r.dst) for r in graph.call_edges(df, graph.import_edges(df)).collect()}
    assert found == {("a/m.py", "a/u.py"), ("a/m.py", "z.py")}
