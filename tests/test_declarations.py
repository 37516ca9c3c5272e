from __future__ import annotations

import ast

from sieveloom.operators import declarations as ops

PYTHON = 'import os\n\n\nclass A:\n    """Text."""\n\n    def one(self):\n        return {\n            "a": 1,\n        }\n\n    def two(self):\n        pass\n\n\ndef three(x,\n          y):\n    if x:\n        return y\n\n    return x\n\n\nX = 1\n'
JAVA = 'package a.b;\n\n/**\n * Keeps things.\n * Twice.\n */\npublic class Foo {\n  // }\n  String s = "}";\n  enum E { A }\n  void m() { }\n}\nclass Bar {\n}\n'


def test_block_ends_equal_the_parser(spark):
    df = spark.createDataFrame([("a.py", "python", PYTHON), ("Foo.java", "java", JAVA), ("n.py", "python", None), ("e.py", "python", ""), ("x.zz", None, "class Q:")], "path string, code_language string, content string")
    found = {(r.path, r.symbol): (r.start_line, r.end_line) for r in ops.symbol_items(df).collect()}
    wanted = {("a.py", n.name): (n.lineno, n.end_lineno) for n in ast.walk(ast.parse(PYTHON)) if isinstance(n, (ast.ClassDef, ast.FunctionDef))}
    assert {k: v for k, v in found.items() if k[0] == "a.py"} == wanted
    assert found["Foo.java", "Foo"] == (7, 12) and found["Foo.java", "E"] == (10, 10) and found["Foo.java", "Bar"] == (13, 14)
    assert not {p for p, _ in found} - {"a.py", "Foo.java"}
    chunks = ops.structural_chunks(df, 5).collect()
    assert {(r.path, r.start_line, r.end_line) for r in chunks} == {("a.py", 1, 3), ("a.py", 4, 8), ("a.py", 9, 13), ("a.py", 16, 20), ("a.py", 21, 21), ("Foo.java", 1, 5), ("Foo.java", 6, 6), ("Foo.java", 7, 11), ("Foo.java", 12, 12), ("Foo.java", 13, 14)}
    assert len({r.id for r in chunks}) == len(chunks)
    assert [(r.path, r.purpose) for r in ops.purposes(df).collect()] == [("Foo.java", "Keeps things. Twice.")]
    parents = {r.symbol for r in ops.qualified(ops.declarations(df)).collect()}
    assert parents == {"A", "A.one", "A.two", "three"}
    kept = ops.symbol_chunks(ops.symbol_items(df), least_file=10).collect()
    assert {r.symbol for r in kept} == {"A", "one", "three", "Foo"}
    assert ops.structural_chunks(df.limit(0)).count() == 0


def test_long_blocks_and_unclosed_braces():
    lines = ["void f() {"] + ["x;"] * 600 + ["}"]
    assert ops.block_end(lines, 1, False) == 1
    assert ops.block_end(["int x;"], 1, False) == 1
    assert ops.block_end(["a {", "/* }", "", "*/ '{'", "} // {"], 1, False) == 5
