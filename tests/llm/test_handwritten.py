from __future__ import annotations

import pytest

from sieveloom.llm.handwritten import kind_of, not_handwritten

CODE = "import os\n\nclass Reader:\n    def load(self, path):\n        with open(path) as f:\n            return f.read()\n"
SERIES = "\n".join(f"  get_x{i}() {{ return this.fields_[{i}]; }}" for i in range(12))


@pytest.mark.parametrize(
    ("path", "content", "kind"),
    [
        ("a/b.py", CODE, None),
        ("a/b.py", "# Code generated by tool v1. DO NOT EDIT.\n" + CODE, "generated"),
        ("a/b.py", CODE + "# This file is automatically generated from x. Do not modify it by hand\n", "generated"),
        ("a/b.py", 'BANNER = "Code generated by " + NAME + ". DO NOT EDIT."\n' + CODE, None),
        ("a/b.py", "# Not generated: do not edit lightly.\n" + CODE, None),
        ("a/b.py", "# Please edit freely, the old auto-generated version is gone.\n" + CODE, None),
        ("a/b_pb2.py", CODE, "generated"),
        ("a/b.ts", SERIES, "generated"),
        ("vendor/lib/x.go", CODE, "vendored"),
        ("web/node_modules/x/y.js", CODE, "vendored"),
        ("src/vendor_portal/x.py", CODE, None),
        ("src/generated_reports/x.py", CODE, None),
        ("static/x.min.js", "a=1", "minified"),
        ("src/x.js", "if(!q||f>9)return null;else{r=q.f(1,!0)}try{a(s)}catch(o){d=o.q}" * 20, "minified"),
        ("src/admin.js", CODE, None),
        ("src/x.py", "W = [\n" + "    0.1, 0.2, 0.3, 0.4,\n" * 60 + "]\n", "data"),
        ("vendor/x.py", " \n\t", None),
        ("vendor/x.py", None, None),
        (None, CODE, None),
    ],
)
def test_kinds(path, content, kind):
    assert kind_of(path, content) == kind


def test_library_copies_and_edges(spark):
    body = "\n".join(f"def {w}(a, b):\n    return a.{w}(b) + b.{w[::-1]}" for w in "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split())
    files = [(1, "src/own.py", CODE, 1), (2, "src/renamed.py", body.replace("iota", "jota"), 1), (2, "src/renamed.py", body, 1), (3, None, None, 1), (4, "deps/a.c", "x", 1), (5, "a.py", "", 1)]
    df = spark.createDataFrame(files, "item_id bigint, path string, content string, kind int")
    library = spark.createDataFrame([(1, body), (2, None)], "library_file_id bigint, content string")
    assert {(r.item_id, r.kind) for r in not_handwritten(df, library).collect()} == {(2, "vendored"), (4, "vendored")}
    assert not_handwritten(df.limit(0), library).count() == 0
    assert not_handwritten(df, library.limit(0)).count() == 1
