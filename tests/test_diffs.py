"""Diffs are split while they are read; deletions, renames and binary files go by their own headers."""

import warnings

import pytest
from pyspark.sql import functions as F

from auditspan.operators import lines
from auditspan.sources import dimensions, files

GIT = """diff --git a/y.ts b/y.ts
deleted file mode 100644
--- a/y.ts
+++ /dev/null
@@ -1,2 +0,0 @@
-gone
--- not a header
diff --git a/old.ts b/new name.ts
similarity index 90%
rename from old.ts
rename to new name.ts
--- a/old.ts
+++ b/new name.ts
@@ -1 +1,2 @@
-a
+b
+c
diff --git a/moved.ts b/to/moved.ts
similarity index 100%
rename from moved.ts
rename to to/moved.ts
diff --git a/p.png b/p.png
index 1..2 100644
Binary files a/p.png and b/p.png differ
diff --git a/n.ts b/n.ts
new file mode 100644
--- /dev/null
+++ b/n.ts
@@ -0,0 +1 @@
+++ plus
"""


def test_files_and_lines_of_a_git_diff(spark, tmp_path):
    (tmp_path / "d.diff").write_text("diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -1 +1 @@\n+x\n" + GIT)
    path = str(tmp_path / "d.diff")
    assert {tuple(r) for r in files.diff_files(spark, path).collect()} == {
        ("x.ts", "x.ts", "modified"), ("y.ts", "y.ts", "deleted"), ("new name.ts", "old.ts", "renamed"), ("to/moved.ts", "moved.ts", "renamed"), ("p.png", "p.png", "binary"), ("n.ts", "n.ts", "added"),
    }
    out = [(r.file, r.line) for r in files.diff_lines(spark, path).orderBy(F.col("file") == "n.ts", F.col("file") != "x.ts", "line_no").collect() if r.line]
    assert out == [("x.ts", x) for x in ("+++ b/x.ts", "@@ -1 +1 @@", "+x")] + [("new name.ts", x) for x in ("+++ b/new name.ts", "@@ -1 +1,2 @@", "-a", "+b", "+c")] + [("n.ts", x) for x in ("+++ b/n.ts", "@@ -0,0 +1 @@", "+++ plus")]
    assert {(r["file"]) for r in lines.hunks(files.diff_lines(spark, path)).collect()} == {"x.ts", "new name.ts", "n.ts"}


def test_plain_diffs_many_files_and_empty_ones(spark, tmp_path):
    (tmp_path / "plain.diff").write_text("--- a/a.ts\t2020\n+++ b/a.ts\t2021\n@@ -1 +1 @@\n-- b\n+c\n--- b.ts\n+++ b.ts\n@@ -3 +3 @@\n+d")
    out = [(r.file, r.line) for r in files.diff_lines(spark, str(tmp_path / "plain.diff")).orderBy("file", "line_no").collect()]
    assert [x for x in out if x[1][:1] == "+" and x[1][:3] != "+++"] == [("a.ts", "+c"), ("b.ts", "+d")] and ("a.ts", "-- b") in out
    (tmp_path / "many.diff").write_text("".join(f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -1 +{i} @@\n+{i}\n" for i in range(10_000)))
    many = files.diff_lines(spark, str(tmp_path / "many.diff")).where("line like '+%' and line not like '+++%'")
    assert many.count() == 10_000 == many.where("line = concat('+', substring(file, 2))").count()
    (tmp_path / "empty.diff").write_text("")
    assert files.diff_lines(spark, str(tmp_path / "empty.diff")).count() == 0 == files.diff_files(spark, str(tmp_path / "empty.diff")).count()


def test_broken_whitelists_are_warned_of(tmp_path):
    (tmp_path / "a.json").write_text('[{"pattern": "x"}]')
    (tmp_path / "b.json").write_text("{oops")
    with pytest.warns(UserWarning, match="b.json"):
        assert dimensions.whitelist_rules(str(tmp_path)) == [{"pattern": "x"}]
    (tmp_path / "b.json").write_text("{}")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert dimensions.whitelist_rules(str(tmp_path)) == [{"pattern": "x"}, {}]
