import pytest
from pyspark.sql import functions as F

from lorekeep.sources import files

# (rule lines, path, is_dir, ignored)
RULES = [
    (["*.log"], "a/b.log", False, True),
    (["*.log", "!keep.log"], "a/keep.log", False, False),
    (["/top.txt"], "top.txt", False, True),
    (["/top.txt"], "a/top.txt", False, None),
    (["out/"], "out", False, None),
    (["out/"], "out", True, True),
    (["out/"], "a/out/x.txt", False, True),
    (["a/*/c"], "a/b/c/d.txt", False, True),
    (["a/**/c.txt"], "a/c.txt", False, True),
    (["a/**/c.txt"], "a/x/y/c.txt", False, True),
    (["**/z"], "z", False, True),
    (["f?o.[ab]"], "fxo.b", False, True),
    (["f?o.[!ab]"], "fxo.b", False, None),
    (["# note", "", "\\#x"], "#x", False, True),
]


@pytest.mark.parametrize("lines, path, is_dir, want", RULES)
def test_rules(spark, lines, path, is_dir, want):
    assert spark.range(1).select(files.decision(F.lit(path), files.parse(lines), is_dir)).first()[0] is want


def test_scan(spark, tmp_path):
    tree = {
        "a.py": "1", "b.bin": "2", "c.log.txt": "3", "node_modules/x.js": "4", "sub/d.md": "5", "sub/e.md": "6", "sub/deep/f.md": "7",
        "gen/g.md": "8", "package-lock.json": "{}", ".gitignore": "gen/\n*.log.txt\n", "sub/.gitignore": "e.md\ndeep/\n", ".lorekeepignore": "!e.md\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = lambda **o: sorted(r["path"] for r in files.scan(spark, str(tmp_path), **o).select("path").collect())
    assert paths() == ["a.py", "sub/d.md", "sub/e.md"]
    assert paths(everywhere=["d.md"]) == ["a.py", "sub/e.md"]
    assert paths(include=["gen", "b.bin"]) == ["a.py", "b.bin", "gen/g.md", "sub/d.md", "sub/e.md"]
    assert paths(include=["gen"], only_included=True) == ["gen/g.md"]
    assert "sub/deep/f.md" in paths(respect_git=False)
    found = files.scan(spark, str(tmp_path))
    stored = found.where("path = 'a.py'").select(F.col("path").alias("source_file"), "modified")
    assert sorted(r["path"] for r in files.unread(found, stored).select("path").collect()) == ["sub/d.md", "sub/e.md"]
