"""Discovery on executors: many files, names of all kinds, ignore rules that go down, links."""

import os
import time

import pytest

from codescope.sources import code, tree


def made(root, names, text="x = 1\n"):
    for name in names:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)


def walked(root):
    """All files that aren't hidden, by the standard library."""
    out = []
    for here, folders, files in os.walk(root):
        folders[:] = [d for d in folders if not d.startswith(".")]
        out += [(os.path.relpath(f"{here}/{f}", root), os.path.getsize(f"{here}/{f}")) for f in files if not f.startswith(".")]
    return sorted(out)


def test_fifty_thousand_files(spark, tmp_path, monkeypatch):
    names = [f"{'_' * (a % 3)}a{a}/b{b}/{'_' * (c % 2)}c{c}.{'py' if c % 3 else 'txt'}" for a in range(20) for b in range(50) for c in range(50)]
    names += [f"deep/{'/'.join('d' * n for n in range(1, 30))}/f{i}.go" for i in range(10)]
    made(tmp_path, names, "")
    made(tmp_path, names[::10])
    began = time.time()
    got = tree.listing(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == walked(tmp_path) and len(names) == 50_010
    # a task opens no folder once it has seen its share, so the rounds spread the tree
    assert got.rdd.getNumPartitions() > 4
    assert time.time() - began < 60
    texts = code.files(spark, str(tmp_path), globs=["a3/*"])
    assert sorted((r["path"], r["size"], r["content"]) for r in texts.select("path", "size", "content").collect()) == [(p, s, "x = 1\n" if s else "") for p, s in walked(tmp_path) if p.startswith("a3/")]


@pytest.mark.parametrize("listed", [1, 3, 4000])
def test_rules_go_down(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(tree, "LISTED", listed)
    made(tmp_path, ["keep.py", "build/a.py", "src/build/b.py", "src/a.log", "src/sub/a.log", "src/sub/keep.log", "src/sub/out/c.py", "out/d.py", "src/sub/deep/e.py", ".hidden/f.py", "src/.g.py", "_private/_h.py", "src/[odd].py", "src/sub/__init__.py"])
    made(tmp_path, [".gitignore"], "build/\n*.log\n[bad\n")
    made(tmp_path, ["src/sub/.gitignore"], "!keep.log\n/out\n**/deep/\n")
    want = ["_private/_h.py", "keep.py", "out/d.py", "src/[odd].py", "src/sub/__init__.py", "src/sub/keep.log"]
    assert sorted(r["path"] for r in tree.listing(spark, str(tmp_path)).collect()) == want
    assert sorted(r["path"] for r in tree.listing(spark, f"file://{tmp_path}", ignores=False).collect()) == [p for p, _ in walked(tmp_path)]
    assert sorted(r["path"] for r in tree.listing(spark, str(tmp_path), depth=2).collect()) == ["_private/_h.py", "keep.py", "out/d.py", "src/[odd].py"]
    hidden = {r["path"] for r in tree.listing(spark, str(tmp_path), hidden=True).collect()}
    assert {".hidden/f.py", "src/.g.py", ".gitignore"} <= hidden and "build/a.py" not in hidden


def test_links_odd_bytes_and_what_is_not_there(spark, tmp_path):
    made(tmp_path, ["a/b.py", "empty/.keep"])
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    os.symlink(tmp_path / "a" / "b.py", tmp_path / "link.py")
    os.symlink(tmp_path / "gone", tmp_path / "broken.py")
    (tmp_path / "odd.py").write_bytes(b"a\xff\xfeb\r\n\x00")
    (tmp_path / "none.py").write_bytes(b"")
    rows = {r["path"]: r for r in code.files(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a/b.py", "link.py", "none.py", "odd.py"]
    assert rows["odd.py"]["content"] == "a��b\r\n\x00" and rows["none.py"]["content"] == "" and rows["link.py"]["lang"] == "python"
    places = code.places(spark, str(tmp_path))
    os.remove(tmp_path / "none.py")  # between listing and reading
    assert {r["path"]: r["content"] for r in tree.contents(places, str(tmp_path)).collect()}["none.py"] is None
    with pytest.raises(Exception, match="gone"):
        tree.listing(spark, str(tmp_path / "gone")).collect()


def test_paths_alone_read_nothing(spark, tmp_path):
    made(tmp_path, ["p/__init__.py", "p/a.py"])
    plan = code.places(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan
