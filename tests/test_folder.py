"""The folder source: everything is listed, little is opened."""

import os

import pytest

from surfacescan.operators import claims
from surfacescan.plans import audit
from surfacescan.rules import default_rules
from surfacescan.sources import folder, read_tree

SEVEN = {".Rprofile": "options(repos = 'x')\n", "_x.R": "1\n", "R/_b.R": 'system("q")\n', ".Rbuildignore": "^x$\n", "configure": "wget x\n", "DESCRIPTION": "Package: p\nVersion: 1\n", "R/a.R": "f()\n"}


@pytest.fixture
def tree(tmp_path):
    for name, body in SEVEN.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(body)
    return tmp_path / "p"


def test_hidden_files_are_seen(spark, tree):
    rows = read_tree(spark, str(tree), "p").collect()
    assert {r["file_context"]: r["content"].decode() for r in rows} == SEVEN and all(r["bytes"] == len(r["content"]) and r["problem"] is None for r in rows)
    done = audit(read_tree(spark, str(tree), "p"))
    claimed = claims.find_file_contexts(read_tree(spark, str(tree), "p"), default_rules())
    assert ("rprofile", ".Rprofile") in {(r["rule"], r["file_context"]) for r in claimed.collect()}
    assert {".Rprofile", "R/_b.R", "_x.R"} <= {r["file_context"] for r in done.coverage.collect()}
    done.release()


def test_large_odd_and_linked_entries_are_rows(spark, tree):
    with open(tree / "big.rda", "wb") as f:
        f.truncate(3 << 30)
    os.mkfifo(tree / "configure.win")
    (tree / "R/link.R").symlink_to(tree / "R/a.R")
    (tree / "R/loop").symlink_to(tree)
    (tree / "R/gone.R").symlink_to(tree / "nowhere")
    os.makedirs(os.fsencode(tree) + b"/data/\xff\xfe")
    (tree / "data/empty").mkdir()
    with open(os.fsencode(tree) + b"/data/\xff\xfe/x.R", "w") as f:
        f.write("1\n")
    got = {r["file_context"]: r for r in read_tree(spark, str(tree), "p", splits=3).collect()}
    assert set(got) == {*SEVEN, "big.rda", "configure.win", "R/link.R", "R/loop", "R/gone.R", "data/��/x.R"}
    assert got["big.rda"]["bytes"] == 3 << 30 and got["big.rda"]["content"] is None and got["big.rda"]["problem"] == folder.TOO_LARGE
    assert got["configure.win"]["problem"] == "not a regular file" and got["data/��/x.R"]["content"] == b"1\n"
    assert all(got[f"R/{x}"]["is_symlink"] and got[f"R/{x}"]["content"] is None for x in ("link.R", "loop", "gone.R"))
    done = audit(read_tree(spark, str(tree), "p"))
    assert [(r["step"], r["file_context"]) for r in done.errors.collect()] == [("read_code", "configure.win")]
    assert {(r["status"], r["reason"]) for r in done.coverage.where("file_context = 'configure.win'").collect()} == {("error", "unreadable")}
    done.release()


def test_packages_by_folder_and_the_number_of_partitions(spark, tmp_path):
    want = set()
    for i in range(30):
        for name in ("R/a.R", ".hidden/deep/er/x", "_y"):
            at = tmp_path / f"p{i}" / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(str(i))
            want.add((f"p{i}", name))
    (tmp_path / ".stray").write_text("x")
    for splits in (1, 2, 7, 500):
        df = read_tree(spark, str(tmp_path), splits=splits)
        assert {(r["package"], r["file_context"]) for r in df.collect()} == want | {(".", ".stray")} and df.count() == 91
    assert df.where("package IN ('p3', 'p4') AND NOT file_context LIKE '.%' AND bytes < 2").count() == 4
    assert read_tree(spark, str(tmp_path), packages=["p3", "p4", "no"], match=r"\.R$|^_").count() == 4 and read_tree(spark, str(tmp_path), largest=0).count() == 0
    assert read_tree(spark, str(tmp_path), content=False).where("content IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="unreadable"):
        read_tree(spark, str(tmp_path / "absent")).count()
    (tmp_path / "none").mkdir()
    assert read_tree(spark, str(tmp_path / "none"), "p").count() == 0


def test_conditions_decide_before_a_file_is_opened(tree, monkeypatch):
    seen = []
    monkeypatch.setattr(folder.Local, "read", lambda self, path, most: seen.append(os.path.relpath(path, tree)) or b"")
    reader = folder.FolderReader({"path": str(tree), "package": "p", "limit": "12", **folder.Wanted.options(match="^R/|_x", largest=4)})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert {r["file_context"] for r in rows} == {"R/a.R", "_x.R"} == set(seen)
    reader = folder.FolderReader({"path": str(tree.parent), "splits": "4", **folder.Wanted.options(["q"])})
    assert [p for part in reader.partitions() for p in part.paths] == [("", False)]  # no other folder is listed


def test_uses_of_one_frame_do_not_meet(spark, tree):
    """What one use of a frame filters must not reach another one."""
    (tree / "l").symlink_to(tree)
    df = read_tree(spark, str(tree), "p")
    left, right = df.where("NOT is_symlink AND bytes > 3").select("file_context"), df.selectExpr("file_context", "bytes AS b", "is_symlink AS s")
    assert right.join(left, "file_context", "left_anti").count() == 2 and left.join(right, "file_context").where("s").count() == 0
    assert df.count() == 8 and left.count() == 6


def test_what_vanishes_or_fails_is_a_row(tree, monkeypatch):
    def fail(self, path, most):
        raise PermissionError(13, "Permission denied")

    monkeypatch.setattr(folder.Local, "read", fail)
    reader = folder.FolderReader({"path": str(tree), "package": "p"})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(rows) == 7 and {r["problem"] for r in rows} == {"unreadable: Permission denied"}
    gone = [r for b in reader.read(folder.Folders([("gone/", True)])) for r in b.to_pylist()]
    assert [(r["file_context"], r["problem"]) for r in gone] == [("gone/", "unreadable: No such file or directory")]
