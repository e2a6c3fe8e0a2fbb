import gzip
import io
import tarfile

import pytest

from surfacescan.plans import corpus
from surfacescan.sources import read_archives, read_tree, tar_entries, validate_entries
from surfacescan.sources.archive import Refused, archive_name, problems, walk


def tar(files, links=(), gz=True):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if gz else "w", format=tarfile.USTAR_FORMAT) as t:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        for name, to in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, to
            t.addfile(info)
    return out.getvalue()


GOOD = {"pkg/DESCRIPTION": b"Package: pkg\nVersion: 1.1\n", "pkg/configure": b"curl x\n"}


def test_walk_and_refusals():
    assert [(e.name, e.size, b) for e, b in walk(tar(GOOD), keep=10**6)] == [(n, len(b), b) for n, b in GOOD.items()]
    assert len(list(walk(tar(GOOD, gz=False)))) == 2
    raw = tar(GOOD, gz=False)
    for bad in (b"not a tar", raw[:600], tar(GOOD)[:60], raw[:124] + b"zzzzzzzzzzz\0" + raw[136:]):
        with pytest.raises(Refused):
            list(walk(bad))
    with pytest.raises(Refused):
        list(walk(tar(GOOD), max_entries=1))
    with pytest.raises(Refused):
        list(walk(tar({"p/a": b"0" * 10**6}), max_ratio=10))
    with pytest.raises(Refused):
        list(walk(tar({"p/a": b"0" * 10**6}), max_bytes=1000))


def test_memory_is_bounded(tmp_path):
    """An archive of 250 files of 8 MB, all kept: 200 MB of memory suffice, whatever the archive's size."""
    import subprocess
    import sys

    with open(tmp_path / "big_1.0.tar", "wb") as f:
        for i in range(250):
            info = tarfile.TarInfo(f"big/{i}.bin")
            info.size = 8 << 20
            f.write(info.tobuf(tarfile.USTAR_FORMAT))
            f.seek(info.size, 1)
        f.write(b"\0" * 1024)
    code = f"""
import resource
from surfacescan.sources.archive import ArchiveReader, Archives
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = ArchiveReader(dict(paths='["{tmp_path}"]', mode="files", keep=str(10 << 20), archive_limit=str(2 << 30), splits="4", caps="{{}}"))
n = held = 0
for part in r.partitions():
    for b in r.read(part):
        n, held = n + b.num_rows, max(held, b.nbytes)
        assert b.column(6).null_count == b.num_rows, b.column(6)
print(n, held, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)
"""
    n, held, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 250 and held < 32 << 20 and grown < 150 << 10  # kilobytes


def test_conditions_spare_the_reading(tmp_path, monkeypatch):
    from surfacescan.sources import archive, folder

    for name in ("pkg", "other"):
        (tmp_path / f"{name}_1.0.tar.gz").write_bytes(tar({f"{name}/DESCRIPTION": b"x", f"{name}/big": b"y" * 5000}))
    (tmp_path / ".bad_2.tar.gz").write_bytes(b"x")
    with open(tmp_path / "huge_1.tar", "wb") as f:
        f.truncate(3 << 30)
    opens, read = [], folder.Local.open
    monkeypatch.setattr(folder.Local, "open", lambda self, path: opens.append(path.rsplit("/", 1)[1]) or read(self, path))

    def rows(mode="files", **wanted):
        opens.clear()
        r = archive.ArchiveReader(dict(paths=f'["{tmp_path}"]', mode=mode, keep="1000000", archive_limit=str(2 << 30), splits="2", caps="{}", **folder.Wanted.options(**wanted)))
        return sorted(((x["package"], x["file_context"] or x["verdict"], x["content"] is not None) for part in r.partitions() for b in r.read(part) for x in b.to_pylist()), key=str)

    bad = [(".bad", "neither gzip nor plain tar", False), ("huge", f"archive of more than {2 << 30} bytes", False)]
    assert rows() == [*bad, *((p, x, True) for p in ("other", "pkg") for x in ("DESCRIPTION", "big"))] and "huge_1.tar" not in opens
    assert rows(packages=["pkg"], largest=100) == [("pkg", "DESCRIPTION", True)] and set(opens) == {"pkg_1.0.tar.gz"}
    assert rows("verdicts") == [*bad, ("other", None, False), ("pkg", None, False)] and opens.count("pkg_1.0.tar.gz") == 1  # headers only


def test_paths_of_archives(tmp_path):
    from surfacescan.sources.archive import listed

    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        for name in ("x_1.tar.gz", ".y.tgz", "z[1].tar", "no.zip"):
            (tmp_path / d / name).write_bytes(b"1")
    names = lambda p: sorted(x.removeprefix(f"{tmp_path}/") for x, _ in listed(f"{tmp_path}/{p}"))
    assert names("a") == names("a/") == ["a/.y.tgz", "a/x_1.tar.gz", "a/z[1].tar"] and names("a/x_1.tar.gz") == ["a/x_1.tar.gz"]
    assert names("*/x_*") == ["a/x_1.tar.gz", "b/x_1.tar.gz"] and names("a/z[1].tar") == ["a/z[1].tar"] and names("[ab]/.y*") == ["a/.y.tgz", "b/.y.tgz"]
    with pytest.raises(FileNotFoundError):
        listed(f"{tmp_path}/none")


def test_problems():
    entries = lambda *a, **k: [e for e, _ in walk(tar(*a, **k))]
    assert problems(entries(GOOD)) == []
    assert problems(entries({"p/../x": b""})) and problems(entries({"/x/a": b""})) and problems(entries({"p/a\\b": b""})) and problems(entries({"p/a": b""}, [("p/l", "a")])) and problems(entries({"p/a": b"", "q/a": b""}))
    assert archive_name("x/pkg_1.0_2.tar.gz") == ("pkg", "1.0_2")


def test_survey(spark, tmp_path):
    (tmp_path / "pkg_1.0.tar.gz").write_bytes(tar(GOOD))
    (tmp_path / "bad_1.0.tar.gz").write_bytes(tar({"bad/a": b""}, [("bad/l", "/etc/passwd")]))
    (tmp_path / "alias_1.0.tar.gz").write_bytes(tar({"other/a": b""}))
    done, refused, odd = corpus.survey(spark, str(tmp_path))
    assert sorted(r["package"] for r in refused.collect()) == ["alias", "bad"]
    assert [(r["package"], r["rule"]) for r in done.matches.collect()] == [("pkg", "curl")]
    assert odd.first()["message"] == "version is 1.1"
    with pytest.raises(ValueError):
        corpus.survey(spark, str(tmp_path), on_error="stop")
    counts = {r["package"]: r for r in validate_entries(tar_entries(spark, str(tmp_path))).collect()}
    assert counts["pkg"]["sound"] and not counts["bad"]["sound"] and counts["bad"]["n_links"] == 1
    sizes = {r["package"]: r for r in corpus.survey_expansion(spark, str(tmp_path)).collect()}
    assert sizes["pkg"]["uncompressed_size"] == 2048 and sizes["pkg"]["compressed_size"] == len(tar(GOOD)) or sizes["pkg"]["ratio"] > 1
    assert read_archives(spark, str(tmp_path)).where("verdict IS NULL").count() == 2


def test_tree(spark, tmp_path):
    for name, body in {"a/configure": "wget x\n", "a/R/b.R": "f()\n", "b/configure": "x\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = {(r["package"], r["file_context"]) for r in read_tree(spark, str(tmp_path)).collect()}
    assert rows == {("a", "configure"), ("a", "R/b.R"), ("b", "configure")}
    assert {r["file_context"] for r in read_tree(spark, str(tmp_path / "a"), "a").collect()} == {"configure", "R/b.R"}


def test_streams(spark, tmp_path):
    from surfacescan.streaming import stream_archives, stream_matches

    (tmp_path / "in/p").mkdir(parents=True)
    (tmp_path / "in/p/configure").write_text("curl a\nwget b\n")
    q = stream_matches(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["rule"] for r in spark.table("hits").collect()) == ["curl", "wget"]
    (tmp_path / "tars").mkdir()
    (tmp_path / "tars/pkg_1.0.tar.gz").write_bytes(tar(GOOD))
    for _ in range(2):  # the second run finds nothing new
        stream_archives(spark, str(tmp_path / "tars"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    hits = lambda: sorted((r["rule"], r["batch"], r["package"]) for r in spark.read.parquet(str(tmp_path / "out/matches")).collect())
    assert hits() == [("curl", 0, "pkg")]
    (tmp_path / "tars/more_1.0.tar.gz").write_bytes(tar({"more/configure": b"wget x\n"}))
    stream_archives(spark, str(tmp_path / "tars"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()  # a new checkpoint: only the new archive
    assert hits() == [("curl", 0, "pkg"), ("wget", 0, "more")]


def test_a_batch_that_comes_again_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from surfacescan.streaming.dropbox import SURVEYED, write_batch

    for name in ("a", "b"):
        (tmp_path / f"{name}_1.0.tar.gz").write_bytes(tar({f"{name}/configure": b"curl x\n", f"{name}/DESCRIPTION": b"Package: z\nVersion: 1.0\n"}))
    (tmp_path / "bad_1.0.tar.gz").write_bytes(b"no tar")
    archives = spark.read.format("binaryFile").load(str(tmp_path / "*.gz")).select("path", "modificationTime", "length")
    out, write, written = str(tmp_path / "out"), DataFrameWriter.parquet, []

    def killed(self, path, *more, **named):
        if len(written) == 3:
            raise KeyboardInterrupt
        written.append(path)
        return write(self, path, *more, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", killed)
    with pytest.raises(KeyboardInterrupt):
        write_batch(spark, archives, "r", 0, out)
    monkeypatch.undo()
    counts = lambda: {n: spark.read.parquet(f"{out}/{n}").count() for n in SURVEYED}
    assert write_batch(spark, archives, "r", 0, out) == 3
    first = counts()
    assert first["matches"] == 2 and first["provenance"] == 2 and first["errors"] == 1
    assert write_batch(spark, archives, "r", 0, out) == 3 and counts() == first  # replayed once more
    for name in ("a", "b", "bad"):  # finished archives are not opened, whoever comes: only their time and length count
        (tmp_path / f"{name}_1.0.tar.gz").rename(tmp_path / f"gone-{name}")
    assert write_batch(spark, archives.sparkSession.read.parquet(f"{out}/finished").select("path", "modificationTime", "length"), "other", 7, out) == 0 and counts() == first


def test_gzip_is_told_by_its_magic():
    assert len(list(walk(gzip.compress(tar(GOOD, gz=False))))) == 2
