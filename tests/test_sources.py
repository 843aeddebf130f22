"""Finding files, archives of every kind, and what is refused."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import random
import subprocess
import sys
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark import cloudpickle

from weblens.formats import NEXUS, NGINX
from weblens.plans import samples
from weblens.session import shared_folder
from weblens.sources import archives, files
from weblens.sources.discover import glob_list, read_logs


def tar_bytes(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in members:
            archive.writestr(name, content)
    return out.getvalue()


def lines_of(spark, folder, fmt=NGINX, **kwargs):
    """{file_source: [lines]} and {file_source: problem}."""
    found, problems = {}, {}
    for row in read_logs(spark, str(folder), fmt, **kwargs).collect():
        if row.problem:
            problems[row.file_source] = row.problem
        elif row.value.strip():
            found.setdefault(row.file_source, []).append(row.value)
    return found, problems


def test_glob_list():
    assert glob_list(" access.log*, other ,,") == ["access.log*", "other"]
    assert glob_list(("a ", "")) == ["a"]


@pytest.mark.parametrize("name,globs,expected", [
    ("access.log", ["access.log*"], True),
    ("ACCESS.LOG.1", ["access.log*"], True),
    ("access.log", ["ACCESS.LOG*"], True),
    ("my-access.log", ["access.log*"], False),
    ("accessXlog", ["access.log*"], False),
    ("request-2025.log.1", ["request*.log*"], True),
    ("a1.log", ["a[0-9].log"], True),
    ("ab.log", ["a[!0-9].log"], True),
    ("a.log", ["?.log", "x*y*z"], True),
    ("x1y2z", ["?.log", "x*y*z"], True),
    ("aB.log", ["A[A-C].log"], True),
    ("a^.log", ["a[^].log", "a[^b].log"], True),
    ("a{b,c}.log", ["a{b,c}.log"], True),
    ("ab.log", ["a{b,c}.log"], False),
    ("a[.log", ["a[.log"], True),
    ("straße.log", ["STRA*.LOG"], True),
])
def test_globs(spark, tmp_path, name, globs, expected):
    (tmp_path / name).write_text("x\n")
    assert expected is any(fnmatch.fnmatch(name.lower(), glob.lower()) for glob in globs)
    assert bool(lines_of(spark, tmp_path, globs=globs)[0]) is expected


def test_plain_files_below_a_folder(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "access.log").write_bytes(b"one\r\ntwo\rthree\n\n  \nlast")
    (tmp_path / "sub" / "access.log.1").write_bytes(b"bad \xff byte\n")
    (tmp_path / "sub" / "deep" / "Access.Log").write_bytes(b"deep\n")
    (tmp_path / "error.log").write_bytes(b"no\n")
    found, problems = lines_of(spark, tmp_path)
    assert problems == {}
    assert found == {
        "nginx:access.log": ["one", "two", "three", "last"],
        "nginx:access.log.1": ["bad � byte"],
        "nginx:Access.Log": ["deep"],
    }


def test_missing_folder_and_file_in_place_of_one(spark, tmp_path):
    (tmp_path / "access.log").write_text("x\n")
    assert lines_of(spark, tmp_path / "nowhere") == ({}, {})
    assert lines_of(spark, tmp_path / "access.log") == ({}, {})
    (tmp_path / "empty").mkdir()
    assert lines_of(spark, tmp_path / "empty") == ({}, {})


def test_archives_side_by_side(spark, tmp_path):
    body = [("logs/access.log", b"a\nb\n"), ("logs/error.log", b"no\n"), ("access.log.2", b"c")]
    (tmp_path / "access.log.tar").write_bytes(tar_bytes(body))
    (tmp_path / "access.log.tar.gz").write_bytes(tar_bytes(body, "w:gz"))
    (tmp_path / "access.log.TAR.BZ2").write_bytes(tar_bytes(body, "w:bz2"))
    (tmp_path / "access.log.zip").write_bytes(zip_bytes(body))
    (tmp_path / "access.log.9.gz").write_bytes(gzip.compress(b"g\r\nh"))
    (tmp_path / "backup.zip").write_bytes(zip_bytes(body))  # the outer name must match as well
    found, problems = lines_of(spark, tmp_path)
    expected = {"nginx:access.log.9.gz->access.log.9": ["g", "h"]}
    for outer in ("access.log.tar", "access.log.tar.gz", "access.log.TAR.BZ2", "access.log.zip"):
        expected[f"nginx:{outer}->logs/access.log"] = ["a", "b"]
        expected[f"nginx:{outer}->access.log.2"] = ["c"]
    assert found == expected and problems == {}


def test_gzip_member_must_match_as_well(spark, tmp_path):
    (tmp_path / "x.log.gz").write_bytes(gzip.compress(b"line\n"))
    assert lines_of(spark, tmp_path, globs=["*.gz"]) == ({}, {})
    assert lines_of(spark, tmp_path, globs="*.log*, y")[0] == {"nginx:x.log.gz->x.log": ["line"]}


def test_nested_archives_and_depth(spark, tmp_path):
    data = b"deep\n"
    names = ["access.log"]
    for level in range(3):
        data = tar_bytes([(names[-1], data), ("access.log.side", f"s{level}\n".encode())], "w:gz")
        names.append(f"access.log-{level}.tar.gz")
    (tmp_path / names[-1]).write_bytes(data)
    outer, middle, inner = reversed(names[1:])
    found, problems = lines_of(spark, tmp_path)
    assert problems == {}
    assert found == {
        f"nginx:{outer}->access.log.side": ["s2"],
        f"nginx:{outer}->{middle}->access.log.side": ["s1"],
        f"nginx:{outer}->{middle}->{inner}->access.log.side": ["s0"],
        f"nginx:{outer}->{middle}->{inner}->access.log": ["deep"],
    }
    found, problems = lines_of(spark, tmp_path, max_depth=1)
    assert list(found) == [f"nginx:{outer}->access.log.side"]
    assert problems == {f"nginx:{outer}->{middle}": "Maximum archive depth reached"}
    with pytest.raises(ValueError):
        lines_of(spark, tmp_path, max_depth=0)


def test_nested_zip_and_gzip_in_tar(spark, tmp_path):
    inner = zip_bytes([("access.log", b"z\n")])
    (tmp_path / "access.log.tar.gz").write_bytes(tar_bytes(
        [("access.log.zip", inner), ("a/access.log.1.gz", gzip.compress(b"g\n"))], "w:gz"))
    found, problems = lines_of(spark, tmp_path)
    assert problems == {}
    assert found == {
        "nginx:access.log.tar.gz->access.log.zip->access.log": ["z"],
        "nginx:access.log.tar.gz->a/access.log.1.gz->access.log.1": ["g"],
    }


@pytest.mark.parametrize("name,safe", [
    ("a/b.log", True), (r"dir\\f", True), ("../x", False), ("/abs", False), ("a/../b", False),
    ("a..b", True), ("c:x", False), (r"C:\x", False), (r"dir\f", False),
])
def test_safe_names(name, safe):
    assert archives.is_safe(name) is safe


def test_unsafe_members_are_refused(spark, tmp_path):
    (tmp_path / "access.log.tar").write_bytes(tar_bytes(
        [("../access.log", b"evil\n"), ("/access.log", b"evil\n"), ("access.log", b"good\n")]))
    found, problems = lines_of(spark, tmp_path)
    assert found == {"nginx:access.log.tar->access.log": ["good"]}
    assert problems == {
        "nginx:access.log.tar->../access.log": "Unsafe path in archive",
        "nginx:access.log.tar->/access.log": "Unsafe path in archive",
    }


def test_damaged_archives_give_nothing_and_stop_nobody(spark, tmp_path):
    body = b"".join(b"line %d\n" % i for i in range(50_000))
    sound = gzip.compress(body)
    (tmp_path / "access.log.1.gz").write_bytes(sound[:-10])
    (tmp_path / "access.log.2.gz").write_bytes(b"no gzip at all")
    (tmp_path / "access.log.tar").write_bytes(b"corrupt")
    (tmp_path / "access.log.zip").write_bytes(zip_bytes([("access.log", body)])[:-40])
    cut = tar_bytes([("access.log", b"first\n"), ("access.log.1", body)])
    (tmp_path / "access.log.b.tar").write_bytes(cut[:len(cut) // 2])
    (tmp_path / "access.log.3.gz").write_bytes(sound)
    found, problems = lines_of(spark, tmp_path)
    assert {k: len(v) for k, v in found.items()} == {"nginx:access.log.3.gz->access.log.3": 50_000}
    assert len(problems) == 5
    assert all(p.startswith("Unreadable archive") for p in problems.values())


def test_a_later_member_of_the_same_name_wins(spark, tmp_path):
    (tmp_path / "access.log.tar").write_bytes(
        tar_bytes([("access.log", b"old\n"), ("./access.log", b"new\n")]))
    found, problems = lines_of(spark, tmp_path)
    assert list(found.values()) == [["new"]]
    assert list(problems.values()) == ["Replaced by a later member of the same name"]


def test_links_in_a_tar_stand_for_their_target(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        info = tarfile.TarInfo("access.log")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"x\n"))
        link = tarfile.TarInfo("access.log.current")
        link.type, link.linkname = tarfile.SYMTYPE, "access.log"
        tar.addfile(link)
    (tmp_path / "access.log.tar").write_bytes(out.getvalue())
    found, problems = lines_of(spark, tmp_path)
    assert sorted(found.values()) == [["x"], ["x"]] and problems == {}


def test_a_link_without_a_file_costs_no_other_member(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, target in (("access.log.gone", "nowhere"), ("access.log.dir", "logs"), ("access.log.loop", "access.log.loop")):
            link = tarfile.TarInfo(name)
            link.type, link.linkname = tarfile.SYMTYPE, target
            tar.addfile(link)
        folder = tarfile.TarInfo("logs")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        info = tarfile.TarInfo("logs/access.log")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"x\n"))
    (tmp_path / "access.log.tar").write_bytes(out.getvalue())
    found, problems = lines_of(spark, tmp_path)
    assert list(found.values()) == [["x"]]
    assert len(problems) == 3 and all(p.startswith("Link without a file") for p in problems.values())


def test_a_failing_stream_is_no_damaged_archive():
    class Failing(io.BytesIO):
        def read(self, size=-1):
            raise OSError("connection lost")

    stream = io.BufferedReader(archives.Watched(Failing(b"x" * 100)))
    with pytest.raises(archives.StorageFailure):
        list(archives._walk(stream, ("access.log.gz",), ["access.log*"], 3))


def test_blocks_join_to_the_whole_text(monkeypatch):
    text = b"a\r\nbb\r\rccc\n" * 40 + b"end\r"
    unified = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    for size in (1, 2, 3, 7, 64, 10_000):
        monkeypatch.setattr(archives, "BLOCK_BYTES", size)
        blocks = list(archives._blocks(io.BytesIO(text)))
        joined = b"".join(blocks)
        assert joined in (unified, unified[:-1])
        assert all(b.endswith(b"\n") for b in blocks[:-1])


@pytest.mark.parametrize("alone,inline", [(1, 1), (1, 1 << 20), (1 << 20, 1 << 20)])
def test_archives_of_every_size_class(spark, tmp_path, monkeypatch, alone, inline):
    """Streamed from the path, dealt out, parsed where unpacked: the same lines."""
    body = b"".join(b"line %d\n" % i for i in range(2000))
    (tmp_path / "request.log.gz").write_bytes(gzip.compress(body))
    (tmp_path / "nexus_logs_1.tar.gz").write_bytes(tar_bytes([("request.log", b"three\n")], "w:gz"))
    (tmp_path / "request.log.2.gz").write_bytes(b"corrupt")
    monkeypatch.setattr(archives, "ALONE_BYTES", alone)
    monkeypatch.setattr(archives, "INLINE_BYTES", inline)
    found, problems = lines_of(spark, tmp_path, NEXUS)
    assert list(problems) == ["nexus:request.log.2.gz"]
    assert found["nexus:nexus_logs_1.tar.gz->request.log"] == ["three"]
    assert sorted(found["nexus:request.log.gz->request.log"]) == sorted(body.decode().split("\n")[:-1])


def test_bz2_text_is_unpacked_by_name(spark, tmp_path):
    (tmp_path / "access.log.bz2").write_bytes(bz2.compress(b"packed\n"))
    assert lines_of(spark, tmp_path)[0] == {"nginx:access.log.bz2": ["packed"]}


def test_files_that_do_not_match_are_never_opened(spark, tmp_path):
    (tmp_path / "access.log").write_text("x\n")
    (tmp_path / "other.gz").write_bytes(b"corrupt")
    frame = read_logs(spark, str(tmp_path), NGINX)
    assert frame.count() == 1


def test_tasks_do_not_need_the_package(tmp_path):
    """What a task runs can be loaded and used where the package cannot be imported."""
    (tmp_path / "task").write_bytes(cloudpickle.dumps((archives._walk, gzip.compress(b"a\nb\n"))))
    script = (
        "import io, pickle, sys\n"
        "from pyspark import cloudpickle\n"
        "walk, data = pickle.load(open('task', 'rb'))\n"
        "found = list(walk(io.BytesIO(data), ('access.log.gz',), ['access.log*'], 3))\n"
        "assert found == [(('access.log.gz', 'access.log'), b'a\\nb\\n', None)], found\n"
        "assert 'weblens' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True)


def test_broken_bytes_are_replaced_as_a_text_reader_would(spark, tmp_path):
    draw = random.Random(7)
    pieces = [b"a", b"\xff", b"\xf0\x9f", b"\xf0\x9f\x98\x80", b"\xe2\x82", b"\xc3", b"\xc3\xa9", b"\x80",
              b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80"]
    lines = [b"x" + b"".join(draw.choices(pieces, k=6)) for _ in range(300)]
    (tmp_path / "access.log").write_bytes(b"\n".join(lines))
    (tmp_path / "access.log.gz").write_bytes(gzip.compress(b"\n".join(lines)))
    found, _ = lines_of(spark, tmp_path)
    expected = sorted(line.decode("utf-8", errors="replace") for line in lines)
    assert [sorted(texts) for texts in found.values()] == [expected, expected]


def test_a_linked_file_is_read_once_under_its_own_name(spark, tmp_path):
    logs, other = tmp_path / "logs", tmp_path / "other"
    (logs / "sub").mkdir(parents=True), other.mkdir()
    (logs / "access.log").write_text("x\n")
    (logs / "access.log.current").symlink_to(logs / "access.log")
    (logs / "access.log.0").symlink_to("access.log")
    (logs / "sub" / "access.log.again").symlink_to(logs / "access.log.current")
    (other / "elsewhere").write_text("y\n")
    (logs / "access.log.b").symlink_to(other / "elsewhere")
    (logs / "access.log.a b%").symlink_to(other / "elsewhere")
    (logs / "access.log.gone").symlink_to(tmp_path / "nowhere")
    (logs / "access.log.tar").write_bytes(tar_bytes([("access.log", b"z\n")]))
    (logs / "sub" / "access.log.link.tar").symlink_to(logs / "access.log.tar")
    (logs / "linked").symlink_to(logs / "sub")
    found, problems = lines_of(spark, logs)
    assert problems == {}
    assert found == {"nginx:access.log": ["x"], "nginx:access.log.a%20b%25": ["y"], "nginx:access.log.tar->access.log": ["z"]}
    table = {r.file_source: r.state for r in files.file_table(spark, files.walk(spark, str(logs), NGINX.globs), "nginx").collect()}
    assert table == {
        "nginx:access.log": "read", "nginx:access.log.current": "duplicate", "nginx:access.log.0": "duplicate",
        "nginx:access.log.again": "duplicate", "nginx:access.log.a b%": "read", "nginx:access.log.b": "duplicate",
        "nginx:access.log.tar": "read", "nginx:access.log.link.tar": "duplicate"}


def test_hidden_folders_are_read_and_hidden_files_told(spark, tmp_path):
    for name in ("_old", ".arch", "plain/_deep/.deeper"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "_old" / "access.log").write_text("old\n")
    (tmp_path / ".arch" / "access.log.1.gz").write_bytes(gzip.compress(b"packed\n"))
    (tmp_path / "plain" / "_deep" / ".deeper" / "access.log.2").write_text("deep\n")
    (tmp_path / "plain" / "access.log.3").write_text("plain\n")
    (tmp_path / "_access.log").write_text("hidden\n")
    found, problems = lines_of(spark, tmp_path)
    assert found == {"nginx:access.log": ["old"], "nginx:access.log.1.gz->access.log.1": ["packed"],
                     "nginx:access.log.2": ["deep"], "nginx:access.log.3": ["plain"]}
    assert problems == {}
    found, problems = lines_of(spark, tmp_path, globs=["*access.log*"])
    assert len(found) == 4 and problems == {"nginx:_access.log": files.HIDDEN}


def test_nested_archives_cost_in_proportion(monkeypatch):
    """Bytes unpacked from the outermost stream do not grow with the square of the members."""
    def unpacked(members):
        inner = [(f"access.log.{i}.tar.gz", tar_bytes([("access.log", b"line\n" * 2000)], "w:gz")) for i in range(members)]
        read = 0
        original = gzip.GzipFile.read

        def counted(self, *args):
            nonlocal read
            data = original(self, *args)
            read += len(data)
            return data

        with monkeypatch.context() as patch:
            patch.setattr(gzip.GzipFile, "read", counted)
            stream = io.BytesIO(tar_bytes(inner, "w:gz"))
            blocks = [b for _, b, problem in archives._walk(stream, ("access.log.tar.gz",), ["access.log*"], 3) if b]
        assert len(blocks) == members
        return read

    assert unpacked(64) <= 2.2 * unpacked(32)


def test_spooled_archives_and_long_lines(spark, tmp_path, monkeypatch):
    body = b"".join(b"line %d\n" % i for i in range(3000))
    data = tar_bytes([("access.log.1.tar", tar_bytes([("access.log", body), ("access.log.2.zip", zip_bytes([("access.log.3", body)]))]))], "w:bz2")
    for size in (1, 1 << 20):
        monkeypatch.setattr(archives, "SPOOL_BYTES", size)
        found = list(archives._walk(io.BytesIO(data), ("access.log.tar.bz2",), ["access.log*"], 3))
        assert [(chain[-1], block) for chain, block, _ in found] == [("access.log", body), ("access.log.3", body)]
    monkeypatch.setattr(archives, "BLOCK_BYTES", 100)
    monkeypatch.setattr(archives, "LINE_BYTES", 1000)
    blocks = list(archives._blocks(io.BytesIO(b"a\n" + b"x" * 5000 + b"\nb\n")))
    assert max(map(len, blocks)) < 1300 and b"".join(blocks).replace(b"\n", b"") == b"a" + b"x" * 5000 + b"b"


@pytest.mark.parametrize("end", ["tar.bz2", "tar.gz"])
def test_compressed_tar_is_unpacked_once_whatever_its_links(end):
    """Each step back in a compressed stream would unpack it from its start."""
    lines = "\n".join(f"{i * i * 7919 % 100_003:x}" for i in range(40_000)).encode()
    members = [("access.log", lines), *((f"access.log.{i}", "access.log") for i in range(10)), ("access.log.gone", "nothing")]
    packed = samples._tar(members, f"w:{end[4:]}")
    read = 0

    class Counted(io.BytesIO):
        def readinto(self, target):
            nonlocal read
            read += (n := super().readinto(target))
            return n

        def read(self, size=-1):
            nonlocal read
            data = super().read(size)
            read += len(data)
            return data

    found = list(archives._walk(Counted(packed), (f"access.log.{end}",), ["access.log*"], 3))
    assert [problem for _, _, problem in found if problem] == ["Link without a file: nothing"]
    for name in ("access.log", *(f"access.log.{i}" for i in range(10))):
        assert b"".join(block for chain, block, _ in found if chain[-1] == name and block) == lines
    assert read <= 2 * len(packed) + (1 << 20)


@pytest.mark.parametrize("size", [archives.SPOOL_BYTES, 10_000])
def test_damaged_compressed_tars_give_the_same_with_and_without_unpacking(monkeypatch, size):
    monkeypatch.setattr(archives, "SPOOL_BYTES", size)
    lines = "\n".join(f"{i * i * 7919 % 100_003:x}" for i in range(40_000)).encode()
    packed = samples._tar([("access.log", lines), ("access.log.1", lines)], "w:gz")
    bare = samples._tar([("access.log", lines)])
    for content, name in [(packed[:len(packed) // 2], "a.tar.gz"), (gzip.compress(bare[:100_000]), "a.tar.gz"),
                          (gzip.compress(packed), "a.tar.gz"), (gzip.compress(b"no tar"), "a.tar.bz2")]:
        (found,) = archives._walk(io.BytesIO(content), (name,), ["access.log*"], 3)
        assert found[1] is None and found[2].startswith("Unreadable archive: ")
    for content in (packed + b"\0", packed + b"garbage", bare):
        found = list(archives._walk(io.BytesIO(content), ("a.tar.gz",), ["access.log"], 3))
        assert b"".join(block for _, block, _ in found) == lines


def test_sample_files_are_made_once_and_alike_by_tasks_and_by_spark(spark):
    made = spark.sparkContext.accumulator(0)
    rows = [("access.log.zip", b"PK\xff\r\n\x00"), ("_old/.arch/other log", "ä\nb".encode()), ("empty", b"")]

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame(rows, "name string, content binary").mapInArrow(count, "name string, content binary")
    want = {name: content + (b"\0" if name.endswith(".zip") else b"\n") for name, content in rows}

    def found(folder):
        return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}

    assert found(samples.write_files(files)) == want and made.value == len(rows)
    samples._write_by_spark(files, folder := shared_folder(spark, "files"))
    assert found(folder) == want and made.value == 2 * len(rows)


def test_sample_tars_with_links_are_packed_in_the_smallest_blocks():
    """Members that repeat within a block take longest to sort; the members themselves are told here again."""
    lines = [f"line {k}" for k in range(1000)]
    name, content = samples._sample_file("links", 7, lines)
    assert name == "access.log.7.tar.bz2" and content[:4] == b"BZh1"
    even, odd = ("\n".join(lines[k::2]).encode() for k in (0, 1))
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:bz2") as tar:
        found = [(i.name, i.linkname if i.issym() else tar.extractfile(i).read()) for i in tar]
    assert found == [("access.log", even), ("access.log.current", "access.log"), ("access.log.gone", "nothing"),
                     ("../access.log", odd), ("access.log.1", odd), ("./access.log.1", even)]
