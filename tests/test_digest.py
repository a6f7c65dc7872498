"""Digests of files: large and odd ones, blocks, and what differs between two copies."""

import hashlib
import os
import shutil
import tracemalloc

import pytest

from regloom.sources import digest


def test_odd_files(spark, tmp_path):
    files = {"a.txt": b"", "b.txt": b"no newline", "sub/c.txt": b"\n\n\xff\xfe\x00 bytes that are no text\r\n" * 70_000, "sub/d e.txt": b"x\n"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/in/{name}"), exist_ok=True)
        open(f"{tmp_path}/in/{name}", "wb").write(data)
    want = {n: (len(d), hashlib.sha256(d).hexdigest(), d.count(b"\n")) for n, d in files.items()}
    for how in (None, True, False):
        got = {r.path.rpartition("/in/")[2].replace("%20", " "): (r.bytes, r.sha256, r.rows) for r in digest.digests(spark, f"file://{tmp_path}/in", ranged=how).collect()}
        assert got == want, how
    cut = {(r.path.rpartition("/in/")[2].replace("%20", " "), r.offset): (r.bytes, r.sha256) for r in digest.blocks(spark, f"file://{tmp_path}/in", 1000).collect()}
    assert cut == {(n, i): (len(d[i : i + 1000]), hashlib.sha256(d[i : i + 1000]).hexdigest()) for n, d in files.items() for i in range(0, len(d), 1000)}
    with pytest.raises(ValueError):
        digest.blocks(spark, f"file://{tmp_path}/in", 0)


def test_where_copies_differ(spark, tmp_path):
    os.makedirs(f"{tmp_path}/a")
    for name in ("x", "y"):
        open(f"{tmp_path}/a/{name}.txt", "wb").write(os.urandom(5000))
    shutil.copytree(f"{tmp_path}/a", f"{tmp_path}/b")
    with open(f"{tmp_path}/b/x.txt", "r+b") as f:
        f.seek(2500)
        f.write(b"changed")
    open(f"{tmp_path}/b/z.txt", "wb").write(b"new")
    sides = [digest.blocks(spark, f"file://{tmp_path}/{n}", 1000) for n in "ab"]
    got = digest.differences(*sides, (f"{tmp_path}/a", f"{tmp_path}/b")).collect()
    assert sorted((r.file, r.offset, r.problem) for r in got) == [("x.txt", 2000, "differs"), ("z.txt", 0, "only right")]


def test_three_gigabytes_in_little_memory(spark, tmp_path):
    """A sparse file beyond what one binary value can hold."""
    path = f"{tmp_path}/big/zeros.txt"
    os.makedirs(os.path.dirname(path))
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    sha = hashlib.sha256()
    for _ in range(3 << 10):
        sha.update(bytes(1 << 20))
    r = digest.digests(spark, f"file://{tmp_path}/big").first()
    assert (r.bytes, r.sha256, r.rows) == (3 << 30, sha.hexdigest(), 0)
    tracemalloc.start()
    digest.hashed(digest.pieces(f"file://{path}", 1 << 30, 200 << 20))
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
