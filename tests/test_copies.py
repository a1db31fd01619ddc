"""Digests and copies of files in blocks: large files, many files, damaged and unfinished copies."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from strata.sources import artifacts as A
from strata.sources import files
from strata.plans.session import ship


def _put(path, content: bytes):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_digests_equal_hashlib(spark, tmp_path):
    ship(spark)
    content = {"a.bin": b"x" * 100_003, "deep/er/b c=1%.bin": os.urandom(5000), "empty": b""}
    for name, c in content.items():
        _put(tmp_path / "in" / name, c)
    for block in (7, 4096, files.BLOCK):
        found = {r.file: (r.size, r.sha256, r.md5) for r in files.checksum_table(spark, str(tmp_path / "in"), block).collect()}
        assert found == {n: (len(c), hashlib.sha256(c).hexdigest(), hashlib.md5(c).hexdigest()) for n, c in content.items() if c}  # an empty file has nothing to check


def test_a_file_larger_than_one_value(spark, tmp_path):
    """A sparse file of 2.2 GB, which no binary value holds."""
    ship(spark)
    (tmp_path / "big").mkdir()
    with open(tmp_path / "big" / "zeros", "wb") as f:
        f.truncate(2_200_000_000)
    want = hashlib.sha256()
    for _ in range(2200):
        want.update(bytes(1_000_000))
    row = files.checksum_table(spark, str(tmp_path / "big")).first()
    assert (row.size, row.sha256) == (2_200_000_000, want.hexdigest())


def test_copies_go_on_and_mend(spark, tmp_path):
    ship(spark)
    for k in range(6):
        _put(tmp_path / "in" / f"d{k % 2}" / f"f{k}", os.urandom(3000 + k))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = files.copy_files(spark, source, target, 512).collect()
    assert sorted(first) == sorted(files.checksum_table(spark, target).collect()) == sorted(files.checksum_table(spark, source).collect())
    whole = os.stat(tmp_path / "out/d0/f0").st_mtime_ns
    os.unlink(tmp_path / "out/d1/f1")
    _put(tmp_path / "out/d0/f2", b"damaged")
    assert sorted(files.copy_files(spark, source, target).collect()) == sorted(first) == sorted(files.checksum_table(spark, target).collect())
    assert os.stat(tmp_path / "out/d0/f0").st_mtime_ns == whole  # what was whole is not written again
    assert not [n for _, _, names in os.walk(target) for n in names if n.endswith(".part")]


def test_a_damaged_copy_leaves_the_pointer(spark, tmp_path, monkeypatch):
    ship(spark)
    rows = spark.range(20).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    old, new = (A.save_index(rows.where(f"id < {n}"), str(tmp_path / "own"), "x", f"2024010{n % 9}T000000Z") for n in (10, 20))
    A.publish_index(spark, old, str(tmp_path / "public"))
    copy = A.copy_files

    def damaging(s, source, target):
        out = copy(s, source, target)
        name = next(n for n in sorted(os.listdir(f"{target}/vectors")) if n.startswith("part-"))
        with open(f"{target}/vectors/{name}", "r+b") as f:
            f.seek(10)
            f.write(b"\xff\xfe")
        return out

    monkeypatch.setattr(A, "copy_files", damaging)
    with pytest.raises(ValueError, match="differs from its source"):
        A.publish_index(spark, new, str(tmp_path / "public"))
    assert A.load_latest(spark, str(tmp_path / "public"), "x")[0].count() == 10
    monkeypatch.undo()
    A.publish_index(spark, new, str(tmp_path / "public"))  # mends the damaged file
    assert A.load_latest(spark, str(tmp_path / "public"), "x")[0].count() == 20
