"""Checksums of files that no task may hold whole, cut into splits and pieces of any size."""

import hashlib
import random

import pytest

from driftwise.sources import files as fs


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(5)
    noise = rng.randbytes(300_000)
    made = {
        "noise.parquet": noise, "ends.parquet": noise + b"\n", "blank.parquet": b"\n" * 9_000, "one line.parquet": noise.replace(b"\n", b"")[:70_000],
        "mark.txt": b"\xef\xbb\xbf" + noise, "mark_ends.txt": b"\xef\xbb\xbf" + noise[:50_000] + b"\n", "returns.csv": b"a\r\nb\r" * 5_000, "packed.gz": noise[:2_000],
        "small.parquet": b"abc", "zeros.parquet": bytes(40_000) + b"\n" + bytes(9),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in made.items()}


@pytest.mark.parametrize("split", ["7000", "134217728"])
def test_long_files_are_hashed_by_pieces(spark, folder, monkeypatch, split):
    path, want = folder
    monkeypatch.setattr(fs, "WHOLE_BYTES", 1_000)
    monkeypatch.setattr(fs, "PIECE_BYTES", 4_096)
    confs = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1000", "spark.sql.sources.binaryFile.maxLength": "2500"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = fs.file_checksums(spark, str(path)).collect()  # a file over 2 500 bytes that is read whole fails
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["length"], r["sha256"]) for r in got} == want and len(got) == len(want)
