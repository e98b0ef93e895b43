"""Folder scans, sequences, digests and sinks."""

import hashlib

import pytest

from archivolt.operators.columns import FIELDS
from archivolt.sources import files


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a-001.jpg", "a-003.JPG", "sub/b-001.png", "x.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = files.folder(spark, str(tmp_path))
    assert sorted(r.name for r in got.collect()) == ["a-001.jpg", "a-003.JPG", "b-001.png"]
    assert sorted((r.prefix, r.page_no) for r in files.page_sequences(got).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    (tmp_path / "sub" / "a-001.jpg").write_bytes(b"again")
    with pytest.raises(Exception, match="page occurs twice"):
        files.page_sequences(files.folder(spark, str(tmp_path))).collect()
    path = got.filter("name = 'b-001.png'").first().path
    right = hashlib.sha256(b"sub/b-001.png").hexdigest()
    check = lambda digest: files.verified(spark, f"{tmp_path}/sub/*.png", spark.createDataFrame([(path, digest)], "path string, sha256 string")).collect()
    assert len(check(right)) == 1
    with pytest.raises(Exception, match="digest differs"):
        check("00")


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([tuple(f"{f}{i}" for f in FIELDS) for i in range(3)] + [("",) * 8], list(FIELDS))
    files.export_archive(rows, str(tmp_path / "csv"))
    assert files.import_archive(spark, str(tmp_path / "csv")).count() == 3


def test_replace_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_batches(spark.createDataFrame([(1, "a"), (2, "b")], "id long, batch_id string"), path)
    files.replace_batches(spark.createDataFrame([(3, "b")], "id long, batch_id string"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_missing_pages_and_archive_files(spark, tmp_path):
    for n in (1, 2, 5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"a-00{n}.png").write_bytes(b"x")
    got = files.missing_pages(files.folder(spark, str(tmp_path / "in")))
    assert sorted(r.missing for r in got.collect()) == [3, 4]
    rows = spark.createDataFrame([("x",) * 8], list(files.FIELDS))
    files.append_archive(rows, f"{tmp_path}/out")
    files.append_archive(rows, f"{tmp_path}/out")
    assert files.import_archive(spark, f"{tmp_path}/out").count() == 2
    files.clear_archive(spark, f"{tmp_path}/out")
    assert files.import_archive(spark, f"{tmp_path}/out").count() == 0
    tasks = spark.createDataFrame([("f.pdf", "text"), ("g.pdf", None)], "filename string, full_text string")
    files.export_tasks(tasks, f"{tmp_path}/txt")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/txt").collect()) == ["", "# f.pdf", "# g.pdf", "text"]
    files.export_tasks(tasks, f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
