"""Files that are scanned: hashes and leading bytes of files that are read in pieces."""

import hashlib

from furrow.sources import files as I


def test_files_longer_than_what_is_held_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 7)
    body = {"a.parquet": b"PAR1" + bytes(range(256)) * 40, "b c%20#.PDF": b"%PDF-" + b"x" * 5000, "e.txt": b"\x00\xff" * 9, "f.las": b"LAS", "noext": b"1"}
    for name, content in body.items():
        (tmp_path / name).write_bytes(content)
    # what the reader of whole files may hold
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r["path"].rsplit("/", 1)[1]: (r["path"], r["size"], r["sha256"], r["signature_ok"]) for r in I.scan_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    ok = {"a.parquet": True, "b c%20#.PDF": True, "e.txt": None, "f.las": False, "noext": None}
    assert {n: x[1:] for n, x in got.items()} == {n: (len(v), hashlib.sha256(v).hexdigest(), ok[n]) for n, v in body.items()}
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()
    assert sorted(x[0] for x in got.values()) == sorted(r["path"] for r in whole)


def test_files_are_read_once_and_not_whole(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    plan = I.scan_files(spark, str(tmp_path / "*.pdf"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "content" not in plan
