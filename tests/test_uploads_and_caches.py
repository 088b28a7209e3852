"""Upload scan by range reads, and caches that keep what they hold."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tributary.plans import ingest
from tributary.sources import files, uploads

MIB = 1 << 20


def expected(path):
    raw = open(path, "rb").read()
    tail = raw[-MIB:] if len(raw) > 2 * MIB else b""
    return hashlib.sha256(str(len(raw)).encode() + raw[:MIB] + tail).hexdigest()[:16]


def test_every_file_has_a_row_and_a_reason(spark, tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    for name, size in (("a.mp4", 10), ("b.MP4", 2 * MIB), ("c.mp4", 2 * MIB + 1), ("deep/d.mp4", 3 * MIB), ("e.txt", 5), ("f.mp4", 0), ("g.mp4", 5 * MIB), ("h.txt", 0)):
        (root / name).write_bytes(os.urandom(size))
    rows = {os.path.relpath(r.path, root): r for r in uploads.uploads(spark, str(root), 4 * MIB, whole=True).collect()}
    assert {k: r.reject for k, r in rows.items() if r.reject} == {"e.txt": "unsupported media type", "h.txt": "unsupported media type", "f.mp4": "empty upload", "g.mp4": "upload too large"}
    for name in ("a.mp4", "b.MP4", "c.mp4", "deep/d.mp4"):
        raw = (root / name).read_bytes()
        assert (rows[name].length, rows[name].content_hash, rows[name].file_hash) == (len(raw), expected(root / name), hashlib.sha256(raw).hexdigest()[:16])
    assert all(r.content_hash is None and r.bytes_read == 0 for r in rows.values() if r.reject)


def test_a_large_file_costs_two_reads(spark, tmp_path):
    path = tmp_path / "big.mp4"
    with open(path, "wb") as f:
        f.write(b"start")
        f.truncate(3 << 30)
        f.seek(-3, os.SEEK_END)
        f.write(b"end")
    row = uploads.uploads(spark, f"file://{tmp_path}", 4 << 30).first()
    head, tail = b"start" + bytes(MIB - 5), bytes(MIB - 3) + b"end"
    assert row.content_hash == hashlib.sha256(str(3 << 30).encode() + head + tail).hexdigest()[:16]
    assert (row.length, row.bytes_read, row.file_hash) == (3 << 30, 2 * MIB, None)


def test_many_files_are_dealt_to_tasks(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.mp4").write_bytes(bytes([i]) * 1000)
    spark.dataSource.register(uploads.Uploads)
    df = spark.read.format("uploads").option("partition_bytes", 5000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 6 and df.select("content_hash").distinct().count() == 30
    assert spark.read.format("uploads").load(str(tmp_path / "none")).count() == 0 if (tmp_path / "none").mkdir() is None else False


def entries(path):
    return [os.path.join(at, x) for at, folders, names in os.walk(path) for x in folders + names]


def test_rows_are_stored_as_a_file_each(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([("a.mp4", "one"), ("a.mp4", "one"), ("a.mp4", "two"), ("b.mp4", ""), ("c.mp4", None), (None, "x")], "name string, content string")
    uploads.store(rows, path)
    uploads.store(rows.where("name = 'a.mp4'"), f"file://{path}")
    got = uploads.uploads(spark, path, MIB, whole=True).collect()
    one, two = (hashlib.sha256(x).hexdigest()[:16] for x in (b"one", b"two"))
    assert sorted((r.length, r.reject or "", r.file_hash or "") for r in got) == sorted([(3, "", one)] * 4 + [(3, "", two)] * 2 + [(0, "empty upload", "")] * 2 + [(1, "unsupported media type", "")])


def test_a_failed_store_leaves_nothing_and_no_scan_sees_a_staged_file(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.range(100).select(F.concat(F.col("id").cast("string"), F.when(F.col("id") == 70, "/").otherwise(""), F.lit(".mp4")).alias("name"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="slash"):
        uploads.store(rows, path)
    assert entries(path) == []
    staged = tmp_path / "in" / f"{uploads.STAGED}0" / "part"
    staged.mkdir(parents=True)
    (staged / "1.mp4").write_bytes(b"x")
    assert uploads.uploads(spark, path, MIB).count() == 0


def test_the_upload_query_makes_a_file_a_document_and_nothing_else_of_each(spark, tmp_path, monkeypatch):
    ids = [*range(-5, 2500), None, None, 7, 7, 7]
    docs = spark.createDataFrame([(x, None if i % 40 == 0 else f"{i} é\n" * (i % 2000)) for i, x in enumerate(ids)], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    monkeypatch.setattr(files, "work_folder", lambda spark: str(tmp_path / "stored"))
    got = ingest.QUERIES["q88_upload_scan"](spark, str(tmp_path / "sf"))
    found = entries(tmp_path / "stored")
    assert sum(map(os.path.isfile, found)) == len(ids) and sum(map(os.path.isdir, found)) <= 30
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/sf/documents.parquet/*.parquet'")
    want = db.execute(ingest.SELECTS["q88_upload_scan"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


KIND = "fingerprint string, start double, end double, text string, confidence double"


@pytest.fixture()
def cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("a", 0.0, 1.0, "old a", 0.5), ("007", 0.0, 1.0, "agent", None), ("1e5", 2.0, 3.0, "two", 0.1), ("1e5", 0.0, 1.0, "one", 0.1), (None, 0.0, 1.0, "nobody", 0.1), ("x/y=z", 0.0, 1.0, "slash", 1.0)]
    files.write_transcripts(spark.createDataFrame(rows, KIND), path)
    return path


def texts(spark, path, *only):
    rows = files.read_transcripts(spark, path, list(only) or None).collect()
    return {r.fingerprint: None if r.segments is None else [s.text for s in r.segments] for r in rows}


def test_a_second_write_keeps_the_first(spark, cache):
    assert texts(spark, cache) == {"a": ["old a"], "007": ["agent"], "1e5": ["one", "two"], "x/y=z": ["slash"]}
    files.write_transcripts(spark.createDataFrame([("b", 0.0, 1.0, "b", 0.5), ("a", 0.0, 1.0, "new a", 0.5), ("a", 1.0, 2.0, "more", 0.5)], KIND), cache)
    assert texts(spark, cache) == {"a": ["new a", "more"], "b": ["b"], "007": ["agent"], "1e5": ["one", "two"], "x/y=z": ["slash"]}
    assert texts(spark, cache, "007", "none") == {"007": ["agent"]}


def test_torn_records_are_misses_and_can_be_written_again(spark, cache):
    folder = os.path.join(cache, "fingerprint=a")
    (part,) = [f for f in os.listdir(folder) if f.startswith("part-")]
    raw = open(os.path.join(folder, part)).read()
    for f in os.listdir(folder):
        os.remove(os.path.join(folder, f))
    open(os.path.join(folder, part), "w").write(raw[: len(raw) // 2])
    assert texts(spark, cache)["a"] is None and texts(spark, cache)["007"] == ["agent"]
    files.write_transcripts(spark.createDataFrame([("a", 0.0, 1.0, "again", 0.5)], KIND), cache)
    assert texts(spark, cache)["a"] == ["again"]


def test_a_failed_write_changes_nothing(spark, cache):
    bad = spark.createDataFrame([("a", 0.0, 1.0, "boom", 0.5)], KIND).withColumn("text", F.when(F.col("text") == "boom", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        files.write_transcripts(bad, cache)
    assert texts(spark, cache)["a"] == ["old a"]


def test_representations_are_kept_by_video(spark, tmp_path):
    path = str(tmp_path / "reps")
    shots = "array(named_struct('shot_id', 's0', 'start', 0D, 'end', 1D, 'transcript', t)) shots"
    one = spark.createDataFrame([("v1", 1.0, "a"), ("v2", 2.0, "b")], "video_id string, duration_seconds double, t string").selectExpr("video_id", "duration_seconds", shots)
    files.write_representations(one, path)
    files.write_representations(one.where("video_id = 'v2'").withColumn("duration_seconds", F.lit(5.0)), path)
    back = files.read_representations(spark, path)
    assert {r.video_id: r.duration_seconds for r in back.collect()} == {"v1": 1.0, "v2": 5.0}
    assert files.not_cached(spark.createDataFrame([("v1",), ("v3",)], "video_id string"), back).first().video_id == "v3"
