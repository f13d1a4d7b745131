import pytest
from pyspark.sql import functions as F

from voxrank.operators import clean
from voxrank.sources import exports, files


def test_quoted_newlines_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "upload.csv"
    path.write_text('text,rating,source\n"Line one\nline two","5",N/A\n"He said ""no""",,shop\nnull,3,\n  padded  ,1,x\n', encoding="utf-8-sig")
    rows = files.read_reviews(spark, str(path)).orderBy("row_no").collect()
    assert [r.text for r in rows] == ["Line one\nline two", 'He said "no"', None, "  padded  "]
    assert [r.rating for r in rows] == ["5", None, "3", "1"]
    assert [r.source for r in rows] == [None, "shop", None, "x"]
    assert [r.row_no for r in rows] == [0, 1, 2, 3]


def test_minimal_upload(spark, tmp_path):
    path = tmp_path / "minimal.csv"
    path.write_text("text\nGood battery\nPoor screen\n")
    assert clean.clean(clean.prepare(files.read_reviews(spark, str(path)))).count() == 2


def test_row_numbers_follow_files_and_blocks(spark, tmp_path):
    for part in range(3):
        lines = [f"{part * 4000 + i}" for i in range(4000)]
        (tmp_path / f"part-{part}.csv").write_text("key\n" + "\n".join(lines) + "\n")
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    small.conf.set("spark.sql.files.openCostInBytes", "0")
    frame = files.with_row_numbers(files.read_csv(small, str(tmp_path), multi_line=False))
    assert frame.rdd.getNumPartitions() > 1
    rows = frame.select("row_no", F.col("key").cast("long").alias("key")).collect()
    assert len(rows) == 12000 and all(r.row_no == r.key for r in rows)


def test_row_numbers_survive_other_splits_at_the_action(spark, tmp_path):
    (tmp_path / "one.csv").write_text("key\n" + "\n".join(str(i) for i in range(40_000)) + "\n")
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    other.conf.set("spark.sql.files.minPartitionNum", "2")
    frame = files.with_row_numbers(files.read_csv(other, str(tmp_path), multi_line=False))
    other.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    other.conf.set("spark.sql.files.minPartitionNum", "5")
    rows = frame.select("row_no", F.col("key").cast("long").alias("key")).collect()
    assert len(rows) == 40_000 and all(r.row_no == r.key for r in rows)


def test_validation_keeps_blanks(spark, tmp_path):
    path = tmp_path / "validation.csv"
    path.write_text('review_text,human_topic,topic_correct\n"NA",,""\nx,Display,True\n')
    rows = files.read_validation(spark, str(path)).orderBy("row_no").collect()
    assert [(r.review_text, r.human_topic, r.topic_correct) for r in rows] == [("NA", "", ""), ("x", "Display", "True")]


def test_export_has_mark_and_safe_text(spark, tmp_path):
    folder = str(tmp_path / "out")
    frame = spark.createDataFrame([("=1", 1, "a,b"), (None, 2, 'say "hi"')], "text string, n int, note string")
    exports.write_csv(frame.coalesce(1), folder)
    part = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbftext,n,note")
    assert b"'=1,1,\"a,b\"" in part and b',2,"say ""hi"""' in part


def test_json_keeps_nulls_and_text(spark, tmp_path):
    folder = str(tmp_path / "out")
    exports.write_json(spark.createDataFrame([("=é", None)], "a string, b double").coalesce(1), folder)
    part = next((tmp_path / "out").glob("part-*.json")).read_text(encoding="utf-8")
    assert part == '{"a":"=é","b":null}\n'


def test_labels_file(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{\n  "Use / Days": "Everyday",\n  "Games": "Gaming"\n}')
    assert {r.label: r.display for r in files.read_labels(spark, str(path)).collect()} == {"Use / Days": "Everyday", "Games": "Gaming"}


def test_snapshot_rejects_other_input(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    folder = str(tmp_path / "snap")
    exports.save_snapshot(folder, {"t": source}, source)
    assert exports.load_snapshot(spark, folder, source.repartition(3))["t"].count() == 2
    with pytest.raises(ValueError, match="does not match"):
        exports.load_snapshot(spark, folder, source.fillna(""))


def test_file_fingerprint(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.bin"
    path.write_bytes(b"payload")
    assert exports.file_fingerprint(spark, str(path)).first().sha256 == hashlib.sha256(b"payload").hexdigest()
