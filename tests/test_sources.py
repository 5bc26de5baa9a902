import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.operators.images import difference_hash, image_metrics, laplacian_variance, quality_table
from gradewell.operators.resolve import merge_one_to_one
from gradewell.sources import features as SF
from gradewell.sources import labels as SL
from gradewell.sources import objects as SO
from gradewell.sources import sinks


def png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    raw = b"".join(b"\0" + line.astype("uint8").tobytes() for line in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def gallery(tmp_path_factory):
    root = tmp_path_factory.mktemp("gallery")
    rng = np.random.default_rng(1)
    images = {"train/Mild/a.png": rng.integers(0, 255, (220, 240)), "val/PDR/b.png": np.full((210, 210), 5), "odd/c.png": rng.integers(90, 160, (64, 48))}
    for name, pixels in images.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(png(pixels))
    (root / "train/Mild/broken.png").write_bytes(b"not an image")
    return root, images


def test_detect_column():
    assert SL.detect_column(["X", "Image_ID", "PATH"], ["id_code", "image_id", "path"]) == "Image_ID"
    assert SL.detect_column([" Grade "], ["grade"], strip=True) == " Grade "
    assert SL.detect_column([" Grade "], ["grade"]) is None
    with pytest.raises(ValueError):
        SL.detect_column(["a"], ["b"], required=True)


def test_label_csv(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("ID_Code,Diagnosis\n a1 ,2\na2,2.7\na3,9\na4,x\n")
    scanned = SL.scan_labels(SL.read_label_csv(spark, str(tmp_path / "labels.csv")), "s")
    assert [(r["id"], r["label"], r["label_ok"]) for r in scanned.orderBy("id").collect()] == [
        ("a1", 2, True), ("a2", 2, True), ("a3", None, False), ("a4", None, False)]
    report = SL.scan_report(scanned).first()
    assert (report["n_rows"], report["n_valid"], report["all_valid"], report["label_counts"]) == (4, 2, False, '{"2":2}')


def test_folder_labels(spark, gallery):
    labelled, unclear = SL.scan_folder_labels(spark, str(gallery[0]))
    got = {(r["id"], r["folder"], r["split"], r["label"]) for r in labelled.collect()}
    assert got == {("a", "Mild", "train", 1), ("broken", "Mild", "train", 1), ("b", "PDR", "val", 4)}
    assert [r["folder"] for r in unclear.collect()] == ["odd"]


def test_images(spark, gallery):
    root, images = gallery
    scanned = SO.scan_images(spark, str(root))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in scanned.drop("data").collect()}
    assert rows["broken.png"]["readable"] is False and rows["a.png"]["readable"] is True
    assert rows["a.png"]["sha256"] == hashlib.sha256((root / "train/Mild/a.png").read_bytes()).hexdigest()
    assert (rows["c.png"]["width"], rows["c.png"]["height"]) == (48, 64)
    metrics = {r["path"].rsplit("/", 1)[1]: r for r in image_metrics(scanned, colour=True).collect()}
    a = images["train/Mild/a.png"].astype(float)
    assert abs(metrics["a.png"]["blur_score"] - laplacian_variance(a)) < 1e-9
    assert abs(metrics["a.png"]["brightness_mean"] - a.mean()) < 1e-9 and abs(metrics["a.png"]["red_std"] - a.std()) < 1e-9
    assert metrics["a.png"]["dhash"] == difference_hash(a)
    assert metrics["b.png"]["green_skewness"] == 0.0 and metrics["b.png"]["blue_entropy"] == 0.0
    assert metrics["broken.png"]["ok"] is False and metrics["broken.png"]["dhash"] == -1
    status = {r["path"].rsplit("/", 1)[1]: (r["status"], r["quality_pass"]) for r in quality_table(scanned).collect()}
    assert status == {"a.png": ("acceptable", True), "b.png": ("blurry;too_dark;low_contrast", False),
                      "c.png": ("image_too_small", False), "broken.png": ("unreadable", False)}


def test_difference_hash_of_a_gradient():
    rising = np.tile(np.arange(90.0), (80, 1))
    assert difference_hash(rising) == -1 and difference_hash(rising[:, ::-1]) == 0


def test_extract_once_resumes_and_splits(spark, gallery, tmp_path):
    scanned = SO.scan_pixels(spark, str(gallery[0]))
    out = str(tmp_path / "metrics")
    seen = spark.sparkContext.accumulator(0)

    def kernel(rows):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch
        return image_metrics(rows.mapInPandas(count, rows.schema))

    assert sinks.append_pending(scanned.filter(F.col("path").contains("Mild")), kernel, out, "path") == 2 and seen.value == 2
    assert sinks.append_pending(scanned, kernel, out, "path") == 2 and seen.value == 4
    assert sinks.append_pending(scanned, kernel, out, "path") == 0 and seen.value == 4
    good, bad = sinks.split_results(spark.read.parquet(out))
    assert good.count() == 3 and bad.count() == 1
    sinks.write_failures(bad.select(F.lit("s").alias("source"), F.lit(1).alias("label"), "path", "error"), str(tmp_path / "failures"))
    with pytest.raises(ValueError, match="all 1 rows failed"):
        sinks.split_results(bad)


def test_feature_table_schema(spark, fx):
    with pytest.raises(ValueError, match="2 feature columns are missing"):
        SF.feature_columns(fx.feats, ["qty_sum", "nope", "neither"])
    legacy = fx.feats.select("label", *[F.lit(1.0).alias(n) for n in ("ma_count", "exudate_area", "vessel_density", "glcm_contrast", "glcm_homogeneity", "glcm_energy")])
    assert len(SF.feature_columns(legacy, ["other"])) == 6
    scan = SF.scan_features(fx.table("orders").withColumn("label", F.lit(1)), ["o_totalprice"])
    assert "ReadSchema: struct<o_totalprice:double>" in scan._jdf.queryExecution().executedPlan().toString()


def test_feedback_and_reports(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, 0, 3.5, ["blur"], "x", 5, 4, None, None), ("b", 1, 0, 3.5, [], "x", 9, 4, 1, None), (None, 1, 0, 1.0, [], "x", 1, 1, 1, None)], sinks.FEEDBACK_SCHEMA)
    sinks.append_feedback(events, str(tmp_path / "feedback"))
    sinks.append_feedback(events, str(tmp_path / "feedback"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "feedback")).collect()]
    assert len(lines) == 2 and all(d["session_id"] == "a" and d["created_at"].startswith("20") for d in lines)
    table = sinks.union_reports([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x|y",)], "b string")])
    assert [r["line"] for r in sinks.markdown_rows(table).filter("part < 2").orderBy("part").collect()] == ["| a | b |", "| --- | --- |"]
    assert any("x\\|y" in r["line"] for r in sinks.markdown_rows(table).collect())
    for fmt in ("csv", "json", "parquet"):
        sinks.write_report(table, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_one_to_one_merge_raises_on_lost_rows(spark):
    a = spark.createDataFrame([(1, 0), (2, 0)], "k int, label int")
    with pytest.raises(ValueError, match="lost"):
        merge_one_to_one(a, a.filter("k = 1"), ["k", "label"])
    with pytest.raises(ValueError, match="repeats"):
        merge_one_to_one(a, a.unionByName(a), ["k", "label"])
