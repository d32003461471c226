"""Sources and sinks over files made here."""

import json
import zipfile

from netloom.sources import readers, writers


def test_label_files_names_and_images(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "a.txt").write_text("1 0.5 0.5 0.1 0.1\n\n2 0.5 0.5 0.1 0.1 R90\n")
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "data.yaml").write_text("nc: 2\nnames: ['gnd', \"op amp\"]\n")
    (tmp_path / "train" / "data.yaml").write_text("names:\n  0: gnd\n  1: vss\nnc: 2\n")
    assert [(r.stem, r.line_no, r.line[:1]) for r in readers.label_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [("a", 0, "1"), ("a", 2, "2")]
    assert [r.stem for r in readers.image_files(spark, str(tmp_path)).collect()] == ["a"]
    assert sorted((r.class_id, r.name) for r in readers.class_names(spark, str(tmp_path)).collect()) == [(0, "gnd"), (0, "gnd"), (1, "op amp"), (1, "vss")]


def test_coco_and_archives(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "p.png", "width": 10, "height": 20}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 3, "name": "gnd"}]}))
    assert [tuple(r) for r in readers.coco_boxes(spark, str(tmp_path / "c.json")).collect()] == [("p.png", 10.0, 20.0, "gnd", 1.0, 2.0, 3.0, 4.0)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
    assert [(r.stem, r.length, bytes(r.content)) for r in readers.archive_members(spark, str(tmp_path)).collect()] == [("x", 5, b"hello")]


def test_grey_pictures_and_progress(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 2 2 255\n\x00\x10\x20\x30")
    assert [(r.x, r.y, r.value) for r in readers.pgm_pixels(spark, str(tmp_path)).orderBy("y", "x").collect()] == [(0, 0, 0), (1, 0, 16), (0, 1, 32), (1, 1, 48)]
    (tmp_path / "results.csv").write_text("epoch, metrics/mAP50(B),   metrics/mAP50-95(B)\n1,0.1,0.05\n2,0.3,0.25\n")
    assert [(r.epochs, r.map5095) for r in readers.progress(spark, str(tmp_path / "results.csv")).collect()] == [(2, 0.25)]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "n int, text string")
    writers.write_ordered_text(lines, str(tmp_path / "deck"), ["n"])
    assert [r.text for r in readers.text_lines(spark, str(tmp_path / "deck")).orderBy("line_no").collect() if r.text] == ["a", "b"]
    assert writers.names_yaml(spark.createDataFrame([("x", 1), ("y", 0)], "name string, id long")).first()[0] == "nc: 2\nnames: ['y', 'x']\n"


def test_numbered_names_and_logs_of_different_headers(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("names:\n  0: a\n  2: 'b c'\n")
    assert sorted((r.class_id, r.name) for r in readers.class_names(spark, str(tmp_path)).collect()) == [(0, "a"), (2, "b c")]
    (tmp_path / "one.csv").write_text("epoch, metrics/mAP50-95(B)\n1, 0.1\n2, 0.2\n")
    (tmp_path / "two.csv").write_text("  time,metrics/mAP50-95(B),  epoch\n9,0.5,7\n\n")
    (tmp_path / "three.csv").write_text("epoch,loss\n3,1\n")
    got = {r.file.rpartition("/")[2]: (r.epochs, r.map5095) for r in readers.progress(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"one.csv": (2, 0.2), "two.csv": (7, 0.5), "three.csv": (3, None)}
