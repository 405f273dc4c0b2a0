"""Readers and sinks on literal files."""

import json

from pyspark.sql import functions as F

from leafmill.sources import readers, sinks


def test_layout_units(spark, tmp_path):
    block = lambda **k: {"type": "text", "bbox": [1, 2, 3, 4], "content": "hello", **k}
    page = {"page": 1, "width": 10, "height": 20, "blocks": [block(), block(type="ref_text", content="[1] x"), block(content="  "), block(image="a.png"), block(type="unreadable")]}
    (tmp_path / "layout.json").write_text(json.dumps([page, {"width": 3}]))
    flat = readers.blocks(readers.layout(spark, str(tmp_path / "layout.json")))
    assert flat.count() == 5 and flat.first().x1 == 3
    got = readers.layout_units(flat).orderBy("unit_id").collect()
    assert [(r.unit_id, r.skip_reason) for r in got] == [("lay:1:0", ""), ("lay:1:1", "references"), ("lay:1:4", "unreadable")]


def test_small_readers(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps({"pages": ["a", "b"]}))
    assert [(r.page, r.raw) for r in readers.raw_pages(spark, str(tmp_path / "raw.json")).orderBy("page").collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "boxes.json").write_text(json.dumps({"p1": {"x1": 1, "y1": 2, "x2": 3, "y2": 4, "image_width": 9, "image_height": 9}}))
    assert readers.figure_boxes(spark, str(tmp_path / "boxes.json")).first().x2 == 3
    (tmp_path / "units.json").write_text(json.dumps({"k1": "t1", "k2": "t2"}))
    assert {r.key: r.text for r in readers.units_cache(spark, str(tmp_path / "units.json")).collect()} == {"k1": "t1", "k2": "t2"}
    (tmp_path / "gl.json").write_text(json.dumps([{"src": "GPU", "ko": "x", "policy": "A"}, {"ko": "y"}]))
    assert [r.src for r in readers.glossary(spark, str(tmp_path / "gl.json"), lower=True).collect()] == ["gpu"]
    (tmp_path / "a.sse").write_text('event: token\ndata: {"text": "hi"}\n\nevent: done\ndata: {}\n\n')
    assert [(r.event, r.text) for r in readers.sse(spark, str(tmp_path / "a.sse")).orderBy("seq").collect()] == [("token", "hi"), ("done", None)]
    for name, status in (("j_0123456789ab", "running"), ("j_0123456789ac", "queued"), ("j_bad", "done")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps({"id": name, "status": status, "submitted": True}))
    assert {r.id: (r.status, r.resubmit) for r in readers.jobs(spark, str(tmp_path)).collect()} == {"j_0123456789ab": ("error", False), "j_0123456789ac": ("queued", True)}
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "y.pdf").write_bytes(b"<html>")
    assert {r.reason for r in readers.documents(spark, str(tmp_path / "*.pdf")).collect()} == {"", "unknown-kind"}
    assert readers.generated_pages(spark, 3, 4).count() == 12


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "k string, r string")
    assert {r.k: r.reasons for r in sinks.reason_map(rows, "k", "r").collect()} == {"a": {"x": 2, "y": 1}, "b": {"x": 1}}
    before, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted((r.k, r.v) for r in sinks.last_wins(before, new, ["k"]).collect()) == [(1, "o"), (2, "n"), (3, "n")]
    sinks.by_job(rows, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 'a'").count() == 3
    sinks.json_records(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, page long, line string")
    sinks.markdown(lines, "\n---\n", str(tmp_path / "m"))
    assert next((tmp_path / "m").rglob("part-*.txt")).read_text() == "a\n---\nb\n"
    files = spark.createDataFrame([("a.md",), ("meta.json",), ("x.png",), ("x.tmp",)], "path string")
    assert sinks.archive_members(files, "all").count() == 3 and sinks.archive_members(files, "text").where(F.col("scope") == "images").count() == 0
