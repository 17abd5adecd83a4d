import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import dxf, schedules, tables

# Group codes and values in turn; ~ stands for a space inside a value.
DXF = """
0 SECTION 2 BLOCKS
0 BLOCK 2 Leaf 10 1.0 20 0.0
0 LINE 8 L 10 1.0 20 0.0 11 3.0 21 0.0
0 ENDBLK
0 BLOCK 2 Tree 10 0.0 20 0.0
0 INSERT 2 Leaf 8 0 10 10.0 20 0.0 50 90.0
0 CIRCLE 8 C 10 5.0 20 5.0 40 2.0
0 ENDBLK
0 BLOCK 2 *Paper_Space 10 0 20 0
0 MTEXT 8 G-ANNO-SCHD 10 1.234 20 9.876 3 Rebar~ 1 schedule
0 ENDBLK
0 ENDSEC
0 SECTION 2 ENTITIES
0 INSERT 2 Tree 8 0 10 100.0 20 0.0 41 2.0 42 2.0
0 LWPOLYLINE 8 P 70 1 10 0 20 0 10 4 20 0 10 4 20 3
0 POLYLINE 8 Q 70 0
0 VERTEX 10 1 20 1
0 VERTEX 10 2 20 2
0 SEQEND
0 ELLIPSE 8 E 10 0 20 0 11 4 21 0 40 0.5 41 0 42 6.283185307179586
0 ARC 8 A 10 0 20 0 40 3 50 350 51 20
0 TEXT 8 S-RBAR-IDEN 10 7 20 8 1 T12~@~150
0 INSERT 2 Missing
0 ENDSEC
0 EOF
"""
DRAWING = "\n".join(t.replace("~", " ") for t in DXF.split()) + "\n"


def test_drawing(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DRAWING)
    rows = dxf.read_dxf(spark, f"file://{tmp_path}/a.dxf")
    got = rows.orderBy("seq").collect()
    assert [r.kind for r in got] == ["LINE", "CIRCLE", "LWPOLYLINE", "LWPOLYLINE", "LWPOLYLINE", "ARC", "TEXT", "MTEXT"]
    line, circle, closed, old, ellipse, arc, text, note = got
    # the leaf's base point goes to (10, 0) of the tree, turned by 90 degrees, all twice as large at (100, 0)
    assert [(round(p.x, 6), round(p.y, 6)) for p in line.points] == [(120, 0), (120, 4)]
    assert (line.block, line.bref, circle.block, circle.bref) == ("Tree", 0, "Tree", 0)
    assert (circle.x, circle.y, circle.radius) == (110, 10, 4)
    assert closed.closed and len(closed.points) == 3 and not old.closed and len(old.points) == 2
    assert max(p.x for p in ellipse.points) == pytest.approx(4) and max(p.y for p in ellipse.points) == pytest.approx(2)
    assert (arc.start_angle, arc.end_angle, arc.bref) == (350, 20, -1)
    assert text.text == "T12 @ 150" and note.text == "Rebar schedule" and note.layout == "Paper_Space"
    boxes = {r.kind: (r.x0, r.y0, r.x1, r.y1) for r in dxf.bounding_boxes(rows, ["kind"]).collect()}
    assert boxes["CIRCLE"] == (106, 6, 114, 14)
    assert [tuple(r) for r in dxf.block_counts(rows).collect()] == [("Tree", 1, 2)]
    assert schedules.identifier_texts(rows).count() == 1 and schedules.layout_cells(rows).first().y == 9.88


def test_broken_drawing(spark, tmp_path):
    (tmp_path / "b.dxf").write_text(DRAWING[:700])
    (tmp_path / "c.dxf").write_bytes(b"\xff\xfe not a drawing")
    assert dxf.read_dxf(spark, f"file://{tmp_path}").count() >= 0


def test_pdf_texts(spark):
    text = "x\nSummary  Schedule\n8 mm 1,200.5 mm 10.25 kg\n12 mm 3000 mm 2.0 kg\nA T8 12 100 200 <varies> 300 3,600\nbad T8\nB1 T12 2 500 500 1000\n"
    rows = spark.createDataFrame([("p", 1, text), ("q", 1, "none"), ("r", 2, text)], "path string, page int, text string")
    assert sorted(map(tuple, schedules.pdf_summary(rows).collect())) == [("p", 8, 1200.5, 10.25), ("p", 12, 3000.0, 2.0)]
    items = schedules.pdf_itemized(rows.where("page = 1")).collect()
    assert [(r.mark, r.dia, r.qty, r.segments, r.length_mm, r.total_length_mm) for r in items] == [("A", 8, 12, [100.0, 200.0, 0.0], 300.0, 3600.0), ("B1", 12, 2, [500.0], 500.0, 1000.0)]
    cells = "A\nT8\n3\n100\n-\n<varies>\n-\n-\n300\n900\nother"
    (row,) = schedules.pdf_cell_rows(spark.createDataFrame([("p", cells)], "path string, text string")).collect()
    assert (row.mark, row.dia, row.qty, row.segments, row.length_mm, row.total_length_mm) == ("A", 8, 3, [100.0, 0.0], 300.0, 900.0)


def test_office_lines(spark):
    lines = [("p", "1 hairpin at top 150 8 12 0.4 0.1 0.4 - - - 0.868 10.416 0.395 4.11"), ("p", "TOTAL 4.11")]
    (row,) = schedules.office_lines(spark.createDataFrame(lines, "path string, line string")).collect()
    assert (row.sno, row.desc, row.spacing, row.dia, row.nos, row.segments, row.weight_kg) == (1, "hairpin at top", 150, 8, 12, [0.4, 0.1, 0.4], 4.11)


def test_layout_grid(spark):
    cells = [
        (99, 0, "Rebar schedule for PW-01(WALL)"),
        (90, 0, "Mark"), (90, 20, "Dia"), (90, 40, "Qty"), (90, 60, "A"), (90, 80, "Bar length"), (90, 100, "Total length"), (90, 120, "Weight"),
        (80, 1, "A"), (80, 21, "8 mm"), (80, 41, "3"), (80, 61, "100"), (79, 81, "<varies>"), (80, 101, "900"), (80, 121, "1.5"), (80, 300, "far"),
        (70, 1, "B"), (70, 21, "12"), (70, 41, "2"), (70, 81, "500"), (70, 121, "2"),
        (60, 121, "3.5"),
        (50, 0, "Summary Schedule"),
        (45, 0, "8 mm"), (44, 30, "900 mm"), (45, 60, "1.5 kg"), (40, 30, "1,900 mm"), (40, 60, "3.5 kg"),
        (30, 0, "REVISION SCHEDULE"), (20, 0, "8 mm"), (20, 10, "1 mm"), (20, 20, "1 kg"),
    ]
    df = spark.createDataFrame([("p", "L1", float(y), float(x), t) for y, x, t in cells], "path string, layout string, y double, x double, text string")
    blocks = schedules.segment_blocks(df)
    rows = {r.mark: r for r in schedules.parse_table_blocks(blocks).collect()}
    assert set(rows) == {"A", "B"}
    a, b = rows["A"], rows["B"]
    assert (a.panel, a.subsheet, a.dia_mm, a.quantity, a.bar_length_mm, a.total_length_mm, a.weight_kg, a.segments) == ("PW-01", "WALL", 8, 3, 0.0, 900.0, 1.5, {"A": 100.0})
    assert (b.total_length_mm, b.segments) == (500.0, {})
    summary = sorted((r.dia or 0, r.length_mm, r.weight_kg, r.panel) for r in schedules.parse_summary_blocks(blocks).collect())
    assert summary == [(0, 1900.0, 3.5, "PW-01"), (8, 900.0, 1.5, "PW-01")]


def test_revision_table_goes(spark):
    heads = [(10.0 * i, 50.0, h) for i, h in enumerate(schedules.REVISION_HEADERS)]
    rows = [("p", "L", y, x, t) for x, y, t in [*heads, (20.0, 40.0, "gone"), (100.0, 40.0, "stays")]]
    kept = schedules.drop_revision_table(spark.createDataFrame(rows, "path string, layout string, y double, x double, text string"))
    assert [r.text for r in kept.collect()] == ["stays"]


def test_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("P1", 8, 90.0, 100.0), ("P1", 12, 5.0, 0.0), ("P2", 8, 0.0, 0.0)], "panel string, dia int, recon double, official double")
    schedules.write_reports(schedules.report_lines(rows), f"{tmp_path}/r")
    got = sorted(map(tuple, schedules.read_reports(spark, f"{tmp_path}/r").select("panel", "dia", "recon", "official", "gap", "pct").collect()))
    assert got == [("P1", 8, 90.0, 100.0, -10.0, "90%"), ("P1", 12, 5.0, 0.0, 5.0, "extra"), ("P2", 8, 0.0, 0.0, 0.0, "-")]


def test_precedence(spark):
    rows = [("P", "pdf", 1.0, "x"), ("P", "sheet", 30.0, "y"), ("P", "own", None, "z"), ("Q", "pdf", 2.0, "x"), ("Q", "pdf", 2.0, "y")]
    df = spark.createDataFrame(rows, "panel string, source string, age_days double, v string")
    got = schedules.precedence(df, ["panel"], ["sheet", "own", "pdf"]).select("panel", "source", "v").collect()
    assert sorted(map(tuple, got)) == [("P", "own", "z"), ("Q", "pdf", "x"), ("Q", "pdf", "y")]


def test_panel_documents(spark, tmp_path):
    doc = {
        "name": "P", "width": 10.0, "height": 5.0, "thickness": 1.0, "openings": [[[0, 0], [1, 1]]],
        "bars": [{"d": 8, "kind": "tie", "z_src": "section", "pts": [[0.25, 1, 2], [3.35, 1, 2]]}], "stats": {"n": 1}, "families": [], "features": [{"kind": "box", "center": [1, 2]}],
    }
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    panels = schedules.read_panels(spark, f"{tmp_path}/p.json")
    (bar,) = schedules.panel_bars(panels).collect()
    assert (bar.name, bar.d, bar.points[0].z) == ("P", 8, 2.0)
    schedules.write_panels(panels, f"{tmp_path}/out")
    again = spark.read.schema(schedules.PANEL).json(f"{tmp_path}/out").first()
    assert [p[0] for p in again.bars[0].pts] == [0.2, 3.4]  # half-even on the decimal digits
    (tmp_path / "q.json").write_text("{}")
    found = tables.models_with_keys(spark, f"{tmp_path}/*.json", ["name", "bars"]).collect()
    assert len(found) == 1 and found[0].path.endswith("p.json")


def test_ocr_and_families(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"tables": [{"title": "T", "headers": ["a", "b"], "rows": [["1"], ["1", "2", "3"]]}]}))
    assert [r.cells for r in schedules.read_ocr(spark, f"{tmp_path}/o.json").orderBy("row_no").collect()] == [["1", ""], ["1", "2"]]
    (tmp_path / "f.csv").write_text('family_name,block_name,copies,avg_spacing,length,width,height,orientation,bbox,center,instance_ids\nF,B,2,150.5,1,2,3,H,"[0.0, 1.0]","[0.5]","[""x"", ""y""]"\n')
    row = schedules.block_families(spark, f"{tmp_path}/f.csv").first()
    assert (row.bbox, row.instance_ids, row.copies) == ([0.0, 1.0], ["x", "y"], 2)


def test_sheet_and_fallback(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,name,date,in,out\nE1,Ann,2024-01-02,09:00:00,\n,skip,2024-01-02,,\nE2,Bo,bad,,17:00:00\n")
    rows = tables.read_sheet_csv(spark, f"{tmp_path}/s.csv").collect()
    assert [(r.employee_id, r.in_time, r.out_time, str(r.date)) for r in rows] == [("E1", "09:00:00", None, "2024-01-02"), ("E2", None, "17:00:00", "None")]
    made = tables.with_fallback(None, lambda: tables.generate_attendance(spark, "2024-01-26", ["Ann", "Bo", "Cy"]))
    got = made.collect()
    assert got and {r.source for r in got} == {"generated"} and all(r.date.weekday() < 5 for r in got)
    assert all("08:00:00" <= r.in_time < "09:00:00" and (r.out_time is None or "17:00:00" <= r.out_time < "19:00:00") for r in got)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(made.collect()) == key(got)


def test_registry_and_images(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"b": {"name": "Bo"}, "a": {"name": "Ann"}}, indent=2))
    registry = tables.read_registry(spark, f"{tmp_path}/r.json")
    tables.write_registry(registry, f"{tmp_path}/out")
    text = spark.read.text(f"{tmp_path}/out").first().value
    assert text == '{"a":{"name":"Ann"},"b":{"name":"Bo"}}'
    for folder, n in (("a", 2), ("c", 1)):
        (tmp_path / "img" / folder).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "img" / folder / f"{i}.JPG").write_bytes(b"x")
    (tmp_path / "img" / "a" / "note.txt").write_text("x")
    images = tables.scan_images(spark, f"file://{tmp_path}/img")
    assert [tuple(r) for r in tables.photo_counts(registry, images).collect()] == [("a", "Ann", 2), ("b", "Bo", 0)]
    cache = images.where("folder = 'a'").select("path", "mtime").withColumn("vector", F.lit(1))
    good, stale = tables.stale_entries(images, cache)
    assert (good.count(), [r.folder for r in stale.collect()]) == (2, ["c"])
    known = tables.resolve_names(images.select(F.col("folder").alias("employee_id")).distinct(), registry)
    assert sorted((r.employee_id, r.name, r.auto_registered) for r in known.collect()) == [("a", "Ann", False), ("c", "c", True)]


def test_upsert_into_book(spark):
    schema = "employee_id long, day string, in_time string, out_time string"
    book = spark.createDataFrame([(1, "d1", "", "17:00:00"), (1, "d2", "08:00:00", None)], schema)
    new = spark.createDataFrame([(1, "d1", "09:00:00", None), (1, "d2", "09:30:00", "18:00:00"), (2, "d1", None, "12:00:00")], schema)
    got = {(r.employee_id, r.day): (r.in_time, r.out_time, r.changed) for r in tables.upsert_rows(book, new).collect()}
    assert got == {(1, "d1"): ("09:00:00", "17:00:00", True), (1, "d2"): ("08:00:00", "18:00:00", True), (2, "d1"): (None, "12:00:00", True)}
    again = spark.createDataFrame([(*k, *v[:2]) for k, v in got.items()], schema)
    assert not any(r.changed for r in tables.upsert_rows(again, new.where("employee_id = 1 and day = 'd1'")).collect())


def test_source_ranking(spark):
    rows = [("/x/PW-01.pdf", "PW-01", 50.0), ("/x/PW-01 (S).pdf", "PW-01 (S)", 99.0), ("/x/PW-01 b.pdf", "PW-01 b", 99.0), ("/x/other.pdf", "other", 100.0)]
    ranked = tables.rank_sources(spark.createDataFrame(rows, "path string, stem string, mtime double"), "PW-01", 100.0, "PW-01").orderBy("rank").collect()
    assert [r.stem for r in ranked] == ["PW-01", "PW-01 (S)", "PW-01 b"]
    sheets = spark.createDataFrame([("/d/PW-01(R2).dwg",), ("/d/PW-01(R).dwg",), ("/d/PW-01(S).dwg",)], "path string")
    assert sorted((r.panel, r.revision or 0) for r in tables.sheet_sets(sheets).collect()) == [("PW-01", 0), ("PW-01", 2)]
    docs = tables.locate_documents(spark.createDataFrame([("PW-01",), ("PW-09",)], "panel string"), spark.createDataFrame([("/d/PW-01 .pdf",)], "path string"))
    assert {r.panel: r.path for r in docs.collect()} == {"PW-01": "/d/PW-01 .pdf", "PW-09": None}


def test_sheets_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "T"), (2, "T"), (3, "U")], "i long, base string")
    tables.write_sheets(tables.unique_titles(df, "base", "i").select("sheet", "i"), f"{tmp_path}/book")
    assert sorted(p.name for p in (tmp_path / "book").iterdir() if p.is_dir()) == ["sheet=T", "sheet=T_2", "sheet=U"]
    before, after = (spark.createDataFrame([(x,) for x in xs], "path string") for xs in (["a"], ["a", "b"]))
    assert [r.path for r in tables.new_files(before, after).collect()] == ["b"]


def test_gate_log(spark):
    lines = spark.createDataFrame([("[mirror] synced E-1 (in) at 09:00:01",), ("GET / 200",)], "value string")
    assert [tuple(r) for r in schedules.gate_log(lines).collect()] == [("E-1", "in", "09:00:01")]
