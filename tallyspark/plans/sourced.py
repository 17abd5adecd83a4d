"""Source and sink queries: texts, layouts, drawings and files are made from the driver's tables and read
back by the readers, so the SQL can say what must come out.

Files go below the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.functions.text import base_name
from tallyspark.session import shared_dir
from tallyspark.sources import dxf as D
from tallyspark.sources import schedules as H
from tallyspark.sources import tables as S
from tallyspark.sources.tables import table

REQUIRED = ("name", "bars", "stats")


def scratch(spark, label):
    return f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"


def part(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.withColumns({"k": F.col("p_partkey"), "s": F.col("p_size"), "price": F.round("p_retailprice", 1), "path": F.concat(F.lit("P"), F.col("p_partkey").cast("string"))})


def text(*pieces):
    return F.concat(*(F.lit(p) if p[:1] != "$" else F.col(p[1:]).cast("string") for p in pieces))


# --- schedules as text ----------------------------------------------------------------------------


def pdf_summary_rows(spark, sf_dir):
    body = F.concat(text("x\n", "$s", " mm 9 mm 1 kg "), F.when(F.col("k") % 3 > 0, "SUMMARY  Schedule\n").otherwise("notes\n"), text("$s", " mm "), F.format_number("price", 1), text(" mm\n", "$s", ".5 kg end"))
    texts = part(spark, sf_dir).select("path", (F.col("k") % 2 + 1).alias("page"), body.alias("text"))
    return H.pdf_summary(texts)


def _mark():
    return F.concat(F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("k") % 5).cast("int") + 1), (F.col("k") % 100).cast("string"))


def pdf_flowed_rows(spark, sf_dir):
    line = F.concat(F.lit("Schedule 1\n  "), _mark(), text(" T", "$s", " 4 <varies> 1,200.5 "), F.col("k").cast("string"), text(" ", "$s", "00\nnot a row T8\n"))
    out = H.pdf_itemized(part(spark, sf_dir).select("path", line.alias("text")))
    return out.select("path", "mark", "dia", "qty", F.array_join(F.transform("segments", lambda v: v.cast("decimal(18,1)")), "+").alias("segments"), "length_mm", "total_length_mm")


def pdf_cell_lines(spark, sf_dir):
    cells = F.concat(F.lit("title\n"), _mark(), text("\nT", "$s", "\n7\n", "$s", "0\n-\n<varies>\n-\n1,000\n"), F.col("k").cast("string"), text("\n", "$s", "5\nend\n"))
    out = H.pdf_cell_rows(part(spark, sf_dir).select("path", cells.alias("text")))
    return out.select("path", "mark", "dia", "qty", F.array_join(F.transform("segments", lambda v: v.cast("decimal(18,1)")), "+").alias("segments"), "length_mm", "total_length_mm")


def office_rows(spark, sf_dir):
    good = F.concat(text(" ", "$k", " ", "$p_name", " bars "), F.when(F.col("k") % 2 == 0, "-").otherwise(F.lit("150")), text(" ", "$s", " 12 ", "$s", "0 - 2.5 - - 1 3.5 42 0.395 ", "$s", ".25"))
    line = F.when(F.col("k") % 7 == 0, F.lit("TOTAL 12 3 4")).otherwise(good)
    out = H.office_lines(part(spark, sf_dir).select("path", line.alias("line")))
    return out.select("path", "sno", "desc", "spacing", "dia", "nos", F.size("segments").alias("n_segments"), F.element_at("segments", 1).alias("first"), "length_m", "total_length_m", "weight_kg")


# --- layouts --------------------------------------------------------------------------------------


def _sheet(spark, sf_dir):
    """Entities of one sheet a brand: an item table, a summary of sizes up to 50, a revision table, and texts
    that are none of them."""
    from pyspark.sql import Window

    rows = part(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("k")))
    last = rows.groupBy("p_brand").agg(F.max("i").alias("n"))

    def cells(df, y, *pairs):
        made = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), t.cast("string").alias("text")) for x, t in pairs))).alias("c")
        return df.select(F.col("p_brand").alias("path"), (y * 1.0).alias("y"), made).select("path", "y", "c.x", "c.text")

    y = F.lit(980) - F.col("i") * 10
    one = F.when(F.col("k") % 6 == 0, F.lit(None)).otherwise(_mark())
    body = cells(rows, y, (1, one), (49, F.col("s")), (101, F.lit("3")), (150, F.when(F.col("k") % 2 == 0, "<varies>").otherwise(F.col("k").cast("string"))), (199, F.format_number("price", 1)), (240, F.lit("far")), (300, text("$s", ".5")))
    head = cells(last, F.lit(980), (0, F.lit("Mark")), (50, F.lit("Dia")), (100, F.lit("Qty")), (150, F.lit("A")), (200, F.lit("Bar Length")), (300, F.lit("Weight")))
    title = cells(last, F.lit(1000), (0, text("Rebar Schedule for ", "$p_brand", " (Wall)")))
    below = F.lit(900) - F.col("n") * 10
    summary = cells(last, below, (0, F.lit("Summary Schedule")))
    sizes = rows.groupBy("p_brand", "s").agg(F.count(F.lit(1)).alias("c")).join(last, "p_brand")
    lines = cells(sizes, below - F.col("s") * 10, (0, text("$s", " mm")), (60, text("$c", " mm")), (120, text("$c", ".25 kg")))
    grand = cells(last, below - 700, (60, text("$n", "0 mm")), (120, text("$n", " kg")))
    stop = cells(last, below - 800, (0, F.lit("Revision Schedule")))
    after = cells(last, below - 810, *((20 * i, F.lit(t)) for i, t in enumerate(H.REVISION_HEADERS)))
    every = title
    for more in (head, body, summary, lines, grand, stop, after):
        every = every.unionByName(more)
    every = every.where(F.col("text").isNotNull()).select("path", F.lit("Layout1").alias("layout"), F.lit("MTEXT").alias("kind"), F.lit(H.SCHEDULE_LAYER).alias("layer"), "x", "y", "text")
    other = rows.select(F.col("p_brand").alias("path"), F.when(F.col("k") % 2 == 0, "Model").otherwise(F.lit("Layout1")).alias("layout"), F.lit("TEXT").alias("kind"), F.when(F.col("k") % 3 == 0, H.IDENTIFIER_LAYER).otherwise(F.lit("A-WALL")).alias("layer"), F.col("k").cast("double").alias("x"), F.col("s").cast("double").alias("y"), F.col("p_name").alias("text"))
    return every.unionByName(other)


def _blocks(spark, sf_dir):
    return H.segment_blocks(H.layout_cells(_sheet(spark, sf_dir)))


def layout_items(spark, sf_dir):
    out = H.parse_table_blocks(_blocks(spark, sf_dir))
    return out.select("panel", "subsheet", "mark", "dia_mm", "quantity", "bar_length_mm", "total_length_mm", "weight_kg", F.try_element_at("segments", F.lit("A")).alias("a"))


def layout_summaries(spark, sf_dir):
    return H.parse_summary_blocks(_blocks(spark, sf_dir)).select("panel", "dia", "length_mm", "weight_kg")


def layout_block_sizes(spark, sf_dir):
    """How many cells each block has, in reading order."""
    return _blocks(spark, sf_dir).groupBy("path", "block", "kind", "panel").agg(F.count(F.lit(1)).alias("n"))


def revision_cells_dropped(spark, sf_dir):
    return H.drop_revision_table(H.layout_cells(_sheet(spark, sf_dir))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def identifier_rows(spark, sf_dir):
    return H.identifier_texts(_sheet(spark, sf_dir)).select("path", "layout", "x", "y", "text")


def block_census(spark, sf_dir):
    entities = part(spark, sf_dir).select(F.col("p_type").alias("block"), (F.col("k") % 40 - 1).cast("int").alias("bref"))
    return D.block_counts(entities)


def drawing_entities(spark, sf_dir):
    """One drawing a brand is written and read: a line and a text for each of its parts, in blocks of two that are
    inserted at the part's place."""
    piece = F.concat(text("0\nLINE\n8\nL", "$s", "\n10\n0\n20\n0\n11\n", "$s", "\n21\n"), (F.col("k") % 9).cast("string"), text("\n0\nTEXT\n8\nS-RBAR-IDEN\n10\n", "$k", "\n20\n", "$s", "\n1\n", "$p_name", "\n0\nINSERT\n2\nMark\n8\n0\n10\n", "$k", "\n20\n5\n"))
    start = "0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nMark\n10\n1\n20\n0\n0\nCIRCLE\n8\nC\n10\n2\n20\n0\n40\n3\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("piece")))), lambda p: p["piece"]), "")
    files = part(spark, sf_dir).groupBy("p_brand").agg(F.concat(F.lit(start), pieces, F.lit("0\nENDSEC\n0\nEOF")).alias("value"))
    folder = scratch(spark, "drawings")
    files.repartition("p_brand").write.partitionBy("p_brand").text(folder)
    rows = D.read_dxf(spark, f"{folder}/*")
    brand = F.regexp_replace(F.regexp_extract("path", "p_brand=([^/]*)/", 1), "%23", "#")
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    place = F.when(F.col("kind") == "LINE", F.concat_ws(",", first["x"].cast("long"), last["x"].cast("long"), last["y"].cast("long"))).otherwise(F.concat_ws(",", F.col("x").cast("long"), F.col("y").cast("long"), F.col("radius").cast("long")))
    return rows.select(brand.alias("brand"), "kind", "layer", "text", "block", place.alias("place"))


def drawing_boxes(spark, sf_dir):
    """Boxes of a panel's drawn entities by kind, over points, centres and radii."""
    k, s = F.col("k").cast("double"), F.col("s").cast("double")
    points = F.when(F.col("k") % 2 == 0, F.array(F.struct(k.alias("x"), s.alias("y")), F.struct((k + 5).alias("x"), (s * 2).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    round_ = F.col("k") % 2 == 1
    rows = part(spark, sf_dir).select("p_brand", points.alias("points"), F.when(round_, k).alias("x"), F.when(round_, s).alias("y"), F.when(round_, s / 2).alias("radius"))
    return D.bounding_boxes(rows, ["p_brand"])


# --- files ----------------------------------------------------------------------------------------


def panel_documents(spark, sf_dir):
    """Panels written as JSON documents and read back as one row a bar."""
    point = F.array(F.col("k") / 8.0, F.col("s") * 1.25)
    bar = F.struct(F.col("s").alias("d"), F.col("p_type").alias("kind"), F.lit("section").alias("z_src"), F.array(point, F.array(F.col("k") * 1.0, F.lit(0.0), F.lit(7.5))).alias("pts"))
    panels = part(spark, sf_dir).groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_list(F.struct("k", bar.alias("bar")))).alias("all"))
    panels = panels.select("name", F.lit(1000.0).alias("width"), F.transform("all", lambda b: b["bar"]).alias("bars"))
    folder = scratch(spark, "panels")
    H.write_panels(panels, folder)
    out = H.panel_bars(H.read_panels(spark, folder))
    return out.select("name", "bar_no", "d", "kind", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"), F.col("points")[1]["z"].alias("z"))


def printed_reports(spark, sf_dir):
    """Weight reports printed per panel, in the order of diameters, and read back."""
    sums = part(spark, sf_dir).groupBy(F.col("p_brand").alias("panel"), F.col("s").alias("dia")).agg(F.sum(F.col("k") % 50).cast("double").alias("recon"), F.sum(F.col("k") % 3 * 40).cast("double").alias("official"))
    folder = scratch(spark, "reports")
    H.write_reports(H.report_lines(sums), folder)
    return H.read_reports(spark, folder).select(F.regexp_replace("panel", "%23", "#").alias("panel"), "dia", "recon", "official", "gap", "pct")


def registry_file(spark, sf_dir):
    """A registry written as one JSON object, read again and used to name orders' customers."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("employee_id"), F.col("c_name").alias("name"))
    folder = scratch(spark, "registry")
    S.write_registry(known, folder)
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("employee_id"))
    return S.resolve_names(found, S.read_registry(spark, folder))


def sheet_file(spark, sf_dir):
    """Attendance written as a sheet with a header row and read back; blank ids go, blank times are null."""
    e = table(spark, sf_dir, "orders")
    who = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("E"), F.col("o_custkey").cast("string")))
    clock = F.format_string("%02d:00:00", (F.col("o_orderkey") % 24).cast("int"))
    rows = e.select(who.alias("ID"), F.col("o_orderpriority").alias("Name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.when(F.col("o_orderkey") % 5 > 0, clock).otherwise("").alias("In"), F.when(F.col("o_orderkey") % 3 > 0, clock).otherwise("").alias("Out"))
    folder = scratch(spark, "sheet")
    S.write_csv(rows, folder)
    back = S.with_fallback(lambda: S.read_sheet_csv(spark, folder), lambda: S.generate_attendance(spark, "2024-01-10", ["a"]))
    return back.select("employee_id", "name", F.col("date").cast("string").alias("date"), "in_time", "out_time", "source")


PEOPLE = ("Ada", "Ben", "Cho", "Dee", "Eli")


def generated_attendance(spark, sf_dir):
    """The seeded sheet that stands in where none is configured."""
    out = S.with_fallback(None, lambda: S.generate_attendance(spark, "2024-01-10", PEOPLE, days=60))
    return out.select("employee_id", "name", F.col("date").cast("string").alias("date"), "in_time", "out_time", "source")


def cached_totals(spark, sf_dir):
    """Totals asked for four times: built, read from the cache, built anew when that is too old, and read once
    more when a later build fails."""
    folder = scratch(spark, "cache")

    def totals(status):
        return lambda: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))

    def broken():
        raise OSError("no source")

    asked = [(0, totals("F")), (29, broken), (30, totals("O")), (90, broken)]
    out = [S.cached(spark, folder, build, 1_700_000_000 + at).withColumn("asked_at", F.lit(at)) for at, build in asked]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def sheets_apart(spark, sf_dir):
    """Rows written to one sheet a title, whose names are made unique, and counted from the files."""
    titles = table(spark, sf_dir, "part").select(F.substring("p_name", 1, 3).alias("base"), "p_type")
    folder = scratch(spark, "sheets")
    S.write_sheets(S.unique_titles(titles.groupBy("base", "p_type").agg(F.count(F.lit(1)).alias("rows")), "base", "p_type"), folder)
    return spark.read.option("header", True).csv(folder).select(F.col("sheet").cast("string").alias("sheet"), "p_type", F.col("rows").cast("long").alias("n"))


def models_listed(spark, sf_dir):
    """JSON files that hold all required keys, among files that lack some or are no objects."""
    kind = F.col("p_size") % 4
    full = F.when(kind == 0, "[1]").when(kind == 1, '{"name": 1, "bars": []}').otherwise('{"stats": {}, "bars": [], "name": "x", "more": 0}')
    folder = scratch(spark, "models")
    files = table(spark, sf_dir, "part").select("p_size", full.alias("value")).distinct()
    files.repartition("p_size").write.partitionBy("p_size").text(folder)
    return S.models_with_keys(spark, folder, REQUIRED).select(F.regexp_extract("path", "/p_size=([0-9]+)/", 1).cast("int").alias("size"))


def ranked_sources(spark, sf_dir):
    """Candidate files of one drawing, the best first."""
    stem = F.concat(F.when(F.col("k") % 3 == 0, F.lit("PW-01")).when(F.col("k") % 3 == 1, F.lit("X PW-01")).otherwise(F.lit("other")), F.when(F.col("k") % 2 == 0, " (S)").otherwise(""))
    files = part(spark, sf_dir).select("path", stem.alias("stem"), (F.col("k") * 7 % 1000).cast("double").alias("mtime"))
    return S.rank_sources(files, "PW-01", 500.0, "PW-01").select("path", "rank")


def sheet_set_rows(spark, sf_dir):
    name = F.concat(F.lit("/in/"), F.col("path"), F.when(F.col("k") % 3 == 0, " (R)").when(F.col("k") % 3 == 1, F.concat(F.lit("(R"), F.col("s").cast("string"), F.lit(")"))).otherwise(""), F.lit(".dwg"))
    return S.sheet_sets(part(spark, sf_dir).select(name.alias("path"))).select("panel", "revision")


def located_documents(spark, sf_dir):
    rows = part(spark, sf_dir)
    ending = F.when(F.col("k") % 3 == 0, ".dwg").when(F.col("k") % 2 == 0, " .pdf").otherwise(".pdf")
    files = rows.select(F.concat(F.lit("/docs/"), F.col("path"), ending).alias("path"))
    return S.locate_documents(rows.select(F.col("path").alias("panel")), files)


def photo_count_rows(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("name"))
    return S.photo_counts(registry, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("folder"))).select("employee_id", "photo_count")


def encoding_cache(spark, sf_dir):
    """Images whose cached vectors are still good, and those to encode anew."""
    images = part(spark, sf_dir).select("path", (F.col("k") % 5).alias("mtime"))
    cache = part(spark, sf_dir).where("s > 10").select("path", (F.col("k") % 5 + F.when(F.col("k") % 4 == 0, 1).otherwise(0)).alias("mtime"), F.col("s").alias("vector"))
    good, stale = S.stale_entries(images, cache)
    return good.select("path", F.lit("good").alias("state")).unionByName(stale.select("path", F.lit("stale").alias("state")))


def gate_lines(spark, sf_dir):
    """Arrivals and departures from a log among other lines."""
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("12:00 synced E"), F.col("user_id"), F.lit(" (in) at "), F.date_format("ts", "HH:mm:ss"))).when(F.col("event_type") == "view", F.concat(F.lit("synced "), F.col("user_id"), F.lit(" (out) at "), F.date_format("ts", "HH:mm:ss"), F.lit(" ok"))).otherwise("error: synced nothing")
    return H.gate_log(table(spark, sf_dir, "events").select(line.alias("value")))


def panels_by_sheet(spark, sf_dir):
    """Items grouped by the sheet that names them, in the order of printing."""
    rows = part(spark, sf_dir).select(base_name(F.concat("p_brand", F.lit(" ("), F.col("p_type"), F.lit(")"))).alias("panel"), "p_type", "s")
    return rows.groupBy("panel", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total")).orderBy("panel", "p_type")


QUERIES = {f.__name__: f for f in (pdf_summary_rows, pdf_flowed_rows, pdf_cell_lines, office_rows, layout_items, layout_summaries, layout_block_sizes, revision_cells_dropped, identifier_rows, block_census, drawing_entities, drawing_boxes, panel_documents, printed_reports, registry_file, sheet_file, generated_attendance, cached_totals, sheets_apart, models_listed, ranked_sources, sheet_set_rows, located_documents, photo_count_rows, encoding_cache, gate_lines, panels_by_sheet)}

_P = "p AS (SELECT *, p_partkey AS k, p_size AS s, ROUND(p_retailprice, 1) AS price, 'P' || p_partkey AS path, ['A', 'B', 'C', 'D', 'E'][CAST(p_partkey % 5 AS INT) + 1] || p_partkey % 100 AS mark FROM part)"
_CELLS = "n AS (SELECT p_brand, COUNT(*) AS n, COUNT(*) FILTER (WHERE p_partkey % 6 = 0) AS unmarked, COUNT(DISTINCT p_size) AS sizes FROM part GROUP BY 1)"
ORACLES = {
    "pdf_summary_rows": f"WITH {_P} SELECT path, s AS dia, price AS length_mm, s + 0.5::DOUBLE AS weight_kg FROM p WHERE k % 2 = 0 AND k % 3 > 0",
    "pdf_flowed_rows": f"WITH {_P} SELECT path, mark, s AS dia, 4 AS qty, '0.0+1200.5' AS segments, CAST(k AS DOUBLE) AS length_mm, s * 100.0::DOUBLE AS total_length_mm FROM p",
    "pdf_cell_lines": f"WITH {_P} SELECT path, mark, s AS dia, 7 AS qty, s || '0.0+0.0+1000.0' AS segments, CAST(k AS DOUBLE) AS length_mm, s * 10 + 5.0::DOUBLE AS total_length_mm FROM p",
    "office_rows": f"""WITH {_P} SELECT path, CAST(k AS INT) AS sno, p_name || ' bars' AS "desc", CASE WHEN k % 2 > 0 THEN 150 END AS spacing, s AS dia, 12 AS nos, 3 AS n_segments, s * 10.0::DOUBLE AS first, 3.5::DOUBLE AS length_m, 42.0::DOUBLE AS total_length_m, s + 0.25::DOUBLE AS weight_kg FROM p WHERE k % 7 > 0""",
    "layout_items": f"WITH {_P} SELECT p_brand AS panel, 'Wall' AS subsheet, mark, s AS dia_mm, 3 AS quantity, price AS bar_length_mm, price AS total_length_mm, s + 0.5::DOUBLE AS weight_kg, CASE WHEN k % 2 = 0 THEN 0.0::DOUBLE ELSE CAST(k AS DOUBLE) END AS a FROM p WHERE k % 6 > 0",
    "layout_summaries": "SELECT p_brand AS panel, p_size AS dia, CAST(COUNT(*) AS DOUBLE) AS length_mm, COUNT(*) + 0.25::DOUBLE AS weight_kg FROM part WHERE p_size <= 50 GROUP BY 1, 2 UNION ALL SELECT p_brand, NULL, COUNT(*) * 10.0::DOUBLE, CAST(COUNT(*) AS DOUBLE) FROM part GROUP BY 1",
    "layout_block_sizes": f"WITH {_CELLS} SELECT p_brand AS path, CAST(1 AS BIGINT) AS block, 'table' AS kind, p_brand AS panel, 6 + 7 * n - unmarked AS n FROM n UNION ALL SELECT p_brand, 2, 'summary', p_brand, sizes * 3 + 2 FROM n",
    "revision_cells_dropped": f"WITH {_CELLS} SELECT p_brand AS path, 5 * n + 4 + sizes + 1 AS n FROM n",
    "identifier_rows": "SELECT p_brand AS path, CASE WHEN p_partkey % 2 = 0 THEN 'Model' ELSE 'Layout1' END AS layout, CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_name AS text FROM part WHERE p_partkey % 3 = 0",
    "block_census": "SELECT p_type AS block, COUNT(DISTINCT p_partkey % 40) AS instances, COUNT(*) AS entities FROM part WHERE p_partkey % 40 > 0 GROUP BY 1",
    "drawing_entities": f"""WITH {_P} SELECT p_brand AS brand, 'LINE' AS kind, 'L' || s AS layer, NULL AS text, NULL AS block, '0,' || s || ',' || k % 9 AS place FROM p UNION ALL SELECT p_brand, 'TEXT', 'S-RBAR-IDEN', p_name, NULL, k || ',' || s FROM p UNION ALL SELECT p_brand, 'CIRCLE', 'C', NULL, 'Mark', (k + 1) || ',5,3' FROM p""",
    "drawing_boxes": f"""WITH {_P} SELECT p_brand, MIN(CASE WHEN k % 2 = 0 THEN k ELSE k - s / 2.0::DOUBLE END) AS x0, MIN(CASE WHEN k % 2 = 0 THEN s ELSE s - s / 2.0::DOUBLE END) AS y0, MAX(CASE WHEN k % 2 = 0 THEN k + 5 ELSE k + s / 2.0::DOUBLE END) AS x1, MAX(CASE WHEN k % 2 = 0 THEN s * 2 ELSE s + s / 2.0::DOUBLE END) AS y1, COUNT(*) AS n FROM p GROUP BY 1""",
    "panel_documents": f"WITH {_P} SELECT p_brand AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY k) - 1 AS INT) AS bar_no, s AS d, p_type AS kind, round_even(k / 8.0::DOUBLE, 1) AS x, round_even(s * 1.25::DOUBLE, 1) AS y, 7.5::DOUBLE AS z FROM p",
    "printed_reports": f"""WITH {_P}, t AS (SELECT p_brand AS panel, s AS dia, CAST(SUM(k % 50) AS DOUBLE) AS recon, CAST(SUM(k % 3 * 40) AS DOUBLE) AS official FROM p GROUP BY 1, 2)
        SELECT panel, dia, recon, official, recon - official AS gap, CASE WHEN official = 0 AND recon > 0 THEN 'extra' WHEN official = 0 THEN '-' ELSE CAST(round_even(100 * recon / official, 0) AS BIGINT) || '%' END AS pct FROM t""",
    "registry_file": "SELECT CAST(c_custkey AS VARCHAR) AS employee_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS name, NOT c_acctbal > 0 AS auto_registered FROM customer",
    "sheet_file": "SELECT 'E' || o_custkey AS employee_id, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 5 > 0 THEN format('{:02d}:00:00', o_orderkey % 24) END AS in_time, CASE WHEN o_orderkey % 3 > 0 THEN format('{:02d}:00:00', o_orderkey % 24) END AS out_time, 'sheet' AS source FROM orders WHERE o_orderkey % 11 > 0",
    "generated_attendance": f"""WITH d AS (SELECT format('E{{:03d}}', i) AS id, [{", ".join(f"'{n}'" for n in PEOPLE)}][i] AS name, CAST(DATE '2024-01-10' - CAST(j AS INT) AS DATE) AS day FROM range(1, {len(PEOPLE) + 1}) p(i), range(0, 60) q(j)),
        r AS (SELECT *, list_transform(range(1, 5), lambda k: CAST('0x' || substr(md5(id || '|' || strftime(day, '%Y-%m-%d') || '|1|' || k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS r FROM d WHERE isodow(day) < 6),
        t AS (SELECT *, CAST(floor(28800 + r[2] * 3600) AS BIGINT) AS a, CAST(floor(61200 + r[3] * 7200) AS BIGINT) AS b FROM r WHERE r[1] >= 0.12)
        SELECT id AS employee_id, name, strftime(day, '%Y-%m-%d') AS date, format('{{:02d}}:{{:02d}}:{{:02d}}', a // 3600, a % 3600 // 60, a % 60) AS in_time, CASE WHEN NOT (day = DATE '2024-01-10' AND r[4] < 0.4) THEN format('{{:02d}}:{{:02d}}:{{:02d}}', b // 3600, b % 3600 // 60, b % 60) END AS out_time, 'generated' AS source FROM t""",
    "cached_totals": "SELECT o_orderpriority, COUNT(*) AS n, a AS asked_at FROM orders, (VALUES (0, 'F'), (29, 'F'), (30, 'O'), (90, 'O')) t(a, s) WHERE o_orderstatus = s GROUP BY 1, 3",
    "sheets_apart": "WITH g AS (SELECT substr(p_name, 1, 3) AS base, p_type, COUNT(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_type) AS i FROM g) SELECT CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS sheet, p_type, n FROM r",
    "models_listed": "SELECT DISTINCT p_size AS size FROM part WHERE p_size % 4 > 1",
    "ranked_sources": "SELECT 'P' || k AS path, CAST(row_number() OVER (ORDER BY CASE WHEN k % 3 = 0 AND k % 2 > 0 THEN 0 ELSE 1 END, abs(k * 7 % 1000 - 500), k % 2, 'P' || k) AS INT) AS rank FROM (SELECT p_partkey AS k FROM part) WHERE k % 3 < 2",
    "sheet_set_rows": "SELECT 'P' || p_partkey AS panel, CASE WHEN p_partkey % 3 = 1 THEN p_size END AS revision FROM part WHERE p_partkey % 3 < 2",
    "located_documents": "SELECT 'P' || p_partkey AS panel, CASE WHEN p_partkey % 3 > 0 THEN '/docs/P' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' .pdf' ELSE '.pdf' END END AS path FROM part",
    "photo_count_rows": "SELECT c_custkey AS employee_id, COUNT(o_orderkey) AS photo_count FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1",
    "encoding_cache": "SELECT 'P' || p_partkey AS path, CASE WHEN p_size > 10 AND p_partkey % 4 > 0 THEN 'good' ELSE 'stale' END AS state FROM part",
    "gate_lines": "SELECT CASE event_type WHEN 'click' THEN 'E' ELSE '' END || user_id AS employee_id, CASE event_type WHEN 'click' THEN 'in' ELSE 'out' END AS mode, strftime(ts, '%H:%M:%S') AS clock FROM events WHERE event_type IN ('click', 'view')",
    "panels_by_sheet": "SELECT p_brand AS panel, p_type, COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS total FROM part GROUP BY 1, 2",
}
