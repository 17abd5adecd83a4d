"""Text, JSON and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import calc as C
from tallyspark.functions import text as T
from tallyspark.operators.match import priority_pick
from tallyspark.plans.tallies import SCHED, sched
from tallyspark.sources import tables as S
from tallyspark.sources.tables import table


def regex_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    digits = F.regexp_count("text", F.lit("[0-9]+"))
    return docs.select("doc_id", digits.cast("long").alias("n_numbers"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).cast("long").alias("n_distinct"))


LABELS = ("T10 UBAR @ 200", "t8 @ 75", "T8 (both faces) @ 100", "U-Bar T8", "ubar", "2 - T10 TIES", "ties T8", "PARTIES", "12.5", "1.2.3", ".", "mark n12 here", "N3", "XN3", "none")


def regex_categories(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit(" T"), F.col("p_size"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" @ "), F.col("p_size"))).otherwise(""))
    label = F.when(F.col("p_size") % 5 == 0, F.concat(F.col("p_size"), F.lit(" - T8"))).when(F.col("p_size") % 7 == 0, F.col("p_size").cast("string")).otherwise(name)
    texts = F.array(label, *map(F.lit, LABELS))
    label = F.element_at(texts, (F.col("p_partkey") % (len(LABELS) + 1)).cast("int") + 1)
    rows = table(spark, sf_dir, "part").select(T.category(label).alias("category"), label.alias("label"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_distinct"))


CALLOUTS = (
    "(26)-(T8)", "-(61) -(T8 U Bar)", "12 - T10", "2 -T12 Crack Bar", "T12 @ 150mm", "T10 TIES @ 150mm", "t10 ubar @ 200 mm B1", "T8 Hook@125mm", "T12 @ 150",
    "T16", "t12", "A1", "AB1", "B", "b", "ABC", "2-(T 8)", "U-BAR T8", "  7  -  T20 ", "T8@100 mm C/C", "note", "", "see T8 Tie @ 75 mm\nside", "3-T16 crack bar",
)


def callout_grammar(spark, sf_dir):
    texts = F.array(*map(F.lit, CALLOUTS))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % len(CALLOUTS)).cast("int") + 1).alias("text"))
    parsed = rows.withColumn("c", T.callout(F.col("text")))
    return parsed.select("p_partkey", "c.*")


def bar_pitches(spark, sf_dir):
    texts = F.array(*map(F.lit, CALLOUTS))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % len(CALLOUTS)).cast("int") + 1).alias("text"))
    pitch, crack = T.bar_pitch(F.col("text")), T.crack_bars(F.col("text"))
    return rows.select("p_partkey", pitch["kind"].alias("kind"), pitch["dia"].alias("dia"), pitch["pitch"].alias("pitch"), crack["count"].alias("crack_count"), crack["dia"].alias("crack_dia"))


def whitespace_canon(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clean = F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))
    return docs.select("doc_id", F.length(clean).cast("long").alias("n_clean"), F.md5(clean).alias("digest"))


def num_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.parse_number(F.col("html")).alias("number"), T.parse_integer(F.col("url")).alias("url_number"))


def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rows.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.max("k").alias("k_max"), F.count("k").alias("n"))


def id_sanitise(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_name"), F.lit("/é ")).alias("raw"), "c_mktsegment")
    return rows.select("c_custkey", T.sanitize_id(F.col("raw")).alias("clean"), T.safe_name(F.col("raw")).alias("safe_raw"), T.safe_name(F.col("c_mktsegment")).alias("safe_segment"))


def sheet_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", T.sheet_name(F.concat(F.col("p_name"), F.lit(": [a/b] a rather long title"))).alias("base"))
    return S.unique_titles(rows, "base", "p_partkey")


def ragged_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("cells"), (F.col("p_size") % 4).cast("int").alias("width"))
    return rows.select("p_partkey", F.concat_ws("|", T.ragged_row(F.col("cells"), F.col("width"))).alias("row"))


def length_literals(spark, sf_dir):
    units = F.element_at(F.array(*map(F.lit, ("", "mm", "cm", "m", " ft", "'", "px"))), (F.col("p_partkey") % 7).cast("int") + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), units).alias("text"))
    return rows.select("p_partkey", F.round(T.length_literal_mm(F.col("text")), 3).alias("mm"))


def panel_names(spark, sf_dir):
    stem = F.concat(F.lit("P-"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" (R"), (F.col("p_size") % 3).cast("string"), F.lit(")"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.base_name(stem).alias("panel"), T.revision(stem).alias("revision"))


BLOCKS = ("CORBEL", "Wire Loop 80", "LoopBox", "Spread Anchor 2.5t", "RR-SA-10", "Stiffener Corbel", "C Channel", "Lifting-Anchor", "beam")


def block_kinds(spark, sf_dir):
    name = F.concat(F.col("p_type"), F.lit(" "), F.element_at(F.array(*map(F.lit, BLOCKS)), (F.col("p_partkey") % len(BLOCKS)).cast("int") + 1))
    kinds = T.block_kind(name).alias("kind"), T.block_kind(name, T.CAST_IN_KINDS).alias("cast_in")
    return table(spark, sf_dir, "part").groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))


def orientation_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    o = C.orientation(F.lit(0.0), F.lit(0.0), F.col("l_quantity") - 25, (F.col("l_suppkey") % 7 - 3).cast("double"), (F.col("l_linenumber") % 3).cast("int") + 1)
    b = C.box_orientation(F.col("l_quantity"), F.col("l_linenumber") * 10)
    return rows.groupBy(o.alias("orientation"), b.alias("box")).agg(F.count(F.lit(1)).alias("n"))


def measure_functions(spark, sf_dir):
    """Path, chord, bends, pitch counts, ladder, mirror and sweep on one row per part."""
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double")
    points = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(x.alias("x"), F.lit(0.0).alias("y")), F.struct(x.alias("x"), y.alias("y")))
    segments = F.array(x, y, x)
    return p.select(
        "p_partkey",
        F.round(C.polyline_length(points), 6).alias("path"),
        F.round(C.chord_length(points), 6).alias("chord"),
        F.round(C.bend_deduction(segments, F.lit(0.5)), 6).alias("cut"),
        C.count_by_pitch(x * 100, y + 1).alias("pieces"),
        C.ladder_at_least(x, (5.0, 10.0, 20.0, 40.0)).alias("scale"),
        C.mirror(x, 50.0).alias("mirrored"),
        C.arc_sweep(x * 10, y * 20).alias("sweep"),
        F.round(C.shoelace_area(points), 6).alias("area"),
        F.round(C.affine(x, 1.0, 50.0, -1.0, 1.0), 6).alias("scaled"),
    )


def source_precedence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ranked = docs.join(labels, "doc_id", "left").select("doc_id", "source", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), "n_chars")
    return priority_pick(ranked, ["source", "lang"], [F.col("quality").desc(), F.col("n_chars").desc(), F.col("doc_id")]).select("source", "lang", "doc_id", "quality")


def confidence_class(spark, sf_dir):
    weak = F.col("l_returnflag").isin("R", "A") & (F.col("l_linenumber") > 2)
    return sched(spark, sf_dir).groupBy("dia", F.when(weak, "low").otherwise("high").alias("conf")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (regex_counts, regex_categories, callout_grammar, bar_pitches, whitespace_canon, num_parse, json_props, id_sanitise, sheet_names, ragged_rows, length_literals, panel_names, block_kinds, orientation_counts, measure_functions, source_precedence, confidence_class)}


def _quoted(texts):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in texts)


_LABEL = "CASE WHEN p_size % 5 = 0 THEN p_size || ' - T8' WHEN p_size % 7 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name || ' T' || p_size || CASE WHEN p_size % 3 = 0 THEN ' @ ' || p_size ELSE '' END END"
_CALLS = f"list_extract([{_quoted(CALLOUTS)}], CAST(p_partkey % {len(CALLOUTS)} AS INT) + 1)"
_ANGLE = "((degrees(atan2(CAST(l_suppkey % 7 - 3 AS DOUBLE), l_quantity - 25)) % 180) + 180) % 180"
ORACLES = {
    "regex_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n_numbers, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS n_distinct FROM documents",
    "regex_categories": rf"""WITH r AS (SELECT list_extract([{_LABEL}, {_quoted(LABELS)}], CAST(p_partkey % {len(LABELS) + 1} AS INT) + 1) AS label FROM part)
        SELECT CASE WHEN regexp_matches(label, '[0-9]+\s*-\s*T[0-9]+') THEN 'count' WHEN regexp_matches(upper(label), 'T[0-9]+\s*[A-Z ]*@\s*[0-9]+') OR contains(label, '@') AND regexp_matches(upper(label), 'T[0-9]+') THEN 'pitch'
        WHEN contains(upper(label), 'UBAR') OR contains(upper(label), 'U-BAR') OR contains(upper(label), 'U BAR') THEN 'u-bar' WHEN contains(upper(label), 'TIE') THEN 'tie'
        WHEN regexp_full_match(label, '[0-9.]+') THEN 'number' WHEN regexp_matches(upper(label), '\bN[0-9]+\b') THEN 'Nn' ELSE 'other' END AS category, COUNT(*) AS n, COUNT(DISTINCT label) AS n_distinct FROM r GROUP BY 1""",
    "callout_grammar": rf"""WITH r AS (SELECT p_partkey, {_CALLS} AS t FROM part), f AS (SELECT p_partkey, trim(replace(t, chr(10), ' ')) AS flat, trim(regexp_replace(replace(replace(replace(t, chr(10), ' '), '(', ''), ')', ''), '\s+', ' ', 'g')) AS bare FROM r),
        k AS (SELECT *, regexp_extract(bare, '(?i)^-?\s*([0-9]+)\s*-\s*T([0-9]+)\s*(.*)$', ['n', 'd', 'note']) AS c, regexp_extract(flat, '(?i)^T([0-9]+)\s*(UBAR|U\s*BAR|TIES?|HOOK)?\s*@\s*([0-9]+)\s*mm\s*(.*)$', ['d', 'kind', 'p', 'note']) AS p,
            CASE WHEN regexp_matches(bare, '(?i)^-?\s*[0-9]+\s*-\s*T[0-9]+') THEN 'count' WHEN regexp_matches(flat, '(?i)^T[0-9]+\s*(UBAR|U\s*BAR|TIES?|HOOK)?\s*@\s*[0-9]+\s*mm') THEN 'pitch' WHEN regexp_matches(flat, '(?i)^T[0-9]+$') THEN 'dia' WHEN regexp_matches(flat, '^[A-Z]{{1,2}}[0-9]{{0,2}}$') THEN 'mark' ELSE 'unparsed' END AS kind FROM f)
        SELECT p_partkey, kind, TRY_CAST(CASE kind WHEN 'count' THEN c.d WHEN 'pitch' THEN p.d WHEN 'dia' THEN flat[2:] END AS INT) AS dia, TRY_CAST(CASE kind WHEN 'count' THEN c.n WHEN 'dia' THEN '1' END AS INT) AS "count", TRY_CAST(CASE kind WHEN 'pitch' THEN p.p END AS INT) AS pitch,
        CASE kind WHEN 'mark' THEN flat END AS mark, CASE kind WHEN 'count' THEN trim(c.note) WHEN 'pitch' THEN trim(trim(p.kind) || ' ' || trim(p.note)) WHEN 'dia' THEN '' END AS note FROM k""",
    "bar_pitches": rf"""WITH r AS (SELECT p_partkey, {_CALLS} AS t FROM part), k AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)T[0-9]+\s*Ties?\s*@\s*[0-9]+\s*mm') THEN 'tie' WHEN regexp_matches(t, '(?i)T[0-9]+\s*UBAR\s*@\s*[0-9]+\s*mm') THEN 'u-bar' WHEN regexp_matches(t, '(?i)T[0-9]+\s*Hook\s*@\s*[0-9]+\s*mm') THEN 'hook' WHEN regexp_matches(t, '(?i)T[0-9]+\s*@\s*[0-9]+\s*mm') THEN 'plain' END AS kind,
            regexp_extract(t, '(?i)T([0-9]+)\s*(Ties?|UBAR|Hook|)\s*@\s*([0-9]+)\s*mm', ['d', 'k', 'p']) AS m, regexp_extract(t, '(?i)([0-9]+)\s*-\s*T([0-9]+)[^0-9]*CRACK\s*BAR', ['n', 'd']) AS c FROM r)
        SELECT p_partkey, kind, TRY_CAST(m.d AS INT) AS dia, TRY_CAST(m.p AS INT) AS pitch, TRY_CAST(c.n AS INT) AS crack_count, TRY_CAST(c.d AS INT) AS crack_dia FROM k""",
    "whitespace_canon": "SELECT doc_id, CAST(length(c) AS BIGINT) AS n_clean, md5(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS c FROM documents)",
    "num_parse": "SELECT page_id, TRY_CAST(regexp_extract(replace(html, ',', ''), '-?[0-9]+(\\.[0-9]+)?', 0) AS DOUBLE) AS number, TRY_CAST(regexp_extract(replace(url, ',', ''), '-?[0-9]+', 0) AS BIGINT) AS url_number FROM pages",
    "json_props": "SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum, MAX(CAST(json_extract_string(props, '$.k') AS INT)) AS k_max, COUNT(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
    "id_sanitise": "SELECT c_custkey, regexp_replace(trim(r), '[^A-Za-z0-9_-]', '', 'g') AS clean, regexp_matches(r, '^[A-Za-z0-9._() \\-]+$') AS safe_raw, regexp_matches(c_mktsegment, '^[A-Za-z0-9._() \\-]+$') AS safe_segment FROM (SELECT *, ' ' || c_name || '/é ' AS r FROM customer)",
    "sheet_names": "SELECT p_partkey, base, CASE WHEN rn = 1 THEN base ELSE base || '_' || rn END AS sheet FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS rn FROM (SELECT p_partkey, substr(trim(regexp_replace(p_name || ': [a/b] a rather long title', '[\\[\\]:*?/\\\\]', '', 'g')), 1, 27) AS base FROM part))",
    "ragged_rows": "SELECT p_partkey, array_to_string(list_resize(string_split(p_name, ' '), p_size % 4, ''), '|') AS row FROM part",
    "length_literals": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size * 1.0::DOUBLE WHEN 1 THEN p_size * 1.0::DOUBLE WHEN 2 THEN p_size * 10.0::DOUBLE WHEN 3 THEN p_size * 1000.0::DOUBLE WHEN 4 THEN ROUND(p_size * 304.8::DOUBLE, 3) WHEN 5 THEN ROUND(p_size * 304.8::DOUBLE, 3) END AS mm FROM part",
    "panel_names": "SELECT p_partkey, 'P-' || p_partkey AS panel, CASE WHEN p_size % 2 = 0 THEN p_size % 3 END AS revision FROM part",
    "block_kinds": f"""WITH r AS (SELECT lower(p_type || ' ' || list_extract([{_quoted(BLOCKS)}], CAST(p_partkey % {len(BLOCKS)} AS INT) + 1)) AS b FROM part)
        SELECT CASE WHEN contains(b, 'corbel') THEN 'corbel' WHEN contains(b, 'wire loop') OR contains(b, 'loopbox') THEN 'loop' WHEN contains(b, 'spread anchor') OR contains(b, 'rr-sa') THEN 'anchor' WHEN contains(b, 'stiffener') OR contains(b, 'channel') THEN 'embed' END AS kind,
        CASE WHEN contains(b, 'corbel') THEN 'corbel' WHEN contains(b, 'anchor') OR contains(b, 'loopbox') THEN 'anchor' WHEN contains(b, 'stiffener') OR contains(b, 'channel') THEN 'channel' ELSE 'other' END AS cast_in, COUNT(*) AS n FROM r GROUP BY 1, 2""",
    "orientation_counts": f"""WITH r AS (SELECT *, {_ANGLE} AS a FROM lineitem) SELECT CASE WHEN l_linenumber % 3 + 1 > 2 THEN 'shape' WHEN a <= 3 OR a >= 177 THEN 'h' WHEN abs(a - 90) <= 3 THEN 'v' ELSE 'diag' END AS orientation,
        CASE WHEN l_quantity > 2 * l_linenumber * 10 THEN 'Horizontal' WHEN l_linenumber * 10 > 2 * l_quantity THEN 'Vertical' ELSE 'Other' END AS box, COUNT(*) AS n FROM r GROUP BY 1, 2""",
    "measure_functions": """WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 17 AS DOUBLE) AS y FROM part) SELECT p_partkey, ROUND(x + y, 6) AS path, ROUND(sqrt(x * x + y * y), 6) AS chord, ROUND(2 * x + y - 2.0::DOUBLE, 6) AS cut, CAST(floor(x * 100 / (y + 1)) + 1 AS BIGINT) AS pieces,
        CASE WHEN x <= 5 THEN 5.0::DOUBLE WHEN x <= 10 THEN 10.0::DOUBLE WHEN x <= 20 THEN 20.0::DOUBLE ELSE 40.0::DOUBLE END AS scale, 50.0::DOUBLE - x AS mirrored, CASE WHEN ((y * 20 - x * 10) % 360 + 360) % 360 = 0 THEN 360.0::DOUBLE ELSE ((y * 20 - x * 10) % 360 + 360) % 360 END AS sweep,
        ROUND(x * y / 2, 6) AS area, ROUND(-1.0::DOUBLE + (x - 1) * 2.0::DOUBLE / 49, 6) AS scaled FROM r""",
    "source_precedence": "SELECT source, lang, doc_id, quality FROM (SELECT d.source, d.lang, d.doc_id, COALESCE(quality, -1) AS quality, row_number() OVER (PARTITION BY source, lang ORDER BY COALESCE(quality, -1) DESC, n_chars DESC, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE rn = 1",
    "confidence_class": SCHED + "SELECT dia, CASE WHEN l_returnflag IN ('R','A') AND l_linenumber > 2 THEN 'low' ELSE 'high' END AS conf, COUNT(*) AS n FROM sched GROUP BY 1, 2",
}
