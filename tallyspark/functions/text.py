"""Column functions for text: number parsing, callout grammar, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category rules in order; block kinds of panel drawings and of cast-in parts, in order;
# units in mm; location words; callout grammar, and the pitch callouts of single bar kinds.
CATEGORY_RULES = (
    ("count", r"\d+\s*-\s*T\d+"),
    ("pitch", r"(?i)T\d+\s*[A-Z ]*@\s*\d+"),
    ("pitch", r"(?is)^(?=.*@)(?=.*T\d+)"),
    ("u-bar", r"(?i)UBAR|U-BAR|U BAR"),
    ("tie", r"(?i)TIE"),
    ("number", r"^[\d.]+$"),
    ("Nn", r"(?i)\bN\d+\b"),
)
BLOCK_KINDS = (("corbel", "corbel"), ("wire loop", "loop"), ("loopbox", "loop"), ("spread anchor", "anchor"), ("rr-sa", "anchor"), ("stiffener", "embed"), ("channel", "embed"))
CAST_IN_KINDS = (("corbel", "corbel"), ("anchor", "anchor"), ("loopbox", "anchor"), ("stiffener", "channel"), ("channel", "channel"), ("", "other"))
UNIT_MM = (("mm", 1.0), ("cm", 10.0), ("m", 1000.0), ("ft", 304.8), ("'", 304.8))
LOCATION_WORDS = "WALL|CORBEL|MOULD|FACE|SLAB|BEAM|COLUMN"
COUNT_CALLOUT = r"(?is)^-?\s*(\d+)\s*-\s*T(\d+)\s*(.*)$"
PITCH_CALLOUT = r"(?is)^T(\d+)\s*(UBAR|U\s*BAR|TIES?|HOOK)?\s*@\s*(\d+)\s*mm\s*(.*)$"
BARE_CALLOUT = r"(?i)^T(\d+)$"
MARK_CALLOUT = r"^[A-Z]{1,2}\d{0,2}$"
BAR_PITCHES = (
    ("tie", r"(?i)T(\d+)\s*Ties?\s*@\s*(\d+)\s*mm"),
    ("u-bar", r"(?i)T(\d+)\s*UBAR\s*@\s*(\d+)\s*mm"),
    ("hook", r"(?i)T(\d+)\s*Hook\s*@\s*(\d+)\s*mm"),
    ("plain", r"(?i)T(\d+)\s*@\s*(\d+)\s*mm"),
)
CRACK_BAR = r"(?i)(\d+)\s*-\s*T(\d+)[^\d]*CRACK\s*BAR"


def parse_number(text: Column) -> Column:
    """First number of a text after dropping commas; null if there is none."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0).try_cast("double")


def parse_integer(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+", 0).try_cast("long")


def canonical_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def callout(text: Column) -> Column:
    """struct(kind, dia, count, pitch, mark, note) of a drawing callout.

    The first rule that fits decides: count and diameter (on text without parentheses), diameter at
    pitch, with or without the kind of bar, bare diameter (count 1), mark reference, unparsed. Case
    does not matter but in marks; the note is what follows. What a rule lacks is null; a null text has no callout.
    """
    flat = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    bare = canonical_space(F.regexp_replace(flat, r"[()]", ""))

    def part(source: Column, pattern: str, group: int) -> Column:
        return F.trim(F.regexp_extract(source, pattern, group))

    def whole(source: Column, pattern: str, group: int) -> Column:
        return part(source, pattern, group).try_cast("int")

    none, nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
    note = F.trim(F.concat(part(flat, PITCH_CALLOUT, 2), F.lit(" "), part(flat, PITCH_CALLOUT, 4)))
    rules = (
        (bare.rlike(COUNT_CALLOUT), "count", whole(bare, COUNT_CALLOUT, 2), whole(bare, COUNT_CALLOUT, 1), none, nothing, part(bare, COUNT_CALLOUT, 3)),
        (flat.rlike(PITCH_CALLOUT), "pitch", whole(flat, PITCH_CALLOUT, 1), none, whole(flat, PITCH_CALLOUT, 3), nothing, note),
        (flat.rlike(BARE_CALLOUT), "dia", whole(flat, BARE_CALLOUT, 1), F.lit(1), none, nothing, F.lit("")),
        (flat.rlike(MARK_CALLOUT), "mark", none, none, none, flat, nothing),
        (text.isNotNull(), "unparsed", none, none, none, nothing, nothing),
    )
    out = F.lit(None)
    for fits, *values in reversed(rules):
        names = "kind", "dia", "count", "pitch", "mark", "note"
        made = F.struct(F.lit(values[0]).alias("kind"), *(v.alias(n) for v, n in zip(values[1:], names[1:], strict=True)))
        out = F.when(fits, made).otherwise(out)
    return out


def bar_pitch(text: Column) -> Column:
    """struct(kind, dia, pitch) of the first pitch callout of ties, u-bars, hooks or plain bars, tried in
    that order anywhere in the text; null without one."""
    out = F.lit(None)
    for kind, pattern in reversed(BAR_PITCHES):
        made = F.struct(F.lit(kind).alias("kind"), *(F.regexp_extract(text, pattern, i).try_cast("int").alias(n) for i, n in ((1, "dia"), (2, "pitch"))))
        out = F.when(text.rlike(pattern), made).otherwise(out)
    return out


def crack_bars(text: Column) -> Column:
    """struct(count, dia) of a callout of crack bars; null without one."""
    made = F.struct(*(F.regexp_extract(text, CRACK_BAR, i).try_cast("int").alias(n) for i, n in ((1, "count"), (2, "dia"))))
    return F.when(text.rlike(CRACK_BAR), made)


def count_callout(text: Column) -> Column:
    """struct(count, dia) of the first count callout, null without one."""
    pattern = r"\(?(\d+)\)?\s*-\s*\(?T(\d+)\)?\b"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("count"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("dia")))


def diameters(text: Column) -> Column:
    """Sorted distinct diameters that a text mentions as T<number>."""
    found = F.regexp_extract_all(text, F.lit(r"\bT(\d+)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: d.try_cast("int"))))


def category(text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(CATEGORY_RULES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def block_kind(name: Column, table=BLOCK_KINDS) -> Column:
    """Kind of the first table entry whose key is part of the lower-cased name."""
    out = F.lit(None).cast("string")
    for part, kind in reversed(table):
        out = F.when(F.contains(F.lower(name), F.lit(part)), kind).otherwise(out)
    return out


def base_name(stem: Column) -> Column:
    """Panel name of a file stem: what stands before the first parenthesis."""
    return F.trim(F.substring_index(stem, "(", 1))


def revision(stem: Column) -> Column:
    """Number of a trailing ``(R<number>)``; null without one."""
    return F.regexp_extract(stem, r"\(R(\d+)\)$", 1).try_cast("int")


def sanitize_id(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[^A-Za-z0-9_-]", "")


def safe_name(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._() \-]+$"), F.lit(False))


def format_duration(ms: Column) -> Column:
    """``Hh Mm`` or ``Mm`` of whole minutes, negative durations as zero; null stays null."""
    minutes = F.greatest(F.floor(ms / 60000), F.lit(0))
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(rest.cast("string"), F.lit("m")))


def format_clock(clock: Column) -> Column:
    """``HH:MM:SS`` to 12-hour ``h:MM AM``; null or empty to a dash."""
    hour = F.substring(clock, 1, 2).try_cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    made = F.concat(twelve.cast("string"), F.lit(":"), F.substring(clock, 4, 2), F.when(hour < 12, " AM").otherwise(" PM"))
    return F.when(F.length(clock) > 0, made).otherwise("—")


def length_literal_mm(text: Column) -> Column:
    """``2.5m``, ``8 ft``, ``1200`` (mm) ... in mm; null if it is no length."""
    clean = F.lower(F.trim(text))
    pattern = r"^(\d+(?:\.\d+)?)\s*(mm|cm|m|ft|')?$"
    unit = F.regexp_extract(clean, pattern, 2)
    factor = F.lit(1.0)
    for name, mm in UNIT_MM:
        factor = F.when(unit == name, mm).otherwise(factor)
    return F.when(clean.rlike(pattern), F.regexp_extract(clean, pattern, 1).try_cast("double") * factor)


def sheet_name(title: Column, most: int = 27) -> Column:
    """A worksheet title without illegal characters, shortened; empty becomes ``Sheet``."""
    clean = F.substring(F.trim(F.regexp_replace(title, r"[\[\]:*?/\\]", "")), 1, most)
    return F.when(F.length(clean) > 0, clean).otherwise("Sheet")


def ragged_row(row: Column, size: Column) -> Column:
    """An array of strings padded with empty ones or cut to ``size``."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), size)), F.lit(1), size)


def data_url_bytes(text: Column) -> Column:
    """Bytes behind the comma of a base64 data URL; null without a comma."""
    return F.when(F.contains(text, F.lit(",")), F.unbase64(F.substring_index(text, ",", -1)))


def locations(cells: Column) -> Column:
    """The cells that name a location or a cover, joined with spaces."""
    return F.concat_ws(" ", F.filter(cells, lambda c: F.trim(c).rlike(rf"(?i)^({LOCATION_WORDS})$|^-?\s*\d+\s*mm$")))


def diameter_label(dia: Column) -> Column:
    return F.when(dia.isNotNull(), F.concat(F.lit("T"), dia.cast("int").cast("string"))).otherwise("-")
