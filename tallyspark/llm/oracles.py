"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from tallyspark.llm.secrets import RULES

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS h, sha1(encode(COALESCE(html, ''))) AS d FROM pages),
m AS (SELECT d, MAX(page_id) AS last FROM p GROUP BY d)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST((CAST('0x' || substr(p.d, 5 * CAST(i // 4 AS INT) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN m ON p.d = m.d"""


def _either_case(pattern: str) -> str:
    """The case-insensitive group spelled out, as RE2 would fold beyond ASCII."""
    if not pattern.startswith("(?i:"):
        return pattern
    out, inside, at = "", False, 0
    body = pattern[4:-1]
    while at < len(body):
        c = body[at]
        if c == "\\":  # an escape is two characters, and \x20 four
            size = 4 if body[at + 1] == "x" else 2
            out += body[at : at + size]
            at += size
            continue
        inside = c == "[" or (inside and c != "]")
        out += f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside else c
        at += 1
    return out


def _spans(rule, order: int) -> str:
    pattern = "'" + _either_case(rule.pattern).replace("'", "''") + "'"
    found, kept, parts = f"regexp_extract_all(t, {pattern})", f"regexp_extract_all(t, {pattern}, {rule.group})", f"regexp_split_to_array(t, {pattern})"
    return f"""SELECT rid, start, {order} AS o, start + n AS stop, '{rule.kind}' AS kind FROM (
        SELECT rid, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(found[i]) AS n, length(kept[i]) AS k
        FROM (SELECT rid, {found} AS found, {kept} AS kept, {parts} AS parts, unnest(range(1, len({found}) + 1)) AS i FROM d WHERE regexp_matches(t, {pattern}))) WHERE k >= {rule.least}"""


_LISTED = "COALESCE(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o){}, '')"
SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(r, i) for i, r in enumerate(RULES))})
SELECT MIN(d.doc_id) AS doc_id, {", ".join(f"COUNT(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))},
    sha256({_LISTED.format(" FILTER (WHERE o < 3)")}) AS base_sha256, {_LISTED.format(" FILTER (WHERE kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS top FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / top) AS e FROM g WHERE top > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, MIN(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, COUNT(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, COALESCE(n.n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id"""

_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}"
SUBSTRINGS = rf"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(text, '[^{_SPACE}]+') AS w, regexp_split_to_array(text, '[^{_SPACE}]+') AS gaps FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(gaps[1:len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS i FROM split),
words AS (SELECT doc_id, i, lower(word) AS word, CAST(SUM(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop, length(word) AS n FROM placed),
texts AS (SELECT doc_id, list(word ORDER BY i) AS w, list(stop - n ORDER BY i) AS starts, list(stop ORDER BY i) AS stops FROM words GROUP BY doc_id),
firsts AS (SELECT *, unnest(range(1, len(w) - 49)) AS i FROM texts WHERE len(w) >= 51),
runs AS (SELECT doc_id, starts[i] AS start, stops[i + 50] AS stop, sha256(array_to_string(w[i:i + 50], ' ')) AS p FROM firsts),
cut_runs AS (SELECT * FROM (SELECT doc_id, start, stop, MIN(doc_id) OVER (PARTITION BY p) AS keeper FROM runs) WHERE doc_id <> keeper),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
line_at AS (SELECT doc_id, line, CAST(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS stop FROM lines),
worded AS (SELECT doc_id, stop - length(line) AS start, stop, list_filter(string_split_regex(lower(line), '[{_SPACE}]+'), lambda w: w <> '') AS w FROM line_at),
paras AS (SELECT doc_id, start, stop, array_to_string(w, ' ') AS p FROM worded WHERE len(w) >= 51),
kinds AS (SELECT p, row_number() OVER (ORDER BY p) AS k, string_split(p, ' ') AS w FROM (SELECT DISTINCT p FROM paras)),
shingles AS (SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM kinds),
sizes AS (SELECT k, COUNT(*) AS n FROM shingles GROUP BY k),
shared AS (SELECT a.k AS a, b.k AS b, COUNT(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.k <> b.k GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.k JOIN sizes y ON b = y.k WHERE m / CAST(x.n + y.n - m AS DOUBLE) >= 0.8),
reach AS (SELECT k AS a, k AS b FROM kinds UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS k, MIN(b) AS class FROM reach GROUP BY a),
cut_lines AS (SELECT * FROM (SELECT doc_id, start, stop, MIN(doc_id) OVER (PARTITION BY class) AS keeper FROM paras JOIN kinds USING (p) JOIN classes USING (k)) WHERE doc_id <> keeper),
cut AS (SELECT * FROM cut_runs UNION ALL SELECT * FROM cut_lines),
begun AS (SELECT *, CASE WHEN start <= MAX(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM cut),
islands AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM begun),
spans AS (SELECT doc_id, MIN(start) AS start, MAX(stop) AS stop FROM islands GROUP BY doc_id, island),
facts AS (SELECT doc_id, COUNT(*) AS n_removed, CAST(SUM(stop - start) AS BIGINT) AS removed_chars, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed FROM spans GROUP BY doc_id),
edges AS (SELECT DISTINCT doc_id AS a, keeper AS b FROM cut UNION SELECT DISTINCT keeper, doc_id FROM cut),
docreach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM docreach r JOIN edges e ON r.b = e.a),
components AS (SELECT a AS doc_id, MIN(b) AS component_id FROM docreach GROUP BY a)
SELECT d.doc_id, COALESCE(n_removed, 0) AS n_removed, COALESCE(removed_chars, 0) AS removed_chars, COALESCE(removed, '') AS removed, component_id
FROM documents d LEFT JOIN facts f ON d.doc_id = f.doc_id JOIN components c ON c.doc_id = d.doc_id"""


def _mul(a: str, b: str | int) -> str:
    return f"(({a}) * {b}::UHUGEINT % {_WHOLE})"


def _add(*terms: str | int) -> str:
    return f"(({' + '.join(f'({t})::UHUGEINT' for t in terms)}) % {_WHOLE})"


def _rotl(x: str, by: int) -> str:
    return f"(({x}) * {1 << by}::UHUGEINT % {_WHOLE} + ({x}) // {1 << (64 - by)}::UHUGEINT)"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def _little(at: str, size: int) -> str:
    """The number that ``size`` bytes from byte ``at`` (from 0) of the hex string x make, least byte first."""
    return "('0x' || " + " || ".join(f"substr(x, CAST(2 * ({at} + {i}) AS INT) + 1, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _round(acc: str, value: str) -> str:
    return _mul(_rotl(_add(acc, _mul(value, _P[1])), 31), _P[0])


def _xxh64(seed: int) -> list[str]:
    """CTEs from ``s0`` (s, x, n: a string, the hex of its bytes and their number) to ``hashed`` (s, h), its XXH64. Each
    step keeps one number, so that no expression repeats a long one."""
    start = [(seed + _P[0] + _P[1]) % (1 << 64), (seed + _P[1]) % (1 << 64), seed, (seed - _P[0]) % (1 << 64)]
    stripes = "list_transform(range(0, n // 32), lambda i: [" + ", ".join(_little(f"32 * i + {8 * k}", 8) for k in range(4)) + "])"
    lanes = f"list_reduce(list_prepend([{', '.join(f'{v}::UHUGEINT' for v in start)}], {stripes}), lambda a, w: [{', '.join(_round(f'a[{k}]', f'w[{k}]') for k in range(1, 5))}])"
    out = [f"s1 AS (SELECT s, x, n, CASE WHEN n >= 32 THEN {lanes} END AS v FROM s0)"]
    out.append(f"s2 AS (SELECT *, CASE WHEN v IS NULL THEN {(seed + _P[4]) % (1 << 64)}::UHUGEINT ELSE {_add(*(_rotl(f'v[{k + 1}]', r) for k, r in enumerate((1, 7, 12, 18))))} END AS h FROM s1)")
    step = 2

    def then(value: str, when: str | None = None) -> None:
        nonlocal step
        value = f"CASE WHEN {when} THEN {value} ELSE h END" if when else value
        out.append(f"s{step + 1} AS (SELECT s, x, n, v, {value} AS h FROM s{step})")
        step += 1

    for k in range(1, 5):
        then(_xor("h", _round("0", f"v[{k}]")), "v IS NOT NULL")
        then(_add(_mul("h", _P[0]), _P[3]), "v IS NOT NULL")
    then(_add("h", "n"))
    for k in range(3):
        then(_xor("h", _round("0", _little(f"(n - n % 32 + {8 * k})", 8))), f"n % 32 >= {8 * k + 8}")
        then(_add(_mul(_rotl("h", 27), _P[0]), _P[3]), f"n % 32 >= {8 * k + 8}")
    then(_xor("h", _mul(_little("(n - n % 8)", 4), _P[0])), "n % 8 >= 4")
    then(_add(_mul(_rotl("h", 23), _P[1]), _P[2]), "n % 8 >= 4")
    for k in range(3):
        then(_xor("h", _mul(_little(f"(n - n % 4 + {k})", 1), _P[4])), f"n % 4 > {k}")
        then(_mul(_rotl("h", 11), _P[0]), f"n % 4 > {k}")
    for shift, factor in ((33, _P[1]), (29, _P[2]), (32, 1)):
        then(_mul(_xor("h", f"h // {1 << shift}::UHUGEINT"), factor))
    return [*out, f"hashed AS (SELECT s, h::UBIGINT AS h FROM s{step})"]


# Fixed values of XXH64, and 2 to the 64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_WHOLE = "18446744073709551616::UHUGEINT"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIMHASH = rf"""WITH RECURSIVE worded AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x09-\x0d\x20]+'), lambda w: w <> '') AS w FROM documents),
pieces AS (SELECT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
s0 AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM pieces)),
{", ".join(_xxh64(42))},
votes AS (SELECT rid, COUNT(*) AS n, {", ".join(f"SUM((h >> {b}) & 1) AS b{b}" for b in range(64))} FROM pieces JOIN hashed USING (s) GROUP BY rid),
prints AS (SELECT w.rid, doc_id, COALESCE({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0 END" for b in range(64))}, 0)::UBIGINT AS fp FROM worded w LEFT JOIN votes v ON w.rid = v.rid),
kinds AS (SELECT fp, MIN(doc_id) AS least FROM prints GROUP BY fp),
near AS (SELECT a.fp AS a, b.fp AS b FROM kinds a JOIN kinds b ON bit_count(xor(a.fp, b.fp)::BIT) <= 2),
reach AS (SELECT fp AS a, fp AS b FROM kinds UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
named AS (SELECT a AS fp, MIN(least) AS component_id FROM reach JOIN kinds ON b = fp GROUP BY a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)"""

ORACLES = {
    "op2_warc_archive": WARC,
    "op3_secret_scan": SECRETS,
    "op8_simhash_near_dedup": SIMHASH,
    "op9_substring_dedup": SUBSTRINGS,
    "op10_embedding_near_dedup": EMBEDDINGS,
}
