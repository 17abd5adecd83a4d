"""Secret scans by a trigram inverted index, in DataFrame expressions only.

Each rule's regex is parsed into a Boolean trigram query: literals give the trigrams that any match
must hold (case-folded), concatenation is AND, alternation is OR, and what repeats zero times or is
a character class gives nothing. Documents are inverted over the trigrams of those queries:
postings (trigram, document). Intersecting postings per document leaves the candidates of each
rule, and only they are verified with its regex. A rule whose query is empty (plain hex runs) scans
every text.

Positions come from splitting a text at a rule's matches: the code points of the pieces and matches
before a match are its start.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, fresh, materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regex that Java and Python read alike; matches whose ``group`` is shorter
    than ``least`` code points are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Public formats of secrets, in the order in which spans at one start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def trigram_query(pattern: str) -> tuple:
    """The Boolean query of a regex: ("tri", t), ("and", ...), ("or", ...) or ("any",).

    Every text with a match satisfies it, after both are lower-cased as ASCII.
    """

    def both(parts: list) -> tuple:
        parts = list(dict.fromkeys(p for p in parts if p != ("any",)))
        return ("any",) if not parts else parts[0] if len(parts) == 1 else ("and", *parts)

    def either(parts: list) -> tuple:
        # what asks for more than another part adds nothing
        sets = {p: frozenset(p[1:] if p[0] == "and" else [p]) for p in parts}
        parts = [p for p in sets if not any(sets[q] < sets[p] for q in sets)]
        return ("any",) if ("any",) in parts else parts[0] if len(parts) == 1 else ("or", *parts)

    def grams(text: str) -> list:
        low = text.lower()
        return [("tri", low[i : i + 3]) for i in range(len(low) - 2)]

    def expand(items: list) -> list[list]:
        """Sequences of literal characters and None (a gap), one per way through the pattern."""
        ways: list[list] = [[]]
        for op, arg in items:
            if op is sre.LITERAL:
                here = [[chr(arg)]]
            elif op is sre.BRANCH:
                here = [w for branch in arg[1] for w in expand(list(branch))]
            elif op is sre.SUBPATTERN:
                here = expand(list(arg[3]))
            elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                here = [[], *expand(list(arg[2]))]
            elif op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
                here = [[]]
                for _ in range(arg[0]):
                    here = [a + b for a in here for b in expand(list(arg[2]))]
            elif op is sre.IN and len(arg) <= 8 and all(x[0] is sre.LITERAL for x in arg):
                here = [[chr(x[1])] for x in arg]
            else:
                here = [[None]]
            if len(ways) * len(here) > 512:  # too many ways to spell out: this part is a gap
                here = [[None]]
            ways = [a + b for a in ways for b in here]
        return ways

    found = []
    for way in expand(list(sre_parser.parse(pattern))):
        runs = "".join("\0" if c is None else c for c in way).split("\0")
        found.append(both([g for run in runs for g in grams(run)]))
    return either(found)


def _leaves(query: tuple) -> set:
    return {query[1]} if query[0] == "tri" else set().union(*map(_leaves, query[1:])) if len(query) > 1 else set()


def _holds(query: tuple, mask: list, bit: dict) -> Column:
    if query[0] == "tri":
        word, at = divmod(bit[query[1]], 60)
        return mask[word].bitwiseAND(F.lit(1 << at).cast("long")) != 0
    parts = [_holds(q, mask, bit) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def _row_key(id_column: str, text: Column) -> Column:
    """A key of (id, text). Keys only ever select rows for verification, so if two rows shared one
    the result would be the same."""
    return F.xxhash64(F.col(id_column), text)


def build_postings(df: DataFrame, trigrams: list[str], id_column: str, text_column: str) -> DataFrame:
    """The inverted index (trigram, key) over ``trigrams``. Lower case is Unicode's here, which takes a few
    more characters for ASCII letters than the rules do: that only adds candidates."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    low = F.lower(text)
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return df.select(_row_key(id_column, text).alias("key"), low.alias("low")).select("key", F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, wanted): the kinds of rules whose trigram query the document's postings satisfy."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    bit = {t: i for i, t in enumerate(sorted(set().union(*map(_leaves, queries.values()))))}
    words = len(bit) // 60 + 1

    def bits(word: int) -> Column:
        own = [F.lit(x) for t, i in bit.items() if i // 60 == word for x in (t, 1 << (i % 60))]
        values = F.create_map(*own).cast("map<string,bigint>")[F.col("trigram")]
        return F.bit_or(F.coalesce(values, F.lit(0).cast("long"))).alias(f"m{word}")

    masks = postings.groupBy("key").agg(*map(bits, range(words)))
    mask = [F.col(f"m{w}") for w in range(words)]
    wanted = F.array_compact(F.array(*(F.when(_holds(q, mask, bit), F.lit(k)) for k, q in queries.items() if q != ("any",))))
    return masks.select("key", wanted.alias("wanted")).where(F.size("wanted") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of one rule's spans, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    keep = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>").alias("out"))

    def step(acc, item):
        start = acc["at"] + F.length(item["piece"])
        end = start + F.length(item["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = F.length(item["kept"]) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.zip_with(
        F.zip_with(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))),
        keep,
        lambda pm, k: F.struct(pm["piece"].alias("piece"), pm["match"].alias("match"), k.alias("kept")),
    )
    return F.aggregate(zipped, begin, step, lambda acc: acc["out"])


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, spans_column: str = "secret_spans") -> DataFrame:
    """All columns of ``df`` plus ``spans_column``, array<struct<start, order, end, kind>> sorted by
    start, then by the rules' order; end is exclusive and both count code points. The index holds the
    trigrams that the rules ask for; a column of that name in ``df`` is an error.

    A null text is empty and has no spans; ids may be null or repeated; no row is lost or doubled.
    Matches are leftmost and do not overlap within a rule; those of several rules may.
    """
    indexed = [r for r in rules if trigram_query(r.pattern) != ("any",)]
    trigrams = sorted(set().union(*(_leaves(trigram_query(r.pattern)) for r in indexed), set()))
    if spans_column.lower() in map(str.lower, df.columns):
        raise ValueError(f"the table has a column {spans_column} already")
    text = F.coalesce(F.col(text_column), F.lit(""))
    key, wanted, row_key = (fresh(df, n) for n in ("secret_key", "secret_wanted", "secret_row"))
    if trigrams:
        postings = materialize(build_postings(df, trigrams, id_column, text_column), "postings")
        cands = materialize(candidates(postings, rules).withColumnsRenamed({"key": key, "wanted": wanted}), "candidates")
        discard(postings)
        joined = df.withColumn(row_key, _row_key(id_column, text)).join(cands, F.col(row_key) == F.col(key), "left")
    else:
        joined = df.withColumn(wanted, F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(text, rule, i)
        parts.append(F.when(F.array_contains(F.coalesce(wanted, F.array().cast("array<string>")), rule.kind), spans).otherwise(none) if rule in indexed else F.when(text.rlike(rule.pattern), spans).otherwise(none))
    return joined.withColumn(spans_column, F.array_sort(F.concat(*parts))).select(*df.columns, spans_column)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(df: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    found = scan(df.select("doc_id", "text")).select("doc_id", "secret_spans")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``; spans that overlap or touch become
    one mark. Null texts stay null."""
    spans = fresh(df, "secret_spans")
    found = scan(df, id_column, text_column, spans_column=spans)
    text = F.col(text_column)
    begin = F.struct(F.lit(-1).alias("to"), F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"))

    def step(acc, s):
        # a span beyond all before it opens a mark, and so ends the one before
        opens = s["start"] > acc["to"]
        starts = F.when(opens, F.concat(acc["starts"], F.array(s["start"]))).otherwise(acc["starts"])
        ends = F.when(opens & (acc["to"] >= 0), F.concat(acc["ends"], F.array(acc["to"]))).otherwise(acc["ends"])
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), starts.alias("starts"), ends.alias("ends"))

    name = fresh(df, "secret_marks")
    found, marks = found.withColumn(name, F.aggregate(spans, begin, step)), F.col(name)
    from_, to = F.concat(F.array(F.lit(0)), marks["ends"], F.array(marks["to"])), F.concat(marks["starts"], F.array(F.length(text)))
    clean = F.array_join(F.zip_with(from_, to, lambda a, z: F.substring(text, a + 1, z - a)), mark)
    return found.withColumn(text_column, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*df.columns)


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """The spans of one text by plain search over every rule, for tests."""
    spans = []
    for i, r in enumerate(rules):
        spans += [(m.start(), i, m.end(), r.kind) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m.group(r.group)) >= r.least]
    return [(k, a, b) for a, _, b, k in sorted(spans)]
