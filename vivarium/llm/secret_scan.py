"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: an OR of clauses, each an AND of trigrams that any match
must contain (in lower case). The index holds the postings (trigram, document) of the trigrams that some query names.
Intersecting postings gives each rule's candidate documents; only those are searched with the regex. A rule without
mandatory trigrams is searched in every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clauses = frozenset  # of frozensets of trigrams; a clause without trigrams is always true


@dataclass(frozen=True)
class Rule:
    """A kind, its regex (Java and Python read it alike) and the least length of its group; shorter ones are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Fixed formats. The first three are the base rules; [0-9a-f]{16,} has the matches of [0-9a-f]+ with 16 characters or more.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

# --- from a regex to a query over trigrams --------------------------------------------------------------------------

TRUE = frozenset({frozenset()})
MOST_STRINGS, MOST_CLAUSES = 64, 64


def _of_strings(strings: frozenset[str]) -> frozenset:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _least(clauses: frozenset) -> frozenset:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a: frozenset, b: frozenset) -> frozenset:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= MOST_CLAUSES else min(a, b, key=len)


def _analyse(nodes) -> tuple[frozenset[str] | None, frozenset]:
    """The finite set of strings that the nodes match, or None; and clauses that hold for every match."""
    strings: frozenset[str] | None = frozenset({""})
    run, clauses = frozenset({""}), TRUE  # run: the strings that the latest finite parts together match
    for op, arg in nodes:
        part, query = _part(op, arg)
        joined = part and frozenset(a + b for a in run for b in part)
        if joined and len(joined) <= MOST_STRINGS:
            run = joined
        else:
            clauses = _and(clauses, _and(_of_strings(run), query))
            run, strings = part or frozenset({""}), None
    return (run if strings is not None else None), _and(clauses, _of_strings(run))


def _part(op, arg) -> tuple[frozenset[str] | None, frozenset]:
    if op is C.LITERAL:
        return frozenset({chr(arg).lower()}), TRUE
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None, TRUE
        return (frozenset(chars) if len(chars) <= 8 else None), TRUE
    if op is C.SUBPATTERN:
        return _analyse(arg[3])
    if op is C.BRANCH:
        sides = [_analyse(x) for x in arg[1]]
        query = _least(frozenset().union(*(q for _, q in sides)))
        every = None if any(s is None for s, _ in sides) else frozenset().union(*(s for s, _ in sides))
        return every, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        some, query = _analyse(inner)
        if some is not None and (low, high) == (0, 1):
            return some | {""}, TRUE
        return (some, query) if (low, high) == (1, 1) else (None, query if low else TRUE)
    if op is C.AT:
        return frozenset({""}), TRUE
    return None, TRUE


def trigram_query(regex: str) -> frozenset:
    """Clauses of trigrams for a regex; TRUE if some match needs none."""
    clauses = _analyse(parser.parse(regex))[1]
    return TRUE if frozenset() in clauses else clauses


# --- the index and the search ---------------------------------------------------------------------------------------



def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, doc_id) of the trigrams that the rules' queries name."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.regex) for t in clause})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted))) if wanted else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the indexed rules of which some clause's postings all hold the document."""
    rows = [(r.kind, i, len(clause), t) for r in rules for i, clause in enumerate(sorted(trigram_query(r.regex), key=sorted)) for t in sorted(clause)]
    table = index.sparkSession.createDataFrame(rows, "kind string, clause int, size int, trigram string")
    hits = index.join(F.broadcast(table), "trigram")  # a row for each trigram of a rule: as small as the rules
    per_doc = hits.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "clause", "size", "trigram")).alias("found"))

    def in_postings(kind: str, clause: int) -> Column:
        return F.size(F.filter("found", lambda x: (x["kind"] == kind) & (x["clause"] == clause)))

    whole = []
    for r in rules:
        clauses = []
        for i, clause in enumerate(sorted(trigram_query(r.regex), key=sorted)):
            if clause:
                clauses.append(in_postings(r.kind, i) == len(clause))
        if clauses:
            any_clause = clauses[0]
            for c in clauses[1:]:
                any_clause = any_clause | c
            whole.append(F.when(any_clause, F.lit(r.kind)))
    kinds = F.array_compact(F.array(*whole)) if whole else F.array().cast("array<string>")
    return per_doc.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


SPAN = "array<struct<start:int,rank:int,end:int>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans: what lies between matches and the matches themselves give their places, in code points."""
    found = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))).cast(SPAN)
        good = F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def _text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    one = lambda s: F.concat(F.element_at(kinds, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    base_sha256 is of kind:start:end of the base spans by start, then by kind as listed; spans lists the spans of all
    rules likewise (offsets in code points, ends exclusive). A null text is read as empty: counts 0, spans ''. Rows are
    indexed by a hash of id and text, so repeated ids and null ids are searched each for its own rules. Texts of any
    length are searched whole; other columns are left out; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    kinds = candidates(postings(keyed.select(F.col("key").alias("doc_id"), "text"), rules), rules).withColumnRenamed("doc_id", "key")
    joined = keyed.join(kinds, "key", "left")
    none = F.array().cast(SPAN)
    found = {}
    for rank, rule in enumerate(rules):
        scan = trigram_query(rule.regex) == TRUE
        chosen = F.lit(True) if scan else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        found[rule.kind] = F.when(chosen & F.col("text").rlike(rule.regex), matches(F.col("text"), rule, rank)).otherwise(none)
    searched = joined.select("doc_id", *(c.alias(k) for k, c in found.items()))
    base = [r.kind for r in BASE]
    return searched.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_text(F.concat(*base), rules), 256).alias("base_sha256"),
        _text(F.concat(*found), rules).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the result: every rule's regex over every text, without an index."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for rank, r in enumerate(rules):
        parts.append(f"""SELECT doc_id, {rank} AS rank, {quoted(r.kind)} AS kind, unnest(string_split_regex(text, {quoted(r.regex)})) AS gap,
  unnest(list_concat(regexp_extract_all(text, {quoted(r.regex)}, 0), [NULL])) AS hit,
  unnest(list_concat(regexp_extract_all(text, {quoted(r.regex)}, {r.group}), [NULL])) AS part,
  {r.least} AS least, generate_subscripts(string_split_regex(text, {quoted(r.regex)}), 1) AS i
 FROM d WHERE regexp_matches(text, {quoted(r.regex)})""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM m),
s AS (SELECT doc_id, rank, kind, stop - length(hit) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
 FROM p WHERE hit IS NOT NULL AND length(part) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def python_matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """The same spans by Python's re; for tests."""
    return [m.span() for m in re.finditer(rule.regex, text) if len(m.group(rule.group)) >= rule.least]
