"""Secret scans over a trigram inverted index.

Each rule is a regular expression. A Boolean trigram query is derived from it:
the trigrams that any text with a match must contain. The index lists, for
each trigram that some rule asks for, the documents whose lower-cased text has
it; a document's postings are intersected by OR-ing their bits, and a rule's
candidates are those whose bits satisfy its query. Candidates are verified
with the expression itself. A rule without mandatory trigrams scans all
documents.

All of this is DataFrame functions. A match's place is the running sum of the
lengths of what ``split`` and ``regexp_extract_all`` give, in code points.

Scale. Postings are rows of (document, trigram) for the rules' few trigrams,
combined within each task before they are shuffled; the texts are shuffled
once, for the join with the candidates, which has a document on each side of
each key. Prefix sums over a text's matches go by blocks of ``BLOCK``, so a
text of very many matches costs time in proportion to them.

Defined results: a null text counts as empty; rows that repeat are rows of
their own; a null ``doc_id`` is a document like others; an empty table gives an
empty result.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import table

BLOCK = 256
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` in which ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules, in listed order.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 characters or more
)
#: Rules that the method adds; their spans follow the base ones at the same start.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


# Trigram queries: a frozenset of clauses, each a frozenset of trigrams; a text
# can match only if it has all trigrams of some clause. ANY is no condition.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _all_of(a: Query, b: Query) -> Query:
    both = {x | y for x in a for y in b}
    return frozenset(x for x in both if not any(y < x for y in both)) if len(both) <= MOST_STRINGS else min(a, b, key=len)


def _any_of(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _of_strings(strings: frozenset) -> Query:
    """The query for a text that contains one of ``strings``."""
    query: Query = frozenset()
    for s in strings:
        query = _any_of(query, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return query


def _sequence(nodes) -> tuple[frozenset | None, Query]:
    """(all strings that ``nodes`` can match if these are few, a query that holds for every match)."""
    whole, exact, query = True, frozenset([""]), ANY
    for node in nodes:
        strings, more = _node(node)
        joined = None if strings is None else frozenset(a + b for a in exact for b in strings)
        if joined is not None and len(joined) <= MOST_STRINGS:
            exact = joined
            continue
        whole = False
        query = _all_of(_all_of(query, _of_strings(exact)), more)
        exact = frozenset([""]) if strings is None else strings
    return (exact, _of_strings(exact)) if whole else (None, _all_of(query, _of_strings(exact)))


def _node(node) -> tuple[frozenset | None, Query]:
    op, value = node
    if op is ops.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is ops.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is ops.LITERAL:
                chars.add(chr(x).lower())
            elif kind is ops.RANGE and x[1] - x[0] < 8:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.BRANCH:
        strings, query = frozenset(), frozenset()
        for branch in value[1]:
            some, more = _sequence(branch)
            strings = None if strings is None or some is None else strings | some
            query = _any_of(query, more)
        return (strings, query) if strings is None or len(strings) <= MOST_STRINGS else (None, query)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if least == most == 1:
            return strings, query
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        return None, query if least else ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams, one of which every text that matches ``pattern`` has whole."""
    return _sequence(parser.parse(pattern))[1]


def vocabulary(rules) -> list[str]:
    """The trigrams that the rules ask for."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})


def build_index(docs: DataFrame, trigrams: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Postings (trigram, doc_id, text_hash): which documents have which of ``trigrams``."""
    low = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    has = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", "text_hash", F.explode(has).alias("trigram"))


def candidates(postings: DataFrame, rules, trigrams: list[str]) -> DataFrame:
    """(doc_id, text_hash, and for each rule with mandatory trigrams whether its query holds)."""
    words = range(-(-len(trigrams) // 63))
    at = F.array_position(F.array(*map(F.lit, trigrams)), F.col("trigram")) - 1
    bits = [F.bit_or(F.when(F.floor(at / 63) == w, F.expr("shiftleft(1L, cast(pmod(slot, 63) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in words]
    found = postings.withColumn("slot", at).groupBy("doc_id", "text_hash").agg(*bits)

    def holds(query: Query) -> Column:
        result = F.lit(False)
        for clause in sorted(map(sorted, query)):
            every = F.lit(True)
            for w in words:
                mask = sum(1 << trigrams.index(t) % 63 for t in clause if trigrams.index(t) // 63 == w)
                if mask:
                    every = every & (F.col(f"bits{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
            result = result | every
        return result

    asked = [(r, trigram_query(r.pattern)) for r in rules]
    return found.select("doc_id", "text_hash", *[holds(q).alias(r.kind) for r, q in asked if q != ANY])


def _starts(steps: Column) -> Column:
    """Exclusive running sums of an array of longs."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda c: F.aggregate(F.slice(steps, c * BLOCK + 1, BLOCK), zero, add))
    offsets = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    inside = lambda i: F.aggregate(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, F.pmod(i, F.lit(BLOCK))), zero, add)
    return F.transform(steps, lambda x, i: F.element_at(offsets, F.floor(i / BLOCK).cast("int") + 1) + inside(i))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's matches, in order."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.length(s).cast("long"))
    judged = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.length(s).cast("long"))
    both = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("n"), judged.alias("judged"))
    steps = F.transform(both, lambda x: x["gap"] + x["n"])
    placed = F.zip_with(both, _starts(steps), lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["n"]).alias("end"), x["judged"].alias("judged")))
    ok = F.filter(placed, lambda s: s["judged"] >= rule.least)
    return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def scan(docs: DataFrame, rules=RULES, text: str = "text", doc_id: str = "doc_id", postings: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash, spans (start, rank, end) by start, then rule.

    ``rank`` is the rule's place in ``rules``; ends are exclusive, both count code
    points. ``postings`` may be an index that ``build_index`` made of the same
    documents for the same rules.
    """
    trigrams = vocabulary(rules)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    if trigrams:
        index = postings if postings is not None else build_index(docs, trigrams, text, doc_id)
        found = candidates(index, rules, trigrams).alias("c")
        rows = rows.alias("d").join(found, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash")), "left")
        rows = rows.select("d.doc_id", "d.text", "d.text_hash", *[f"c.{k}" for k in found.columns[2:]])
    none = F.array().cast(SPANS)
    per_rule = []
    for rank, rule in enumerate(rules):
        narrowed = F.coalesce(F.col(rule.kind), F.lit(False)) if rule.kind in rows.columns else F.lit(True)
        per_rule.append(F.when(narrowed & F.col("text").rlike(rule.pattern), _spans(F.col("text"), rule, rank).cast(SPANS)).otherwise(none))
    return rows.select("doc_id", "text_hash", F.array_sort(F.concat(*per_rule)).alias("spans"))


def listed(spans: Column, rules) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(listed(base, RULES).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans"), RULES).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"""SELECT doc_id, {rank} AS rank, {quoted(r.kind)} AS kind,
               unnest(string_split_regex(text, {quoted(r.pattern)})[:len(regexp_extract_all(text, {quoted(r.pattern)}))]) AS gap,
               unnest(regexp_extract_all(text, {quoted(r.pattern)})) AS m,
               unnest(regexp_extract_all(text, {quoted(r.pattern)}, {r.group})) AS judged,
               unnest(range(len(regexp_extract_all(text, {quoted(r.pattern)})))) AS i, {r.least} AS least
        FROM d"""
        for rank, r in enumerate(RULES)
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM m),
s AS (SELECT doc_id, rank, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE length(judged) >= least),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
