"""Secret scan over a trigram index of the documents. DataFrame functions only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.runtime import small, table


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: Base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the base rules leave out: private key blocks, and tokens known by their prefix.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

MOST_STRINGS = 16
MOST_TRIGRAMS = 2
#: Fixed value: letters from the most to the least frequent in English; anything else counts as rarer (find() gives -1).
_FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"
#: Documents whose postings are intersected together.
LIST_DOCS = 4096


def _strings(node) -> set[str] | None:
    """All strings that a part of a regex can match, if these are few; else None."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value)}
    if op == "IN":
        found = set()
        for kind, x in value:
            if str(kind) != "LITERAL":
                return None
            found.add(chr(x))
        return found if len(found) <= MOST_STRINGS else None
    if op == "SUBPATTERN":
        return _joined(value[-1])
    if op == "BRANCH":
        parts = [_joined(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and value[1] is not _parser.MAXREPEAT and value[1] <= 2:
        part = _joined(value[2])
        if part is None:
            return None
        return {"".join(x) for n in range(value[0], value[1] + 1) for x in itertools.product(sorted(part), repeat=n)}
    return None


def _joined(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(found) * len(part) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Trigrams that any match contains: all of these conditions hold, each being alternatives of sets of trigrams.

    Read off the parsed regex: neighbouring parts that match few strings are multiplied out; each
    of the strings needs all of its (lower-cased) trigrams, and one of the strings has to be there.
    Without a string of three characters there is no condition, and the rule scans every text.
    """
    found = []

    def add(strings: set[str]) -> None:
        if strings and all(len(x) >= 3 for x in strings):
            found.append(sorted({frozenset(x[i : i + 3].lower() for i in range(len(x) - 2)) for x in strings}, key=sorted))

    run = {""}
    for node in _parser.parse(regex):
        part = _strings(node)
        if part is None:
            add(run)
            run = {""}
            op, value = str(node[0]), node[1]
            inner = value[-1] if op == "SUBPATTERN" else value[2] if op == "MAX_REPEAT" and value[0] else None
            if inner is not None and (inside := _joined(inner)):
                add(inside)
        elif len(run) * len(part) > MOST_STRINGS:
            add(run)
            run = part
        else:
            run = {a + b for a in run for b in part}
    add(run)
    return found


def rarest(option: frozenset[str]) -> list[str]:
    """The ``MOST_TRIGRAMS`` of a string's trigrams that text has least, judged by their letters: these are looked up.

    Fewer trigrams than a match has leave more candidates, never fewer.
    """
    return sorted(option, key=lambda t: (-sum(_FREQUENT.find(c) % 99 for c in t), t))[:MOST_TRIGRAMS]


def posting_lists(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): the index, for the trigrams that some rule asks for.

    A list holds the sorted doc_ids of one of many blocks of documents, so a frequent trigram has a list
    in each block and none of these grows with the table.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-docs.count() // LIST_DOCS))
    low = docs.select("doc_id", F.lower("text").alias("low"))
    met = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = low.select("doc_id", F.explode(met).alias("trigram"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    return postings.groupBy(block, "trigram").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"), F.max(F.col("doc_id").isNull()).alias("null_id"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): which rules with mandatory trigrams may match a document.

    Within a block of documents each rule's query is evaluated on the lists: those of a string's
    rarest trigrams are intersected, alternatives united, conditions intersected. A null doc_id stands for
    all rows without one; it is in no list and is a candidate of every rule if any such row has a trigram.
    """
    queries = {rule.kind: q for rule in rules if (q := trigram_query(rule.regex))}
    trigrams = sorted({t for q in queries.values() for options in q for option in options for t in rarest(option)})
    lists = table(posting_lists(docs, trigrams))
    held = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"), F.max("null_id").alias("null_id"))
    none = F.array().cast(lists.schema["ids"].dataType)

    def ids(query: list[list[frozenset[str]]]) -> Column:
        ids_of = lambda option: reduce(F.array_intersect, [F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in rarest(option)])
        return reduce(F.array_intersect, [reduce(F.array_union, [ids_of(o) for o in options]) for options in query])

    found = held.select("null_id", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), ids(q).alias("ids")) for kind, q in queries.items()])).alias("x"))
    with_null = F.when(F.col("null_id"), F.concat("x.ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("x.ids"))
    pairs = found.select("x.kind", F.explode(with_null).alias("doc_id"))
    return pairs.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _matches(rule: Rule) -> Column:
    """Array of (gap, span, value) of the matches of a rule in ``text``: code points since the last one, its own, and its value's."""
    match = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)) if rule.group else match
    gaps = F.transform(F.split("text", rule.regex, -1), F.length)
    return F.arrays_zip(gaps.alias("gap"), F.transform(match, F.length).alias("span"), F.transform(value, F.length).alias("value"))


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Replace the matches in the column of each rule by its (start, order, stop), in code points.

    Running sums go over about the square root of the number of matches at a time: lengths of these
    pieces first, sums over the pieces, and then within each from its sum on.
    """
    kinds = [rule.kind for rule in rules]
    width = lambda k: F.ceil(F.sqrt(F.size(k))).cast("int")
    pieces = lambda k: F.transform(F.sequence(F.lit(0), F.ceil(F.size(k) / width(k)).cast("int") - 1), lambda i: F.slice(k, i * width(k) + 1, width(k)))
    rows = rows.withColumns({k: F.when(F.size(k) > 0, pieces(k)) for k in kinds})

    def starts(k: str) -> Column:
        lengths = F.transform(k, lambda piece: F.aggregate(piece, F.lit(0), lambda at, x: at + F.coalesce(x["gap"] + x["span"], F.lit(0))))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all"))
        return F.aggregate(lengths, none, step, lambda state: state["all"])

    rows = rows.withColumns({k: F.when(F.col(k).isNotNull(), F.arrays_zip(F.col(k).alias("piece"), starts(k).alias("start"))) for k in kinds})

    def placed(order: int, rule: Rule) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            stop = start + x["span"]
            span = F.struct(start.alias("start"), F.lit(order).alias("kind"), stop.alias("stop"))
            return F.struct(F.coalesce(stop, state["at"]).alias("at"), F.when(x["value"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        within = lambda z: F.aggregate(z["piece"], F.struct(z["start"].alias("at"), F.array().cast(_SPANS).alias("spans")), step, lambda state: state["spans"])
        return F.coalesce(F.flatten(F.transform(rule.kind, within)), F.array().cast(_SPANS))

    return rows.withColumns({rule.kind: placed(order, rule) for order, rule in enumerate(rules)})


def _listed(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Matches are leftmost and do not overlap within a kind; those whose value is shorter than the
    rule's ``least`` are dropped. Spans are ``kind:start:end`` in code points, ordered by start,
    then by the order of the rules; base_sha256 is the SHA-256 of those of the base rules. Null text
    is empty and has none; rows with equal doc_id are each scanned. A rule runs on the documents
    that its trigram query leaves, rules without mandatory trigrams (``hex``) on all of them.
    """
    rules = (*BASE_RULES, *more)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    may = small(table(candidates(docs, rules)))
    rows = docs.join(may.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    columns = []
    for rule in rules:
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.regex) else F.lit(True)
        columns.append(F.when(F.coalesce(asked, F.lit(False)) & F.col("text").rlike(rule.regex), _matches(rule)).alias(rule.kind))
    found = _with_spans(rows.select("doc_id", *columns), rules)
    kinds = [rule.kind for rule in rules]
    base = F.array_sort(F.concat(*[rule.kind for rule in BASE_RULES]))
    every = F.array_sort(F.concat(*kinds))
    counts = [F.size(rule.kind).cast("long").alias(f"n_{rule.kind}") for rule in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(_listed(base, kinds), 256).alias("base_sha256"), _listed(every, kinds).alias("spans"))


def _oracle(rules: tuple[Rule, ...]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for order, rule in enumerate(rules):
        regex = quoted(rule.regex)
        parts.append(
            f"SELECT doc_id, {order} AS kind, {quoted(rule.kind)} AS name, "
            f"unnest([length(x) for x in string_split_regex(text, {regex})][:len(regexp_extract_all(text, {regex}))]) AS gap, "
            f"unnest([length(x) for x in regexp_extract_all(text, {regex})]) AS span, "
            f"unnest([length(x) for x in regexp_extract_all(text, {regex}, {rule.group})]) >= {rule.least} AS good, "
            f"generate_subscripts(regexp_extract_all(text, {regex}), 1) AS i "
            f"FROM d WHERE regexp_matches(text, {regex})"
        )
    base = ", ".join(quoted(r.kind) for r in BASE_RULES)
    counts = ", ".join(f"CAST(count(*) FILTER (name = {quoted(r.kind)}) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, CAST(sum(gap + span) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM m),
w AS (SELECT doc_id, kind, name, stop - span AS start, name || ':' || (stop - span) || ':' || stop AS txt FROM s WHERE good),
g AS (SELECT doc_id, {counts},
  string_agg(txt, ',' ORDER BY start, kind) FILTER (name IN ({base})) AS base,
  string_agg(txt, ',' ORDER BY start, kind) AS spans FROM w GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE_SQL = _oracle((*BASE_RULES, *MORE_RULES))
