"""Secrets in texts: a trigram index picks the candidates of each rule, the rule's regex verifies.

From each rule's regex a Boolean query over trigrams of lower-cased text is derived: what any match
must contain. The index holds the postings (trigram, document) of the trigrams some query asks for,
in trigram order, so that a frequent trigram's postings lie in many files. A clause's postings are
intersected by aggregating them per document; only documents that satisfy a rule's query are read by
its regex. A rule without mandatory trigrams reads every text. All of it is SQL expressions.
"""

from __future__ import annotations

import re._constants as tokens
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import session
from tidegauge.llm.tables import tasks_for

BROADCAST_ROWS = 1 << 20  # candidate rows sent to every executor: 16 bytes each


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if the group is at least so long; classes spell out both cases."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base rules, then those this operator adds, in the order of their kinds.
_NAMES = "|".join(either_case(w).replace("_", "_?") for w in (
    "password", "passwd", "secret", "token", "api_key"))
BASE_RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones need no match
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + ADDED_RULES

SPAN = "struct<start:int,kind:int,end:int>"
_MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams; a text with a match holds all trigrams of one clause. [] allows any text.

    Runs of characters known up to a few alternatives are spelled out; what lies between them says
    nothing. Alternatives of a run become clauses, several runs multiply them.
    """
    runs: list[set[str]] = []
    run = {""}
    for strings in _parts(regex_parser.parse(pattern)):
        if strings is None or len(run) * len(strings) > _MOST_STRINGS:
            runs.append(run)
            run = {""} if strings is None else strings
        else:
            run = {a + b for a in run for b in strings}
    clauses = {frozenset()}
    for strings in [*runs, run]:
        grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in grams and len(clauses) * len(grams) <= _MOST_STRINGS:
            clauses = {a | b for a in clauses for b in grams}
    if frozenset() in clauses:
        return []
    # A clause that asks for more than another one adds nothing.
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _parts(items) -> list[set[str] | None]:
    """For each part of a sequence the lower-cased strings it can be, or None."""
    out: list[set[str] | None] = []
    for op, value in items:
        if op is tokens.LITERAL:
            out.append({chr(value).lower()})
        elif op is tokens.IN and all(o is tokens.LITERAL for o, _ in value):
            out.append({chr(c).lower() for _, c in value})
        elif op is tokens.SUBPATTERN:
            out.extend(_parts(value[-1]))
        elif op is tokens.BRANCH:
            branches = [_whole(b) for b in value[1]]
            out.append(None if None in branches else set().union(*branches))
        elif op in (tokens.MAX_REPEAT, tokens.MIN_REPEAT) and value[1] == 1:
            inner = _whole(value[2])
            out.append(None if inner is None else inner | {""})
        elif op in (tokens.MAX_REPEAT, tokens.MIN_REPEAT) and value[0] >= 1:
            out.extend([*_parts(value[2]), None])
        else:
            out.append(None)
    return out


def _whole(items) -> set[str] | None:
    strings = {""}
    for part in _parts(items):
        if part is None or len(strings) * len(part) > _MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in part}
    return strings


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram, doc_id`` of these trigrams, written in their order."""
    spark = docs.sparkSession
    folder = session.scratch(spark, "trigram-index")
    grams = F.array(*[F.lit(g) for g in trigrams])
    present = F.transform(F.array(F.lower("text")),
                          lambda t: F.filter(grams, lambda g: F.contains(t, g)))[0]
    postings = docs.select("doc_id", F.explode(present).alias("trigram"))
    files = tasks_for(docs, 256 << 20, 1)
    (postings.repartitionByRange(files, "trigram", "doc_id")
     .sortWithinPartitions("trigram", "doc_id").write.parquet(folder))
    return spark.read.parquet(folder)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, mask``: bit r is set if the document satisfies the trigram query of rule r."""
    spark = docs.sparkSession
    clauses = [(r, c) for r, rule in enumerate(rules) for c in trigram_query(rule.pattern)]
    grams = sorted(set().union(*[c for _, c in clauses]))
    terms = spark.createDataFrame(
        [(n, g, 1 << k, (1 << len(c)) - 1, 1 << r)
         for n, (r, c) in enumerate(clauses) for k, g in enumerate(sorted(c))],
        "clause int, trigram string, bit long, whole long, rule long")
    hits = trigram_index(docs, grams).join(F.broadcast(terms), "trigram")  # as large as the rules
    both = hits.groupBy("doc_id", "clause").agg(
        F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"),
        F.first("rule").alias("rule"))
    return (both.filter("bits = whole").groupBy("doc_id").agg(F.bit_or("rule").alias("mask"))
            .withColumnRenamed("doc_id", "candidate"))


def rule_spans(text: Column, kind: int, rule: Rule) -> Column:
    """Spans of a rule's matches, in code points, the end exclusive.

    The text between matches and the matches themselves alternate; their lengths add up to places.
    """
    java = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, java, 0)
    value = F.regexp_extract_all(text, java, rule.group) if rule.group else whole
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(F.get(whole, i))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.when(F.length(F.get(value, i)) >= rule.least, F.array(span)).otherwise(
            F.array().cast(f"array<{SPAN}>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    places = F.sequence(F.lit(0), F.size(whole) - 1)
    folded = F.aggregate(places, start, step)["spans"]
    return F.when(F.size(whole) > 0, folded)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """``docs`` with ``spans``, an array of (start, kind number, end) in order of start, then kind.

    ``docs`` has the columns doc_id and text; others are kept as they are, and ``prefix`` keeps the
    new names spans, candidate and mask off theirs. NULL and empty texts have no spans. Repeated rows repeat, rows
    of one id are judged by their own texts, a NULL id is an id, an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id"), F.col("text"))
    found = candidates(narrow, rules)
    folder = session.scratch(docs.sparkSession, "secret-candidates")
    found.write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder).select(
        F.col("candidate").alias(f"{prefix}candidate"), F.col("mask").alias(f"{prefix}mask"))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(f"{prefix}candidate")),
                       "left")
    none = F.array().cast(f"array<{SPAN}>")
    spans = []
    for r, rule in enumerate(rules):
        searched = rule_spans(F.col("text"), r, rule)
        if trigram_query(rule.pattern):
            searched = F.when(F.col(f"{prefix}mask").bitwiseAND(F.lit(1 << r).cast("long")) != 0, searched)
        spans.append(F.coalesce(searched, none))
    return joined.withColumn(f"{prefix}spans", F.array_sort(F.concat(*spans))).drop(
        f"{prefix}candidate", f"{prefix}mask")


def span_list(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, for each row."""
    found = with_spans(docs.select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans"))


def redacted(text: Column, spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each stretch that spans cover replaced by the kind of its first span."""
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        before = text.substr(state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(inside, state["out"]).otherwise(
                F.concat(state["out"], F.array(before, F.get(kinds, s["kind"])))).alias("out"))

    def finish(state: Column) -> Column:
        rest = text.substr(state["at"] + 1, F.length(text))
        return F.concat(F.array_join(state["out"], ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def _rule_sql(kind: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, row_no, [s FOR s IN [{{
      'start': CAST(coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0)
                    + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT),
      'kind': {kind},
      'end': CAST(coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0)
                  + coalesce(list_sum([length(x) FOR x IN m[1:i]]), 0) AS BIGINT),
      'wide': length(v[i]) >= {rule.least}}} FOR i IN range(1, len(m) + 1)] IF s.wide] AS found_spans
  FROM (SELECT doc_id, row_no, string_split_regex(t, '{pattern}') AS p,
               regexp_extract_all(t, '{pattern}', 0) AS m,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM numbered)"""


def report_sql() -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = f"""{kinds}[e.kind + 1] || ':' || e.start || ':' || e."end\""""
    return f"""
WITH numbered AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_no FROM documents),
found AS ({' UNION ALL '.join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
merged AS (
  SELECT doc_id, row_no, list_sort(flatten(list(found_spans))) AS all_spans FROM found GROUP BY doc_id, row_no)
SELECT doc_id,
  {', '.join(f"CAST(len([e FOR e IN all_spans IF e.kind = {k}]) AS BIGINT) AS n_{r.kind}"
             for k, r in enumerate(BASE_RULES))},
  sha256(array_to_string([{text} FOR e IN all_spans IF e.kind < {len(BASE_RULES)}], ',')) AS base_sha256,
  array_to_string([{text} FOR e IN all_spans], ',') AS spans
FROM merged"""
