"""Secrets in texts: a trigram inverted index proposes documents for each rule, and the rules' expressions verify them. SQL functions only.

Method. Each rule's regular expression is parsed, and a Boolean query on trigrams derived that every match must satisfy: a literal run needs all its
trigrams, an alternation one of its branches. The index holds, for every trigram that any query names, the documents whose lower-cased text has it. A
rule's candidates are the documents whose postings satisfy its query, by one aggregation over the postings; rules whose expression has no mandatory
trigram scan every document. Candidates are verified on the whole text, with the positions of all matches.

The base kinds (assign, access, hex) are fixed rules; the further rules add spans and never take any away.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import fresh


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters. The pattern means the same in Java and Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the same as runs of any length with the short ones dropped
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A Boolean query: a trigram, ("and", queries), ("or", queries), or None where nothing is mandatory.
Query = str | tuple | None


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match must have."""
    words, query = _analyse(sre_parser.parse(pattern))
    return _both(query, _of_words(words))


def _of_words(words: list[str] | None) -> Query:
    """Of an exact set of strings."""
    if not words or any(len(w) < 3 for w in words):
        return None
    return _any([_all(sorted({w[i : i + 3] for i in range(len(w) - 2)})) for w in words])


def _all(queries: list) -> Query:
    queries = [q for q in queries if q is not None]
    return None if not queries else queries[0] if len(queries) == 1 else ("and", tuple(dict.fromkeys(queries)))


def _any(queries: list) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    return queries[0] if len(set(queries)) == 1 else ("or", tuple(dict.fromkeys(queries)))


def _both(a: Query, b: Query) -> Query:
    return _all([a, b])


def _analyse(parsed, most: int = 24) -> tuple[list[str] | None, Query]:
    """The exact set of lower-cased strings of an expression if it is small (else None), and a query that holds besides."""
    run, query = [""], None  # strings of the run of literals that ends here
    exact = True
    for op, value in parsed:
        words, inner = _part(op, value)
        query = _both(query, inner)
        if words is not None and len(words) * len(run) <= most:
            run = [a + b for a in run for b in words]
        else:
            query = _both(query, _of_words(run))
            run, exact = [""], False
    if exact:
        return run, query
    return None, _both(query, _of_words(run))


def _part(op, value) -> tuple[list[str] | None, Query]:
    if op is sre.LITERAL:
        return [chr(value).lower()], None
    if op is sre.IN:
        chars = set()
        for kind, v in value:
            if kind is sre.LITERAL:
                chars.add(chr(v).lower())
            elif kind is sre.RANGE and v[1] - v[0] < 4:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (sorted(chars), None) if len(chars) <= 6 else (None, None)
    if op is sre.SUBPATTERN:
        return _analyse(value[3])
    if op is sre.BRANCH:
        found = [_analyse(branch) for branch in value[1]]
        if all(w is not None and q is None for w, q in found):
            return [w for ws, _ in found for w in ws], None
        return None, _any([_both(q, _of_words(w)) for w, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        words, query = _analyse(inner)
        if least == 0:
            return (["", *words], None) if most == 1 and words is not None and query is None else (None, None)
        if words is not None and query is None and least == most == 1:
            return words, None
        return None, _both(query, _of_words(words))
    if op is sre.AT:
        return [""], None
    return None, None


def trigrams_of(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _holds(query: Query, postings: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(postings, query)
    parts = [_holds(q, postings) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the postings of the trigrams over texts(key, text); case is ignored."""
    low = texts.select("key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for each document with any, the kinds of the rules whose trigram query its postings satisfy."""
    postings = index.groupBy("key").agg(F.collect_set("trigram").alias("trigrams"))
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern)) is not None]
    met = F.array_compact(F.array(*[F.when(_holds(q, F.col("trigrams")), F.lit(kind)) for kind, q in asked]))
    return postings.select("key", met.alias("rules")).filter(F.size("rules") > 0)


#: Matches of a text whose spans are gathered at once: arrays are copied as they grow, so a long one is made of blocks.
BLOCK = 1_024
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches in a text; code points, end exclusive.

    The pieces between the matches and the matches themselves, taken out by the same expression, give the positions.
    """
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = hits if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), judged.alias("judged"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"), none.alias("own"))

    def step(so_far: Column, part: Column) -> Column:
        begin = so_far["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        own = F.when(F.length(part["judged"]) >= rule.least, F.concat(so_far["own"], F.array(span))).otherwise(so_far["own"])
        return F.struct(end.alias("at"), so_far["out"].alias("out"), own.alias("own"))

    def block(so_far: Column, own: Column) -> Column:
        closed = lambda x: F.struct(x["at"].alias("at"), F.concat(x["out"], F.array(x["own"])).alias("out"), none.alias("own"))
        return F.aggregate(own, so_far, step, closed)

    return F.aggregate(blocks, start, block, lambda x: F.flatten(x["out"]))


def find_secrets(docs: DataFrame, added: tuple[Rule, ...] = ADDED_RULES) -> DataFrame:
    """docs, with all its columns, and `secrets`: array<struct<start, rank, kind, end>> by start, then rank of the kind.

    docs needs doc_id and text; a column `secrets` of its own is replaced, all others stay, whatever their names. A null text is empty and has no secrets; null
    doc_ids and repeated rows are rows like others; an empty table gives an empty result.
    """
    rules = BASE_RULES + added
    own = [c for c in docs.columns if c.lower() != "secrets"]
    at, met = fresh("__key", own), fresh("__rules", own)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    named = sorted(set().union(*map(trigrams_of, queries.values())))
    key = F.xxhash64("doc_id", "text")
    index = trigram_index(docs.filter("text is not null").select(key.alias("key"), "text"), named)
    proposed = candidates(index, rules).select(F.col("key").alias(at), F.col("rules").alias(met))
    joined = docs.select(*(f"`{c}`" for c in own), key.alias(at)).join(proposed, at, "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(_SPANS)
    found = []
    for order, rule in enumerate(rules):
        asked = F.array_contains(met, rule.kind) if queries[rule.kind] is not None else text.rlike(rule.pattern)
        found.append(F.when(asked, spans_of(rule, order, text)).otherwise(none))
    every = F.array_sort(F.concat(*found))
    return joined.select(*(f"`{c}`" for c in own), every.alias("secrets"))


def span_text(secrets: Column, base_only: bool = False) -> Column:
    """`kind:start:end` of spans, joined by commas."""
    chosen = F.filter(secrets, lambda s: s["rank"] < len(BASE_RULES)) if base_only else secrets
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of find_secrets() with every secret in the text replaced by `mark` (overlapping ones by one), without `secrets`."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, s: Column) -> Column:
        fresh = s["start"] >= so_far["at"]
        gap = F.substr("text", so_far["at"] + 1, s["start"] - so_far["at"])
        out = F.when(fresh, F.concat(so_far["out"], gap, F.lit(mark))).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), out.alias("out"))

    cut = F.aggregate("secrets", start, step, lambda x: F.concat(x["out"], F.substr(F.col("text"), x["at"] + 1)))
    return found.withColumn("text", F.when(F.size("secrets") > 0, cut).otherwise(F.col("text"))).drop("secrets")
