"""Secret scanning through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: trigrams
that every match must contain, with alternatives.  The index holds postings
``(trigram, document)`` of lower-cased texts for the trigrams that the queries mention.
Postings are intersected per document, which gives each rule its candidates, and only
these are verified with the expression itself; a rule without mandatory trigrams is
verified on every text.  All of it is DataFrame expressions.

Defined results: null text counts as empty; repeated rows give repeated rows, a null id
is matched null-safe; texts without secrets have zero counts and an empty span list; an
empty table gives an empty result; extra columns are ignored by the scan and kept by
the redaction.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import materialize
from pixelweave.llm.text import whole

#: Alternatives of a rule followed as exact strings before they become a query.
MAX_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("host_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
)

TRUE = ("and", ())


def _strings_query(strings: set[str]):
    """The trigrams of one of the strings must all occur."""
    options = []
    for s in strings:
        grams = tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))
        if not grams:
            return TRUE
        options.append(("and", grams))
    return options[0] if len(options) == 1 else ("or", tuple(sorted(options)))


def _all_of(parts: list):
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    return ("and", tuple(dict.fromkeys(flat)))


def trigram_query(pattern: str):
    """A Boolean query that every match's text satisfies, over lower-cased trigrams.

    A query is a trigram, ``("and", queries)`` or ``("or", queries)``; the empty
    conjunction is satisfied by every text.
    """

    def product(a: set[str], b: set[str]) -> set[str] | None:
        return {x + y for x in a for y in b} if len(a) * len(b) <= MAX_EXACT else None

    def of(items) -> tuple[set[str] | None, object]:
        """Exact strings that the items can match, if few; else None and a query."""
        found, run = [], {""}
        whole_is_exact = True
        for op, arg in items:
            exact, query = one(op, arg)
            joined = product(run, exact) if exact is not None else None
            if joined is None:
                whole_is_exact = False
                found.append(_strings_query(run))
                found.append(query if exact is None else TRUE)
                run = exact if exact is not None else {""}
            else:
                run = joined
        if whole_is_exact:
            return run, _strings_query(run)
        found.append(_strings_query(run))
        return None, _all_of(found)

    def one(op, arg):
        if op is rc.LITERAL:
            return {chr(arg).lower()}, TRUE
        if op is rc.SUBPATTERN:
            return of(arg[3])
        if op is rc.BRANCH:
            options = [of(x) for x in arg[1]]
            if all(e is not None for e, _ in options):
                union = set().union(*(e for e, _ in options))
                if len(union) <= MAX_EXACT:
                    return union, TRUE
            queries = [q if e is None else _strings_query(e) for e, q in options]
            return None, TRUE if TRUE in queries else ("or", tuple(queries))
        if op is rc.IN:
            chars = {chr(v).lower() for k, v in arg if k is rc.LITERAL}
            if all(k is rc.LITERAL for k, _ in arg) and len(chars) <= 8:
                return chars, TRUE
            return None, TRUE
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, item = arg
            exact, query = of(item)
            if high == 1 and low == 0 and exact is not None:
                return exact | {""}, TRUE
            return None, query if low else TRUE
        return None, TRUE

    exact, query = of(rp.parse(pattern))
    return _strings_query(exact) if exact is not None else query


def query_trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(query_trigrams, query[1]), set())


def trigram_postings(docs: DataFrame, trigrams: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(trigram, doc_id)``: of the given trigrams, or (None) of all."""
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(whole(text_col)).alias("low"))
    if trigrams is None:
        every = F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))
        return low.select(F.explode(every).alias("trigram"), "doc_id")
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def _satisfied(query, mask: Column, bit: dict[str, int]) -> Column:
    if isinstance(query, str):
        return mask.bitwiseAND(F.lit(1 << bit[query])) != 0
    op, parts = query
    if op == "and":
        need = sum(1 << bit[p] for p in parts if isinstance(p, str))
        out = mask.bitwiseAND(F.lit(need)) == F.lit(need)
        for p in parts:
            if not isinstance(p, str):
                out = out & _satisfied(p, mask, bit)
        return out
    out = _satisfied(parts[0], mask, bit)
    for p in parts[1:]:
        out = out | _satisfied(p, mask, bit)
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, c_0, c_1, ...)``: may rule k match, by the index; only rows where one may."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(query_trigrams, queries)))
    blocks = [grams[i : i + 60] for i in range(0, len(grams), 60)]
    postings = trigram_postings(docs, grams, id_col, text_col)
    place = {g: (b, i) for b, own in enumerate(blocks) for i, g in enumerate(own)}
    number = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(1 << place[g][1]))])[F.col("trigram")]
    block = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(place[g][0]))])[F.col("trigram")]
    postings = postings.select("doc_id", number.alias("bit"), block.alias("block"))
    masks = postings.groupBy("doc_id").agg(*[F.coalesce(F.bit_or(F.when(F.col("block") == b, F.col("bit"))), F.lit(0)).alias(f"m_{b}") for b in range(len(blocks))])
    tests = []
    for k, q in enumerate(queries):
        if q == TRUE:
            continue
        tests.append(_everywhere(q, place).alias(f"c_{k}"))
    out = masks.select("doc_id", *tests)
    some = F.lit(False)
    for k, q in enumerate(queries):
        if q != TRUE:
            some = some | F.col(f"c_{k}")
    return out.where(some)


def _everywhere(query, place: dict[str, tuple[int, int]]) -> Column:
    """Like ``_satisfied`` when the trigrams fill more than one mask column."""
    if isinstance(query, str):
        b, i = place[query]
        return F.col(f"m_{b}").bitwiseAND(F.lit(1 << i)) != 0
    op, parts = query
    by_block: dict[int, dict[str, int]] = {}
    for p in parts:
        if isinstance(p, str):
            by_block.setdefault(place[p][0], {})[p] = place[p][1]
    if op == "and":
        tests = [_satisfied(("and", tuple(own)), F.col(f"m_{b}"), own) for b, own in by_block.items()]
        tests += [_everywhere(p, place) for p in parts if not isinstance(p, str)]
        out = tests[0] if tests else F.lit(True)
        for t in tests[1:]:
            out = out & t
        return out
    out = _everywhere(parts[0], place)
    for p in parts[1:]:
        out = out | _everywhere(p, place)
    return out


def _spans(text: str, rule: Rule, rank: int) -> Column:
    """Spans ``(start, rank, end, kind)`` of a rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + s["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + s["n"]).alias("at"), F.when(s["held"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.transform(
        F.arrays_zip(found.alias("m"), held.alias("g"), F.slice(gaps, F.lit(1), F.size(found)).alias("p")),
        lambda z: F.struct(F.length(z["m"]).alias("n"), F.length(z["p"]).alias("gap"), F.length(z["g"]).alias("held")),
    )
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def _bounded(rule: Rule) -> str:
    """The pattern that finds a text worth verifying: a long enough match."""
    if rule.group == 0 and rule.pattern.endswith("]+"):
        tail = re_tail(rule.pattern)
        return f"{rule.pattern[:-1]}{{{rule.least - tail},}}"
    return rule.pattern


def re_tail(pattern: str) -> int:
    """Characters that a pattern of literals and one final class needs before the class."""
    return len(pattern[: pattern.rindex("[")])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` (never null) and ``spans``, an array of
    ``(start, rank, end, kind)`` in text order.

    Rows meet their postings by a hash of id and text, so ids that are null or repeat do
    not gather in one task; if two such hashes are equal, candidates are more, not fewer.
    The candidates are written first: the optimizer broadcasts them if they are few.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col), whole(text_col)).alias("_own"), whole(text_col).alias("text"))
    may = materialize(candidates(rows, rules, "_own", "text").withColumnRenamed("doc_id", "_id"), "secret-candidates")
    joined = rows.join(may, F.col("_own") == F.col("_id"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for k, r in enumerate(rules):
        test = F.coalesce(F.col(f"c_{k}"), F.lit(False)) if f"c_{k}" in may.columns else F.lit(True)
        parts.append(F.when(test & F.col("text").rlike(_bounded(r)), _spans("text", r, k)).otherwise(none))
    return joined.select("row", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans per document."""
    base = [k for k, r in enumerate(rules) if r.base]
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules, "doc_id", "text").select("row.doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(_listed(F.filter("spans", lambda s: s["rank"].isin(base))), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans by one mark."""
    found = scan(docs, rules, id_col, text_col)
    text = F.col("text")

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole_text = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    fresh = F.when(F.size("spans") > 0, whole_text).otherwise(F.col("row")[text_col])
    return found.select(*[(fresh if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
