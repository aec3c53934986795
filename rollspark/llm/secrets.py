"""Secret scans through a trigram index, in DataFrame operations alone."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` is a regex with the same meaning in Python and Java; a match counts if the group
    ``group`` (0: the whole) has at least ``least`` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0


#: The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
)
#: Rules of our own that come on top.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(rule: Rule, most: int = 24) -> list[list[list[str]]]:
    """What a text must hold to match: AND over clauses, OR over a clause's alternatives, AND over their trigrams.

    Trigrams are in lower case. An empty list: the pattern has no mandatory trigrams.
    """
    clauses: list[list[list[str]]] = []

    def close(run: set[str]) -> None:
        alternatives = [sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(run)]
        if alternatives and all(alternatives):
            clauses.append(alternatives)

    def strings(node) -> set[str] | None:
        """All strings that a node matches in lower case, if there are few."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(c).lower() for _, c in arg}
        if op == "SUBPATTERN":
            return of_sequence(arg[3])
        if op == "BRANCH":
            found = [of_sequence(x) for x in arg[1]]
            return None if None in found else set().union(*found)
        if op == "MAX_REPEAT" and arg[1] <= 8 and (one := of_sequence(arg[2])) is not None:
            return _limited({s for k in range(arg[0], arg[1] + 1) for s in _powers(one, k)}, most)
        return None

    def of_sequence(nodes) -> set[str] | None:
        run = {""}
        for node in nodes:
            got = strings(node)
            run = None if got is None else _limited({a + b for a in run for b in got}, most)
            if run is None:
                return None
        return run

    run: set[str] = {""}
    for node in sre.parse(rule.pattern):
        got = strings(node)
        joined = None if got is None else _limited({a + b for a in run for b in got}, most)
        if joined is None:
            close(run)
            run = got or {""}
        else:
            run = joined
    close(run)
    return clauses


def _powers(one: set[str], k: int) -> set[str]:
    out = {""}
    for _ in range(k):
        out = {a + b for a in out for b in one}
    return out


def _limited(found: set[str], most: int) -> set[str] | None:
    return found if len(found) <= most else None


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _condition(clauses: list[list[list[str]]], present: str) -> str:
    """SQL for a trigram query over an array of trigrams."""
    return " and ".join("(" + " or ".join("(" + " and ".join(f"array_contains({present}, {_quoted(t)})" for t in alt) + ")" for alt in clause) + ")" for clause in clauses)


#: SQL for no spans.
NONE = "cast(array() as array<struct<s: int, k: int, e: int>>)"


def _running(values: str, zero: str, combine: str) -> str:
    """SQL for what ``combine`` makes of all values before each one, in steps of the square root of their number."""
    folded = lambda part, start: f"aggregate({part}, {start}, (a, x) -> {combine})"
    sums = f"transform(sequence(0, (size(v) - 1) div w), b -> {folded('slice(v, b * w + 1, w)', zero)})"
    before = f"transform(sequence(0, size(sums) - 1), b -> {folded('slice(sums, 1, b)', zero)})"
    each = f"transform(sequence(0, size(v) - 1), i -> {folded('slice(v, (i div w) * w + 1, i % w)', 'before[i div w]')})"
    made = let("cast(ceil(sqrt(size(v))) as int)", "w", let(sums, "sums", let(before, "before", each)))
    return let(values, "v", f"if(size(v) = 0, array(), {made})")


def _spans(rule: Rule, text: str, order: int) -> str:
    """SQL for an array of (start, order, end) of a rule's matches, leftmost and not overlapping, in code points."""
    # \G holds each match to the end of the one before, so the lazy gap never starts a second scan of the tail.
    pattern = _quoted(("(?si)" if rule.any_case else "(?s)") + r"\G(.*?)(" + rule.pattern + ")")
    get = lambda i: f"regexp_extract_all({text}, {pattern}, {i})"
    span = "named_struct('s', at[i] + gap[i], 'k', {k}, 'e', at[i] + both[i])".format(k=order)
    fine = f"filter(sequence(0, size(both) - 1), i -> length(value[i]) >= {rule.least})" if rule.least else "sequence(0, size(both) - 1)"
    found = let(_running("both", "0", "a + x"), "at", f"transform({fine}, i -> {span})")
    value = let(get(rule.group + 2), "value", found) if rule.least else found
    body = let(f"transform({get(1)}, x -> length(x))", "gap", f"if(size(gap) = 0, {NONE}, {let(f'zip_with(gap, {get(2)}, (x, y) -> x + length(y))', 'both', value)})")
    return body


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Add ``secrets``, an array of (s, k, e): start, number of the rule in ``rules``, end (exclusive) in code points.

    1. A Boolean trigram query is derived from each pattern. 2. One scan makes the postings: a row for each query trigram
       and document that holds it. 3. Postings are intersected by document, which leaves each rule's candidates. 4. The
       candidates' whole texts are verified by the pattern; rules without mandatory trigrams scan every text.

    Null text: no secrets. A document is known by its key and the hash of its text, so repeated rows and repeated or null
    keys are right too. Empty table: empty result. All input columns stay, whatever their names; one named ``secrets`` is
    replaced. Spans are sorted by start, then rule; spans of different rules may overlap. The work is nearly in proportion to
    a text's length and matches.
    """
    columns = [c for c in docs.columns if c != "secrets"]
    queries = {r.kind: trigram_query(r) for r in rules}
    wanted = sorted({t for q in queries.values() for clause in q for alt in clause for t in alt})
    # The input row is one column, so its names clash with none made here.
    known = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(key).cast("string"), F.lit("-")).alias("name"))
    known = known.select("row", "t", F.concat_ws(":", "name", F.xxhash64("t"), F.length("t")).alias("k"))

    listed = ", ".join(map(_quoted, wanted))
    postings = known.select("k", F.explode(F.expr(let("lower(t)", "low", f"filter(array({listed}), x -> contains(low, x))"))).alias("trigram"))
    indexed = [(i, r) for i, r in enumerate(rules) if queries[r.kind]]
    candidates = (
        postings.groupBy("k")
        .agg(F.collect_set("trigram").alias("present"))
        .select("k", F.expr("filter(array(" + ", ".join(f"if({_condition(queries[r.kind], 'present')}, {i}, -1)" for i, r in indexed) + "), i -> i >= 0)").alias("rules"))
        .where(F.size("rules") > 0)
    )
    found = known.join(candidates, "k", "left")
    each = []
    for i, r in enumerate(rules):
        # A class repeated without bound has maximal runs, so asking for its least length first finds the same matches.
        run = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        scan = Rule(r.kind, f"{run[1]}{{{r.least},}}") if run and r.least and not r.any_case else r
        gate = f"array_contains(rules, {i})" if queries[r.kind] else f"t rlike {_quoted(scan.pattern)}"
        each.append(f"if({gate}, {_spans(scan, 't', i)}, {NONE})")
    return found.withColumn("secrets", F.expr(f"sort_array(concat({', '.join(each)}))")).select("row.*", "secrets")


def redact(docs: DataFrame, text: str = "text", secrets: str = "secrets", mask: str = "[SECRET]", step: int = 1024) -> DataFrame:
    """Replace the spans in the text by ``mask``, overlapping spans by one; null texts stay null.

    What lies between the spans is taken from steps of the text and joined once, so the work is in proportion to the text
    and the number of spans.
    """
    quoted = ".".join(f"`{c}`" for c in text.split("."))
    piece = lambda a, b: f"if({b} <= {a}, '', substr(array_join(slice(steps, {a} div {step} + 1, ({b} - 1) div {step} - {a} div {step} + 1), ''), {a} % {step} + 1, {b} - {a}))"
    # A span that begins before the end of one before it belongs to that one's mask.
    firsts = "filter(sequence(0, size(z) - 1), i -> z[i].s >= at[i])"
    pieces = f"transform({firsts}, i -> {piece('at[i]', 'z[i].s')})"
    last = "array_max(transform(z, x -> x.e))"
    tail = let(last, "last", let(f"length({quoted})", "n", piece("last", "n")))
    joined = f"array_join(concat({pieces}, array({tail})), {_quoted(mask)})"
    made = let(_running("transform(z, x -> x.e)", "0", "greatest(a, x)"), "at", let(f"regexp_extract_all({quoted}, '(?s).{{1,{step}}}', 0)", "steps", joined))
    masked = f"if(size({secrets}) = 0, {quoted}, {let(secrets, 'z', made)})"
    return docs.withColumn(text, F.expr(f"if({quoted} is null, null, {masked})"))


def secret_digest(scanned: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Counts of the base rules, the hash of their spans, and all spans as text."""
    kinds = "array(" + ", ".join(_quoted(r.kind) for r in rules) + ")"
    joined = f"array_join(transform({{}}, x -> concat_ws(':', {kinds}[x.k], x.s, x.e)), ',')"
    count = lambda i: F.expr(f"cast(size(filter(secrets, x -> x.k = {i})) as bigint)")
    return scanned.select(
        F.col(key).alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(joined.format("filter(secrets, x -> x.k < 3)")), 256).alias("base_sha256"),
        F.expr(joined.format("secrets")).alias("spans"),
    )
