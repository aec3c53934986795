"""Answer extraction and normal forms as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, replaced

BOX = "\\boxed{"

#: What normal form A replaces, in order.
SUBSTITUTIONS = (
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
)
#: What normal form A removes, in order.
REMOVED = (
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
)
#: Patterns of answer lines, words and marks of mathematics.
ANSWER_ANYWHERE = r"(?i)Answer\s*:\s*([^\n]+)"
ANSWER_LINE = r"(?im)^\s*answer\s*:\s*(.+)\s*$"
HYBRID = r"Answer:\s*\\boxed\{([^}]+)\}"
WORD = r"[a-zA-Z]{2,}"
MATH = r"\\[a-zA-Z]+|[\d$\\{}^_=+\-*/().,]|\\frac|\\sqrt|\\boxed"


def _closed(tail: str) -> str:
    """SQL: what comes before the brace that closes a text's open brace; null if none does. Steps from brace to brace."""
    step = "if(a.depth = 0, a, named_struct('depth', a.depth + if(right(p, 1) = '{', 1, -1), 'at', a.at + length(p)))"
    fold = f"aggregate(regexp_extract_all({tail}, '[^{{}}]*[{{}}]', 0), named_struct('depth', 1, 'at', 0), (a, p) -> {step})"
    return let(fold, "e", f"if(e.depth = 0, substr({tail}, 1, e.at - 1), null)")


def extract_boxed(col: str, on_unbalanced: str = "null", last: str = "opener") -> Column:
    """The content of the last box with nested braces: of the last opener (an unbalanced one gives null, or what follows it
    for ``tail``), or of the last opener that is closed (``last='closed'``)."""
    parts = f"split({col}, '\\\\\\\\boxed\\\\{{')"
    if last == "closed":
        # From the last opener backwards; later openers are part of what earlier ones hold.
        inner = _closed("t")
        tails = f"transform(sequence(1, size(p) - 1), i -> {let('concat_ws(' + chr(39) + chr(92) * 2 + 'boxed{' + chr(39) + ', slice(p, size(p) - i + 1, i))', 't', inner)})"
        return F.expr(let(parts, "p", f"if(size(p) < 2, null, try_element_at(filter({tails}, x -> x is not null), 1))"))
    rest = "null" if on_unbalanced == "null" else "t"
    return F.expr(let(parts, "p", f"if(size(p) < 2, null, {let('element_at(p, -1)', 't', f'coalesce({_closed(chr(116))}, {rest})')})"))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_match(col: Column, pattern: str) -> Column:
    return bind(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)), lambda found: F.when(F.size(found) > 0, F.element_at(found, -1)))


def answer_anywhere(col: Column) -> Column:
    return last_match(col, ANSWER_ANYWHERE)


def answer_line(col: Column) -> Column:
    return F.trim(last_match(col, ANSWER_LINE))


def normalize_final(c: Column) -> Column:
    """Normal form A: what follows the last =, with words, units and TeX wrappers taken out."""
    s = F.element_at(F.split(c, "="), -1)
    s = replaced(replaced(s, SUBSTITUTIONS), [(x, "") for x in REMOVED])
    s = F.regexp_replace(s, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for name in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, r"(\\" + name + r"\{)(.*?)(\})", "$2")
    s = F.regexp_replace(s, r"(\\boxed\{)(.*)(\})", "$2")
    s = F.regexp_replace(s, r"(frac)([^{])(.)", r"frac{$2}{$3}")
    s = F.replace(F.regexp_replace(s, r"(sqrt)([^{])", r"sqrt{$2}"), F.lit("$"), F.lit(""))
    return F.trim(bind(s, lambda s: F.when(F.replace(s, F.lit(","), F.lit("")).rlike("^[0-9]+$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)))


def _int_text(c: Column) -> Column:
    """An integer's text without plus sign and leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")


def canonical_key(c: Column) -> Column:
    """Key B: wrappers off; integers and floats near an integer as integers; other text in lower case. Null gives ''."""
    s = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, r"\\\(|\\\)", ""), r"^\$+|\$+$", "")
    s = F.regexp_replace(s, r"^\\boxed\{(.*)\}$", "$1")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[.}\]\\)\s]+$", ""), r"^[\\\s({\[\$]+", ""))


    def key(s: Column) -> Column:
        number = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s).try_cast("double")
        near = (F.abs(number - F.rint(number)) < 1e-9) & (F.abs(number) < 1e15)
        return F.when(s.rlike("^[+-]?[0-9]+$"), _int_text(s)).when(near, F.rint(number).cast("bigint").cast("string")).otherwise(F.lower(s))

    return bind(s, key)


def canonical_key_clean(c: Column) -> Column:
    """Key C: fractions as a/b, whole percentages and integers with prose after them as integers."""
    s = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    s = F.trim(replaced(s, [(t, "") for t in ("\\text{", "\\textbf{", "\\(", "\\)", "$")]))
    s = F.regexp_replace(s, "[.;,]+$", "")
    frac = r"\\frac\{([^{}]+)\}\{([^{}]+)\}"
    s = bind(s, lambda s: F.when(s.rlike(frac), F.concat(F.trim(F.regexp_extract(s, frac, 1)), F.lit("/"), F.trim(F.regexp_extract(s, frac, 2)))).otherwise(s))
    percent = r"^(-?[0-9]+)(?:\\%|%)$"
    lead = r"^(-?[0-9]+)\s+[a-zA-Z]"

    def key(s: Column) -> Column:
        tight = F.replace(s, F.lit(" "), F.lit(""))
        return (
            F.when(tight.rlike(percent), _int_text(F.regexp_extract(tight, percent, 1)))
            .when(s.rlike("^-?[0-9]+$"), _int_text(s))
            .when(F.contains(s, F.lit("/")), F.lower(s))
            .when(s.rlike(lead) & (F.length(s) <= 32), _int_text(F.regexp_extract(s, lead, 1)))
            .otherwise(F.lower(s))
        )

    return bind(s, key)


def semantic_bucket(c: Column) -> Column:
    return bind(
        canonical_key_clean(c),
        lambda k: F.when(k == "", "empty")
        .when(k.rlike("^-*[0-9]+/-*[0-9]+$"), F.concat(F.lit("frac:"), k))
        .when(k.rlike("^-?[0-9]+$"), F.concat(F.lit("n:"), k))
        .otherwise(F.concat(F.lit("s:"), F.substring(F.regexp_replace(k, r"\s+", " "), 1, 120))),
    )


def latex_key(c: Column, halves: bool = True) -> Column:
    """Key D: TeX text without spacing, units and \\left \\right, with fractions and roots in braces. With ``halves`` the one decimal
    0.5 becomes a fraction, as the survey's special case says; without, every decimal stays one."""
    pairs = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
    s = replaced(c, pairs)
    s = bind(s, lambda s: bind(F.split(s, r"\\text\{ "), lambda units: F.when(F.size(units) == 2, units[0]).otherwise(s)))
    s = replaced(s, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    s = F.regexp_replace(s, r"^\.", "0.")
    s = bind(s, lambda s: bind(F.split(s, "=", -1), lambda sides: F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), sides[1]).otherwise(s)))
    s = F.replace(F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    if halves:
        s = F.regexp_replace(s, r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def is_runon(c: Column, max_chars: int = 80) -> Column:
    """Long prose that is no answer."""

    def judged(s: Column) -> Column:
        words, hits = F.regexp_count(s, F.lit(WORD)), F.regexp_count(s, F.lit(MATH))
        integer = F.replace(s, F.lit(","), F.lit("")).rlike("^-?[0-9]+$")
        return (s != "") & ((F.length(s) > max_chars) | ((words >= 6) & (hits < 3)) | ((words >= 4) & (hits == 0) & ~integer))

    return bind(F.trim(F.coalesce(c, F.lit(""))), judged)
