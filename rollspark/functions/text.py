"""Text column functions of prompts and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_nonblank(*cols: str) -> Column:
    """The first of several columns that is not blank."""
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in cols])


def ground_truth(col: str, field: str = "ground_truth") -> Column:
    """A field of a dict that was stored as its single-quoted text; other text is the value itself."""
    inside = F.get_json_object(F.translate(F.col(col), "'", '"'), f"$.{field}")
    return F.when(F.trim(F.col(col)).startswith("{"), inside).otherwise(F.trim(F.col(col)))


def is_integer_gold(col: str) -> Column:
    return F.replace(F.trim(F.coalesce(F.col(col), F.lit(""))), F.lit(","), F.lit("")).rlike("^-?[0-9]+$")


def last_sentence(col: str) -> Column:
    """The last part that is not blank, cut after .!? and white space, or at line ends."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("")


def prompt_flags(problem: str, gold: str) -> dict[str, Column]:
    last, p, g = last_sentence(problem), F.lower(problem), F.lower(F.trim(F.coalesce(F.col(gold), F.lit(""))))
    return {
        "last_starts_prove": last.rlike(r"(?i)^prove\b"),
        "last_contains_prove": F.contains(F.lower(last), F.lit("prove")),
        "contains_show_that": F.col(problem).rlike(r"(?i)\bshow\s+that\b"),
        "gold_in_prompt": (g != "") & F.contains(p, g),
    }


#: Prompt templates by name.
TEMPLATES = {
    "dapo_answer_v1": """Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem.

{problem}

Remember to put your answer on its own line after "Answer:".""",
    "verl_math_boxed": "{problem} Let's think step by step and output the final answer within \\boxed{}.",
    "verl_polaris_maxrl": "{problem}\nPlease reason step by step, and put your final answer within \\boxed{}.",
    "hybrid_answer_boxed": """Solve the following math problem step by step. End your response with the final answer on its own line, formatted exactly as: Answer: \\boxed{$Answer}

{problem}

Remember: the last line must be "Answer: \\boxed{...}" with your final answer inside the box.""",
}


def format_prompt(problem: str, variant: str) -> Column:
    before, after = TEMPLATES[variant].split("{problem}")
    return F.concat(F.lit(before), F.col(problem), F.lit(after))


def extract_problem(col: str) -> Column:
    """The user's text of a rendered chat, without the instruction at its end."""
    user = F.regexp_extract(col, r"(?s)<\|im_start\|>user\n(.*?)\n<\|im_end\|>", 1)
    text = F.trim(F.when(F.col(col).rlike(r"(?s)<\|im_start\|>user\n.*?\n<\|im_end\|>"), user).otherwise(F.col(col)))
    return F.trim(F.regexp_replace(text, r"\nPlease reason step by step, and put your final answer within \\boxed\{\}\.?$", ""))


#: Numeric code to LaTeX, in order.
TOKENS = (
    ("np.arcsin", "\\arcsin"),
    ("np.arccos", "\\arccos"),
    ("np.arctan", "\\arctan"),
    ("np.sqrt", "\\sqrt"),
    ("np.sin", "\\sin"),
    ("np.cos", "\\cos"),
    ("np.tan", "\\tan"),
    ("np.exp", "\\exp"),
    ("np.log", "\\log"),
    ("np.pi", "\\pi"),
    ("arcsin", "\\arcsin"),
    ("arccos", "\\arccos"),
    ("arctan", "\\arctan"),
    ("sqrt", "\\sqrt"),
)


def replaced(c: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def rewrite_tokens(col: str, pairs=TOKENS, marker: str = "np.") -> Column:
    """Ordered replacements, only in texts that hold the marker."""
    text = F.trim(F.col(col))
    return F.when(F.contains(text, F.lit(marker)), replaced(text, pairs)).otherwise(text)
