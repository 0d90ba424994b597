"""Scalar text expressions.  All JVM-side Column code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snippetflow.functions.rand import uniform

# Defaults of the reference configuration.
CROP_CHARS = 14000            # training crop length in characters
CROP_PROBS = (0.45, 0.45, 0.10)  # head, tail, middle
PROMPT_MAX_CHARS = 2048       # code characters given to the language prompt
MAX_TOKENS = 512              # token sequence cap of the classifier
PREVIEW_CHARS = 300

# Unicode white space as Python's str.strip() sees it: \s with UNICODE
# plus the four separators U+001C..U+001F.
_WS = r"[\s\x{1c}-\x{1f}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_length(code="code") -> Column:
    """Length in code points (as Python len)."""
    return F.length(_c(code))


def crop_head(code="code", n: int = CROP_CHARS) -> Column:
    """First n characters."""
    return F.substring(_c(code), 1, n)


def crop_tail(code="code", n: int = CROP_CHARS) -> Column:
    """Last n characters (unchanged when shorter)."""
    t = _c(code)
    return F.when(F.length(t) <= n, t).otherwise(F.substring(t, -n, n))


def crop_start(code, n: int, seed, *keys) -> Column:
    """0-based start of the random window: uniform over 0..len-n."""
    t = _c(code)
    span = F.greatest(F.length(t) - F.lit(n), F.lit(0)) + F.lit(1)
    return F.floor(uniform(seed, *keys) * span).cast("int")


def crop_window(code="code", n: int = CROP_CHARS, seed=42, keys=("id",)) -> Column:
    """Window of n chars with a seeded uniform start; unchanged if len <= n."""
    t = _c(code)
    start = crop_start(t, n, seed, *keys)
    return F.when(F.length(t) <= n, t).otherwise(F.substring(t, start + F.lit(1), n))


def crop_choice(seed=42, keys=("id",), probs=CROP_PROBS) -> Column:
    """Which view a training row gets: 'head', 'tail' or 'middle'."""
    u = uniform(seed, F.lit("crop"), *keys)
    return (F.when(u < F.lit(probs[0]), F.lit("head"))
            .when(u < F.lit(probs[0] + probs[1]), F.lit("tail"))
            .otherwise(F.lit("middle")))


def crop_augment(code="code", n: int = CROP_CHARS, seed=42, keys=("id",),
                 probs=CROP_PROBS) -> Column:
    """Apply the chosen view."""
    choice = crop_choice(seed, keys, probs)
    return (F.when(choice == "head", crop_head(code, n))
            .when(choice == "tail", crop_tail(code, n))
            .otherwise(crop_window(code, n, seed, keys)))


def strip_ws(s) -> Column:
    """Python ``str.strip()``: Unicode white space at both ends."""
    return F.regexp_replace(_c(s), rf"(?U)^{_WS}+|{_WS}+$", "")


def clean_response(resp="response") -> Column:
    """Strip white space, then drop every ' and \" (inner blanks stay)."""
    return F.translate(strip_ws(resp), "'\"", "")


def prompt_user_content(code="code", max_chars: int = PROMPT_MAX_CHARS) -> Column:
    """The user turn of the language prompt."""
    return F.concat(F.lit("Code snippet:\n\n"), F.substring(_c(code), 1, max_chars),
                    F.lit("\n\nIdentify the language:"))


# The system turn of the language prompt; {labels} is the
# label list written as a Python list literal.
SYSTEM_PROMPT_TEMPLATE = """You are an expert code classification engine. 
Strict Rules:
1. Classify the code into EXACTLY ONE of these categories: {labels}.
2. Distinguish carefully between 'C' and 'C++'. Look for '<iostream>', 'class', 'namespace', or 'template' (indicates C++) versus '<stdio.h>', 'malloc', 'struct' without methods (indicates C).
3. Distinguish 'Java' from 'C#'. Look for 'System.out.println' (Java) vs 'Console.WriteLine' (C#).
4. Output ONLY the language name from the list. No explanations."""


def system_prompt(labels) -> str:
    """The system turn for a given label list."""
    return SYSTEM_PROMPT_TEMPLATE.format(labels=str(list(labels)))


def chat_prompt(labels, code="code", max_chars: int = PROMPT_MAX_CHARS) -> Column:
    """array<struct<role, content>> with the system and user turns."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt(labels)).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt_user_content(code, max_chars).alias("content")),
    )


def preview(code="code", n: int = PREVIEW_CHARS, strip: bool = False) -> Column:
    """First n characters followed by '...' (optionally stripped first)."""
    t = strip_ws(code) if strip else _c(code)
    return F.concat(F.substring(t, 1, n), F.lit("..."))


def format_duration(seconds="seconds") -> Column:
    """X10: '1h 2m 3s' / '2m 3s' / '3s', every part truncated."""
    s = _c(seconds).cast("double")
    h = F.floor(s / 3600).cast("long")
    m = F.floor((s - F.floor(s / 3600) * 3600) / 60).cast("long")
    sec = F.floor(s - F.floor(s / 60) * 60).cast("long")
    return (F.when(h > 0, F.format_string("%dh %dm %ds", h, m, sec))
            .when(m > 0, F.format_string("%dm %ds", m, sec))
            .otherwise(F.format_string("%ds", sec)))


TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(code="code", pattern: str = TOKEN_SPLIT) -> Column:
    """Word tokens of lower(code); empty pieces removed."""
    return F.filter(F.split(F.lower(_c(code)), pattern), lambda t: t != F.lit(""))


def tokens_truncated(code="code", max_tokens: int = MAX_TOKENS,
                     pattern: str = TOKEN_SPLIT) -> Column:
    """X11: first max_tokens tokens (model tokenizer re-aimed as word tokens)."""
    return F.slice(tokens(code, pattern), 1, max_tokens)
