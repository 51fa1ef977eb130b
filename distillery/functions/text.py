"""Column expressions for words, prompts, messages and rendered text.

All of these are JVM-side Spark SQL expressions (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from distillery import options as O

# A word is a maximal run of characters that Python's ``str.split()`` does
# not treat as whitespace. Java's Unicode ``\s`` plus the four information
# separators U+001C..U+001F gives exactly Python's ``str.isspace`` set.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
# The same set written for RE2 (DuckDB), used by the oracle SQL.
WORD_PATTERN_RE2 = (
    r"[^\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Array of whitespace-separated words (Python ``str.split()``)."""
    return F.regexp_extract_all(_c(text), F.lit(WORD_PATTERN), F.lit(0))


def word_count(text) -> Column:
    """Number of words as BIGINT; null text gives null."""
    return F.size(words(text)).cast("bigint")


def teacher_prompt(instruction, system: str = O.TEACHER_SYSTEM_PROMPT) -> Column:
    """``System: {sys}\\nUser: {instruction}\\nAssistant:``"""
    return F.concat(F.lit("System: " + system + "\nUser: "), _c(instruction), F.lit("\nAssistant:"))


def assistant_prompt(prompt) -> Column:
    """``User: {prompt}\\nAssistant:``"""
    return F.concat(F.lit("User: "), _c(prompt), F.lit("\nAssistant:"))


def student_prompt(instruction, system: str = O.ASSISTANT_SYSTEM_PROMPT) -> Column:
    """Teacher layout with the assistant system prompt."""
    return teacher_prompt(instruction, system)


def training_text(instruction, output, system: str = O.ASSISTANT_SYSTEM_PROMPT) -> Column:
    """``System: {sys}\\nUser: {instruction}\\nAssistant: {output}``"""
    return F.concat(F.lit("System: " + system + "\nUser: "), _c(instruction),
                    F.lit("\nAssistant: "), _c(output))


def message(role: str | Column, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _c(content).alias("content"))


def chat_messages(instruction, system: str = O.TEACHER_SYSTEM_PROMPT,
                  system_role: str = "system") -> Column:
    """``[{role: system, content: sys}, {role: user, content: instruction}]``.

    ``system_role="developer"`` gives the batch-request variant.
    """
    return F.array(message(system_role, F.lit(system)), message("user", instruction))


def role_title(role) -> Column:
    """``user`` -> ``User``: first character upper-cased, rest unchanged."""
    r = _c(role)
    return F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))


def render_messages(messages, generation_prompt: bool = False) -> Column:
    """Render an array of {role, content} as ``Role: content`` lines."""
    body = F.array_join(
        F.transform(_c(messages), lambda m: F.concat(role_title(m["role"]), F.lit(": "), m["content"])),
        "\n")
    if generation_prompt:
        body = F.concat(body, F.lit("\nAssistant:"))
    return body
