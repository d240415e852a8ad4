"""What counts as a letter, for Python and for Spark's Java expressions."""

from __future__ import annotations

import regex

LETTER_RUNS = regex.compile(r"\p{L}+")
JAVA_NOT_LETTERS = r"[^\p{L}]+"


def lowered_runs(text: str) -> list[str]:
    """The letter runs of a text, each in lower case.

    Lower-casing the whole text first is quicker, but two letters change with their neighbours or their length.
    """
    if "İ" in text or "Σ" in text:
        return [w.lower() for w in LETTER_RUNS.findall(text)]
    return LETTER_RUNS.findall(text.lower())
