"""Rows that every operator has to live with."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """n different-looking words in lines of twelve."""
    words = []
    for i in range(n):
        x = (seed * 7919 + i * 104729 + i * i * 31) % 9973
        words.append("".join("bcdfglmnprst"[(x >> 3 * j) % 12] + "aeiou"[(x >> 2 * j) % 5] for j in range(2 + x % 3)))
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def odd_rows():
    """Every kind of row an operator has to live with."""
    clean = prose(1, 120)
    return [
        (1, clean, "en", "a", len(clean)),
        (2, clean, "en", "a", len(clean)),  # a copy
        (2, clean, "en", "a", len(clean)),  # a repeated row
        (3, prose(3, 90), None, None, None),
        (4, None, "en", "b", None),
        (5, "", "de", "b", 0),
        (6, " \t\n\x0b\x0c\r ", "de", None, 7),
        (None, prose(4, 70), "fr", "c", None),
        (None, None, None, None, None),
        (7, "12 34 — 56 !!", "es", "c", 13),
        (8, prose(8, 30000), "es", "c", None),  # very long
        (9, "x" * 5000, "en", "a", 5000),  # one long word
        (10, "é漢 \U0001f600 ß́ ▁▁", "en", "d", None),
        (11, prose(11, 200), "en", "a", None),
    ]
