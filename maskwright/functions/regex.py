"""Translate ``re`` patterns to the java.util.regex dialect that Spark evaluates.

The two dialects disagree about what a word, a digit and a blank are outside ASCII, and about
``$``. Each shorthand is replaced by an explicit Unicode set so a pattern finds the same code
points on the JVM as it does in Python.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

_OUTSIDE = {
    r"\w": f"[{WORD}]",
    r"\d": DIGIT,
    r"\s": f"[{SPACE}]",
    r"\S": f"[^{SPACE}]",
    r"\b": BOUNDARY,
}
_INSIDE = {r"\w": WORD, r"\d": DIGIT, r"\s": SPACE}


def to_java(pattern: str) -> str:
    """Rewrite the shorthands of ``pattern``; everything else has the same meaning in Java."""
    out: list[str] = []
    in_set = False
    i = 0
    while i < len(pattern):
        if pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
            continue
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if token == "$" and not in_set:
            out.append(r"(?=\n?\z)")
        else:
            out.append((_INSIDE if in_set else _OUTSIDE).get(token, token))
        if token == "[":
            in_set = True
        elif token == "]":
            in_set = False
        i += len(token)
    return "".join(out)
