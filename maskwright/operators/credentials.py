"""Credential policy for pasted logs and forwarded text.

These rules look for where a credential stands (an assignment, a header, a block), not for what it
looks like, so they hold whatever detector runs beside them. Line breaks are always spelled out as
CRLF, CR or LF, and quotation prefixes are matched by back-reference, so a block ends where its
quotation ends. Loops over unbounded text are possessive: they neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.functions.regex import WORD
from maskwright.operators.detect import beyond_ascii
from maskwright.operators.detect import rule_spans as detect_rule

_EOL = r"(?:\r\n|\r|\n)"
_LINE_END = r"(?=[\r\n]|\z)"
_LINE_START = r"(?<![^\r\n])"
_QUOTING = r"((?:[ \t]*>)*+)"

# A key may carry a prefix joined by "_" or "-" and must end right before its quote or operator.
# Each run of word characters is entered once, from its start.
_KEY = rf"(?:[{WORD}-]*[_-])?{V.CREDENTIAL_KEYS}"
_BLOCK_MARK = r"[|>](?:[+-][0-9]?|[0-9][+-]?)?[ \t]*(?:#[^\r\n]*+)?"

_VALUE = "|".join(
    [
        r'"(?:[^"\\]|\\.)++"',
        r"'(?:[^'\\]|\\.)++'",
        # an opening quote that is never closed: up to the end of its first line
        r"""(?!""|'')["'][^\r\n]++""",
        # Bare words. A lone block mark is not a value: its value is the block below it.
        rf"""(?!{_BLOCK_MARK}{_LINE_END})[^\s,;"'][^\s,;]*+""",
    ]
)

_CONTINUED = rf"{_EOL}\2\3[ \t]++[^\s][^\r\n]*+"
_BLANK_LINES = rf"(?:{_EOL}\2[ \t]*+{_LINE_END})*+"

# Rule -> (pattern, number of the span's group). Group 1 is what stays in front of the span.
PATTERNS = {
    # key = value on one line, and quoted values over several
    "assignment": (
        rf"""(?isu)()(([\"']?)(?<![{WORD}-]){_KEY}\3[ \t]*[:=][ \t]*(?:{_VALUE}))""",
        2,
    ),
    # key: | with an indented block below, at the same level of quotation
    "block": (
        rf"""(?iu)({_LINE_START}{_QUOTING}([ \t]*+)(?:-[ \t]+)?)"""
        rf"""(([\"']?){_KEY}\5[ \t]*:[ \t]*{_BLOCK_MARK}(?:{_BLANK_LINES}{_CONTINUED})++)""",
        4,
    ),
    # copied request and response headers with their continuation lines
    "header": (
        rf"(?iu)({_LINE_START}{_QUOTING}([ \t]*+))"
        rf"((?:{'|'.join(V.CREDENTIAL_HEADERS)}):[ \t]*+"
        rf"(?:[^\s][^\r\n]*+(?:{_CONTINUED})*+|(?:{_CONTINUED})++))",
        4,
    ),
    "private_key": (
        r"()(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z0-9 ]*PRIVATE KEY-----)",
        2,
    ),
}


def _guard(rule: str, text: str) -> str:
    low, colon, equals = f"lower({text})", f"contains({text}, ':')", f"contains({text}, '=')"

    def named(*names: str) -> str:
        # letters outside ASCII may match as well
        return f"({beyond_ascii(text)} OR {' OR '.join(f'contains({low}, {name!r})' for name in names)})"

    keys = named("key", "token", "passw", "secret")
    return {
        "assignment": f"({colon} OR {equals}) AND {keys}",
        "block": f"{colon} AND (contains({text}, '|') OR contains({text}, '>')) AND {keys}",
        "header": f"{colon} AND {named('authorization', 'cookie')}",
        "private_key": f"contains({text}, 'PRIVATE KEY-----')",
    }[rule]


def _rule(text: str, rule: str) -> dict:
    pattern, group = PATTERNS[rule]
    return {"pattern": pattern, "groups": (1, group), "guard": _guard(rule, text)}


def rule_spans(text: str, rule: str) -> str:
    """All matches of one credential rule as a SQL expression."""
    return S.find_all(text, label="secret", **_rule(text, rule))


def rule_pieces(text: str, rule: str) -> str:
    """The text cut around the matches of one credential rule, null without any. To be held as a column."""
    return S.pieces(text, **_rule(text, rule))


def raw_spans(text: str) -> str:
    """Matches of every credential rule, unmerged."""
    return S.joined(detect_rule(text, "secret"), *(rule_spans(text, rule) for rule in PATTERNS))


def credential_spans(text: str) -> str:
    """Disjoint ranges of ``text`` that the policy masks whatever the detector finds."""
    return S.bind("creds", raw_spans(text), S.merge("creds"))


def with_credentials(df: DataFrame, text_col: str = "text", out: str = "credentials") -> DataFrame:
    return S.hold(df, {out: credential_spans(text_col)})
