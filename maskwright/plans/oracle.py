"""SQL texts that recompute the results in another engine, from the same tables.

They share patterns and view definitions with the Spark side, but find, merge and cut spans by
joins, windows and string aggregation. RE2 has ASCII word characters, so texts are matched with
their Latin-1 letters folded to ``_`` and cut from the original by offset.
"""

from __future__ import annotations

from maskwright import fixed_values as V
from maskwright.sources import tables as T


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


MESSAGES = f"messages AS ({T.view_sql(T.message_view(T.DUCKDB), 'orders')})"
ATTEMPTS = f"attempts AS ({T.view_sql(T.attempt_view(T.DUCKDB), 'events')})"
PASTED = f"logs AS ({T.view_sql(T.pasted_view(T.DUCKDB), 'events')})"
LOGS = f"logs AS ({T.view_sql(T.log_view(T.DUCKDB), 'events')})"
TEXTS = f"{MESSAGES}, texts AS ({T.texts_sql()})"
INTERNAL = "(" + ", ".join(lit(d) for d in T.INTERNAL_DOMAINS) + ")"

_PATTERNS = {name: (label, pattern) for name, label, pattern in V.RULES}
_PHONE_BODY = _PATTERNS["phone"][1].split(r"(?<=^))", 1)[1].split("(?=", 1)[0]


def folded(name: str, source: str, keys: str, text: str = "text") -> str:
    return (
        f"{name} AS (SELECT {keys}, regexp_replace({text}, '[À-ÖØ-öø-ÿ]', '_', 'g') AS f "
        f"FROM {source})"
    )


def _all_matches(source: str, keys: str, pattern: str, label: str, group: int = 0) -> str:
    p = lit(pattern)
    before = (
        "list_sum(list_transform(g[1:i], lambda x: length(x))) "
        "+ coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) "
        "+ length(m[i]) - length(h[i])"
    )
    return (
        f"SELECT {keys}, {lit(label)} AS label, hit.s AS s, hit.s + hit.n AS e FROM ("
        f"SELECT {keys}, unnest(list_transform(range(1, len(m) + 1), lambda i: "
        f"{{'s': cast({before} AS bigint), 'n': length(h[i])}})) AS hit FROM ("
        f"SELECT {keys}, regexp_extract_all(f, {p}) AS m, regexp_extract_all(f, {p}, {group}) AS h, "
        f"string_split_regex(f, {p}) AS g FROM {source} WHERE regexp_matches(f, {p})))"
    )


def _phones(source: str, keys: str) -> str:
    """Step from match to match: the phone rule looks around itself, which RE2 cannot."""
    p = lit(rf"(?s)^((?:.*?\s)??)({_PHONE_BODY})(?:[\s.,;:]|$)")
    return (
        f"SELECT {keys}, 'private_phone' AS label, s, s + n AS e FROM ("
        f"WITH RECURSIVE walk AS (SELECT {keys}, f AS rest, 0::bigint AS base, NULL::bigint AS s, "
        f"NULL::bigint AS n FROM {source} UNION ALL "
        f"SELECT {keys}, substr(rest, length(pre) + length(hit) + 1), base + length(pre) + length(hit), "
        f"base + length(pre), length(hit) FROM (SELECT *, regexp_extract(rest, {p}, 1) AS pre, "
        f"regexp_extract(rest, {p}, 2) AS hit FROM walk) WHERE hit <> '') "
        f"SELECT * FROM walk WHERE s IS NOT NULL)"
    )


def rule(source: str, keys: str, name: str) -> str:
    label, pattern = _PATTERNS[name]
    if name == "phone":
        return _phones(source, keys)
    return _all_matches(source, keys, pattern, label, 1 if name == "person_hint" else 0)


def raw(name: str, source: str, keys: str) -> str:
    """CTE with the matches of all rules: keys, label, s, e."""
    return f"{name} AS ({' UNION ALL '.join(rule(source, keys, r) for r in _PATTERNS)})"


# The credential policy on texts that hold only plain assignments (no prefixes, blocks or headers).
def assignments(source: str, keys: str) -> str:
    pattern = (
        rf'(?is)\b{V.CREDENTIAL_KEYS}[ \t]*[:=][ \t]*(?:"(?:[^"\\]|\\.)+"|'
        r"""'(?:[^'\\]|\\.)+'|[^\s,;"'][^\s,;]*)"""
    )
    return _all_matches(source, keys, pattern, "secret")


def merged(name: str, source: str, keys: str) -> str:
    """CTEs that join overlapping rows of ``source`` (keys, label, s, e) into islands."""
    order = f"PARTITION BY {keys} ORDER BY s, e, label"
    return (
        f"{name}_o AS (SELECT *, max(e) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND "
        f"1 PRECEDING) AS reach FROM (SELECT DISTINCT {keys}, label, s, e FROM {source})), "
        f"{name}_c AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER "
        f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}_o), "
        f"{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e, first(label ORDER BY "
        f"(label <> 'secret'), e - s DESC, s, label) AS label FROM {name}_c GROUP BY {keys}, island)"
    )


def redacted(name: str, source: str, spans: str, keys: list[str], text: str = "text", mark: str = "'[' || upper(label) || ']'") -> str:
    """CTE keys, redacted: the text with its disjoint spans replaced."""
    k = ", ".join(keys)
    on = " AND ".join(f"t.{c} = r.{c}" for c in keys)
    j = " AND ".join(f"t.{c} = q.{c}" for c in keys)
    tk = ", ".join(f"t.{c}" for c in keys)
    return (
        f"{name}_g AS (SELECT {tk}, string_agg(substr(t.{text}, (q.p + 1)::bigint, (q.s - q.p)::bigint) || {mark}, '' ORDER BY q.s) AS head, "
        f"max(q.e) AS tail FROM {source} t JOIN (SELECT *, coalesce(lag(e) OVER (PARTITION BY {k} ORDER BY s), 0) AS p "
        f"FROM {spans}) q ON {j} GROUP BY {tk}), "
        f"{name} AS (SELECT {tk}, CASE WHEN r.tail IS NULL THEN t.{text} ELSE r.head || substr(t.{text}, (r.tail + 1)::bigint) END "
        f"AS redacted FROM {source} t LEFT JOIN {name}_g r ON {on})"
    )


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


DETECTED = ", ".join(
    [TEXTS, folded("folded", "texts", "text_id"), raw("found", "folded", "text_id"), merged("spans", "found", "text_id")]
)
