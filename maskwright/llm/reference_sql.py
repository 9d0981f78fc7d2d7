"""SQL texts that recompute training-data queries in another engine, from the same tables.

Of the other queries none has such a text: op1, op3 and op8 train models, op2 aligns with edits, op4 hashes
with a function and op5 and op13 use tokenizers that SQL lacks, op10 and op12 are too slow in SQL over whole tables, and op11
parses documents. They are compared with plain versions in ``tests/llm/``.
"""

from __future__ import annotations

from maskwright.llm import quality_rules


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Kind: pattern, and the condition on a whole match `m` and its group `v`.
_SECRETS = {
    "assign": (_ASSIGN, "length(v) >= 12"),
    "access": (r"(AKIA[A-Z0-9]+)", "length(m) >= 18"),
    "hex": (r"([0-9a-f]+)", "length(m) >= 16"),
    "private_key": (r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", "true"),
}


def _matches(rank: int, kind: str) -> str:
    """Matches with their offsets: gaps and matches of a text in turn, lengths summed up to each match."""
    pattern, condition = _SECRETS[kind]
    p = _lit(pattern)
    return (
        f"SELECT rid, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT rid, m, v, "
        "cast(sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS bigint) - length(m) AS s FROM ("
        f"SELECT rid, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_extract_all(text, {p}, 1)) AS v, "
        f"unnest(string_split_regex(text, {p})[1:n]) AS g, unnest(range(1, n + 1)) AS i "
        f"FROM (SELECT rid, text, len(regexp_extract_all(text, {p})) AS n FROM docs WHERE regexp_matches(text, {p}))"
        f")) WHERE {condition}"
    )


_SPANS = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"

op6_secret_ledger = (
    "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), "
    f"found AS ({' UNION ALL '.join(_matches(i, k) for i, k in enumerate(_SECRETS))}), "
    "per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, "
    f"count(*) FILTER (kind = 'hex') AS n_hex, {_SPANS} FILTER (rank < 3) AS base, {_SPANS} AS spans FROM found GROUP BY rid) "
    "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
    "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (rid)"
)

# Measurements of op7: words of five at a time are compared as lists, and their places counted once.
_MEASURED = (
    "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, "
    r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, "
    r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents), "
    "windows AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p:p + 4]) AS n FROM ("
    "SELECT rid, words, unnest(range(1, len(words) - 3)) AS p FROM docs WHERE len(words) > 5)), "
    "covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM windows, range(0, 5) r(k) WHERE windows.n > 1 GROUP BY rid), "
    "measured AS (SELECT doc_id, len(words) AS n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS bigint) AS word_chars, "
    "length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, "
    "len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines "
    "FROM docs LEFT JOIN covered USING (rid)), "
)


def _bits(rules) -> str:
    return " + ".join(f"(CASE WHEN {cond} THEN {1 << bit} ELSE 0 END)" for bit, cond in (quality_rules.RULES[r] for r in rules))


_JUDGED = f"judged AS (SELECT *, cast({_bits(quality_rules.RULES)} AS bigint) AS failed FROM measured) "

op7_quality_rule_ledger = (
    _MEASURED + _JUDGED + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, "
    f"({_bits(quality_rules.POLICIES['v1'])}) > 0 AS base_failed, ({_bits(quality_rules.POLICIES['v2'])}) = 0 AS kept, failed FROM judged"
)


def _ablation(policy: str, rule: str) -> str:
    others = [r for r in quality_rules.POLICIES[policy] if r != rule]
    fails, clean = f"({_bits([rule])}) > 0", f"({_bits(others)}) = 0"
    return (
        f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) AS n_rows, count(*) FILTER ({fails}) AS n_failed, "
        f"count(*) FILTER ({fails} AND {clean}) AS n_failed_alone FROM judged HAVING count(*) > 0"
    )


quality_rule_ablations = _MEASURED + _JUDGED + " UNION ALL ".join(
    _ablation(policy, rule) for policy, rules in quality_rules.POLICIES.items() for rule in rules
)

op9_warc_round_trip = (
    "WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), "
    "f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p) "
    "SELECT page_id, payload_bytes, payload_digest, "
    "CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, "
    "CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"
)

ORACLE: dict[str, str] = {
    "op6_secret_ledger": op6_secret_ledger,
    "op7_quality_rule_ledger": op7_quality_rule_ledger,
    "op9_warc_round_trip": op9_warc_round_trip,
    "quality_rule_ablations": quality_rule_ablations,
}
