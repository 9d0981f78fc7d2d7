"""Secret scans over content-addressed blobs.

A blob is a text under its SHA-256. The ledger keeps, per blob, which rule versions have scanned it
and what they found, so every historical version is scanned once by each version of each rule, no
matter how many paths or commits hold it. Findings are joined back to all paths. All of it is
DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.spans import bind, cut, find_all, hold, regex_literal

LEDGER = "blob string, rules array<string>, findings array<struct<start:int,end:int,label:string>>"

# Rules in the order in which kinds are listed: version, pattern, and the condition on a match `m`.
# The patterns and least lengths decide the results.
RULES: dict[str, tuple[int, str, str]] = {
    "assign": (
        1,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        "length(regexp_extract(m, {key}, 1)) >= 12",
    ),
    "access": (1, r"AKIA[A-Z0-9]{14,}", "true"),
    "hex": (1, r"[0-9a-f]{16,}", "true"),
    "private_key": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "true"),
}
_ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# Cheap conditions that every text with a finding of the kind meets.
_GUARDS = {
    "assign": r"rlike({t}, r'[:=]')",
    "access": "contains({t}, 'AKIA')",
    "hex": r"rlike({t}, r'[0-9a-f]{{16}}')",
    "private_key": "contains({t}, 'PRIVATE KEY')",
}
BASE = ("assign", "access", "hex")


def versions() -> dict[str, str]:
    """Kind to rule version, as the ledger names it."""
    return {kind: f"{kind}@{version}" for kind, (version, _, _) in RULES.items()}


def findings(kind: str, text: str) -> str:
    """SQL: the spans of one kind in a text, in code points; leftmost, not overlapping, then filtered.

    For ``access`` and ``hex`` the least length stands in the pattern: their matches are whole runs, so
    a run that is too short is passed over either way. A failing ``assign`` match still uses up its text.
    """
    _, pattern, condition = RULES[kind]
    found = find_all(text, pattern, kind, guard=_GUARDS[kind].format(t=text))
    test = condition.format(key=regex_literal(_ASSIGN_VALUE))
    if test == "true":
        return found
    return f"filter({found}, s -> {bind('m', cut(text, 's.start', 's.end'), test)})"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blobs(rows: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(blob, text): each distinct content once. Copies are dropped before the shuffle as well as after."""
    text = rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))


def scan(rows: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text") -> DataFrame:
    """New ledger rows: for each blob of ``rows`` the rule versions that had not scanned it, and what they find.

    With a ledger of all rules for all blobs there is nothing to scan and no row. The result is
    meant to be appended to the ledger. Null texts are the empty blob.
    """
    todo = blobs(rows, text_col=text_col)
    wanted = ", ".join(f"'{v}'" for v in versions().values())
    if ledger is None:
        todo = todo.select("blob", "text", F.expr(f"array({wanted}) AS rules"))
    else:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = todo.join(done, "blob", "left").select(
            "blob", "text", F.expr(f"array_except(array({wanted}), coalesce(done, array())) AS rules")
        ).where("size(rules) > 0")
    none = "cast(array() AS array<struct<start:int,end:int,label:string>>)"
    parts = [
        f"CASE WHEN array_contains(rules, '{v}') THEN {findings(kind, 'text')} ELSE {none} END" for kind, v in versions().items()
    ]
    return hold(todo, {"findings": f"concat({', '.join(parts)})"}).select("blob", "rules", "findings")


def findings_by_path(rows: DataFrame, ledger: DataFrame, *, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``rows``: the path, blob, and ``findings`` of the current rule versions, in order
    of start, then of kind as listed.

    A path may repeat (a version each) or be null. A text whose blob the ledger lacks has null
    findings. A blob under very many paths is one skewed join key, which Spark splits.
    """
    names = versions()
    rank = ", ".join(f"'{k}'" for k in names)
    version = "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in names.items()) + "), f.label)"
    fresh = ledger.select("blob", F.expr(f"filter(findings, f -> array_contains(rules, {version})) AS findings"))
    whole = fresh.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("_found"))
    order = f"array_sort(_found, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE cast(array_position(array({rank}), a.label) - array_position(array({rank}), b.label) AS int) END)"
    paths = rows.select(F.col(path_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))
    return paths.join(whole, "blob", "left").select(path_col, "blob", F.expr(f"{order} AS findings"))
