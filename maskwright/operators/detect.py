"""Detection: nine rules over a text, merged into disjoint spans, and the redacted copy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.functions.regex import BOUNDARY, DIGIT, WORD, to_java

# First characters a match can begin with. Testing them before looking behind keeps the
# regex engine off its slow path at most positions. They never reject a match.
_FIRST = {
    "secret": "[sgaxbtpSGAXBTP\u017f]",
    "account": f"[A-Z{DIGIT}][A-Z{DIGIT} -]{{8}}",
    "phone": rf"[+({DIGIT}]",
    "date": f"[JFMASOND{DIGIT}]",
    "address": DIGIT,
    "person_hint": "[MDPIRSBCTF]",
    "person_loose": "[A-Z]",
}


def _java(name: str, pattern: str) -> str:
    java = to_java(pattern)
    if name == "person_hint":  # split at the group so that the greeting is group 1
        greeting, person = java[: java.index("([A-Z]")], java[java.index("([A-Z]") :]
        java = f"({greeting}){person}"
    if name in _FIRST:
        # all of these but "+" and "(" are word characters, where a boundary only looks behind
        if name != "phone":
            java = java.replace(BOUNDARY, f"(?<![{WORD}])", 1)
        java = f"(?={_FIRST[name]}){java}"
    return java


JAVA_RULES = {name: (label, _java(name, pattern)) for name, label, pattern in V.RULES}


# Shapes that stand in every ASCII text with a match of the rule; a scan for them stops at most places after a character.
_BLANK = r"[\s\x1C-\x1F]"
_SHAPES = {
    "account": "[A-Z0-9][A-Z0-9 -]{8}",
    "phone": r"[0-9](?:\)[\s\x1C-\x1F.-]?|[\s\x1C-\x1F.-])[0-9]{3,4}[\s\x1C-\x1F.-]?[0-9]{3}",
    "date": "[0-9][-/][0-9]",
    "address": f"[0-9]{_BLANK}+[A-Z]",
}
_MONTH = "(?=[JFMASOND])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def beyond_ascii(text: str) -> str:
    return f"octet_length({text}) > length({text})"


def _guard(name: str, text: str) -> str | None:
    """A condition that every text with a match of the rule meets. Shapes and lower case are tests for ASCII: digits,
    blanks and letters outside it (``ſ``, the Kelvin sign) match as well."""
    if name == "secret":
        low = f"lower({text})"
        keys = " OR ".join(f"contains({low}, '{k}')" for k in ("key", "token", "passw", "secret"))
        shapes = " OR ".join(f"contains({low}, '{k}')" for k in ("sk-", "ghp_", "akia", "xox", "bearer"))
        return f"({beyond_ascii(text)} OR ((contains({text}, ':') OR contains({text}, '=')) AND ({keys})) OR {shapes})"
    if name in _SHAPES:
        shapes = [f"rlike({text}, {S.regex_literal(x)})" for x in (_SHAPES[name], *([_MONTH] if name == "date" else []))]
        digits = f"rlike({text}, {S.regex_literal(DIGIT)})"
        return f"CASE WHEN {beyond_ascii(text)} THEN {digits} ELSE {' OR '.join(shapes)} END"
    return {
        "email": f"contains({text}, '@')",
        "url": f"contains({text}, '://')",
    }.get(name)


def _rule(text: str, rule: str, guards: bool) -> dict:
    return {
        "pattern": JAVA_RULES[rule][1],
        "groups": (1, 2) if rule == "person_hint" else None,
        "guard": _guard(rule, text) if guards else None,
    }


def rule_spans(text: str, rule: str, *, guards: bool = True) -> str:
    """All matches of one rule, unmerged, as a SQL expression over the SQL expression ``text``."""
    return S.find_all(text, label=JAVA_RULES[rule][0], **_rule(text, rule, guards))


def rule_pieces(text: str, rule: str) -> str:
    """The text cut around the matches of one rule, null without any. To be held as a column."""
    return S.pieces(text, **_rule(text, rule, True))


def raw_spans(text: str, *, rules: list[str] | None = None, guards: bool = True) -> str:
    """Matches of every rule, unmerged."""
    names = list(JAVA_RULES) if rules is None else rules
    return S.joined(*(rule_spans(text, name, guards=guards) for name in names))


# A model takes texts and returns, for each, a list of (label, start, end).
Model = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]

_MODELS: dict[str, Model] = {}


def register_model(name: str, model: Model) -> None:
    """Make ``model`` available as a detection engine.

    ``model`` maps an iterator of text batches to an iterator of span batches, so it can load its
    weights once per Python worker.
    """
    if name == "heuristic":
        raise ValueError("the built-in engine cannot be replaced")
    _MODELS[name] = model


def engine_spans(text: str, engine: str) -> Column:
    """Unmerged spans of the chosen engine. An engine that is not there is an error, never a
    silent change to another one."""
    if engine == "heuristic":
        return F.expr(raw_spans(text))
    if engine not in _MODELS:
        raise ValueError(f"unknown detection engine: {engine}")
    model = _MODELS[engine]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in model(batches):
            yield pd.Series(
                [
                    [{"start": int(a), "end": int(b), "label": k} for k, a, b in row]
                    for row in found
                ]
            )

    # postponed annotations are strings; the function kind is read from real types
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, S.SPANS)(F.expr(text))


def detect(
    df: DataFrame,
    text_col: str = "text",
    *,
    engine: str = "heuristic",
    raw: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Add ``engine``, ``spans``, ``span_count``, ``by_label`` and ``redacted_text`` to ``df``.

    ``raw`` names a span column to use in place of the engine's own findings. With ``strict`` an
    impossible span stops the job; otherwise the row is marked ``invalid`` and keeps null results,
    so bad rows can be set aside without losing them.
    """
    if raw is None and engine == "heuristic":
        found = S.hold(df, {"_raw": raw_spans(text_col)})
        held = S.hold(found, {"spans": S.merge("_raw"), "invalid": "false"}).drop("_raw")
    else:
        staged = df.withColumn("_raw", F.expr(raw) if raw else engine_spans(text_col, engine))
        known = ", ".join(repr(k) for k in [*V.LABELS, V.MANUAL_LABEL])
        fine = f"({S.is_valid('_raw', text_col)} AND forall(_raw, v -> v.label IN ({known})))"
        broken = "raise_error('detector returned an invalid span')" if strict else "null"
        spans = f"CASE WHEN {fine} THEN {S.merge('_raw')} ELSE {broken} END"
        held = S.hold(staged, {"spans": spans, "invalid": f"NOT {fine}"}).drop("_raw")
    redacted = S.redact(text_col, "spans", lambda s: S.placeholder(f"{s}.label"))
    return held.withColumns(
        {
            "engine": F.lit(engine),
            "span_count": F.expr("cast(size(spans) AS bigint)"),
            "by_label": F.expr(S.count_by_label("spans")),
            "redacted_text": F.expr(f"CASE WHEN spans IS NOT NULL THEN {redacted} END"),
        }
    )


def explode_spans(df: DataFrame, ids: list[str], text_col: str | None = "text") -> DataFrame:
    """One row per span. Without ``text_col`` the result holds no source characters."""
    kept = [*ids, *([text_col] if text_col else [])]
    match = [F.expr(S.cut(text_col, "s.start", "s.end")).alias("match_text")] if text_col else []
    return df.select(*kept, F.explode("spans").alias("s")).select(
        *ids,
        F.col("s.label").alias("label"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        *match,
        F.expr(S.placeholder("s.label")).alias("placeholder"),
    )


def result(
    df: DataFrame, ids: list[str], text_col: str = "text", *, include_source: bool = False
) -> DataFrame:
    """The scan result. Source text and matched text are left out unless asked for."""
    match = f"'text', {S.cut(text_col, 's.start', 's.end')}, " if include_source else ""
    shown = (
        f"transform(spans, s -> named_struct('label', s.label, 'start', s.start, 'end', s.end, "
        f"{match}'placeholder', {S.placeholder('s.label')}))"
    )
    return df.select(
        *ids,
        F.lit(V.SCHEMA_VERSION).alias("schema_version"),
        F.lit(V.OFFSET_UNIT).alias("offset_unit"),
        "engine",
        "span_count",
        "by_label",
        *([F.col(text_col).alias("text")] if include_source else []),
        F.expr(shown).alias("detected_spans"),
        "redacted_text",
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores; leave a large one as its splits are.

    Matching costs far more than moving the text, and a file with a single row group is a single
    task. An input that fills one split per core or more is never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(2 * cores) if size < cores * split else df
