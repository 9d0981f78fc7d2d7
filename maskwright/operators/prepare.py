"""Prepare texts for sharing: one policy over one or several fields of a request.

A request is one row: ``request_id``, ``use_case``, ``fields`` (map of field to text) and
``manual_masks`` (array of field, start, end). Everything about a request is decided inside its row,
without a shuffle, whatever its length: texts are scanned and kept whole. Only requests that make no
sense (unknown use case, wrong fields, no text, masks out of range, unusable routing) are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.functions import spans as S
from maskwright.functions.regex import SPACE
from maskwright.operators.credentials import PATTERNS
from maskwright.operators.credentials import rule_pieces as credential_pieces
from maskwright.operators.detect import JAVA_RULES, engine_spans, rule_pieces
from maskwright.operators.routing import routing, with_domains

MASKS = "array<struct<field:string,start:int,end:int>>"


def _fields_of(use_case: str) -> str:
    cases = " ".join(
        f"WHEN '{name}' THEN array({', '.join(repr(f) for f in fields)})"
        for name, fields in V.USE_CASE_FIELDS.items()
    )
    return f"CASE {use_case} {cases} END"


def matching_masks(text: str, needle: str) -> str:
    """Every place, overlapping ones included, where ``needle`` stands in ``text``.

    Each step takes at least one code point and stops before the next place, so the lengths of the steps
    give the offsets; the first place needs no step. Steps are bound to the end of the one before, so a
    text is read once, and no content needs another way.
    """
    kind = "array<struct<start:int,end:int>>"
    quoted = f"concat(r'(?s)\\G.+?(?=\\Q', replace({needle}, r'\\E', r'\\E\\\\E\\Q'), r'\\E)')"

    def place(at: str) -> str:
        return f"array(named_struct('start', {at}, 'end', {at} + length({needle})))"

    later = S.fold(
        f"regexp_extract_all({text}, {quoted}, 0)",
        "0",
        kind,
        lambda s, x: f"{s} + length({x})",
        lambda s, x: place(f"{s} + length({x})"),
    )
    none = f"cast(array() AS {kind})"
    first = f"CASE WHEN startswith({text}, {needle}) THEN {place('0')} ELSE {none} END"
    return f"CASE WHEN length({needle}) = 0 OR NOT contains({text}, {needle}) THEN {none} ELSE concat({first}, {later}) END"


def add_masks(present: str, added: str) -> str:
    """Masks with ``added`` appended, without repeats."""
    return f"array_union({present}, {added})"


def request_error(fields: str = "fields", masks: str = "manual_masks", use_case: str = "use_case") -> str:
    """Why a request is refused before it is looked at, or null."""
    expected = _fields_of(use_case)

    def every(test: Callable[[str], str], joined: str) -> str:
        cases = " ".join(
            f"WHEN '{name}' THEN {joined.join(test(f'{fields}[{f!r}]') for f in names)}" for name, names in V.USE_CASE_FIELDS.items()
        )
        return f"CASE {use_case} {cases} END"

    blank = every(lambda v: f"NOT rlike({v}, r'[^{SPACE}]')", " AND ")
    bad_mask = (
        f"size({masks}) > 0 AND exists({masks}, m -> NOT coalesce(m.start >= 0 AND m.start < m.end "
        f"AND m.end <= length({fields}[m.field]), false))"
    )
    missing = every(lambda v: f"{v} IS NULL", " OR ")
    return (
        f"CASE WHEN {expected} IS NULL THEN 'unknown_use_case' "
        f"WHEN sort_array(map_keys({fields})) <> sort_array({expected}) "
        f"OR ({fields} IS NOT NULL AND {missing}) THEN 'wrong_fields' "
        f"WHEN {blank} THEN 'input_empty' "
        f"WHEN {bad_mask} THEN 'invalid_mask' END"
    )


def ascii_json_length(text: str) -> str:
    """Length of ``text`` inside an ASCII-escaped JSON string."""

    def count(pattern: str) -> str:
        return f"regexp_count({text}, {S.regex_literal(pattern)})"

    short, astral = r'["\\\n\r\t\x08\x0C]', r"[\x{10000}-\x{10FFFF}]"
    other = r"[^ -~\n\r\t\x08\x0C\x{10000}-\x{10FFFF}]"
    return f"(length({text}) + {count(short)} + 5 * {count(other)} + 11 * {count(astral)})"


def _envelope(use_case: str, engine: str) -> int:
    """Size of an export body around empty field values, without its routing summary."""
    candidate = {
        "use_case": use_case,
        "policy_version": V.POLICY_VERSION,
        "engine": engine,
        "fields": dict.fromkeys(V.USE_CASE_FIELDS[use_case], ""),
        "routing": None if use_case != "email" else {},
    }
    return len(json.dumps({"receipt": "x" * V.RECEIPT_CHARS, "candidate": candidate, "confirmed": True}))


_ROUTING_KEYS = ["recipient_count", "crosses_example_boundary", "all_recipients_internal"]


def limit_flags(limits: dict[str, int], engine: str) -> str:
    """Sorted names of the ``limits`` (some of ``V.REQUEST_LIMITS``) that a prepared request exceeds."""
    sizes = {
        "text_chars": "aggregate(map_values(fields), 0L, (n, v) -> n + length(v))",
        "manual_masks": "size(manual_masks)",
        "findings_per_field": "array_max(transform(map_keys(fields), k -> size(filter(findings, f -> f.field = k))))",
        "recipients": "coalesce(routing.recipient_count, 0)",
        "body_bytes": candidate_bytes(engine),
    }
    tests = ", ".join(f"CASE WHEN {sizes[name]} > {limits[name]} THEN '{name}' END" for name in sorted(limits))
    return f"array_compact(array({tests}))"


def candidate_bytes(engine: str) -> str:
    """Size of the body that would carry the candidate back for export."""
    cases = " ".join(
        f"WHEN '{name}' THEN {_envelope(name, engine)}" for name in V.USE_CASE_FIELDS
    )
    texts = f"aggregate(map_values(candidate_fields), 0L, (n, v) -> n + {ascii_json_length('v')})"
    keys = len(json.dumps(dict.fromkeys(_ROUTING_KEYS, 0))) - len("{}") - len(_ROUTING_KEYS)
    values = " + ".join(
        f"length(cast(routing.{f} AS string))"
        for f in ("recipient_count", "crosses_boundary", "all_recipients_internal")
    )
    return (
        f"(CASE use_case {cases} END + {texts} + "
        f"CASE WHEN use_case = 'email' THEN {keys} + {values} ELSE 0 END)"
    )


_PLACES = "array<struct<first:int,i:int>>"
_FOUND = "array<struct<field:string,label:string,start:int,end:int,match:string,sources:array<string>>>"
_KNOWN = "array<struct<label:string,match:string>>"
_NAMED = "array<struct<field:string,label:string,start:int,end:int,placeholder:string,sources:array<string>>>"
_OWNED = "size(filter(_owners, o -> o.label = l AND o.first = o.i))"
_ORIGINS = {"cred": (1, "credential_rule"), "auto": (2, "detector"), "hand": (4, "manual")}


def _origin_bits(part: str) -> str:
    """For each merged span the origins that overlap it, as bits; the array is one longer, its first is no span.

    One sweep over the starts of spans and origins in order: an origin lies in the span that began last, as a
    merged span is the union of the origins that overlap.
    """
    starts = ", ".join(f"transform(_{kind}_{part}, o -> struct(o.start AS at, {bit} AS bit))" for kind, (bit, _) in _ORIGINS.items())
    return S.fold(
        f"sort_array(concat(transform(_spans_{part}, o -> struct(o.start AS at, 0 AS bit)), {starts}))",
        "0",
        "array<int>",
        lambda s, x: f"CASE WHEN {x}.bit = 0 THEN 0 ELSE {s} | {x}.bit END",
        lambda s, x: f"CASE WHEN {x}.bit = 0 THEN array({s}) ELSE cast(array() AS array<int>) END",
        "concat(acc.out, array(acc.state))",
    )


def _few_sources(s: str, part: str) -> str:
    """Sorted origins that overlap the merged span ``s``, looked up one by one."""
    hits = ", ".join(
        f"CASE WHEN exists(_{kind}_{part}, o -> o.start < {s}.end AND o.end > {s}.start) THEN '{origin}' END"
        for kind, (_, origin) in _ORIGINS.items()
    )
    return f"array_compact(array({hits}))"


def _sources(bits: str) -> str:
    """Sorted names of origins."""
    hits = ", ".join(f"CASE WHEN {bits} & {bit} <> 0 THEN '{origin}' END" for bit, origin in _ORIGINS.values())
    return f"array_compact(array({hits}))"


def _overlapping(s: str, part: str) -> str:
    """Sorted origins that overlap the span ``s``, where each kind has few, without a lambda."""
    names = [f"cast(array({', '.join(repr(name) for bit, name in _ORIGINS.values() if bits & bit)}) AS array<string>)" for bits in range(8)]
    bits = " + ".join(
        f"CASE WHEN {' OR '.join(f'(get(_{kind}_{part}, {k}).start < {s}.end AND get(_{kind}_{part}, {k}).end > {s}.start)' for k in range(S.SPELLED))} "
        f"THEN {bit} ELSE 0 END"
        for kind, (bit, _) in _ORIGINS.items()
    )
    return f"element_at(array({', '.join(names)}), {bits} + 1)"


def _few_placeholders() -> str:
    """Placeholders of the few known identities in their order, where no placeholder stands in the input."""

    def name(k: int) -> str:
        label = f"get(_known, {k}).label"
        earlier = "".join(f" + CASE WHEN get(_known, {j}).label = {label} THEN 1 ELSE 0 END" for j in range(k))
        return f"concat('[', upper({label}), '_', cast(1{earlier} AS string), ']')"

    return f"slice(array({', '.join(map(name, range(2 * S.SPELLED)))}), 1, size(_known))"


def _first_places() -> str:
    """Of each finding (``i``, its place among all) the place of the first with the same label and text, by sorting."""
    keyed = "sort_array(transform(_found, (f, i) -> struct(concat(f.label, chr(0), f.match) AS k, i AS i)))"
    return S.fold(
        keyed,
        "named_struct('k', cast(null AS string), 'i', 0)",
        _PLACES,
        lambda s, x: f"CASE WHEN {s}.k <=> {x}.k THEN {s} ELSE named_struct('k', {x}.k, 'i', {x}.i) END",
        lambda s, x: f"array(named_struct('first', CASE WHEN {s}.k <=> {x}.k THEN {s}.i ELSE {x}.i END, 'i', {x}.i))",
    )


def _numbers() -> str:
    """The number of each finding within its label, in the order of findings: identities count in order of first
    appearance."""

    def number(s: str, x: str) -> str:
        return f"CASE WHEN NOT {s}.label <=> {x}.label THEN 1 WHEN {s}.first = {x}.first THEN {s}.n ELSE {s}.n + 1 END"

    numbered = S.fold(
        "_owners",
        "named_struct('label', cast(null AS string), 'first', -1, 'n', 0)",
        "array<struct<i:int,n:int>>",
        lambda s, x: f"named_struct('label', {x}.label, 'first', {x}.first, 'n', {number(s, x)})",
        lambda s, x: f"array(named_struct('i', {x}.i, 'n', {number(s, x)}))",
    )
    return f"transform(sort_array({numbered}), o -> o.n)"


def _free_names(label: str, count: str) -> str:
    """As many placeholders of one label, by number, skipping any that already stands in the input."""
    stem = f"concat('[', upper({label}), '_')"
    names = f"transform(sequence(1, n + size(_taken)), k -> concat({stem}, k, ']'))"
    free = f"slice(array_except({names}, _taken), 1, n)"
    return S.bind("n", count, free)


def prepare(
    requests: DataFrame,
    *,
    engine: str = "heuristic",
    internal_domains: list[str] | None = None,
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """Apply the sharing policy. One row out per request.

    With ``limits`` (for example ``fixed_values.REQUEST_LIMITS``) a column ``limit_flags`` names those
    that an accepted request exceeds; nothing else changes.

    ``candidate_fields`` holds the text to be shared, ``findings`` where and why it was masked
    (no matched text), ``routing`` the recipient summary of an email. When ``reject_reason`` is
    set, all of them are null.
    """
    df = requests.withColumn(
        "manual_masks", F.expr(f"coalesce(manual_masks, cast(array() AS {MASKS}))")
    )
    df = df.withColumn("_error", F.expr(request_error()))
    is_email = "(_error IS NULL AND use_case = 'email')"
    for header in V.ROUTING_FIELDS:
        df = with_domains(df, F.expr(f"CASE WHEN {is_email} THEN fields['{header}'] END"), f"_{header}")
    df = S.hold(df, {"routing": routing("_sender", "_recipients", internal_domains or []), "_error": "_error"})
    unroutable = f"{is_email} AND routing IS NULL"
    df = S.hold(
        df.drop("_sender", "_recipients"),
        {"_error": f"CASE WHEN {unroutable} THEN 'invalid_email_routing' ELSE _error END"},
    )

    # A request has one long text (text or body) and, for an email, a subject.
    df = df.withColumns(
        {
            "_main_name": F.expr("CASE WHEN use_case = 'email' THEN 'body' ELSE 'text' END"),
            "_main": F.expr(
                "CASE WHEN _error IS NOT NULL THEN '' "
                "WHEN use_case = 'email' THEN fields['body'] ELSE fields['text'] END"
            ),
            "_subject": F.expr(
                "CASE WHEN _error IS NULL AND use_case = 'email' THEN fields['subject'] ELSE '' END"
            ),
        }
    )
    parts = {"subject": "'subject'", "main": "_main_name"}
    if engine != "heuristic":
        df = df.withColumns({f"_found_{p}": engine_spans(f"_{p}", engine) for p in parts})
    # the detector and the credential policy share the matches of the secret rule; matches are held before they are
    # merged, as what stands inside a bound expression is interpreted
    rules = list(JAVA_RULES) if engine == "heuristic" else ["secret"]
    cuts = {f"_cut_{rule}_{p}": rule_pieces(f"_{p}", rule) for p in parts for rule in rules}
    cuts |= {f"_cut_{rule}_{p}": credential_pieces(f"_{p}", rule) for p in parts for rule in PATTERNS}
    df = S.hold(df, cuts)
    raws = {f"_shaped_{p}": [S.placed(f"_cut_{rule}_{p}", "secret") for rule in ("secret", *PATTERNS)] for p in parts}
    if engine == "heuristic":
        raws |= {f"_raw_{p}": [S.placed(f"_cut_{rule}_{p}", JAVA_RULES[rule][0]) for rule in rules] for p in parts}
    df = S.hold(df, {name: f"sort_array({S.joined(*found)})" for name, found in raws.items()}).drop(*cuts)
    held = {}
    for part, name in parts.items():
        found = f"_found_{part}"
        if engine == "heuristic":
            held[f"_auto_{part}"] = S.merge_sorted(f"_raw_{part}")
        else:
            known = ", ".join(repr(k) for k in V.LABELS)
            held[f"_auto_{part}"] = (
                f"CASE WHEN {S.is_valid(found, f'_{part}')} AND forall({found}, v -> v.label IN ({known})) "
                f"THEN {S.merge(found)} ELSE raise_error('detector returned an invalid span') END"
            )
        held[f"_cred_{part}"] = S.merge_sorted(f"_shaped_{part}")
        own = f"filter(manual_masks, m -> m.field = {name})"
        masks = f"transform({own}, m -> {S.span('m.start', 'm.end', repr(V.MANUAL_LABEL))})"
        held[f"_hand_{part}"] = f"CASE WHEN _error IS NULL AND size(manual_masks) > 0 THEN {masks} ELSE {S.NO_SPANS} END"
    df = S.hold(df, held).drop(*raws, *[f"_found_{p}" for p in parts])

    def union(part: str) -> str:
        every = S.joined(f"_auto_{part}", f"_cred_{part}", f"_hand_{part}")
        return f"CASE WHEN _error IS NULL THEN sort_array({every}) ELSE {S.NO_SPANS} END"

    def listed(part: str, name: str) -> str:
        def row(s: str, match: str, sources: str) -> str:
            return (
                f"named_struct('field', {name}, 'label', {s}.label, "
                f"'start', {s}.start, 'end', {s}.end, 'match', {match}, 'sources', {sources})"
            )

        def rows(match: str, sources: str) -> str:
            return f"transform(_spans_{part}, (s, i) -> {row('s', match, sources)})"

        places = [f"get(_spans_{part}, {k})" for k in range(S.SPELLED)]
        spelled = ", ".join(row(s, S.cut(f"_{part}", f"{s}.start", f"{s}.end"), _overlapping(s, part)) for s in places)
        short = " AND ".join(f"size(_{kind}_{part}) <= {S.SPELLED}" for kind in ("spans", *_ORIGINS))
        few = rows(S.cut(f"_{part}", "s.start", "s.end"), _few_sources("s", part))
        many = rows(S.cut_chunks("parts", "s.start", "s.end"), _sources("bits[i + 1]"))
        many = S.bind("parts", S.chunks(f"_{part}"), S.bind("bits", _origin_bits(part), many))
        return (
            f"CASE WHEN size(_spans_{part}) = 0 THEN cast(array() AS {_FOUND}) "
            f"WHEN {short} THEN slice(array({spelled}), 1, size(_spans_{part})) "
            f"WHEN size(_spans_{part}) <= {S.RUN} THEN {few} ELSE {many} END"
        )

    tokens = r"\[[A-Z_]+_[1-9][0-9]*\]"
    df = S.hold(df, {"_error": "_error", **{f"_every_{p}": union(p) for p in parts}})
    df = S.hold(df, {f"_spans_{p}": S.merge_sorted(f"_every_{p}") for p in parts}).drop(*[f"_every_{p}" for p in parts])
    df = S.hold(df, {"_found": S.joined(*(listed(p, n) for p, n in parts.items())), "_first_main": "size(_spans_subject)"})
    values = "concat_ws('\\n', map_values(fields))"
    df = S.hold(
        df.drop(*[f"_{kind}_{p}" for kind in ("spans", "auto", "cred", "hand") for p in parts]),
        {
            # few findings are compared with each other, many are sorted
            "_known": f"CASE WHEN size(_found) BETWEEN 1 AND {S.RUN} THEN array_distinct(cast(arrays_zip(_found.label, _found.match) AS {_KNOWN})) "
            f"ELSE cast(array() AS {_KNOWN}) END",
            "_firsts": f"CASE WHEN size(_found) > {S.RUN} THEN {_first_places()} ELSE cast(array() AS {_PLACES}) END",
            "_taken": f"CASE WHEN size(_found) > 0 AND contains({values}, '[') THEN array_distinct(regexp_extract_all({values}, r'{tokens}', 0)) "
            "ELSE cast(array() AS array<string>) END",
        },
    )
    owners = "CASE WHEN size(_firsts) = 0 THEN cast(array() AS array<struct<label:string,first:int,i:int>>) ELSE sort_array(transform(_firsts, o -> struct(_found[o.first].label AS label, o.first AS first, o.i AS i))) END"
    df = S.hold(df, {"_owners": owners})
    labels = "array_distinct(_owners.label)"
    short = f"size(_found) <= {2 * S.SPELLED} AND size(_taken) = 0"
    names = S.bind("labels", labels, f"map_from_arrays(labels, transform(labels, l -> {_free_names('l', _OWNED)}))")
    few_names = S.bind(
        "labels",
        "array_distinct(_known.label)",
        "map_from_arrays(flatten(transform(labels, l -> filter(_known, w -> w.label = l))), "
        f"flatten(transform(labels, l -> {_free_names('l', 'size(filter(_known, w -> w.label = l))')})))",
    )
    df = S.hold(
        df.drop("_firsts"),
        {
            "_names": f"CASE WHEN size(_owners) > 0 THEN {names} ELSE cast(map() AS map<string,array<string>>) END",
            "_numbers": f"CASE WHEN size(_owners) > 0 THEN {_numbers()} ELSE cast(array() AS array<int>) END",
            "_few_names": f"CASE WHEN size(_known) = 0 OR ({short}) THEN cast(map() AS map<struct<label:string,match:string>,string>) ELSE {few_names} END",
            "_placeholders": f"CASE WHEN size(_known) > 0 AND {short} THEN {_few_placeholders()} ELSE cast(array() AS array<string>) END",
        },
    )
    headers = ", ".join(
        f"named_struct('field', '{h}', 'label', 'private_email', 'start', 0, "
        f"'end', length(fields['{h}']), 'placeholder', '[{h.upper()}_REMOVED]', "
        "'sources', array('routing_policy'))"
        for h in V.ROUTING_FIELDS
    )

    def named(f: str, placeholder: str) -> str:
        return (
            f"named_struct('field', {f}.field, 'label', {f}.label, 'start', {f}.start, "
            f"'end', {f}.end, 'placeholder', {placeholder}, 'sources', {f}.sources)"
        )

    identity = "named_struct('label', {f}.label, 'match', {f}.match)"
    looked_up = (
        f"CASE WHEN size(_numbers) > 0 THEN _names[f.label][_numbers[i] - 1] ELSE _few_names[{identity.format(f='f')}] END"
    )
    spelled = ", ".join(
        named(f, f"get(_placeholders, cast(array_position(_known, {identity.format(f=f)}) AS int) - 1)")
        for f in (f"get(_found, {k})" for k in range(2 * S.SPELLED))
    )
    scanned = (
        f"CASE WHEN size(_found) = 0 THEN cast(array() AS {_NAMED}) WHEN size(_placeholders) > 0 THEN slice(array({spelled}), 1, size(_found)) "
        f"ELSE transform(_found, (f, i) -> {named('f', looked_up)}) END"
    )
    df = S.hold(df, {"_scanned": scanned}).drop(
        "_owners", "_taken", "_known", "_names", "_few_names", "_numbers", "_placeholders", "_found"
    )

    def masked(part: str) -> str:
        """The findings of a part stand together, those of the subject first."""
        text, first, n = f"_{part}", "_first_main" if part == "main" else "0", "_first_main"
        if part == "main":
            n = f"(size(_scanned) - {n})"
        cases = " ".join(
            f"WHEN {k} THEN {S.redact_few(text, '_scanned', first, k, lambda s: f'{s}.placeholder')}" for k in range(1, S.SPELLED + 1)
        )
        more = S.bind("own", f"slice(_scanned, {first} + 1, {n})", S.redact(text, "own", lambda s: f"{s}.placeholder"))
        return f"CASE {n} WHEN 0 THEN {text} {cases} ELSE {more} END"

    email_fields = (
        "map('sender', '[SENDER_REMOVED]', 'recipients', '[RECIPIENTS_REMOVED]', "
        f"'subject', {masked('subject')}, 'body', {masked('main')})"
    )
    df = S.hold(
        df,
        {
            "findings": f"CASE WHEN use_case = 'email' THEN {S.joined(f'array({headers})', '_scanned')} ELSE _scanned END",
            "candidate_fields": f"CASE WHEN use_case = 'email' THEN {email_fields} "
            f"ELSE map('text', {masked('main')}) END"
        },
    )
    df = df.withColumnRenamed("_error", "reject_reason")
    flags = [F.when(F.col("reject_reason").isNull(), F.expr(limit_flags(limits, engine))).alias("limit_flags")] if limits else []
    fine = F.col("reject_reason").isNull()
    kept = [c for c in requests.columns if c not in ("fields", "manual_masks")]
    return df.select(
        *kept,
        F.lit(V.POLICY_VERSION).alias("policy_version"),
        F.lit(engine).alias("engine"),
        F.when(fine, F.col("candidate_fields")).alias("candidate_fields"),
        F.when(fine, F.col("routing")).alias("routing"),
        F.when(fine, F.col("findings")).alias("findings"),
        F.when(fine, F.expr("cast(size(findings) AS bigint)")).alias("span_count"),
        F.when(fine, F.expr(S.count_by_label("findings"))).alias("by_label"),
        F.when(fine, F.expr("cast(size(manual_masks) AS bigint)")).alias("manual_mask_count"),
        "reject_reason",
        *flags,
    )


def accepted(prepared: DataFrame) -> DataFrame:
    return prepared.where("reject_reason IS NULL")


def rejected(prepared: DataFrame) -> DataFrame:
    """Quarantine: why a request was refused, without its text."""
    return prepared.where("reject_reason IS NOT NULL").select("request_id", "use_case", "reject_reason")


def findings(prepared: DataFrame) -> DataFrame:
    """One row per finding; offsets and reasons only."""
    return accepted(prepared).select("request_id", "use_case", F.inline("findings"))


def uncovered_expected(expected: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Expected ranges that are not wholly inside the covered ranges of their text.

    Both sides hold ``keys``, ``start`` and ``end``; covered ranges of a text must be disjoint and
    are counted by their overlap, so no row is made per character.
    """
    have = covered.select(*keys, F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    # least and greatest skip nulls, so a range without any partner is told apart first
    overlap = F.when(
        F.col("c_start").isNotNull(), F.least("end", "c_end") - F.greatest("start", "c_start")
    )
    meets = [F.col(f"e.{k}") == F.col(f"c.{k}") for k in keys]
    meets += [F.col("c_start") < F.col("end"), F.col("c_end") > F.col("start")]
    return (
        expected.alias("e")
        .join(have.alias("c"), meets, "left")
        .groupBy(*[F.col(f"e.{k}") for k in keys], "start", "end")
        .agg(F.coalesce(F.sum(overlap), F.lit(0)).alias("covered"))
        .where("covered < end - start")
        .select(*keys, "start", "end", F.expr("end - start - covered").alias("missing"))
    )


def reviewed_text(fields: str = "candidate_fields", use_case: str = "use_case") -> str:
    """The reviewed text as one plain string."""
    lines = ", ".join(
        f"concat('{f.capitalize()}: ', {fields}['{f}'])" for f in V.USE_CASE_FIELDS["email"]
    )
    return (
        f"CASE WHEN {use_case} = 'email' THEN concat_ws('\\n\\n', {lines}) ELSE {fields}['text'] END"
    )
