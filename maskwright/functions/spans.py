"""SQL expressions over spans: find, check, merge, cut and redact.

A span column is ``array<struct<start:int,end:int,label:string>>`` with zero-based, half-open
offsets counted in Unicode code points. Each function takes SQL expressions and returns one, to be
used through ``F.expr`` or inside a query text. A whole scan is therefore one narrow projection: it
needs no shuffle, no Python worker and no state outside its own row.

``fn`` arguments are Python functions from the text of a lambda variable to the text of its body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string>"
SPANS = f"array<{SPAN}>"
NO_SPANS = f"cast(array() AS {SPANS})"

# A code point Unicode reserves as "not a character"; it separates matches from gaps.
MARK = "﷐"

# Folds gather their output in runs of this length, so long arrays are not copied per element.
RUN = 128

# Up to so many matches or spans are looked up by their places instead of folded: a step of a fold copies what it
# has gathered, which costs far more than a few look-ups.
FEW = 16

# Up to so many matches of a rule, or spans of a text, are handled by expressions without a lambda, which Spark compiles.
SPELLED = 4

# Code points of a piece of a text that is cut very often, and the larger pieces on the way there.
CHUNK = 1 << 8
_SIZES = (1 << 22, 1 << 15, CHUNK)


def regex_literal(pattern: str) -> str:
    """A raw SQL string literal; a quote inside a pattern is written as its code."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hold(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection may be folded into every later use: a filter on a scan result, or on
    something derived from it, would be pushed below the projection with a copy of the whole scan
    inside. The output of a one-row generator cannot be pushed down or copied. Spark interprets a
    generator, so the columns are made by a projection below it, which is compiled.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[F.expr(expr).alias(f"_held_{name}") for name, expr in columns.items()])
    fields = ", ".join(f"_held_{name} AS {name}" for name in columns)
    return made.select(*kept, F.expr(f"inline(array(struct({fields})))"))


def span(start: str, end: str, label: str) -> str:
    return f"named_struct('start', {start}, 'end', {end}, 'label', {label})"


def joined(*arrays: str) -> str:
    """The elements of several arrays, none of them null, in turn."""
    return f"flatten(array({', '.join(arrays)}))"


def fold(
    items: str,
    state: str,
    out_type: str,
    next_state: Callable[[str, str], str],
    emit: Callable[[str, str], str],
    finish: str = "acc.out",
) -> str:
    """Left fold that also emits rows.

    ``next_state`` and ``emit`` take the state and an item; ``emit`` yields an array of rows.
    ``finish`` may use ``acc.state`` and ``acc.out``. Rows are gathered run by run, which keeps the
    work close to linear on texts with very many matches.
    """
    nothing = f"cast(array() AS {out_type})"

    def pair(new_state: str, out: str) -> str:
        return f"named_struct('state', {new_state}, 'out', {out})"

    one = pair(next_state("acc.state", "item"), f"concat(acc.out, {emit('acc.state', 'item')})")
    run = (
        f"aggregate(slice(items, run * {RUN} + 1, {RUN}), {pair('total.state', nothing)}, "
        f"(acc, item) -> {one})"
    )
    add_run = bind("part", run, pair("part.state", "concat(total.out, part.out)"))
    start = pair(state, nothing)
    runs = f"sequence(0, cast((size(items) - 1) div {RUN} AS int))"
    return bind(
        "items",
        items,
        f"CASE WHEN size(items) <= {RUN} "
        f"THEN aggregate(items, {start}, (acc, item) -> {one}, acc -> {finish}) "
        f"ELSE aggregate({runs}, {start}, (total, run) -> {add_run}, acc -> {finish}) END",
    )


def find_all(
    text: str,
    pattern: str,
    label: str,
    *,
    groups: tuple[int, int] | None = None,
    guard: str | None = None,
) -> str:
    """Every non-overlapping match of a Java ``pattern``, left to right, as spans.

    With ``groups`` the pattern is one group followed by another: the first is consumed but stays
    outside the span, the second is the span. ``guard`` is a cheap condition that every text with a
    match meets.
    """
    # a text without a match stays out of the interpreted part
    tests, cuts = _cuts(text, pattern, groups, guard)
    return f"CASE WHEN {tests} THEN {bind('pieces', cuts, placed('pieces', label))} ELSE {NO_SPANS} END"


def pieces(text: str, pattern: str, *, groups: tuple[int, int] | None = None, guard: str | None = None) -> str:
    """What :func:`placed` makes spans of; null, or the whole text, without a match. Held as a column of its own, it is
    compiled as the spans are. Few texts that meet a guard have no match, so these are not searched twice."""
    tests, cuts = _cuts(text, pattern, groups, guard)
    return f"CASE WHEN {guard or tests} THEN {cuts} END"


def _cuts(text: str, pattern: str, groups: tuple[int, int] | None, guard: str | None) -> tuple[str, str]:
    """When there is a match, and the text cut around all of them.

    One pass of the regex engine wraps each match in marks; cutting at the marks gives gap, match,
    gap, …, match, gap, and a running length gives the offsets. A text that already holds the mark
    takes a two-pass route instead, which leaves a null at the end.
    """
    rx = regex_literal(pattern)
    before, inside = groups or (None, 0)
    wrapped = f"{f'${before}' if groups else ''}{MARK}${inside}{MARK}"
    one_pass = f"split(regexp_replace({text}, {rx}, '{wrapped}'), '{MARK}', -1)"
    lead = f"regexp_extract_all({text}, {rx}, {before})" if groups else "array('')"
    hit = f"regexp_extract_all({text}, {rx}, {inside})"
    two_pass = (
        f"flatten(transform(arrays_zip(split({text}, {rx}, -1), {lead}, {hit}), "
        "z -> array(concat_ws('', z.`0`, z.`1`), z.`2`)))"
    )
    tests = " AND ".join([*([guard] if guard else []), f"rlike({text}, {rx})"])
    return tests, f"CASE WHEN contains({text}, '{MARK}') THEN {two_pass} ELSE {one_pass} END"


def placed(pieces: str, label: str) -> str:
    """Spans from ``pieces``, which may be null. Up to ``SPELLED`` matches are written out, so that they are compiled."""
    offsets = fold(
        pieces,
        "named_struct('at', 0, 'hit', false)",
        SPANS,
        lambda s, x: f"named_struct('at', {s}.at + length({x}), 'hit', NOT {s}.hit)",
        lambda s, x: f"CASE WHEN {s}.hit AND {x} IS NOT NULL THEN "
        f"array({span(f'{s}.at', f'{s}.at + length({x})', repr(label))}) ELSE {NO_SPANS} END",
    )

    def ends(n: int) -> str:
        return " + ".join(f"length(get({pieces}, {k}))" for k in range(n))

    spelled = " ".join(
        f"WHEN size({pieces}) <= {2 * n + 2} THEN array({', '.join(span(ends(2 * k + 1), ends(2 * k + 2), repr(label)) for k in range(n))})"
        for n in range(1, SPELLED + 1)
    )
    front = f"length(concat_ws('', slice({pieces}, 1, {{}})))"
    few = f"transform(sequence(1, size({pieces}) - 2, 2), i -> {span(front.format('i'), front.format('i + 1'), repr(label))})"
    return (
        f"CASE WHEN {pieces} IS NULL OR size({pieces}) < 3 THEN {NO_SPANS} {spelled} "
        f"WHEN size({pieces}) <= 2 * {FEW} + 2 THEN {few} ELSE {offsets} END"
    )


def is_valid(spans: str, text: str) -> str:
    """True when every span lies inside ``text`` and holds at least one character."""
    return f"forall({spans}, v -> v.start >= 0 AND v.start < v.end AND v.end <= length({text}))"


def _key(s: str) -> str:
    """What decides the label of a joined span: the least one gives it."""
    return (
        f"named_struct('plain', {s}.label <> 'secret', 'size', {s}.start - {s}.end, "
        f"'start', {s}.start, 'label', {s}.label)"
    )


def merge(spans: str) -> str:
    """Join overlapping spans into disjoint ones that cover the same characters.

    Spans that only touch stay apart. A joined span takes the label of its strongest member: a
    secret first, then the longest, then the earliest, then the label that sorts first.
    """
    return f"CASE WHEN size({spans}) > 1 THEN {bind('sorted', f'sort_array({spans})', _merged())} ELSE {spans} END"


def merge_sorted(spans: str) -> str:
    """What :func:`merge` gives for a column of sorted spans; a few of them need no lambda."""

    def at(k: int) -> str:
        return f"get({spans}, {k})"

    def most(ends: list[str]) -> str:
        return ends[0] if len(ends) == 1 else f"greatest({', '.join(ends)})"

    def joined_span(members: list[int]) -> str:
        if len(members) == 1:
            return at(members[0])
        keys = ", ".join(_key(at(k)) for k in members)
        return span(f"{at(members[0])}.start", most([f"{at(k)}.end" for k in members]), f"least({keys}).label")

    def spelled(n: int, k: int, done: list[list[int]], members: list[int]) -> str:
        if k == n:
            return f"array({', '.join(map(joined_span, [*done, members]))})"
        over = f"{at(k)}.start < {most([f'{at(m)}.end' for m in members])}"
        return f"CASE WHEN {over} THEN {spelled(n, k + 1, done, [*members, k])} ELSE {spelled(n, k + 1, [*done, members], [k])} END"

    apart = " AND ".join(f"(size({spans}) <= {k} OR {at(k)}.start >= {at(k - 1)}.end)" for k in range(1, 2 * SPELLED))
    cases = " ".join(f"WHEN size({spans}) = {n} THEN {spelled(n, 1, [], [0])}" for n in range(2, SPELLED + 1))
    return (
        f"CASE WHEN size({spans}) <= 1 THEN {spans} WHEN size({spans}) <= {2 * SPELLED} AND {apart} THEN {spans} {cases} "
        f"ELSE {bind('sorted', spans, _merged())} END"
    )


def _merged() -> str:
    """The merge of two or more spans, bound to ``sorted``."""
    key_type = "struct<plain:boolean,size:int,start:int,label:string>"
    state_type = f"struct<start:int,end:int,best:{key_type}>"

    def fresh(s: str, x: str) -> str:
        return f"({s}.end IS NULL OR {x}.start >= {s}.end)"

    def closed(s: str) -> str:
        return f"array({span(f'{s}.start', f'{s}.end', f'{s}.best.label')})"

    def next_state(s: str, x: str) -> str:
        opened = f"named_struct('start', {x}.start, 'end', {x}.end, 'best', {_key(x)})"
        grown = (
            f"named_struct('start', {s}.start, 'end', greatest({s}.end, {x}.end), "
            f"'best', least({s}.best, {_key(x)}))"
        )
        return (
            f"CASE WHEN {fresh(s, x)} THEN {opened} ELSE {grown} END"
        )

    # A span begins a cluster unless one in front of it reaches over its start.
    heads = "filter(sequence(0, size(sorted) - 1), i -> NOT exists(slice(sorted, 1, i), p -> p.end > sorted[i].start))"
    one = span("members[0].start", "array_max(members.end)", f"array_min(transform(members, m -> {_key('m')})).label")
    cluster = bind(
        "members",
        "slice(sorted, h + 1, coalesce(get(heads, k + 1), size(sorted)) - h)",
        f"CASE WHEN size(members) = 1 THEN members[0] ELSE {one} END",
    )
    few = bind("heads", heads, f"transform(heads, (h, k) -> {cluster})")
    many = fold(
        "sorted",
        f"cast(null AS {state_type})",
        SPANS,
        next_state,
        lambda s, x: f"CASE WHEN {fresh(s, x)} AND {s}.end IS NOT NULL THEN {closed(s)} "
        f"ELSE {NO_SPANS} END",
        f"concat(acc.out, {closed('acc.state')})",
    )
    apart = "forall(sequence(1, size(sorted) - 1), i -> sorted[i].start >= sorted[i - 1].end)"
    return f"CASE WHEN {apart} THEN sorted WHEN size(sorted) <= {FEW} THEN {few} ELSE {many} END"


def covered(spans: str) -> str:
    """Number of characters inside disjoint ``spans``."""
    return f"aggregate({spans}, 0L, (n, c) -> n + (c.end - c.start))"


def cut(text: str, start: str, end: str) -> str:
    return f"substring({text}, {start} + 1, {end} - {start})"


def chunks(text: str) -> str:
    """``text`` as pieces of ``CHUNK`` code points. A position is found by counting from the front, so it is cut
    into large pieces first and these into smaller ones; then any cut counts within a piece."""
    out = f"array({text})"
    for k, size in enumerate(_SIZES):
        pieces = f"transform(sequence(0, greatest(length(t{k}) - 1, 0) div {size}), i -> substring(t{k}, i * {size} + 1, {size}))"
        out = f"flatten(transform({out}, t{k} -> {pieces}))"
    return out


def cut_chunks(parts: str, start: str, end: str) -> str:
    """What :func:`cut` gives, from the ``chunks`` of the text."""
    low, high = f"greatest({start} - k * {CHUNK}, 0)", f"least({end} - k * {CHUNK}, {CHUNK})"
    pieces = f"transform(sequence({start} div {CHUNK}, ({end} - 1) div {CHUNK}), k -> substring({parts}[k], {low} + 1, {high} - {low}))"
    return f"CASE WHEN {start} < {end} THEN concat_ws('', {pieces}) ELSE '' END"


def placeholder(label: str) -> str:
    return f"concat('[', upper({label}), ']')"


def redact(text: str, spans: str, replacement: Callable[[str], str]) -> str:
    """``text`` with every span of an ordered, disjoint array replaced. Where there are many, the text is cut
    by way of its ``chunks``, which makes the work follow its length and not the square of it."""

    def pieces(gap: Callable[[str, str], str]) -> str:
        before = f"CASE WHEN i = 0 THEN 0 ELSE {spans}[i - 1].end END"
        tail = cut(text, f"element_at({spans}, -1).end", f"length({text})")
        return f"concat_ws('', transform({spans}, (item, i) -> concat_ws('', {gap(before, 'item.start')}, {replacement('item')})), {tail})"

    few = pieces(lambda a, b: cut(text, a, b))
    many = bind("parts", chunks(text), pieces(lambda a, b: cut_chunks("parts", a, b)))
    return (
        f"CASE WHEN size({spans}) > {RUN} THEN {many} "
        f"WHEN size({spans}) > 0 THEN {few} ELSE {text} END"
    )


def redact_few(text: str, spans: str, first: str, n: int, replacement: Callable[[str], str]) -> str:
    """``text`` with ``n`` spans of an ordered, disjoint array replaced, from the place ``first`` on, without a lambda."""
    items = [f"get({spans}, {first} + {k})" for k in range(n)]
    ends = ["0", *(f"{x}.end" for x in items)]
    parts = ", ".join(f"{cut(text, end, f'{x}.start')}, {replacement(x)}" for end, x in zip(ends, items, strict=False))
    return f"concat_ws('', {parts}, {cut(text, ends[-1], f'length({text})')})"


def count_by_label(spans: str) -> str:
    """``map<label, count>`` of a span array."""
    return bind(
        "labels",
        f"sort_array(array_distinct({spans}.label))",
        "map_from_arrays(labels, transform(labels, k -> "
        f"cast(size(filter({spans}, w -> w.label = k)) AS bigint)))",
    )
