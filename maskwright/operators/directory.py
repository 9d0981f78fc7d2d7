"""Find people of a directory by name or address inside message texts.

The directory has ``name``, ``email``, ``role`` and a rank ``staff_ord``. A mention is the first
case-insensitive place where the name or the address stands anywhere in body and subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.sources.scratch import written

# Up to this many people are compared with each text in place; more are joined on text fragments.
IN_ROW_LIMIT = 64
# Up to this many people and bytes the fragments of the directory are broadcast.
BROADCAST_LIMIT = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
FRAGMENT = 8
_BLOCK = 256
# Bits per needle of the filter that fragments of a text pass before they are exploded, and the largest number
# of 64-bit words that it takes (4 MB); beyond that it lets more through, and the join decides as before.
FILTER_BITS = 32
FILTER_WORDS = 1 << 19

_HIT = (
    "struct(n.staff_ord, n.name, n.role, n.kind, {at} AS start, {at} + length(n.needle) AS end)"
)


def _needles(staff: DataFrame) -> DataFrame:
    """A row per person and kind; a person listed twice counts once."""
    pairs = "inline(array(struct('name' AS kind, name AS needle), struct('email' AS kind, email AS needle)))"
    return staff.select("staff_ord", "name", "role", F.expr(pairs)).where("length(needle) > 0").distinct()


def mentions(messages: DataFrame, staff: DataFrame) -> DataFrame:
    """One row per message row, person and kind: ``start``, ``end`` and the matched text.

    A message that stands in the input twice is reported twice; equal rows of the directory count
    once; a person without name or address is found by the other; ``role`` may be null; a null
    subject or body mentions nobody. The directory is counted first, which decides only how the two
    sides meet: a small one goes to every text as an array, a larger one is joined by fragments
    (broadcast or shuffled), so the work follows the texts and the matches, never texts times people.
    """
    texts = messages.select("message_id", F.expr("concat(body, ' ', subject)").alias("_text"))
    width = " + ".join(f"coalesce(octet_length({c}), 0)" for c in ("name", "email", "role"))
    size = staff.limit(BROADCAST_LIMIT + 1).selectExpr("count(*) AS people", f"coalesce(sum({width}), 0) AS bytes").first()
    small = size.people <= BROADCAST_LIMIT and size.bytes <= BROADCAST_BYTES
    if small and size.people <= IN_ROW_LIMIT:
        found = _without_text(_in_row(texts, staff))
    else:
        found = by_fragment(texts, staff, small)
    return found.select(
        "message_id", "staff_ord", F.col("name").alias("employee"), "role", "kind", "start", "end", "match_text", "offsets_shifted"
    )


def _without_text(hits: DataFrame) -> DataFrame:
    """Hits with what is needed of their text in its place."""
    return hits.withColumns(
        {
            "match_text": F.expr(S.cut("_text", "start", "end")),
            # lower-casing may change lengths outside ASCII; such offsets refer to the lowered text
            "offsets_shifted": F.expr("length(lower(_text)) <> length(_text)"),
        }
    ).drop("_text")


def _in_row(texts: DataFrame, staff: DataFrame) -> DataFrame:
    listed = _needles(staff).agg(F.collect_list(F.struct("staff_ord", "name", "role", "kind", "needle")).alias("people"))
    at = "(locate(lower(n.needle), low) - 1)"
    hits = S.bind("low", "lower(_text)", f"filter(transform(_people, n -> {_HIT.format(at=at)}), h -> h.start >= 0)")
    rows = texts.withColumn("_people", listed.scalar())
    return rows.select("message_id", "_text", F.inline(F.expr(hits)))


def _filter(keyed: DataFrame) -> tuple[DataFrame, int]:
    """A bit array over hashed fragments as one row with an array of words, and how many words there are.

    The size follows from the number of needles, which is counted; two bits stand for each fragment.
    """
    needles = keyed.count()
    words = 1
    while words < FILTER_WORDS and 64 * words < FILTER_BITS * needles:
        words *= 2
    places = ", ".join(f"struct(cast({word} AS long) AS id, shiftleft(1L, {bit}) AS bit)" for word, bit in _places("fragment", words))
    filled = keyed.select(F.expr(f"inline(array({places}))")).groupBy("id").agg(F.bit_or("bit").alias("word"))
    every = keyed.sparkSession.range(words).join(filled.hint("merge"), "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")).alias("w"))
    return every.agg(F.expr("transform(array_sort(collect_list(w)), w -> w.word)").alias("words")), words


def _places(fragment: str, words: int) -> list[tuple[str, str]]:
    """The two bits of a fragment: the word, of a number that is a power of two, and the bit in it."""
    return [(f"(shiftright({h}, 6) & {words - 1})", f"({h} & 63)") for h in (f"hash({fragment})", f"hash({fragment}, 1)")]


def fragment_candidates(texts: DataFrame, keyed: DataFrame, widths: list[int], kept: tuple[str, ...] = ("_key",)) -> DataFrame:
    """Fragments of each text that the directory may know, distinct, beside the columns ``kept``: few but true ones
    get through, so few are joined.

    Places are rows, by blocks and then by place, so that all tests are compiled; a row is made only of what passes.
    """
    if not widths:
        return texts.select(*kept, F.lit("").alias("fragment")).where("false")
    words, size = _filter(keyed)
    rows = texts.withColumn("_low", F.expr("lower(_text)")).where(f"length(_low) >= {min(widths)}")
    rows = rows.select("*", F.expr(f"explode(sequence(0, (length(_low) - 1) div {_BLOCK})) AS _b"))
    rows = rows.withColumn("_block", F.expr(f"substring(_low, cast(_b * {_BLOCK} + 1 AS int), {_BLOCK + max(widths) - 1})"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, widths))).alias("_w")).where("length(_block) >= _w")
    rows = rows.select("*", F.expr(f"explode(sequence(1, least({_BLOCK}, length(_block) - _w + 1))) AS _i"))
    rows = rows.withColumn("fragment", F.expr("substring(_block, _i, _w)"))
    for word, bit in _places("fragment", size):
        rows = rows.where(F.call_function("getbit", F.element_at(words.scalar(), F.expr(f"{word} + 1")), F.expr(bit)) == 1)
    first = rows.where(F.expr(f"locate(fragment, _low) = _b * {_BLOCK} + _i"))
    return first.select(*kept, "fragment")


def by_fragment(texts: DataFrame, staff: DataFrame, small: bool) -> DataFrame:
    """Mentions by way of text fragments; ``small`` says that the directory may be broadcast.

    People who share a name are looked for once; they part in the last step, after which nothing is shuffled. With a
    broadcast directory a text is not shuffled at all, else once.
    """
    people = _needles(staff).withColumns({"low": F.expr("lower(needle)"), "_n": F.expr("length(needle)")})
    needles = people.select("low", "_n").distinct()
    width = f"least(length(low), {FRAGMENT})"
    pieces = needles.withColumn(
        "fragment",
        F.explode(
            F.expr(
                f"array_distinct(transform(sequence(1, length(low) - {width} + 1), "
                f"i -> substring(low, i, {width})))"
            )
        ),
    )
    # Each needle is looked up by the one fragment that fewest other needles share. Spark would take a directory for as
    # small as its compressed file and collect its fragments on the driver to broadcast them; hints keep it from that.
    shared = pieces.groupBy("fragment").agg(F.count("*").alias("owners"))
    keyed = pieces.join(shared.hint("merge"), "fragment").groupBy("low", "_n").agg(F.min_by("fragment", F.struct("owners", "fragment")).alias("fragment"))
    keyed = written(keyed, "needles")
    widths = [r[0] for r in keyed.select(F.expr(width)).distinct().collect()]  # 1 … FRAGMENT
    if small:
        fragments = fragment_candidates(texts, keyed, widths, tuple(texts.columns))
        candidates = fragments.join(F.broadcast(keyed), "fragment").drop("fragment")
    else:
        # Mentions depend on the text alone, so its hash is its key: message ids may repeat. Texts that share a hash
        # share candidates, and each candidate is looked for in its text.
        texts = texts.withColumn("_key", F.xxhash64("_text"))
        fragments = fragment_candidates(texts, keyed, widths)
        known = fragments.join(keyed.hint("merge"), "fragment").select("_key", "low", "_n").distinct()
        candidates = texts.join(known.hint("merge"), "_key").drop("_key")
    hits = (
        candidates.withColumn("start", F.expr("locate(low, lower(_text)) - 1"))
        .where("start >= 0")
        .withColumn("end", F.expr("start + _n"))
    )
    return _without_text(hits).join(F.broadcast(people) if small else people.hint("merge"), ["low", "_n"])


def fold_mentions(found: DataFrame) -> DataFrame:
    """One row per message and person with the sorted kinds of mention."""
    return found.groupBy("message_id", "staff_ord", "employee", "role").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds")
    )
