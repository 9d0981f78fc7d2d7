"""Repair of conversation structure at least cost, over a suffix-shared automaton.

The rows of a conversation become a signature of role and fault, one letter a row. What a repair costs
from a row on depends only on the letters from there on and on the state of the grammar, so signatures
are merged from the end: sorted by their reversed letters, those with an end in common stand together,
and every node (a distinct end) is made and solved once, for the four states at once. A node keeps the
cheapest cost to go and, as a shared chain, the best audit from there on.

Grammar of role initials: ``(s?(ua)+)?``. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.

Long conversations are cut into pieces of ``PIECE`` rows. A piece is solved under the costs to go at its
end; these come from the pieces behind it by their tables of least costs, four by four numbers each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.storage import stored

#: Rows of a conversation that are solved in one go, and about how much text they may hold.
PIECE = 512
PIECE_BYTES = 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 60
#: Where the next u or a leads from each state; None where the grammar has no place for that initial.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_FREE = (2, 2, 3, 2)
#: Costs to go behind the last row: of states 1 and 2 by what must be inserted.
_END = (0, 2 * INSERT, INSERT, 0)

_ROLES = ("user", "assistant")

# Per state the cost to go and the best audit as a chain (edit, next state, rest), shared by all signatures
# with this end; the rest is a node, or the one edit that follows an insert.
_Node = tuple[tuple[int, ...], tuple]


def _ending(costs: tuple[int, ...], insert: bool) -> _Node:
    """The node behind the last row: each state's cost to go; with ``insert`` the missing roles come here."""
    chains: tuple = (None, None, None, None)
    if insert:
        chains = (None, ("I", 2, ("I", 3, None)), ("I", 3, None), None)
    return costs, chains


def _before(letter: str, node: _Node) -> _Node:
    """The node of ``letter`` followed by ``node``: per state the least cost, and the ASCII-least edit of that cost.

    An edit and a state have one next state, so equal costs are decided by the edit's initial alone. Two
    inserts in a row come back to where they began, so one before a row is enough.
    """
    costs = node[0]
    late = TRUNCATED if letter.isupper() and letter != "X" else 0
    role = letter.lower()
    own: list[tuple[int, str, int]] = []
    for state in range(4):
        best = (costs[state] + DELETE, "D", state)
        if letter != "X":
            to = _NEXT[role][state] if role in _NEXT else None
            if to is not None:
                best = min(best, (costs[to] + late, "K", to))
            best = min(best, (costs[_FREE[state]] + late + REROLE, "R", _FREE[state]))
        own.append(best)
    out, chains = [], []
    for state in range(4):
        cost, edit, to = own[state]
        after = own[_FREE[state]]
        if (after[0] + INSERT, "I") < (cost, edit):
            out.append(after[0] + INSERT)
            chains.append(("I", _FREE[state], (after[1], after[2], node)))
        else:
            out.append(cost)
            chains.append((edit, to, node))
    return tuple(out), tuple(chains)


def _walk(node: _Node | None, state: int) -> tuple[str, int]:
    """The audit from a node and state on, and the state it ends in."""
    out = []
    while node is not None:
        step = node[1][state] if len(node) == 2 else node
        if step is None:
            break
        edit, state, node = step
        out.append(edit)
    return "".join(out), state


def solve(signatures: Iterator[tuple[str, tuple[int, ...], bool]]) -> Iterator[tuple[tuple[int, ...], _Node]]:
    """Cost to go of each state, and the node, per (signature, costs behind it, is it the last piece).

    Signatures come sorted by (costs, last, reversed letters): the stack holds the nodes of the present one's
    ends, and what the next has in common with it stays, so every distinct end is solved once.
    """
    key, past, stack = None, "", []
    for letters, costs, last in signatures:
        if key != (costs, last):
            key, past, stack = (costs, last), "", [_ending(costs, last)]
        back = letters[::-1]
        common = 0
        for x, y in zip(past, back):  # noqa: B905 the shorter ends it
            if x != y:
                break
            common += 1
        del stack[common + 1 :]
        for letter in back[common:]:
            stack.append(_before(letter, stack[-1]))
        past = back
        yield stack[-1][0], stack[-1]


def _table(letters: str) -> list[int]:
    """Least cost of a piece from each state to each, sixteen numbers."""
    rows = []
    for to in range(4):
        costs: tuple[int, ...] = tuple(0 if s == to else _NEVER for s in range(4))
        for letter in reversed(letters):
            costs = tuple(min(c, _NEVER) for c in _before(letter, (costs, ()))[0])
        rows.append(costs)
    return [rows[to][state] for state in range(4) for to in range(4)]


def edited(audit: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """``role:text`` of the rows that an audit leaves, its inserts among them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = _NEXT[roles[at][:1]][state]
            at += 1
            continue
        role = _ROLES[_FREE[state] - 2]
        state = _FREE[state]
        if edit == "R":
            out.append(f"{role}:{texts[at]}")
            at += 1
        else:
            out.append(f"{role}:")
    return out


def faults(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Different rows of each conversation with their number of copies and, by ``fault``, what is wrong with the
    first copy: blank, duplicate or truncated, else null. Further copies are duplicates, or blank like the first."""
    plain = rows.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    counted = stored(plain.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns")
    mark = F.sha2(F.col("text"), 256)
    said = counted.withColumn("mark", mark).groupBy("conv", "role", "mark").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count("*").alias("n")
    )
    # only what is said at several turns takes part in the join
    again = stored(said.where("n > 1").select("conv", "role", "mark", "first"), "said_again")
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("conv", "role", "mark")]
    joined = counted.withColumn("mark", mark).alias("r").join(again.alias("a"), keys, "left")
    return joined.select(
        "r.conv", "r.turn", "r.role", "r.text", "r.copies",
        F.expr(
            r"""CASE WHEN NOT r.text RLIKE '[^\\x20\\x09-\\x0D]' THEN 'blank'
                WHEN a.first IS NOT NULL AND NOT a.first.turn <=> r.turn THEN 'duplicate'
                WHEN r.text RLIKE '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z' THEN 'truncated' END"""
        ).alias("fault"),
    )


_PIECE = (
    "conv {}, part int, piece int, letters string, first string, last string, roles array<string>, texts array<string>, "
    "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
)


def _letter(role: str, fault: str | None) -> str:
    """X for a row that must be deleted, else its initial, or o for one the grammar does not know; a capital if truncated."""
    if fault in ("blank", "duplicate"):
        return "X"
    letter = role[:1] if role[:1] in ("u", "a", "s") else "o"
    return letter.upper() if fault == "truncated" else letter


def _illegal(left: str, right: str) -> int:
    return int(left[:1] + right[:1] not in ("su", "ua", "au"))


def pieces(found: DataFrame, size: int = PIECE) -> DataFrame:
    """Rows in order, cut into pieces. The order of all conversations is dealt out by ranges, so a conversation
    of any size lies in neighbouring partitions, and tasks only stream."""
    conv = found.schema["conv"].dataType.simpleString()
    # the order of conversations themselves does not matter, but nulls and all types must have one
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv", "turn", "role", "text", "copies", "fault", F.spark_partition_id().alias("part"))
    schema = T.StructType.fromDDL(_PIECE.format(conv))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        own: dict | None = None
        used, held, number, last_turn = 0, 0, 0, None

        def close() -> None:
            nonlocal own, number
            if own is not None:
                own["letters"] = "".join(own["letters"])
                done.append(own)
                number += 1
            own = None

        for batch in batches:
            for conv, turn, role, text, copies, fault, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is not None and (own["conv"] != conv or len(own["roles"]) >= size or used >= PIECE_BYTES):
                    last_turn = last_turn if own["conv"] == conv else None
                    close()
                if own is None:
                    used = 0
                    own = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                    own |= {"conv": conv, "part": part, "piece": number, "letters": [], "first": role, "last": role}
                    own |= {"roles": [], "texts": [], "low": None, "high": None}
                if own["roles"]:
                    own["illegal"] += _illegal(own["last"], role)
                if fault:
                    own[fault] += 1
                own["blank" if fault == "blank" else "duplicate"] += copies - 1
                own["illegal"] += (copies - 1) * _illegal(role, role)
                own["letters"].append(_letter(role, fault) + "X" * (copies - 1))
                own["roles"] += [role] * copies
                own["texts"] += [text, *[""] * (copies - 1)]
                own["last"] = role
                if turn is not None:
                    own["turns"] += turn != last_turn
                    own["low"] = turn if own["low"] is None else own["low"]
                    own["high"] = last_turn = turn
                used += len(text)
                held += len(text)
                if held >= 8 * PIECE_BYTES or len(done) >= 1024:
                    if done:
                        yield _batch(done, schema)
                    done, held = [], 0
        close()
        if done:
            yield _batch(done, schema)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=to_arrow_schema(schema))


def _behind(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the pieces of one long conversation, from the last on: the least costs to go behind each, and the
    state each begins in under the best repair; needs sixteen numbers a piece."""
    frame = frame.sort_values(["part", "piece"])
    tables = [list(t) for t in frame["table"]]
    behind = [list(_END)]
    for table in reversed(tables[1:]):
        after = behind[-1]
        costs = [min(min(table[4 * s + q] + after[q], _NEVER) for q in range(4)) for s in range(4)]
        behind.append(costs)
    frame = frame[["conv", "part", "piece"]].copy()
    frame["behind"] = behind[::-1]
    frame["is_last"] = [False] * (len(tables) - 1) + [True]
    return frame


def _sorted_signatures(rows: DataFrame) -> DataFrame:
    """Different signatures with what is behind them, near those with the same end."""
    order = ["is_last", "behind", F.reverse("letters")]
    return rows.select("letters", "behind", "is_last").distinct().repartitionByRange(*order).sortWithinPartitions(*order)


def solutions(rows: DataFrame) -> DataFrame:
    """Cost and audit of each different (signature, costs behind, is it last) from each state, and where it ends."""
    schema = T.StructType.fromDDL(
        "letters string, behind array<long>, is_last boolean, cost array<long>, audit array<string>, ends array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)

        def asked(seen: list) -> Iterator[tuple[str, tuple[int, ...], bool]]:
            for batch in batches:
                for letters, behind, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    seen.append((letters, behind, last))
                    yield letters, tuple(behind), last

        seen: list = []
        out: list[dict] = []
        for costs, node in solve(asked(seen)):
            letters, behind, last = seen.pop()
            walks = [_walk(node, s) for s in range(4)]
            out.append(
                {
                    "letters": letters, "behind": behind, "is_last": last, "cost": list(costs),
                    "audit": [w for w, _ in walks], "ends": [e for _, e in walks],
                }
            )
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=wanted)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    return _sorted_signatures(rows).mapInArrow(run, schema)


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    """The state that each piece of a long conversation begins in."""
    frame = frame.sort_values(["part", "piece"])
    state, begins = 0, []
    for ends in frame["ends"]:
        begins.append(state)
        state = int(ends[state])
    frame = frame[["conv", "part", "piece"]].copy()
    frame["begin"] = begins
    return frame


def _same_piece(a: str, b: str) -> Column:
    out = F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    for c in ("part", "piece"):
        out &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return out


def repair(
    rows: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """One row per conversation that has rows: id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 and pieces.

    Rows go by turn, nulls first, then by role and text. Null roles and texts are one space. The first fault of
    a row counts: blank, duplicate (role and text seen earlier), truncated (no ``.``, ``!`` or ``?`` at its end).
    Keep costs 0, Rerole 1, Delete 2 (a must for blank and duplicate rows), Insert 5, a truncated row that stays
    5; of the cheapest audits the ASCII-least is taken. Rows without an id are one conversation; copies of a
    row are counted before they are shuffled; long texts and conversations are taken whole.
    """
    conv = rows.schema[id_col].dataType.simpleString()
    cut = stored(pieces(faults(rows, id_col, turn_col, role_col, text_col), piece), "pieces")
    per = cut.groupBy("conv").agg(F.count("*").alias("n"))
    # a conversation has several pieces only if it is long or lies on a border of partitions
    many = stored(per.where("n > 1").select("conv"), "long")
    light = cut.select("conv", "part", "piece", "letters")
    several = light.alias("c").join(many.alias("m"), F.col("c.conv").eqNullSafe(F.col("m.conv")), "left_semi")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["table"] = [_table(x) for x in frame.pop("letters")]
            yield frame

    numbers = several.mapInPandas(tables, f"conv {conv}, part int, piece int, table array<long>")
    behind = stored(numbers.groupBy("conv").applyInPandas(_behind, f"conv {conv}, part int, piece int, behind array<long>, is_last boolean"), "behind")
    alone = F.array(*[F.lit(c).cast("long") for c in _END])
    placed = cut.alias("c").join(behind.alias("b"), _same_piece("c", "b"), "left").select(
        "c.*", F.coalesce("b.behind", alone).alias("behind"), F.coalesce("b.is_last", F.lit(True)).alias("is_last"),
        F.col("b.conv").isNotNull().alias("is_part") | F.col("b.part").isNotNull(),
    )
    placed = placed.toDF(*cut.columns, "behind", "is_last", "is_part")
    solved = stored(solutions(placed), "solutions")
    whole = placed.join(solved, ["letters", "behind", "is_last"])
    ends = stored(whole.where("is_part").select("conv", "part", "piece", "ends"), "ends")
    begins = stored(ends.groupBy("conv").applyInPandas(_chained, f"conv {conv}, part int, piece int, begin int"), "begins")
    whole = whole.alias("c").join(begins.alias("b"), _same_piece("c", "b"), "left").select("c.*", F.coalesce("b.begin", F.lit(0)).alias("begin"))
    done = stored(_finished(whole, conv), "finished")

    single = done.where("NOT is_part").selectExpr(
        "conv", "cost", "audit", "sha", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "1L AS pieces"
    )
    joined = _joined(done.where("is_part"), conv)
    out = single.unionByName(joined)
    return out.select(
        F.col("conv").alias(id_col),
        F.expr("coalesce(high - low + 1 - turns, 0L) AS gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha").alias("repaired_sha256"),
        "pieces",
    )


_DONE = (
    "conv {}, part int, piece int, is_part boolean, is_last boolean, begin int, cost long, audit string, sha string, body string, first string, "
    "last string, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
)


def _finished(whole: DataFrame, conv: str) -> DataFrame:
    """Audit and repaired text of each piece; only pieces of long conversations pass their text on."""
    schema = T.StructType.fromDDL(_DONE.format(conv))
    inputs = ["cost", "audit", "roles", "texts"]
    plain = [n for n in schema.names if n not in ("cost", "audit", "sha", "body")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = batch.to_pydict()
            for k in range(batch.num_rows):
                row = {n: columns[n][k] for n in plain}
                begin = row["begin"]
                row["cost"], row["audit"] = columns["cost"][k][begin], columns["audit"][k][begin]
                body = "\n".join(edited(row["audit"], columns["roles"][k], columns["texts"][k], begin))
                row["sha"] = hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()
                row["body"] = body if row["is_part"] else None
                out.append(row)
            yield _batch(out, schema)

    return whole.select(*plain, *inputs).mapInArrow(run, schema)


def _joined(parts: DataFrame, conv: str) -> DataFrame:
    """Long conversations put together from their pieces, in order. A task streams its rows: one hash, one
    audit and a few numbers are all it holds of a conversation."""
    schema = T.StructType.fromDDL(
        f"conv {conv}, cost long, audit string, sha string, blank long, duplicate long, truncated long, illegal long, low long, "
        "high long, turns long, pieces long"
    )
    fields = ["conv", "part", "piece", "begin", "cost", "audit", "body", "first", "last", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    dealt = parts.select(*fields).repartition("conv").sortWithinPartitions("conv", "part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict | None = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if own is None or own["conv"] != r["conv"]:
                    if own is not None:
                        out.append(_closed(own))
                    own = {k: r[k] for k in ("conv", "cost", "low", "high")}
                    own |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "pieces"), 0)
                    own |= {"audit": [], "sha": hashlib.sha256(), "any": False, "past": None}
                for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    own[k] += r[k]
                if own["past"] is not None:
                    own["illegal"] += _illegal(own["past"]["last"], r["first"])
                    if own["past"]["high"] is not None and own["past"]["high"] == r["low"] and own["past"]["part"] != r["part"]:
                        own["turns"] -= 1
                kept = r["audit"].strip("D") != ""
                if kept:
                    own["sha"].update((("\n" if own["any"] else "") + r["body"]).encode("utf-8", "replace"))
                    own["any"] = True
                own["audit"].append(r["audit"])
                own["low"] = r["low"] if own["low"] is None else own["low"]
                own["high"] = r["high"] if r["high"] is not None else own["high"]
                own["pieces"] += 1
                own["past"] = r
            if out:
                yield _batch(out, schema)
        if own is not None:
            yield _batch([_closed(own)], schema)

    return dealt.mapInArrow(run, schema)


def _closed(own: dict) -> dict:
    return own | {"audit": "".join(own["audit"]), "sha": own["sha"].hexdigest()}


def damage(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults by the hash of ``conv_id:turn``: one in twenty each is dropped, loses its
    text, loses its sentence ends, stands twice, or says it is the user's. Nulls are one space."""
    clean = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    word = "coalesce(cast({} AS string), ' ')"
    hashed = clean.withColumn("_fault", F.expr(f"crc32(concat({word.format('conv_id')}, ':', {word.format('turn')})) % 20"))
    return hashed.where("_fault <> 0").select(
        "conv_id",
        "turn",
        F.expr("CASE WHEN _fault = 4 THEN 'user' ELSE role END AS role"),
        F.expr("CASE _fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text"),
        F.expr("explode(sequence(1, if(_fault = 3, 2, 1))) AS _copy"),
    ).drop("_copy")


def with_all(found: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``found`` with a row of zeros for each conversation of ``rows`` of which nothing is left."""
    ids = rows.select(F.col(id_col).alias("_id")).distinct()
    out = ids.join(found, F.col("_id").eqNullSafe(F.col(id_col)), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("_id").alias(id_col),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
