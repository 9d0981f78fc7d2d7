"""Prepare and export requests from JSON lines under a closed schema.

A line is read as VARIANT, so that what it holds is known by its own type: no text turns into a number, no
number into a boolean, and no unknown field is lost. A line that does not fit is kept with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import fixed_values as V
from maskwright.operators.prepare import MASKS

_KINDS = "'support_ticket', 'ai_prompt', 'email'"
_RECEIPT = r"^[A-Za-z0-9_-]{32,128}\z"


def _part(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def _type(v: str) -> str:
    """``STRING``, ``BIGINT``, ``BOOLEAN``, ``VOID``, ``OBJECT<…>``, … ; null if there is nothing."""
    return f"schema_of_variant({v})"


def _keys(v: str) -> str:
    return f"map_keys(cast({v} AS map<string,variant>))"


def _object(v: str, where: str, required: list[str], optional: list[str] | None = None) -> list[str]:
    """Branches of a CASE that name what is wrong with the fields of an object."""
    allowed = ", ".join(f"'{n}'" for n in [*required, *(optional or [])])
    needed = ", ".join(f"'{n}'" for n in required)
    return [
        f"WHEN NOT coalesce({_type(v)} LIKE 'OBJECT%', false) THEN 'wrong_type: {where}'",
        f"WHEN size(array_except({_keys(v)}, array({allowed}))) > 0 THEN 'unknown_field: {where}'",
        f"WHEN size(array_except(array({needed}), {_keys(v)})) > 0 THEN 'missing_field: {where}'",
    ]


def _is(v: str, where: str, kind: str) -> str:
    return f"WHEN NOT coalesce({_type(v)} = '{kind}', false) THEN 'wrong_type: {where}'"


def _texts(v: str, where: str) -> list[str]:
    values = f"map_values(cast({v} AS map<string,variant>))"
    return [
        f"WHEN NOT coalesce({_type(v)} LIKE 'OBJECT%', false) THEN 'wrong_type: {where}'",
        f"WHEN exists({values}, x -> {_type('x')} <> 'STRING') THEN 'wrong_type: {where}'",
    ]


def _masks(v: str) -> list[str]:
    items = f"cast({v} AS array<variant>)"
    known = "array('field', 'start', 'end')"
    sound = (
        f"coalesce({_type('m')} LIKE 'OBJECT%', false) AND size(array_except({_keys('m')}, {known})) = 0 AND size({_keys('m')}) = 3 "
        f"AND {_type(_part('m', 'field'))} = 'STRING' AND {_type(_part('m', 'start'))} = 'BIGINT' AND {_type(_part('m', 'end'))} = 'BIGINT' "
        # further than an offset can be: no range, and no overflow of its type
        f"AND abs(try_variant_get(m, '$.start', 'decimal(20,0)')) < 2147483648 AND abs(try_variant_get(m, '$.end', 'decimal(20,0)')) < 2147483648"
    )
    return [
        f"WHEN {v} IS NOT NULL AND NOT {_type(v)} LIKE 'ARRAY%' THEN 'wrong_type: manual_masks'",
        f"WHEN {v} IS NOT NULL AND exists({items}, m -> NOT coalesce({sound}, false)) THEN 'wrong_type: manual_masks'",
    ]


def _lines(spark: SparkSession, path: str, branches: list[str]) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    lines = lines.withColumn("v", F.expr("try_parse_json(line)"))
    return lines.withColumn("refused", F.expr(f"CASE WHEN v IS NULL THEN 'not_json' {' '.join(branches)} END"))


def read_prepare_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``request_id``, ``use_case``, ``fields``, ``manual_masks``, ``refused`` and ``line``.

    ``refused`` says why a line is no request, else it is null; a refused line has no other values. Fields
    must be there with the type they have: text, an object of texts, a list of masks with whole numbers.
    ``manual_masks`` may be left out; ``null`` is no value of any field. What a sound request asks for is
    judged by ``prepare``.
    """
    use_case, fields, masks = (_part("v", n) for n in ("use_case", "fields", "manual_masks"))
    branches = [
        *_object("v", "request", ["request_id", "use_case", "fields"], ["manual_masks"]),
        _is(_part("v", "request_id"), "request_id", "STRING"),
        _is(use_case, "use_case", "STRING"),
        *_texts(fields, "fields"),
        *_masks(masks),
        f"WHEN NOT try_variant_get(v, '$.use_case', 'string') IN ({_KINDS}) THEN 'unknown_value: use_case'",
    ]
    rows = _lines(spark, path, branches)
    sound = lambda e: F.expr(f"CASE WHEN refused IS NULL THEN {e} END")
    return rows.select(
        sound("try_variant_get(v, '$.request_id', 'string')").alias("request_id"),
        sound("try_variant_get(v, '$.use_case', 'string')").alias("use_case"),
        sound("try_variant_get(v, '$.fields', 'map<string,string>')").alias("fields"),
        sound(f"coalesce(try_variant_get(v, '$.manual_masks', '{MASKS}'), cast(array() AS {MASKS}))").alias("manual_masks"),
        "refused",
        "line",
    )


def read_export_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``receipt``, ``use_case``, ``engine``, ``policy_version``, ``fields``, ``routing``, ``refused`` and ``line``.

    As :func:`read_prepare_requests`; besides, ``confirmed`` must be the literal ``true``, not a text or a number,
    and the receipt 32 to 128 characters of an address-safe alphabet.
    """
    c, routing = _part("v", "candidate"), _part("v", "candidate.routing")
    sides = ("crosses_example_boundary", "all_recipients_internal")
    none = f"({routing} IS NULL OR {_type(routing)} = 'VOID')"
    branches = [
        *_object("v", "request", ["receipt", "candidate", "confirmed"]),
        _is(_part("v", "receipt"), "receipt", "STRING"),
        _is(_part("v", "confirmed"), "confirmed", "BOOLEAN"),
        *_object(c, "candidate", ["use_case", "engine", "fields"], ["policy_version", "routing"]),
        _is(_part("v", "candidate.use_case"), "use_case", "STRING"),
        _is(_part("v", "candidate.engine"), "engine", "STRING"),
        *_texts(_part("v", "candidate.fields"), "fields"),
        *[b.replace("WHEN ", f"WHEN NOT {none} AND ", 1) for b in _object(routing, "routing", ["recipient_count", *sides])],
        *[b.replace("WHEN ", f"WHEN NOT {none} AND ", 1) for b in (
            _is(_part("v", "candidate.routing.recipient_count"), "routing", "BIGINT"),
            *[_is(_part("v", f"candidate.routing.{n}"), "routing", "BOOLEAN") for n in sides],
        )],
        f"WHEN NOT try_variant_get(v, '$.candidate.use_case', 'string') IN ({_KINDS}) THEN 'unknown_value: use_case'",
        f"WHEN NOT coalesce(try_variant_get(v, '$.candidate.policy_version', 'string'), '{V.POLICY_VERSION}') = '{V.POLICY_VERSION}' "
        "THEN 'unknown_value: policy_version'",
        f"WHEN NOT rlike(try_variant_get(v, '$.receipt', 'string'), r'{_RECEIPT}') THEN 'unknown_value: receipt'",
        "WHEN NOT try_variant_get(v, '$.confirmed', 'boolean') THEN 'review_required'",
    ]
    rows = _lines(spark, path, branches)
    found = {
        "receipt": ("receipt", "string"),
        "use_case": ("candidate.use_case", "string"),
        "engine": ("candidate.engine", "string"),
        "policy_version": ("candidate.policy_version", "string"),
        "fields": ("candidate.fields", "map<string,string>"),
        "routing": ("candidate.routing", f"struct<recipient_count:bigint,{sides[0]}:boolean,{sides[1]}:boolean>"),
    }
    columns = [F.expr(f"CASE WHEN refused IS NULL THEN try_variant_get(v, '$.{p}', '{t}') END").alias(n) for n, (p, t) in found.items()]
    rows = rows.select(*columns, "refused", "line")
    return rows.withColumn("policy_version", F.expr(f"CASE WHEN refused IS NULL THEN coalesce(policy_version, '{V.POLICY_VERSION}') END"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("refused IS NULL").drop("refused", "line")


def refused(rows: DataFrame) -> DataFrame:
    """Lines set aside, with the reason."""
    return rows.where("refused IS NOT NULL").select("line", "refused")
