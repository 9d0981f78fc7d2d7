"""Mailbox headers: how many recipients, and which side of the organisation they are on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S

# Runs of what stands in an atom; loops are possessive, so a header is read once from left to right.
_ATOM = r"""[^\x00-\x20\x7f()<>@,;:\\".\[\]]++"""
_DOTTED = rf"{_ATOM}(?:\.{_ATOM})*+"
_QUOTED = r'"(?:[^"\\]|\\.)*+"'
_COMMENT = r"\([^()\\]*+\)"
_SPACE = rf"(?:[ \t]|{_COMMENT})*+"
# The local part is ASCII.
_ASCII = r"""[^\x00-\x20\x7f-\x{10FFFF}()<>@,;:\\".\[\]]++"""
_LOCAL = rf"""(?:{_ASCII}(?:\.{_ASCII})*+|"(?:[^"\\\x7f-\x{{10FFFF}}]|\\[\x00-\x7e])*+")"""
_ADDRESS = rf"{_LOCAL}@{_DOTTED}"
_NAME = rf"(?:(?:{_QUOTED}|{_ATOM}|[ \t.])*+)"
# A last bracket may be left open.
_MAILBOX = rf"{_SPACE}(?:{_NAME}{_SPACE}<[ \t]*+{_ADDRESS}[ \t]*+(?:>|\z)|{_ADDRESS}){_SPACE}"
_LIST = rf"\A{_MAILBOX}(?:,{_MAILBOX})*+\z"
_DOMAIN = rf"@({_DOTTED})"


def with_domains(df: DataFrame, header: Column, out: str) -> DataFrame:
    """Lower-cased domains of a comma-separated mailbox header; null when it is malformed.

    Display names, quoted names and local parts, comments and domains in any script are understood.
    Groups, nested comments, routes and bracketed network addresses are not: such a header gives null, so
    ``prepare`` sets its request aside with a reason.
    """
    # Only quoted names and comments may hold a control character, and only they are taken out. Lower case leaves
    # addresses as long and as they are split, as what stands around a domain is neither a letter nor joins two.
    quoted = F.contains(header, F.lit('"')) | F.contains(header, F.lit("("))
    usable = F.rlike(header, F.lit(_LIST)) & ~(quoted & F.rlike(header, F.lit(r"[\r\n\x00]")))
    bare = F.when(quoted, F.regexp_replace(header, F.lit(f"{_QUOTED}|{_COMMENT}"), F.lit(""))).otherwise(header)
    return df.withColumn(out, F.when(usable, F.regexp_extract_all(F.lower(bare), F.lit(_DOMAIN), F.lit(1))))


def routing(sender_domains: str, recipient_domains: str, internal_domains: list[str]) -> str:
    """Routing summary of a message, or null when a header is not acceptable."""
    known = "array(" + ", ".join(S.text_literal(d.lower()) for d in internal_domains) + ")"
    if not internal_domains:
        known = "cast(array() AS array<string>)"
    every = f"size(array_except({recipient_domains}, {known})) = 0"
    some = f"arrays_overlap({recipient_domains}, {known})"
    summary = (
        f"named_struct('recipient_count', size({recipient_domains}), "
        f"'crosses_boundary', CASE WHEN array_contains({known}, get({sender_domains}, 0)) THEN NOT {every} ELSE {some} END, "
        f"'all_recipients_internal', {every})"
    )
    return (
        f"CASE WHEN size({sender_domains}) = 1 AND size({recipient_domains}) >= 1 "
        f"THEN {summary} END"
    )
