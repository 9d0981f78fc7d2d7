"""The supplied tables, and the message, text, log and review views derived from them.

A view is a list of expressions over one table, written so that Spark and a reference database read
them alike; ``{array}``, ``{slice}``, ``{seconds}`` and ``{string}`` stand for the few spellings that
differ. All views are projections: they need no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.running import local_micros

SPARK = {
    "array": "array",
    "slice": "slice",
    "seconds": lambda ts, n: f"timestampadd(SECOND, cast({n} AS int), {ts})",
}
DUCKDB = {
    "array": "list_value",
    "slice": "list_slice",
    "seconds": lambda ts, n: f"({ts} + to_seconds({n}))",
}

# Domains counted as inside: the nations of the first region.
INTERNAL_DOMAINS = [f"nation{k}.example.com" for k in (0, 5, 10, 15, 20)]

_PERSON = (
    "CASE {} % 4 WHEN 0 THEN 'Greta Holm' WHEN 1 THEN 'Bruno Keller' "
    "WHEN 2 THEN 'Chiara Conti' ELSE 'Dmitri Orlov' END"
)


def _digits(value: str, width: int) -> str:
    return f"lpad(cast({value} AS string), {width}, '0')"


def message_view(dialect: dict) -> dict[str, str]:
    """One message per order."""
    customer = "'customer.' || o_custkey"
    host = "'nation' || ({} % 25) || '.example.com'"
    sender = (
        f"CASE WHEN o_custkey % 53 = 0 THEN {customer} WHEN o_custkey % 7 = 0 "
        f"THEN {customer} || '@' || upper({host.format('o_custkey')}) "
        f"ELSE {customer} || '@' || {host.format('o_custkey')} END"
    )
    supplier = "'supplier.' || (o_orderkey % {m}) || '@' || " + host.format("(o_orderkey % {m})")
    recipients = (
        f"{dialect['slice']}({dialect['array']}({supplier.format(m=97)}, {supplier.format(m=55)}, "
        f"{supplier.format(m=20)}), 1, cast(o_orderkey % 4 AS int))"
    )
    subject = (
        "'Order ' || o_orderkey || ' for nation_' || (o_custkey % 25) || "
        f"CASE WHEN o_orderkey % 3 = 0 THEN ' via Supplier#' || {_digits('o_orderkey % 1000', 9)} "
        "ELSE '' END"
    )
    clerk = "'nation.' || (o_custkey % 25) || '@' || " + host.format("o_custkey")
    body = (
        "CASE substr(o_orderpriority, 1, 1) "
        f"WHEN '1' THEN 'Dear ' || {_PERSON.format('o_custkey')} || ',' || chr(10) || "
        f"'please call +1 (415) 555-' || {_digits('o_orderkey % 10000', 4)} || ' about order ' || "
        f"o_orderkey || '.' || chr(10) || 'Regards,' || chr(10) || {_PERSON.format('o_orderkey')} "
        f"WHEN '2' THEN 'Account 4' || {_digits('o_custkey', 11)} || ' was charged to DE' || "
        f"{_digits('o_custkey % 100', 2)} || {_digits('o_orderkey', 18)} || "
        "'. See https://shop.example.com/orders/' || o_orderkey || ' today.' "
        "WHEN '3' THEN 'Shipped on ' || substr(cast(o_orderdate AS string), 1, 10) || ' to ' || "
        "(100 + o_custkey % 900) || ' Harbor Street, Unit ' || (1 + o_orderkey % 40) || '.' "
        f"WHEN '4' THEN 'api_key = key' || {_digits('o_orderkey % 5000', 8)} || '; write to ' || {clerk} || "
        f"' or to ' || {clerk} || '.' "
        "ELSE 'No details to report.' END"
    )
    return {
        "message_id": "o_orderkey",
        "direction": "CASE o_orderstatus WHEN 'O' THEN 'outbound' WHEN 'F' THEN 'inbound' ELSE 'internal' END",
        "sender": sender,
        "recipients": recipients,
        "subject": subject,
        "body": body,
        "sent_at": dialect["seconds"]("o_orderdate", "o_orderkey % 86400"),
    }


def attempt_view(dialect: dict) -> dict[str, str]:
    """One review attempt per event; six events in a row share a receipt."""
    return {
        "event_id": "event_id",
        "occurred_at": "ts",
        "action": "CASE event_type WHEN 'view' THEN 'prepared' WHEN 'error' THEN 'discarded' ELSE 'exported' END",
        "token": "'t' || (event_id - event_id % 6)",
        "fingerprint": "CASE WHEN event_type <> 'view' AND event_id % 4 = 0 THEN 'f1' ELSE 'f0' END",
        "confirmed": "CASE WHEN event_type = 'signup' AND user_id % 3 = 0 THEN CAST(NULL AS boolean) "
        "ELSE event_type <> 'signup' OR user_id % 3 = 1 END",
        "use_case": "CASE user_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'ai_prompt' ELSE 'support_ticket' END",
        "engine": "'heuristic'",
        "span_count": "event_id % 5",
        "manual_mask_count": "user_id % 3",
    }


def log_view(dialect: dict) -> dict[str, str]:
    """A pasted log per event. Its credential range follows from how it is put together."""
    eol = "CASE event_id % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END"
    quoting = "CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '> ' ELSE '> > ' END"
    credential = (
        "CASE event_type "
        f"WHEN 'view' THEN 'Authorization: Bearer key ' || event_id || {eol} || {quoting} || '  more ' || user_id "
        "WHEN 'click' THEN 'Set-Cookie: session=s' || event_id || '; Path=/' "
        f"WHEN 'purchase' THEN 'password: |' || {eol} || {quoting} || '  first ' || user_id || {eol} || {quoting} || '  last' "
        "WHEN 'signup' THEN '\"api_key\": \"a ' || chr(92) || '\"' || event_id || chr(92) || '\" b\"' "
        "ELSE '' END"
    )
    harmless = f"CASE WHEN event_type = 'error' THEN 'password_reset: |' || {eol} || {quoting} || '  link' ELSE '' END"
    lead = f"'😀 request ' || event_id || {eol} || {quoting}"
    return {
        "event_id": "event_id",
        "text": f"{lead} || {credential} || {harmless} || {eol} || {quoting} || 'Accept: text/plain'",
        "lead_length": f"length({lead})",
        "credential_length": f"length({credential})",
    }


def pasted_view(dialect: dict) -> dict[str, str]:
    """A second pasted log per event: other headers, key blocks, quotes over two lines or never closed."""
    eol = "CASE event_id % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END"
    quoting = "CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '> ' ELSE '> > ' END"
    credential = (
        "CASE event_type "
        "WHEN 'view' THEN 'Cookie: session=s' || event_id "
        "WHEN 'click' THEN 'Proxy-Authorization: Basic ' || event_id "
        f"WHEN 'purchase' THEN '-----BEGIN RSA PRIVATE KEY-----' || {eol} || {quoting} || 'MIIE' || event_id || {eol} || "
        f"{quoting} || '-----END RSA PRIVATE KEY-----' "
        "WHEN 'signup' THEN 'password = \"never closed ' || event_id "
        f"ELSE 'secret: \"line one ' || event_id || {eol} || {quoting} || 'line two\"' END"
    )
    lead = f"'entry ' || event_id || {eol} || {quoting}"
    return {
        "event_id": "event_id",
        "text": f"{lead} || {credential} || {eol} || {quoting} || 'Accept: text/plain'",
        "lead_length": f"length({lead})",
        "credential_length": f"length({credential})",
    }


def view_sql(view: dict[str, str], table: str) -> str:
    columns = ", ".join(f"{expr} AS {name}" for name, expr in view.items())
    return f"SELECT {columns} FROM {table}"


# The text table: documents, page addresses with markup, chat turns and message bodies.
TEXT_PARTS = [
    ("documents", "'d:' || doc_id", "'document'", "text"),
    ("pages", "'p:' || page_id", "'page'", "url || ' ' || html"),
    ("conversations", "'c:' || conv_id || ':' || turn", "'chat'", "text"),
    ("messages", "'m:' || message_id", "'message'", "body"),
]


def texts_sql(messages: str = "messages") -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS text_id, {kind} AS kind, {text} AS text "
        f"FROM {messages if table == 'messages' else table}"
        for table, key, kind, text in TEXT_PARTS
    )


class Tables:
    """Readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _view(self, view: dict[str, str], table: str, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        return deal(self.read(table)).select(*[F.expr(e).alias(n) for n, e in view.items()])

    def messages(self, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """``deal`` may spread the rows of the table before the longer ones of the view are made of them."""
        return self._view(message_view(SPARK), "orders", deal)

    def attempts(self) -> DataFrame:
        return self._view(attempt_view(SPARK), "events")

    def logs(self) -> DataFrame:
        return self._view(log_view(SPARK), "events")

    def pasted(self) -> DataFrame:
        return self._view(pasted_view(SPARK), "events")

    def _stream(self, table: str) -> DataFrame:
        """The rows of a table as they arrive, be it one file or a folder of part files.

        A stream takes a single file only by way of a pattern.
        """
        return self.spark.readStream.schema(self.read(table).schema).parquet(f"{self.path(table)[:-1]}[t]")

    def message_stream(self, parts: int | None = None) -> DataFrame:
        """Messages as they arrive; with ``parts`` each micro-batch is dealt out to as many tasks, as a file
        that a stream takes in is read by one."""
        view = message_view(SPARK)
        rows = self._stream("orders")
        rows = rows if parts is None else rows.repartition(parts)
        rows = rows.select(*[F.expr(e).alias(n) for n, e in view.items()])
        return rows.withColumn("sent_at", F.expr(f"timestamp_micros({local_micros('sent_at')})"))

    def attempt_stream(self, *actions: str) -> DataFrame:
        view = attempt_view(SPARK)
        rows = self._stream("events").select(*[F.expr(e).alias(n) for n, e in view.items()])
        rows = rows.withColumn("occurred_at", F.expr(f"timestamp_micros({local_micros('occurred_at')})"))
        return rows.where(F.col("action").isin(*actions))

    def texts(self) -> DataFrame:
        parts = []
        for table, key, kind, text in TEXT_PARTS:
            rows = self.messages() if table == "messages" else self.read(table)
            parts.append(
                rows.select(F.expr(key).alias("text_id"), F.expr(kind).alias("kind"), F.expr(text).alias("text"))
            )
        first, *rest = parts
        for part in rest:
            first = first.unionAll(part)
        return first
