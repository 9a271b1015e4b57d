"""The value of each kind of fact, put together from its parts. operators.report.parsed takes them apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symgrid.functions.text import combine_route, controller_route


def route(method: Column, prefix: Column, template: Column, class_name: Column) -> Column:
    return F.concat_ws(" ", F.upper(method), controller_route(combine_route(prefix, template), class_name))


def config(key: Column, pattern: Column) -> Column:
    return F.concat_ws("|", key, F.coalesce(pattern, F.lit("unknown")))


def db_table(schema: Column, table: Column, origin: Column) -> Column:
    return F.concat_ws("|", F.concat_ws(".", schema, table), origin)


def registration(service: Column, implementation: Column, lifetime: Column) -> Column:
    return F.concat(service, F.lit(" → "), implementation, F.lit("|"), lifetime)


def middleware(name: Column, position: Column, terminal: Column) -> Column:
    return F.concat(name, F.lit("|pos:"), position.cast("string"), F.when(terminal, "|terminal").otherwise(""))


def piped(head: Column, tail: Column) -> Column:
    """Exceptions, log templates and retry policies."""
    return F.concat_ws("|", head, tail)


def razor(prop: Column, type_name: Column) -> Column:
    return F.concat_ws(": ", prop, type_name)
