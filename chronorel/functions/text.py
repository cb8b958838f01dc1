"""Text, value and rendering functions: identifiers on the driver, cells as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a task.
STOP_WORDS = frozenset("the for and with from task predict prediction next value target entity table column same using".split())


def singular_forms(token: str) -> list[str]:
    """The token, then what is left without a plural ending, if enough is."""
    return [token] + [token[: -len(end)] for end, least in (("es", 5), ("s", 4)) if token.endswith(end) and len(token) >= least]


def identifier_tokens(name: str) -> list[str]:
    """Lower-case alphanumeric parts of at least 2 characters, with their singular forms."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name.lower()) if len(p) >= 2]
    return list(dict.fromkeys(f for p in parts for f in singular_forms(p)))


def task_tokens(text: str) -> list[str]:
    """Words of a task text of at least 3 characters that are no stop words, with their singular forms."""
    said = [w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) >= 3 and w not in STOP_WORDS]
    return list(dict.fromkeys(f for w in said for f in singular_forms(w)))


def identifier_tokens_col(c: Column) -> Column:
    """``identifier_tokens`` as an expression."""
    parts = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda p: F.length(p) >= 2)
    cut = lambda p, n: F.substring(p, F.lit(1), F.length(p) - n)
    forms = lambda p: F.concat(
        F.array(p),
        F.when(p.endswith("es") & (F.length(p) > 4), F.array(cut(p, 2))).otherwise(F.array().cast("array<string>")),
        F.when(p.endswith("s") & (F.length(p) > 3), F.array(cut(p, 1))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.flatten(F.transform(parts, forms)))


#: Parts of column names that may give a label away.
LEAKAGE = ("label", "target", "future", "leak", "outcome")


def leakage_name(c: Column) -> Column:
    return F.lower(c).rlike("|".join(LEAKAGE))


def column_role(name: Column, is_pk: Column, is_fk: Column, is_time: Column, numeric: Column) -> Column:
    """Role of a column from keys, type and name."""
    low = F.lower(name)
    return (
        F.when(is_pk, "primary_key").when(is_fk, "foreign_key").when(is_time, "timestamp")
        .when(low.endswith("id") | low.endswith("key"), "identifier")
        .when(low.rlike("status|type|segment|priority|flag|category|class"), "category")
        .when(low.rlike("name|title|comment|description|text"), "text")
        .when(numeric, "measure")
        .otherwise("category")
    )


def table_role(name: str, has_time: bool, n_fks: int) -> str:
    """``static`` without a time column; else ``event`` (several parents or a plural name) or ``entity``."""
    if not has_time:
        return "static"
    return "event" if n_fks >= 2 or name.endswith("s") else "entity"


def number_text(c: Column) -> Column:
    """Compact text of a number: integers plain, very large or small as exponent, else up to 4 decimals."""
    size = F.abs(c)
    trimmed = F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", "")
    return (
        F.when(c.isNull() | F.isnan(c.cast("double")), "")
        .when(c == F.floor(c.cast("double")), F.when(size < 1e15, F.format_string("%d", F.floor(c.cast("double")).cast("long"))).otherwise(F.format_string("%.3e", c.cast("double"))))
        .when((size >= 1e6) | (size < 1e-3), F.format_string("%.3e", c.cast("double")))
        .otherwise(trimmed)
    )


def cell_text(c: Column, kind: str, width: int = 80) -> Column:
    """Text of a cell: missing as '', numbers compact, dates as days, long text cut."""
    if kind in ("float", "double", "tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return number_text(c)
    if kind.startswith(("timestamp", "date")):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s)


def day_text(c: Column) -> Column:
    """Day of a time, ``static`` without one."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("static"))


def row_text(table: str, time: Column, cells: list[tuple[str, Column, str]], most: int = 6) -> Column:
    """``[day] table: k=v, ...`` of the first ``most`` columns, skipping missing values."""
    parts = [F.when(cell_text(c, k) != "", F.concat(F.lit(f"{n}="), cell_text(c, k))) for n, c, k in cells[:most]]
    return F.concat(F.lit("["), day_text(time), F.lit(f"] {table}: "), F.concat_ws(", ", *parts))


def signature(c: Column, kind: str) -> Column:
    """Comparable form of a value: text trimmed and lower-cased, numbers to 3 decimals, times as text."""
    if kind == "string":
        return F.lower(F.trim(c))
    if kind in ("float", "double"):
        return F.format_string("%.3f", F.round(c, 3))
    return c.cast("string")


def outer_call(expr: str) -> tuple[str, str] | None:
    """(function, argument) where one call spans the whole expression, else None."""
    call = re.fullmatch(r"([A-Za-z_]\w*)\s*\((.*)\)", expr.strip(), re.DOTALL)
    if not call:
        return None
    open_now = 0
    for sign in re.findall(r"[()]", call[2]):
        open_now += 1 if sign == "(" else -1
        if open_now < 0:
            return None
    return None if open_now else (call[1], call[2].strip())


def parse_feature(name: str, root: str, tables: set[str]) -> tuple[tuple[str, ...], str]:
    """(tables from the root on, description) of a feature name such as ``root.SUM(child.col)``.

    A leading ``root.`` (or another plain name and a dot) is no part of the
    expression.  Only names in ``tables`` count as tables, each once.  A bare
    table as argument stands for its rows; what is left is the column.
    """
    head, dot, tail = name.strip().partition(".")
    rest = tail if dot and "(" not in head else name.strip()
    path, calls, within = [root], "", ""
    while True:
        if call := outer_call(rest):
            calls, rest = calls + f"{call[0].lower()} of ", call[1]
        elif (split := rest.partition("."))[0] in tables and split[1]:
            path.append(split[0])
            within, rest = f" within {split[0]}{within}", split[2].strip()
        else:
            break
    path += [p for p in rest.split(".")[:-1] if p in tables]
    if rest in tables:
        path += [rest] if calls else []
        leaf = f"rows in {rest}"
    else:
        leaf = rest.replace("_", " ") or "feature"
    return tuple(dict.fromkeys(path)), calls + leaf + within


def first_number(c: Column, default: float = 0.0) -> Column:
    """First number in a text, or the default."""
    return F.coalesce(F.regexp_extract(c, r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double"), F.lit(default))


def path_id(c: Column) -> Column:
    """Canonical path id ``p000123``: the number after a p, else one that stands alone; null for texts without either."""
    number = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.concat(F.lit("p"), F.lpad(F.coalesce(number(r"(?i)p\s*0*([0-9]{1,6})"), number(r"\b([0-9]{1,6})\b")), 6, "0"))


def numeric_map(m: Column) -> Column:
    """Finite numbers of a feature map; text that is no number goes."""
    as_double = F.transform_values(m, lambda _, v: v.try_cast("double"))
    return F.map_filter(as_double, lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def quote(name: str) -> str:
    """An identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def find_json(text: str) -> dict | None:
    """The longest JSON object in a text, or None."""
    best, size = None, -1
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text[at:])
            if isinstance(value, dict) and end > size:
                best, size = value, end
            at = text.find("{", at + max(end, 1))
        except ValueError:
            at = text.find("{", at + 1)
    return best


def json_safe(value):
    """Keys as text, dates as ISO text, NaN as None, through nested values."""
    if isinstance(value, dict):
        return {"|".join(map(str, k)) if isinstance(k, tuple) else str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value
