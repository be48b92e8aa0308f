"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtide.functions.text import SPACE_CHARS, WORD_BODY, WS_BODY
from voxtide.sources.tables import CTES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return fn

    return add


def with_inputs(sql: str) -> str:
    """Put the input tables a statement names in front of it."""
    body = sql.strip()
    text, used = body, []
    for n in reversed(CTES):  # a table may name those before it
        if re.search(rf"\b{n}\b", text):
            used.insert(0, n)
            text += CTES[n]
    ctes = [f"{n} as ({CTES[n]})" for n in used]
    if not ctes:
        return body
    if re.match(r"with\s+recursive\b", body, re.I):
        return "with recursive " + ", ".join(ctes) + ", " + re.sub(r"^with\s+recursive\s+", "", body, flags=re.I)
    if re.match(r"with\b", body, re.I):
        return "with " + ", ".join(ctes) + ", " + re.sub(r"^with\s+", "", body, flags=re.I)
    return "with " + ", ".join(ctes) + " " + body


# ---- SQL spellings of the text helpers, for the checking side ----------------

D_WS, D_NWS = f"[{WS_BODY}]", f"[^{WS_BODY}]"
D_WORD = f"[{WORD_BODY}]"


def d_trim(x: str) -> str:
    return f"trim({x}, '{SPACE_CHARS}')"


def d_collapse(x: str) -> str:
    return d_trim(f"regexp_replace({x}, '{D_WS}+', ' ', 'g')")


def d_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def d_words(x: str) -> str:
    return d_count(x, f"{D_NWS}+")


def d_fuzzy(x: str) -> str:
    return f"md5({d_collapse(f"regexp_replace(lower({x}), '[^{WORD_BODY}{WS_BODY}]', '', 'g')")})"


def d_any(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def d_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def d_values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"
