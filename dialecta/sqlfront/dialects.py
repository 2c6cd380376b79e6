"""The nine dialects and what a reader must know about each (public vendor behaviour)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """How texts of a dialect are read and written."""

    name: str
    quote: str  # opening quote used when writing identifiers
    string_quotes: str  # characters that delimit string literals
    ident_quotes: str  # opening characters that delimit identifiers
    nulls_high: bool  # nulls sort after all values by default
    plus_concats: bool
    int_division: bool  # integer / integer truncates
    backslash: bool  # backslash escapes in string literals
    tsql: bool = False


_ALL = (
    Dialect("redshift", '"', "'", '"', True, False, True, False),
    Dialect("snowflake", '"', "'", '"', True, False, False, True),
    Dialect("sqlserver", "[", "'", '["', False, True, True, False, True),
    Dialect("synapse", "[", "'", '["', False, True, True, False, True),
    Dialect("fabric_dw", "[", "'", '["', False, True, True, False, True),
    Dialect("fabric_lakehouse", "`", "'\"", "`", False, False, False, True),
    Dialect("databricks", "`", "'\"", "`", False, False, False, True),
    Dialect("oracle", '"', "'", '"', True, False, False, False),
    Dialect("bigquery", "`", "'\"", "`", False, False, False, True),
)
DIALECTS: dict[str, Dialect] = {d.name: d for d in _ALL}
TSQL = tuple(d.name for d in _ALL if d.tsql)
SPARKISH = ("databricks", "fabric_lakehouse")


def dialect(name: str) -> Dialect:
    """A dialect by its label; case, blanks and hyphens do not matter."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    if key not in DIALECTS:
        raise ValueError(f"unknown dialect {name!r}; known are {', '.join(DIALECTS)}")
    return DIALECTS[key]


def quoted(parts: list[str], d: Dialect) -> str:
    """A qualified name in a dialect's quotes; variables of a script (${name}, {{name}}) stay as they are."""
    close = {"[": "]"}.get(d.quote, d.quote)
    return ".".join(p if p[:2] in ("${", "{{") else d.quote + p.replace(close, close * 2) + close for p in parts)
