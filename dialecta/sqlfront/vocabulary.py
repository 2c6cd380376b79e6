"""What each dialect knows: functions, clauses and type names, and a check of emitted text against it.

The tables state public vendor behaviour. A name that no table mentions (a
user's own function, say) is not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

from dialecta.sqlfront.dialects import SPARKISH, TSQL, dialect
from dialecta.sqlfront.lexer import OP, WORD, Group, Token, tokens, tree

_LETTERS = {"R": ("redshift",), "S": ("snowflake",), "T": TSQL, "O": ("oracle",), "B": ("bigquery",), "P": SPARKISH}

#: Functions by the dialects that have them (R Redshift, S Snowflake, T the T-SQL family, O Oracle, B BigQuery, P the Spark dialects).
_FUNCTIONS = (
    ("RSOP", "NVL NVL2 ADD_MONTHS MONTHS_BETWEEN DECODE TO_CHAR TO_DATE TO_TIMESTAMP TO_NUMBER REGEXP_COUNT LISTAGG MEDIAN"),
    ("RSOBP", "LENGTH CEIL LAST_DAY INITCAP REGEXP_REPLACE REGEXP_SUBSTR REGEXP_INSTR LPAD RPAD SUBSTR TRUNC CHR"),
    ("OBP", "INSTR"), ("RB", "STRPOS"), ("RSP", "POSITION SPLIT_PART CONVERT_TIMEZONE DATE_PART"), ("RSTP", "CHARINDEX LEN DATEADD DATEDIFF"), ("P", "LOCATE MAKE_DATE DATE_FORMAT NOW COLLECT_LIST COLLECT_SET EXPLODE FROM_UTC_TIMESTAMP TO_UTC_TIMESTAMP UUID GET_JSON_OBJECT"),
    ("RSTBP", "SUBSTRING TRY_CAST"), ("RTBP", "CEILING"), ("BP", "DATE_ADD DATE_SUB DATE_DIFF IF"), ("RSBP", "DATE_TRUNC REPEAT MD5"), ("TP", "DATEPART"), ("STP", "YEAR MONTH DAY CHAR"), ("ST", "DATEFROMPARTS"),
    ("B", "TIMESTAMP_DIFF TIMESTAMP_ADD TIMESTAMP_SUB TIMESTAMP_TRUNC DATETIME_DIFF DATETIME_ADD DATETIME_TRUNC SAFE_CAST FORMAT_DATE FORMAT_TIMESTAMP PARSE_DATE PARSE_TIMESTAMP GENERATE_UUID COUNTIF LOGICAL_OR LOGICAL_AND SAFE_DIVIDE UNNEST GENERATE_ARRAY JSON_EXTRACT_SCALAR"),
    ("R", "DATE_PART_YEAR FNV_HASH"), ("RST", "GETDATE"), ("T", "DATETRUNC DATENAME EOMONTH SYSDATETIME SYSUTCDATETIME GETUTCDATE IIF ISNULL STRING_SPLIT STUFF REPLICATE HASHBYTES NEWID COUNT_BIG DATALENGTH CONVERT TRY_CONVERT"),
    ("SBP", "IFNULL SPLIT ARRAY_AGG PARSE_JSON"), ("S", "IFF STRTOK UUID_STRING BOOLOR_AGG BOOLAND_AGG DIV0 HLL FLATTEN GET_PATH OBJECT_CONSTRUCT DATE_FROM_PARTS"), ("SP", "ZEROIFNULL NULLIFZERO TO_VARCHAR COUNT_IF"), ("TBP", "STRING_AGG"), ("TB", "FORMAT"),
    ("O", "STANDARD_HASH SYS_GUID FROM_TZ NUMTODSINTERVAL"), ("RP", "BOOL_OR BOOL_AND"), ("RSO", "RATIO_TO_REPORT"), ("STOBP", "APPROX_COUNT_DISTINCT"), ("RS", "JSON_EXTRACT_PATH_TEXT"), ("TOB", "JSON_VALUE"), ("SOP", "REGEXP_LIKE"), ("RSTOP", "EXP"),
)
FUNCTIONS: dict[str, frozenset[str]] = {n: frozenset(d for x in letters for d in _LETTERS[x]) for letters, names in _FUNCTIONS for n in names.split()}

#: Words of clauses by the dialects that have them.
_WORDS = (
    ("RS", "TOP"), ("RSBP", "LIMIT RECURSIVE"), ("RSP", "ILIKE"), ("SP", "RLIKE"), ("O", "ROWNUM"), ("OS", "DUAL CONNECT MATCH_RECOGNIZE NEXTVAL"), ("T", "NOLOCK"), ("TO", "APPLY"), ("SOPR", "LATERAL"), ("SO", "SAMPLE"), ("STBP", "TABLESAMPLE"),
    ("R", "DISTKEY SORTKEY DISTSTYLE ENCODE SIMILAR"), ("P", "TBLPROPERTIES"), ("RSOBP", "NATURAL NULLS"), ("OSRP", "MINUS"), ("OR", "SYSDATE"),
)
WORDS: dict[str, frozenset[str]] = {n: frozenset(d for x in letters for d in _LETTERS[x]) for letters, names in _WORDS for n in names.split()}
WORDS["TOP"] |= frozenset(TSQL)
WORDS["QUALIFY"] = frozenset(("redshift", "snowflake", "bigquery", "databricks"))
WORDS["COLUMNSTORE"] = frozenset(("sqlserver", "synapse"))
WORDS["DISTRIBUTION"] = frozenset(("synapse",))

#: Type names that are no type elsewhere.
_TYPES = (("O", "VARCHAR2 NVARCHAR2 CLOB"), ("OS", "NUMBER"), ("SP", "VARIANT"), ("R", "SUPER"), ("T", "DATETIME2 UNIQUEIDENTIFIER MONEY BIT DATETIMEOFFSET"), ("B", "INT64 FLOAT64 BIGNUMERIC"), ("BPS", "STRING"))
TYPES: dict[str, frozenset[str]] = {n: frozenset(d for x in letters for d in _LETTERS[x]) for letters, names in _TYPES for n in names.split()}


def _word_counts(t: Token, before, after) -> bool:
    """Whether a word stands where it has its clause's meaning (it may be a name elsewhere)."""
    w = t.upper
    if w == "TOP":
        return before is not None and before.is_("SELECT", "DISTINCT", "ALL")
    if w in ("LIMIT", "RECURSIVE", "QUALIFY", "ILIKE", "RLIKE", "MINUS", "NULLS", "NATURAL"):
        return before is not None and after is not None and not (after.kind == OP and after.text in (",", ".", "=", ")"))
    if w == "DUAL":
        return before is not None and before.is_("FROM")
    if w == "CONNECT":
        return after is not None and after.is_("BY")
    if w == "APPLY":
        return before is not None and before.is_("CROSS", "OUTER")
    if w in ("SAMPLE", "MATCH_RECOGNIZE"):
        return isinstance(after, Group)
    if w == "NEXTVAL":
        return before is not None and before.text == "."
    if w == "DISTRIBUTION":
        return after is not None and after.text == "="
    if w == "SIMILAR":
        return after is not None and after.is_("TO")
    if w == "SYSDATE":
        return not isinstance(after, Group) and not (before is not None and before.text == ".")
    if w == "ENCODE":
        return after is not None and after.kind == WORD
    return True


def _strange(items: list, d: str) -> Iterator[tuple[str, str]]:
    """(code, what) of everything in a bracket tree that a dialect does not know."""
    for i, t in enumerate(items):
        before, after = items[i - 1] if i else None, items[i + 1] if i + 1 < len(items) else None
        if isinstance(t, Group):
            yield from _strange(t.items, d)
        elif t.kind == OP and t.text == "::" and d not in ("redshift", "snowflake", *SPARKISH):
            yield "CAST_OPERATOR", "the operator ::"
        elif t.kind == WORD and not (before is not None and before.kind == OP and before.text == "." and t.upper != "NEXTVAL"):
            w = t.upper
            typed = before is not None and (before.is_("AS") or before.text == "::")
            if w in TYPES and typed and d not in TYPES[w]:
                yield f"TYPE_{w}", f"the type {w}"
            elif w in FUNCTIONS and isinstance(after, Group) and not typed and d not in FUNCTIONS[w] and not (before is not None and before.is_("INTO", "TABLE", "VIEW", "FROM", "JOIN", "UPDATE", "REFERENCES", "ON")):
                yield f"FUNCTION_{w}", f"the function {w}"
            elif w in WORDS and d not in WORDS[w] and _word_counts(t, before, after):
                yield f"CLAUSE_{w}", f"{w}"


def unknown_to(sql: str, target: str) -> list[tuple[str, str]]:
    """(code, what) of all syntax in a text that the target does not know, once each; literals, quoted names and comments do not count."""
    flat = tokens(sql, dialect(target))
    try:
        items = tree(flat)
    except ValueError:
        items = flat
    return list(dict.fromkeys(_strange(items, dialect(target).name)))
