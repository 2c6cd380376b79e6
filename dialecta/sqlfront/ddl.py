"""DDL of nine dialects to object specifications and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from dialecta.sqlfront.dialects import Dialect, dialect
from dialecta.sqlfront.front import Finding
from dialecta.sqlfront.lexer import NUMBER, OP, QUOTED, STRING, WORD, Group, plain, split_at, tree
from dialecta.sqlfront.script import Statement, statements
from dialecta.sqlfront.types import DataType, UnknownType, parse_type, split_fields, to_spark


@dataclass
class Column:
    name: str
    type: DataType
    nullable: bool = True
    default: str | None = None
    identity: tuple[int, int] | None = None
    generated: str | None = None
    comment: str | None = None
    encode: str | None = None
    collate: str | None = None


@dataclass
class Constraint:
    kind: str  # primary_key, unique, foreign_key, check
    columns: list[str]
    name: str | None = None
    ref_table: list[str] | None = None
    ref_columns: list[str] = field(default_factory=list)
    expression: str | None = None
    enforced: bool = True


@dataclass
class TableSpec:
    """A table as declared; ``query`` is the SELECT of a CREATE TABLE AS."""

    name: list[str]
    columns: list[Column] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    distribution: tuple[str, list[str]] | None = None  # hash, round_robin, replicate, auto
    sort_key: list[str] = field(default_factory=list)
    sort_kind: str = "compound"
    cluster_by: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    location: str | None = None
    comment: str | None = None
    query: str | None = None
    or_replace: bool = False
    if_not_exists: bool = False
    temporary: bool = False
    external: bool = False

    def schema(self) -> T.StructType:
        """The Spark schema; what Spark has no place for stays in field metadata."""
        out = []
        keys = {c for k in self.constraints if k.kind == "primary_key" for c in k.columns}
        for c in self.columns:
            meta = {"source_type": c.type.written}
            meta |= {k: v for k, v in (("default", c.default), ("comment", c.comment), ("encode", c.encode), ("generated", c.generated)) if v is not None}
            if c.identity:
                meta["identity"] = list(c.identity)
            if c.type.length and c.type.generic in ("CHAR", "VARCHAR"):
                meta["length"] = c.type.length
            out.append(T.StructField(c.name, to_spark(c.type), c.nullable and c.name not in keys, meta))
        return T.StructType(out)


@dataclass
class ViewSpec:
    name: list[str]
    query: str
    columns: list[str] = field(default_factory=list)
    materialized: bool = False
    or_replace: bool = False


@dataclass
class RoutineSpec:
    """A procedure or function: header parts and the body as text."""

    kind: str
    name: list[str]
    parameters: str
    body: str
    returns: str | None = None
    language: str | None = None


@dataclass
class TriggerSpec:
    """A trigger's header and its body as text."""

    name: list[str]
    timing: str  # BEFORE, AFTER or INSTEAD OF
    events: list[str]
    table: list[str]
    each_row: bool
    condition: str | None
    body: str
    kind: str = "trigger"


class _Reader:
    """A cursor over the items of one statement."""

    def __init__(self, items: list, d: Dialect):
        self.items, self.d, self.i = items, d, 0

    def peek(self, k: int = 0):
        return self.items[self.i + k] if self.i + k < len(self.items) else None

    def take(self, *words: str) -> bool:
        """Skips the words if they stand here."""
        if all((t := self.peek(k)) is not None and t.is_(w) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        t = self.peek()
        if t is not None and t.kind == OP and t.text == text:
            self.i += 1
            return True
        return False

    def group(self) -> Group | None:
        t = self.peek()
        if isinstance(t, Group):
            self.i += 1
            return t
        return None

    def name(self) -> list[str]:
        parts = []
        while (t := self.peek()) is not None and t.kind in (WORD, QUOTED):
            parts += t.value.split(".") if t.kind == QUOTED and t.text[0] == "`" else [t.value]
            self.i += 1
            if not self.op("."):
                break
        return parts

    def word(self) -> str | None:
        t = self.peek()
        if t is not None and t.kind in (WORD, QUOTED, STRING, NUMBER):
            self.i += 1
            return t.value
        return None


def names(g: Group | None) -> list[str]:
    """Column names of a bracketed list; expressions stay as text."""
    out = []
    for item in split_at(g.items, ",") if g else []:
        plain_name = [t for t in item if not t.is_("ASC", "DESC")]
        out.append(plain_name[0].value if len(plain_name) == 1 and not isinstance(plain_name[0], Group) else plain(plain_name).strip())
    return out


_OPTION_WORDS = ("NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "IDENTITY", "AUTOINCREMENT", "GENERATED", "COMMENT", "ENCODE", "COLLATE", "CONSTRAINT", "DISTKEY", "SORTKEY", "OPTIONS", "ENABLE", "ENFORCED", "MASKED", "AS", "FOREIGN", "TAG")


def _column(items: list, spec: TableSpec, d: Dialect, notes: list[Finding]) -> None:
    r = _Reader(items, d)
    column = r.word()
    start, depth = r.i, 0
    while (t := r.peek()) is not None and (depth > 0 or isinstance(t, Group) or t.upper not in _OPTION_WORDS):
        depth += {"<": 1, ">": -1}.get(t.text, 0) if t.kind == OP else 0
        r.i += 1
    written = plain(items[start : r.i]).strip()
    try:
        kind = parse_type(written, d)
    except (UnknownType, ValueError):
        kind = DataType("TEXT", written=written)
        notes.append(Finding("UNKNOWN_TYPE", "error", f"column {column}: type {written or '(none)'} is not known; text is used"))
    c = Column(column, kind)
    label = None
    while r.peek() is not None:
        if r.take("NOT", "NULL"):
            c.nullable = False
        elif r.take("NOT", "ENFORCED") or r.take("NULL") or r.take("ENABLE") or r.take("ENFORCED"):
            pass
        elif r.take("CONSTRAINT"):
            label = r.word()
        elif r.take("DEFAULT"):
            begin = r.i
            r.i += 1
            while (t := r.peek()) is not None and (isinstance(t, Group) or t.upper not in _OPTION_WORDS):
                r.i += 1
            c.default = plain(items[begin : r.i]).strip()
        elif r.take("PRIMARY", "KEY"):
            r.take("NONCLUSTERED") or r.take("CLUSTERED")
            spec.constraints.append(Constraint("primary_key", [column], label))
        elif r.take("UNIQUE"):
            spec.constraints.append(Constraint("unique", [column], label))
        elif r.take("REFERENCES"):
            ref = r.name()
            spec.constraints.append(Constraint("foreign_key", [column], label, ref, names(r.group())))
        elif r.take("CHECK"):
            g = r.group()
            spec.constraints.append(Constraint("check", [column], label, expression=plain(g.items).strip() if g else ""))
        elif r.take("IDENTITY") or r.take("AUTOINCREMENT"):
            g = r.group()
            n = [int(t.text) for t in g.items if t.kind == NUMBER] if g else []
            c.identity = (n[0], n[1]) if len(n) == 2 else (1, 1)
        elif r.take("GENERATED"):
            r.take("ALWAYS") or r.take("BY", "DEFAULT")
            r.take("ON", "NULL")
            r.take("AS")
            if r.take("IDENTITY"):
                g = r.group()
                n = [int(t.text) for t in g.items if t.kind == NUMBER] if g else []
                c.identity = (n[0], n[1]) if len(n) == 2 else (n[0], 1) if n else (1, 1)
            else:
                g = r.group()
                c.generated = plain(g.items).strip() if g else None
        elif r.take("AS"):
            g = r.group()
            c.generated = plain(g.items).strip() if g else None
        elif r.take("COMMENT"):
            c.comment = r.word()
        elif r.take("ENCODE"):
            c.encode = r.word()
        elif r.take("COLLATE"):
            c.collate = r.word()
        elif r.take("DISTKEY"):
            spec.distribution = ("hash", [column])
        elif r.take("SORTKEY"):
            spec.sort_key.append(column)
        elif r.take("OPTIONS"):
            g = r.group()
            for item in split_at(g.items, ",") if g else []:
                if item and item[0].value.lower() == "description":
                    c.comment = item[-1].value
        else:
            notes.append(Finding("COLUMN_OPTION_IGNORED", "warning", f"column {column}: {r.peek().text} is not kept"))
            r.i += 1
    spec.columns.append(c)


def _rule(items: list, spec: TableSpec, d: Dialect) -> bool:
    """A table constraint; False if the items are a column."""
    r = _Reader(items, d)
    label = None
    if r.take("CONSTRAINT"):
        label = r.word()
    if r.take("PRIMARY", "KEY"):
        r.take("NONCLUSTERED") or r.take("CLUSTERED")
        k = Constraint("primary_key", names(r.group()), label)
    elif r.peek() is not None and r.peek().is_("UNIQUE"):
        r.i += 1
        r.take("KEY")
        r.take("NONCLUSTERED") or r.take("CLUSTERED")
        k = Constraint("unique", names(r.group()), label)
    elif r.take("FOREIGN", "KEY"):
        cols = names(r.group())
        r.take("REFERENCES")
        k = Constraint("foreign_key", cols, label, r.name(), names(r.group()))
    elif r.peek() is not None and r.peek().is_("CHECK") and isinstance(r.peek(1), Group):
        r.i += 1
        k = Constraint("check", [], label, expression=plain(r.group().items).strip())
    else:
        return False
    k.enforced = not any(a.is_("NOT") and b.is_("ENFORCED") for a, b in zip(items, items[1:]))
    spec.constraints.append(k)
    return True


def parse_table(s: Statement, d: Dialect) -> tuple[TableSpec, list[Finding]]:
    """A CREATE TABLE statement."""
    notes: list[Finding] = []
    r = _Reader(tree(s.tokens), d)
    spec = TableSpec([])
    r.take("CREATE")
    spec.or_replace = r.take("OR", "REPLACE")
    while r.peek() is not None and not r.take("TABLE"):
        w = r.peek().upper
        spec.temporary |= w in ("TEMP", "TEMPORARY", "VOLATILE")
        spec.external |= w == "EXTERNAL"
        r.i += 1
    spec.if_not_exists = r.take("IF", "NOT", "EXISTS")
    spec.name = r.name()
    if spec.name and spec.name[-1].startswith("#"):
        spec.temporary = True
    g = r.group()
    if g is not None:
        for item in split_fields(g.items):
            if item and not _rule(item, spec, d):
                _column(item, spec, d, notes)
    while r.peek() is not None:
        _option(r, spec, notes)
    for col in spec.columns:
        col.nullable = col.nullable and not any(k.kind == "primary_key" and col.name in k.columns for k in spec.constraints)
    return spec, notes


def _listed(r: _Reader) -> list[str]:
    g = r.group()
    if g is not None:
        return names(g)
    out = [".".join(r.name())]
    if isinstance(r.peek(), Group):
        out[-1] += "(" + plain(r.group().items) + ")"
    while r.op(","):
        out.append(".".join(r.name()))
    return out


def _option(r: _Reader, spec: TableSpec, notes: list[Finding]) -> None:
    if r.take("DISTSTYLE"):
        style = (r.word() or "").lower()
        if style != "key":
            spec.distribution = ({"even": "round_robin", "all": "replicate"}.get(style, style), [])
    elif r.take("DISTKEY"):
        spec.distribution = ("hash", names(r.group()))
    elif r.take("COMPOUND") or r.take("INTERLEAVED"):
        spec.sort_kind = r.items[r.i - 1].text.lower()
    elif r.take("SORTKEY"):
        spec.sort_key = names(r.group())
    elif r.take("CLUSTER", "BY"):
        spec.cluster_by = _listed(r)
    elif r.take("PARTITION", "BY") or r.take("PARTITIONED", "BY"):
        r.take("RANGE") or r.take("LIST") or r.take("HASH")
        spec.partition_by = [n.split(" ")[0] if " " in n and "(" not in n else n for n in _listed(r)]
        if isinstance(r.peek(), Group):
            spec.properties["partitions"] = plain(r.group().items).strip()
    elif r.take("USING"):
        spec.properties["using"] = r.word() or ""
    elif r.take("LOCATION"):
        r.op("=")
        spec.location = r.word()
    elif r.take("COMMENT"):
        r.op("=")
        r.take("ON")
        spec.comment = r.word()
    elif r.take("WITH"):
        g = r.group()
        for item in split_at(g.items, ",") if g else []:
            _with_option(item, spec, r.d)
    elif r.take("TBLPROPERTIES") or r.take("OPTIONS"):
        g = r.group()
        for item in split_at(g.items, ",") if g else []:
            pair = split_at(item, "=")
            if len(pair) == 2:
                spec.properties[pair[0][0].value] = plain(pair[1]).strip().strip("'\"")
                if pair[0][0].value.lower() == "description":
                    spec.comment = pair[1][0].value
    elif r.take("AS"):
        spec.query = plain(r.items[r.i :]).strip()
        r.i = len(r.items)
    else:
        t = r.peek()
        if not isinstance(t, Group):
            notes.append(Finding("TABLE_OPTION_IGNORED", "info", f"{t.text} is not kept"))
        r.i += 1


def _with_option(item: list, spec: TableSpec, d: Dialect) -> None:
    if not item:
        return
    if item[0].is_("DISTRIBUTION"):
        kind = next((t.value.lower() for t in item[1:] if t.kind == WORD), "")
        spec.distribution = (kind, names(next((t for t in item if isinstance(t, Group)), None)))
    elif item[0].is_("CLUSTER"):
        spec.cluster_by = names(next((t for t in item if isinstance(t, Group)), None))
    elif item[0].is_("PARTITION"):
        g = next((t for t in item if isinstance(t, Group)), None)
        if g and g.items:
            spec.partition_by = [g.items[0].value]
    else:
        spec.properties[item[0].value.lower()] = plain(item).strip()


def parse_view(s: Statement, d: Dialect) -> ViewSpec:
    """A CREATE VIEW or CREATE MATERIALIZED VIEW statement; the query stays text of its dialect."""
    items = tree(s.tokens)
    r = _Reader(items, d)
    r.take("CREATE")
    replace = r.take("OR", "REPLACE")
    while r.peek() is not None and not r.take("VIEW"):
        r.i += 1
    r.take("IF", "NOT", "EXISTS")
    name = r.name()
    g = r.group()
    cols = names(g) if g else []
    while r.peek() is not None and not r.peek().is_("AS"):
        r.i += 1
    r.take("AS")
    body = items[r.i :]
    for k in range(len(body) - 2):
        if body[k].is_("WITH") and (body[k + 1].is_("NO") and body[k + 2].is_("SCHEMA") or body[k + 1].is_("CHECK")):
            body = body[:k]
            break
    return ViewSpec(name, plain(body).strip(), cols, s.kind == "materialized_view", replace)


def parse_routine(s: Statement, d: Dialect) -> RoutineSpec:
    """The header of a procedure or function; the body is not interpreted."""
    items = tree(s.tokens)
    r = _Reader(items, d)
    while r.peek() is not None and not (r.peek().is_("PROCEDURE", "PROC", "FUNCTION")):
        r.i += 1
    r.i += 1
    name = r.name()
    g = r.group()
    params = plain(g.items).strip() if g else ""
    begin = r.i
    returns = language = None
    body_at = None
    while (t := r.peek()) is not None:
        if t.is_("RETURNS", "RETURN") and returns is None and body_at is None:
            k = r.i + 1
            while k < len(items) and not items[k].is_("AS", "IS", "LANGUAGE", "BEGIN", "RETURN", "STABLE", "IMMUTABLE", "VOLATILE"):
                k += 1
            returns = plain(items[r.i + 1 : k]).strip()
            r.i = k
            continue
        if t.is_("LANGUAGE") and r.peek(1) is not None:
            language = r.peek(1).value
        if t.is_("AS", "IS", "BEGIN") and body_at is None:
            body_at = r.i + (0 if t.is_("BEGIN") else 1)
        r.i += 1
    if d.tsql and g is None and body_at is not None and begin < body_at and items[begin].text.startswith("@"):  # parameters without brackets
        stop = next((k for k in range(begin, body_at) if items[k].is_("WITH", "RETURNS")), body_at - items[body_at - 1].is_("AS", "IS"))
        params = plain(items[begin:stop]).strip()
    body = items[body_at if body_at is not None else begin :]
    text = body[0].value if body and body[0].kind == STRING else plain(body).strip()
    return RoutineSpec(s.kind, name, params, text.strip(), returns, language)


def parse_trigger(s: Statement, d: Dialect) -> TriggerSpec:
    """A CREATE TRIGGER statement, with the table before or after the events."""
    r = _Reader(tree(s.tokens), d)
    while not r.take("TRIGGER"):
        r.i += 1
    t = TriggerSpec(r.name(), "AFTER", [], [], False, None, "")
    begin = len(r.items)
    while r.peek() is not None:
        if r.take("INSTEAD", "OF"):
            t.timing = "INSTEAD OF"
        elif r.take("BEFORE") or r.take("AFTER"):
            t.timing = r.items[r.i - 1].upper
        elif r.take("ON"):
            t.table = r.name()
        elif r.take("FOR", "EACH", "ROW"):
            t.each_row = True
        elif r.peek().is_("INSERT", "UPDATE", "DELETE"):
            t.events.append(r.peek().upper)
            r.i += 1
            if r.take("OF"):
                t.events[-1] += " OF " + ", ".join(_listed(r))
        elif r.take("WHEN"):
            g = r.group()
            t.condition = plain(g.items).strip() if g else None
        elif r.peek().is_("AS", "BEGIN", "DECLARE", "EXECUTE", "CALL"):
            begin = r.i + (1 if r.peek().is_("AS") else 0)
            break
        else:
            r.i += 1
    t.body = plain(r.items[begin:]).strip()
    return t


def parse_script(sql: str, source: str) -> list[tuple[Statement, object, list[Finding]]]:
    """Every statement of a script with its specification (None for queries and unsupported kinds)."""
    d = dialect(source)
    out = []
    for s in statements(sql, d):
        try:
            if s.kind == "table":
                spec, notes = parse_table(s, d)
                out.append((s, spec, notes))
            elif s.kind in ("view", "materialized_view"):
                out.append((s, parse_view(s, d), []))
            elif s.kind == "trigger":
                out.append((s, parse_trigger(s, d), []))
            elif s.kind in ("procedure", "function"):
                out.append((s, parse_routine(s, d), []))
            else:
                out.append((s, None, []))
        except (ValueError, IndexError, AttributeError) as e:
            out.append((s, None, [Finding("PARSE_ERROR", "error", f"{s.kind}: {e}")]))
    return out
