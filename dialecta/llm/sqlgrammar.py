"""A SQL well-formedness check made of a lexer and local grammars.

A script becomes a *shape*, one character per token. Balanced brackets and
CASE..END are reduced from the inside out, each by a local grammar, until a
statement is a flat shape that one statement grammar accepts. All patterns are
possessive, so the work is linear in the length of the text.

Types, functions and options are not looked up: an unknown type is no error.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from dialecta.llm.textforms import canonical_glyphs

_FAMILY = {
    "redshift": "double", "snowflake": "double", "oracle": "double",
    "sqlserver": "bracket", "synapse": "bracket", "fabric_dw": "bracket",
    "databricks": "tick", "fabric_lakehouse": "tick", "bigquery": "tick",
}

#: Words with a place in the grammar. Reserved words are never names unless quoted; soft ones may be.
_RESERVED = (
    "select from where group order having union intersect except join on and or not null in is between like case when "
    "then else end with insert into values update set merge using delete create table as by distinct"
).split()
_SOFT = (
    "view primary foreign key references constraint unique check default all top limit offset fetch qualify recursive "
    "minus ilike rlike similar escape exists interval over filter within inner left right full outer cross natural lateral "
    "matched replace if distkey sortkey diststyle cluster partition partitioned clustered distribution comment options "
    "tblproperties location enforced identity encode collate generated always compound interleaved overwrite apply "
    "go alter drop truncate grant revoke call exec execute use declare begin commit rollback analyze vacuum copy refresh "
    "explain describe show optimize rename procedure function trigger asc desc nulls first last for add column connect start prior "
    "pivot unpivot output returning match_recognize autoincrement auto_increment persisted tran transaction loop while repeat proc"
).split()
_CODE = {w: chr(0x4E00 + i) for i, w in enumerate(_RESERVED + _SOFT)}
_SOFT_CHARS = "".join(_CODE[w] for w in _SOFT)
_CHAR = {"ident": "n", "chain": "q", "star": "m", "number": "0", "string": "s", "bad": "\x00"}


def _g(pattern: str) -> str:
    """Grammar text to a regular expression: <word> is a keyword, {X} a named part, ‹ and › are
    angle brackets of the script; blanks are layout."""
    while (m := re.search(r"\{([A-Z]+)\}", pattern)) is not None:
        pattern = pattern[: m.start()] + "(?:" + _PARTS[m.group(1)] + ")" + pattern[m.end() :]
    pattern = re.sub(r"<([a-z_]+)>", lambda m: _CODE[m.group(1)], pattern.replace(" ", ""))
    return pattern.replace("‹", "<").replace("›", ">")


_PARTS = {
    "N": f"[nq{_SOFT_CHARS}]",
    # after reduction: A argument list, Q subquery, C column definitions, D options, W window, K case,
    # v operators applied, c a test, e logic
    "TYPE": r"[nq<interval>]{1,4}+ A?+ (?:[n]{3})?+ (?:<with>[n]{2,3}+)?+ (?:\[\])*+",
    "CALL": r"{N}A(?:<within><group>[AW])?+(?:<filter>A)?+(?:[n]<nulls>)?+(?:<over>(?:[AW]|{N}))?+",
    "LITERALS": r"\[(?:[s0zA][nqs0zvceAKm,]*+)?\]",
    "PRIM": r"[-+~<prior>]*+ (?: v | <exists>Q | <interval>[s0]{N}(?:{N})?+ | {CALL} | (?:[n]|<all>)Q | {N}s | {VN} | [0sz]++ | [AQKm] | <null> | :[n0] | \? | {LITERALS} ) (?:\[[0snqvA]\]|{LITERALS}|::{TYPE}|:{N}|\.{N}|[n]{3}s)*+",
    "OP": r"\|\| | ‹› | [‹›!=]= | = | ‹ | › | [-+*/%&^~]",
    "TEST": r"(?:<is><not>?+(?:<null>|<distinct><from>{PRIM}|{N}) | <not>?+ (?: <in>[AQ] | <between>{PRIM}<and>{PRIM} | (?:<like>|<ilike>|<rlike>|<similar>{N}){PRIM}(?:<escape>s)?+ ))",
    "E": r"(?:[ec]|{PRIM})",
    "ITEM": r"(?:[*m](?:(?:<except>|<replace>|[n])A)*+|{E}(?:<as>(?:{N}|s)|[n])?+)",
    "SORT": r"{E}(?:<asc>|<desc>)?+(?:<nulls>(?:<first>|<last>))?+",
    "ARG": r"(?:\*|(?:{N}=›)?+{E}(?:[n]<nulls>)?+(?:<as>(?:{N}|s))?+)",
    "ALIAS": r"(?:<as>{N}|[n])A?+",
    "SOURCE": r"(?:<lateral>)?+(?:Q|{N}A?+|<table>A|A)(?:<match_recognize>M)?+{ALIAS}?+(?:<with>A)?+",
    "OUTPUT": r"(?:(?:<output>|<returning>){ITEM}(?:,{ITEM})*+(?:<into>{N}A?+)?+)?+",
    "CTES": r"(?:<with><recursive>?+{N}A?+<as>(?:<not>?+[n])?+Q(?:,{N}A?+<as>(?:<not>?+[n])?+Q)*+)?+",
    "JOINED": r"(?:(?:<natural>|<inner>|(?:<left>|<right>|<full>)[n]?+<outer>?+)?+<join>{SOURCE}(?:<on>{E}|<using>A) | (?:<cross>|<natural>)<join>{SOURCE} | (?:<cross>|<outer>)<apply>{SOURCE} | <lateral><view>[n]*+{CALL}{N}(?:<as>{N}(?:,{N})*+)?+ | (?:<pivot>|<unpivot>)(?:[n]<nulls>)?+A{ALIAS}?+ | ,{SOURCE})",
    "TABLES": r"{SOURCE}{JOINED}*+",
    "SELECT": r"<select>(?:<distinct>|<all>)?+(?:<top>(?:0|A)[n]?+)?+{ITEM}(?:,{ITEM})*+(?:<into>{N})?+(?:<from>{TABLES})?+(?:<where>{E})?+(?:<start><with>{E})?+(?:<connect><by>[n]?+{E})?+(?:<start><with>{E})?+(?:<group><by>(?:<all>|{KEY}(?:,{KEY})*+(?:<with>[n](?![n]))?+))?+(?:<having>{E})?+(?:<qualify>{E})?+",
    "KEY": r"(?:[n][n]A|{E})",
    "CORE": r"(?:{SELECT} | Q | <values>A(?:,A)*+)",
    "QUERY": r"{CTES}{CORE}(?:(?:<union>|<intersect>|<except>|<minus>)(?:<all>|<distinct>)?+{CORE})*+(?:<order><by>{SORT}(?:,{SORT})*+)?+(?:<limit>{E})?+(?:<offset>{E}[n]?+)?+(?:<fetch>(?:[n]|<first>)++0?+[n]*+)?+(?:<for>(?:<update>|[n])[n]?+A?+(?:,[n]A?+)*+)?+",
    "DEFAULT": r"(?:[-+]?0 | [sz] | <null> | {CALL} | {N}s? | A)(?:::{TYPE})*+",
    "COLOPT": r"<not><null> | <null> | <default>(?:{DEFAULT}) | <primary><key> | <not>?<enforced> | <unique> | <references>{N}A?+(?:<on>(?:<delete>|<update>)(?:<set>(?:<null>|<default>)|{N}{1,2}))*+ | <identity>A?+ | <check>A | <comment>s | <collate>{N} | <encode>{N} | <constraint>{N} | <generated>(?:<always>|<by><default>)<as>(?:<identity>)?+A?+ | <distkey> | <sortkey> | <options>[AD] | (?:<autoincrement>|<auto_increment>)A?+ | <persisted> | <with>[n][n]{N}A?+",
    "COLUMN": r"{N}(?:<as>A|{TYPE})(?:{COLOPT})*+",
    "RULE": r"(?:<constraint>{N})?+(?:<primary><key>{N}?+A | <unique><key>?+{N}?+A | <foreign><key>{N}?+A<references>{N}A?+(?:<on>(?:<delete>|<update>)(?:<set>(?:<null>|<default>)|{N}{1,2}))*+ | <check>A)(?:<not>?<enforced>|<not>?{N})*+",
    "OPTION": r"(?:v | <partition>{N}(?:<values>(?:[n]|<in>)*+A?+)?+[nqA0]*+ | {N}{1,4}+A?+(?:=(?:(?:{N}|0|s)A?|{LITERALS}))?+)",
    "SETS": r"[ve](?:,[ve])*+",
    "TABLEOPT": r"<using>{N} | <diststyle>(?:<key>|<all>|[n]) | <distkey>A | (?:<compound>|<interleaved>)?<sortkey>A | <cluster><by>(?:A|{N}(?:,{N})*+) | <partition><by>(?:{CALL}|A|{N}A?+|[n]A)(?:[AD]|[n]{1,2}0)?+ | <partitioned><by>A | <with>[AD] | <comment>s | v | <location>s | <options>[AD] | <tblproperties>[AD] | <on>{N}A?+",
    "DEFINE": r"<create>(?:<or>(?:<replace>|<alter>))?+",
    "EXISTS": r"(?:<if><not><exists>)?+",
    "WHEN": r"<when><not>?<matched>(?:<by>{N})?+(?:<and>{E})?+<then>(?:<update><set>{SETS}(?:<where>{E})?+|<insert>A?<values>A|<insert>[n*]|<update><set>\*|<delete>)",
}
#: Words that follow NOT or AND in other places than an expression, or open a clause, are no operand.
_PARTS["VN"] = "[nq" + "".join(_CODE[w] for w in _SOFT if w not in ("default", "matched", "enforced", "exists", "comment", "location", "top", "limit", "offset", "on", "prior", "for", "output", "returning")) + "]"
_STATEMENTS = (
    r"{DEFINE}[n]*+<table>{EXISTS}{N}(?:C(?:{TABLEOPT})*+(?:<as>{QUERY})?+ | (?:{TABLEOPT})*+<as>{QUERY} | <like>{N})",
    r"{DEFINE}[n]*+<view>{EXISTS}{N}[AC]?+(?:{TABLEOPT}|<with>[n])*+<as>{QUERY}(?:<with>[n]++)?+",
    r"{QUERY}",
    r"{CTES}<insert>(?:<into>|<overwrite>)?+<table>?+{N}A?+{OUTPUT}(?:{QUERY}|<default><values>){OUTPUT}",
    r"{CTES}<update>{N}{ALIAS}?+<set>{SETS}{OUTPUT}(?:<from>{TABLES})?+(?:<where>{E})?+{OUTPUT}",
    r"{CTES}<delete><from>?+{N}{ALIAS}?+{OUTPUT}(?:(?:<using>|<from>){TABLES})?+(?:<where>{E})?+{OUTPUT}",
    r"{CTES}<merge><into>?+{N}{ALIAS}?+<using>{SOURCE}<on>{E}(?:{WHEN})++{OUTPUT}",
    # commands are not parsed in full, but each has the parts that it cannot do without
    r"<alter>(?:<table>|{N}){1,2}{N}[^\x00]{2,}+", r"(?:<truncate>(?:<table>)?+|<drop>(?:<table>|{N}){1,2}(?:<if><exists>)?){N}A?+(?:,{N})*+(?:[n]|<on>{N})*+",
    r"(?:<grant>|<revoke>)[^\x00]+?[n]<group>?{N}[^\x00]*+", r"(?:<call>|<exec>|<execute>|<use>|<declare>|<refresh>|<describe>|<optimize>|<rename>|<comment>|<copy>)[^\x00]++", r"<set>{N}[^\x00]++",
    r"(?:<begin>|<commit>|<rollback>|<analyze>|<vacuum>|<show>)[^\x00]*+", r"<explain>[n]*+{QUERY}",
    r"<create>[n]++{N}[^\x00]*+",
)


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(_g(pattern))


_COMPOUND = _compiled(r"{PRIM}(?:{OP}{PRIM})++")
_TESTED = _compiled(r"{PRIM}{TEST}++")
_LOGIC = _compiled(r"<not>*+(?:c|{PRIM})(?:(?:<and>|<or>)<not>*+(?:c|{PRIM}))++ | <not>++(?!<null>)(?:c|{PRIM})")
_CASE = _compiled(r"{E}?+(?:<when>{E}<then>{E})++(?:<else>{E})?+")
_INNER_CASE = _compiled(r"<case>([^()<case><end>]*+)<end>")
_INNER = _compiled(r"\(([^()<case>]*+)\)")
_ARGS = _compiled(r"(?: (?:<distinct>|<all>)?+{ARG}(?:,{ARG})*+(?:<order><by>{SORT}(?:,{SORT})*+)?+(?:<limit>0)?+ | {N}?+{E}?+<from>{E}(?:<for>{E})?+ | {PRIM}<in>{E} | {E}<as>{TYPE} | {SORT}(?:,{SORT})*+ )?")
_SUBQUERY = _compiled("{QUERY}")
_COLUMNS = _compiled("(?:{RULE}|{COLUMN})(?:,(?:{RULE}|{COLUMN}))*+")
_OPTIONS = _compiled("{OPTION}(?:,{OPTION})*+")
#: The end of a window's frame; its AND is no logic.
_FRAME = _compiled(r"[n](?:<between>(?:{N}|0|<interval>s{N}?+){2,3}?<and>(?:{N}|0|<interval>s{N}?+){2,3}+|(?:{N}|0){2}+)$")
_PIVOTED = _compiled(r"(?:{CALL}(?:<as>?+[n])?+(?:,{CALL}(?:<as>?+[n])?+)*+|{N}|A)<for>c")
_PATTERN = _compiled(r"[nA|*+?]++")
_ROWS = _compiled(r"(?:<partition><by>{E}(?:,{E})*+)?+(?:<order><by>{SORT}(?:,{SORT})*+)?+[^\x00]*?[n]P[^\x00]*+")
_WINDOW = _compiled(r"[nq]?+(?:<partition><by>{E}(?:,{E})*+)?+(?:<order><by>{SORT}(?:,{SORT})*+)?+")
_STATEMENT = tuple(map(_compiled, _STATEMENTS))
_SELECT, _WITH, _VALUES, _CREATE, _FROM = (_CODE[w] for w in ("select", "with", "values", "create", "from"))
_ROUTINE = tuple(_CODE[w] for w in ("procedure", "proc", "function", "trigger"))


_GRANTS = _CODE["grant"] + _CODE["revoke"]
#: Nothing ends with these: a part is missing.
_DANGLING = frozenset(
    [_CODE[w] for w in "select from where group order having union intersect except join on and or not in is between like when then else insert into values update set merge using table create as by distinct add column with drop grant exec call".split()]
) | frozenset("-+/,=.(<>")
_STOPPED = re.compile("[" + "".join(c for c in _DANGLING if c not in "-+/,=.(<>" and c not in (_CODE["as"], _CODE["then"], _CODE["else"], _CODE["values"])) + "]" + _CODE["end"])


_ROUTINE_HEAD = _compiled("<create>(?:<or>(?:<replace>|<alter>))?+[n]{0,2}[" + "".join(_ROUTINE) + "]")
#: Words that open and close blocks of a routine's body.
_OPENED = _compiled("<begin>(?!<tran>|<transaction>)|(?<!<end>)<case>")
_CLOSED = _compiled("<end>(?!<if>|<loop>|<while>|<repeat>|<for>)")


def _is_routine(shape: str) -> bool:
    return _ROUTINE_HEAD.match(shape) is not None


def _breaks_off(shape: str) -> bool:
    return shape[-1] in _DANGLING and shape[-2:] != _CODE["default"] + _VALUES


def _open_blocks(shape: str) -> int:
    """Blocks that a piece of a routine's body opens and does not close."""
    if _CODE["begin"] not in shape and _CODE["end"] not in shape and _CODE["case"] not in shape:
        return 0
    return len(_OPENED.findall(shape)) - len(_CLOSED.findall(shape))


def _bare_select(shape: str) -> bool:
    """Whether the last SELECT names columns of tables but has no FROM: its end is missing."""
    at = shape.rfind(_SELECT)
    if at < 0:
        return False
    depth, names = 0, False
    for i in range(at, len(shape)):
        c = shape[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                break
        elif c == _FROM:
            return False
        elif c == "q" and shape[i + 1 : i + 2] != "(":
            names = True
    return names


_IN_TYPE = frozenset("nq,:0sADQ" + _SOFT_CHARS + _CODE["not"] + _CODE["null"] + _CODE["primary"])


def _generics(shape: str) -> str:
    """Types with parameters in angle brackets, nested to any depth, become one name each."""
    out, at, i = [], 0, shape.find("n<")
    while i >= 0:
        j, depth = i + 1, 0
        if i and (shape[i - 1] in "nq" or shape[i - 1] in _SOFT_CHARS):
            while j < len(shape):
                c = shape[j]
                depth += (c == "<") - (c == ">")
                if not depth or c not in _IN_TYPE and c not in "<>":
                    break
                j += 1
            if j < len(shape) and not depth:
                out.append(shape[at : i + 1])
                at = j + 1
        i = shape.find("n<", max(at, i + 1))
    return "".join([*out, shape[at:]])


def _compact(shape: str) -> str:
    """Applied operators, tests and logic become one character each."""
    if "<" in shape:
        shape = _generics(shape)
    return _LOGIC.sub("e", _TESTED.sub("c", _COMPOUND.sub("v", shape)))


@lru_cache(maxsize=20_000)
def _group(body: str) -> str:
    """The character for a balanced group without brackets inside; x00 if no local grammar takes it."""
    c = body[:1]
    if c == _SELECT or c == _WITH or c == _VALUES or c == "Q" and len(body) > 1:
        return "Q" if _SUBQUERY.fullmatch(_compact(body)) else "\x00"
    if body == "Q":
        return "Q"
    flat = _compact(body)
    if _ARGS.fullmatch(flat) or _PIVOTED.fullmatch(flat):
        return "A"
    if _COLUMNS.fullmatch(_generics(body)):
        return "C"
    if _WINDOW.fullmatch(_compact(_FRAME.sub("", body))):
        return "W"
    if _OPTIONS.fullmatch(flat):
        return "D"
    return "P" if _PATTERN.fullmatch(body) else "M" if _ROWS.fullmatch(body) else "\x00"


def _case(m: re.Match) -> str:
    return "K" if _CASE.fullmatch(_compact(m.group(1))) else "\x00"


@lru_cache(maxsize=20_000)
def shape_ok(shape: str) -> bool:
    """Whether one statement's shape (no semicolon) is complete and well formed."""
    if "\x00" in shape:
        return False
    if _is_routine(shape):
        return shape.count("(") == shape.count(")") and len(shape) > 5 and not _breaks_off(shape)
    if _breaks_off(shape) or shape[0] not in _GRANTS and _bare_select(shape):
        return False
    case = _CODE["case"]
    while True:
        before = shape
        if case in shape:
            shape = _INNER_CASE.sub(_case, shape)
        if "(" in shape:
            shape = _INNER.sub(lambda m: _group(m.group(1)), shape)
        if "\x00" in shape:
            return False
        if shape == before:
            break
    shape = _compact(shape)
    return any(p.fullmatch(shape) for p in _STATEMENT)


_IDENT = r"[^\W\d][\w$#]*|[@#]+\w+"
_QUOTES = {"double": r'"(?:[^"]|"")+"', "bracket": r'"(?:[^"]|"")+"|\[[^\[\]\n]+\]', "tick": r"`[^`\n]+`"}
_QUOTES["any"] = r'"(?:[^"]|"")+"|\[[^\[\]\n]+\]|`[^`\n]+`'
_STRINGS = dict.fromkeys(_QUOTES, r"'(?:[^']|'')*'")
_STRINGS["tick"] = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\""""
#: A line that a merge or a patch left behind, where code stands.
_LEFTOVER = r"(?:(?<=\n)|\A)(?:[<>|=]{7}(?![<>|=])|@@ -\d|\+\+\+ |diff --git |[-+](?=[ \t]{2,}\S))[^\n]*"


def _lexer(family: str) -> re.Pattern:
    name = f"(?:{_QUOTES[family]}|{_IDENT})"
    return re.compile(
        rf"/\*.*?\*/|--[^\n]*|\$\$.*?\$\$|{_STRINGS[family]}|{_LEFTOVER}|{name}(?:\s*\.\s*(?:{name}|\*))*(?:\s*\.)?|\$?\d+(?:\.\d*)?(?:e[-+]?\d+)?(?!\w)|\.\d+|[^\s]",
        re.S,
    )


_LEXERS = {f: _lexer(f) for f in _QUOTES}
_PUNCT = frozenset("(),;+-*/%=<>!|:?&^~[]")


class _Classes(dict):
    """Token to shape character, by its first and last characters where it is no known word."""

    def __init__(self, family: str):
        super().__init__(_CODE)
        self.update({c: c for c in _PUNCT})
        self.tick = family == "tick"

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c == "'" or c == '"' and self.tick:
            return "\x00" if len(t) == 1 else "s" if c == "'" else "z"  # z is never a name
        if c == "$" and t[1:2].isdigit():
            return "0"
        if c == "$":
            return "s" if len(t) > 3 else "\x00"
        if c.isdigit() or c == "." and len(t) > 1:
            return "0"
        if c in "-/":
            return "" if t[:2] in ("--", "/*") else "\x00"
        if c in "<>|=+" or t.startswith(("@@ -", "diff --git ")):
            return "\x00"
        if c in '"[`' and len(t) == 1 or t[-1] == ".":
            return "\x00"
        if c.isalpha() or c in '_@#"[`':
            if t[-1] == "*" and "." in t:
                return "m"
            return "q" if "." in _QUOTED.sub("", t) and not t.endswith((".nextval", ".currval")) else "n"
        return "\x00"


_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|`[^`]*`')
_CLASSES = {f: _Classes(f) for f in _QUOTES}
def family_of(dialect: str | None) -> str:
    """Quoting family of a dialect label; case and blanks do not matter, an unknown label allows every quote."""
    return _FAMILY.get((dialect or "").strip().lower(), "any")


def shapes(sql: str, family: str) -> list[str]:
    """Shape of each statement of a script; look-alike characters count as what they look like."""
    classes = _CLASSES[family]
    whole = "".join([classes[t] for t in _LEXERS[family].findall(canonical_glyphs(sql).lower())])
    return [s for s in whole.split(";") if s]


class Judged(NamedTuple):
    """What the local grammars say of one statement."""

    ok: bool  # can be parsed
    some: bool  # is not empty
    routine: bool  # creates a routine
    clean: bool  # as part of a routine's body: nothing foreign, nothing broken off
    blocks: int  # blocks opened and not closed


_EMPTY = Judged(True, False, False, True, 0)


def statement(sql: str, family: str) -> Judged:
    """The judgement on the text between two statement ends."""
    parts = shapes(sql, family)
    if not parts:
        return _EMPTY
    clean = not any("\x00" in p or _breaks_off(p) or _STOPPED.search(p) for p in parts)
    return Judged(all(map(shape_ok, parts)), True, _is_routine(parts[0]), clean, sum(map(_open_blocks, parts)))


def script_ok(judged: list[Judged]) -> bool:
    """Whether a script of these statements can be parsed.

    From the first routine on, what follows is its body: statements of procedural languages are not
    parsed, but nothing foreign may stand there, nothing may break off, and every block must be closed.
    """
    first = next((k for k, j in enumerate(judged) if j.routine), len(judged))
    return all(j.ok for j in judged[: first + 1]) and all(j.clean for j in judged[first:]) and not sum(j.blocks for j in judged[first:])


# --- chunks as maps of lexer states -----------------------------

#: code, literal, "quoted", `quoted`, [quoted], line comment, block comment, $$ body
STATES = "CSDTBLKE"
_END = {"S": "'", "D": '"', "T": "`", "B": "]", "L": "\n", "K": "*/", "E": "$$"}
_OPEN = {"'": "S", '"': "D", "`": "T", "[": "B", "-": "L", "/": "K", "$": "E"}
_UNSAFE_END = "-/*\\'\"`[]$"
CHUNK = 1_024
#: Longest line that can end a batch of statements (GO, or / in Oracle); no chunk begins or ends inside one.
MARGIN = 24
_BATCH_LINE = {"bracket": "go", "double": "/", "any": "go"}


def _scanner(family: str) -> re.Pattern:
    body = r"'(?:[^'\\]|\\.)*+(?P<s>')?" if family == "tick" else r"'[^']*+(?P<s>')?"
    dq = r'"(?:[^"\\]|\\.)*+(?P<d>")?' if family == "tick" else r'"[^"]*+(?P<d>")?'
    br = r"|\[[^\]]*+(?P<b>\])?" if family in ("bracket", "any") else ""
    line = rf"(?P<line>(?:(?<=[\n;])|\A)[ \t]{{0,8}}{_BATCH_LINE[family]}[ \t]{{0,8}}\r?(?=\n|\Z))|" if family in _BATCH_LINE else ""
    return re.compile(
        rf"{line}{body}|{dq}|`[^`]*+(?P<t>`)?{br}|--[^\n]*+(?P<l>\n)?|/\*(?:[^*]|\*(?!/))*+(?P<k>\*/)?|(?<![\w$#])\$\$(?:[^$]|\$(?!\$))*+(?P<e>\$\$)?|[();]",
        re.S | re.I,
    )


_SCANNERS = {f: _scanner(f) for f in _QUOTES}


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of about ``size`` characters; no piece ends inside a mark of several characters,
    nor near a line that could end a batch unless it ends with that line."""
    size = max(size, MARGIN)
    out, at = [], 0
    while at < len(text):
        end = at + size
        while end < len(text):
            cut = text.rfind("\n", max(at, end - MARGIN), end)
            if cut < 0:
                cut = text.find("\n", end, end + MARGIN)
            if cut >= 0:
                end = cut + 1
                break
            if len(text) - end <= MARGIN:
                end = len(text)
            elif text[end - 1] in _UNSAFE_END or text[end] == "$":
                end += 1
            else:
                break
        out.append(text[at:end])
        at = end
    return out


class Cut(NamedTuple):
    """A chunk entered in one state: exit state, (begin, end) of what ends its statements, net and lowest bracket depth."""

    exit: str
    marks: list[tuple[int, int]]
    net: int
    low: int


def cuts(chunk: str, family: str, state: str) -> Cut:
    at = 0
    if state != "C":
        end = chunk.find(_END[state])
        if state in "SD" and family == "tick":
            m = re.match(r"(?:[^\\%s]|\\.)*+" % _END[state], chunk, re.S)
            end = m.end() if m.end() < len(chunk) else -1
        if end < 0:
            return Cut(state, [], 0, 0)
        at = end + len(_END[state])
    marks, net, low = [], 0, 0
    for m in _SCANNERS[family].finditer(chunk, at):
        c = m.group(0)[0]
        if c == ";" or m.lastgroup == "line":
            marks.append(m.span())
        elif c == "(":
            net += 1
        elif c == ")":
            net -= 1
            low = min(low, net)
        elif m.end() == len(chunk) and m.lastgroup is None:
            return Cut(_OPEN[c], marks, net, low)
    return Cut("C", marks, net, low)


def state_map(chunk: str, family: str, states: str = STATES) -> dict:
    """What the chunk does to every entry state: exits, statement ends, bracket summary."""
    each = [cuts(chunk, family, s) for s in states]
    return {"exits": "".join(e.exit for e in each), "ends": [len(e.marks) for e in each], "net": [e.net for e in each], "low": [e.low for e in each]}


def identity(states: str = STATES) -> dict:
    return {"exits": states, "ends": [0] * len(states), "net": [0] * len(states), "low": [0] * len(states)}


def compose(a: dict, b: dict) -> dict:
    """The map of chunk a followed by chunk b (which knows all states); associative."""
    j = [STATES.index(x) for x in a["exits"]]
    return {
        "exits": "".join([b["exits"][k] for k in j]),
        "ends": [n + b["ends"][k] for n, k in zip(a["ends"], j)],
        "net": [n + b["net"][k] for n, k in zip(a["net"], j)],
        "low": [min(lo, n + b["low"][k]) for lo, n, k in zip(a["low"], a["net"], j)],
    }


def closed(whole: dict) -> bool:
    """Whether a text of this map, entered as code, ends outside literals with its brackets balanced."""
    return whole["exits"][0] in "CL" and whole["net"][0] == 0 and whole["low"][0] == 0


class Run:
    """Consecutive chunks of a text, mapped one by one and reduced to one map.

    The run that begins a text is entered as code, so only that state's row is kept of its map.
    """

    def __init__(self, text: str, family: str, first: bool, size: int = CHUNK):
        self.text, self.family = text, family
        self.states = "C" if first else STATES
        self.parts = chunks(text, size) or [""]
        self.each = [{s: cuts(p, family, s) for s in (self.states if k == 0 else STATES)} for k, p in enumerate(self.parts)]
        self.map = identity(self.states)
        for k, e in enumerate(self.each):
            own = self.states if k == 0 else STATES
            m = {"exits": "".join([e[s].exit for s in own]), "ends": [len(e[s].marks) for s in own], "net": [e[s].net for s in own], "low": [e[s].low for s in own]}
            self.map = m if k == 0 else compose(self.map, m)

    def pieces(self, state: str = "C") -> list[str]:
        """The run, entered in ``state``, cut at the statement ends."""
        out, begin, at = [], 0, 0
        for p, e in zip(self.parts, self.each):
            c = e[state]
            for a, b in c.marks:
                out.append(self.text[begin : at + a])
                begin = at + b
            state, at = c.exit, at + len(p)
        return [*out, self.text[begin:]]


def is_well_formed(sql: str, dialect: str | None, size: int = CHUNK) -> bool:
    """Whether every statement of the script can be parsed in the dialect; a script without statements can."""
    family = family_of(dialect)
    run = Run(canonical_glyphs(sql), family, True, size)
    return closed(run.map) and script_ok([statement(p, family) for p in run.pieces()])
