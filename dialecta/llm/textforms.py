"""Per-text forms used by the look-alike, copy and near-duplicate operators.

Everything here is a pure function of one string, so it can run inside an
Arrow batch on any executor.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

# Characters of other scripts that are drawn like a Latin
# letter (a public fact of the Unicode character charts).
LOOKALIKE_LETTERS = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ρ": "p", "Ӏ": "I",
    # Armenian, and Latin letters outside the basic alphabet
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "ɡ": "g", "ɑ": "a",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲥ": "c",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Roman numerals of one letter
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    # punctuation
    "‐": "-", "‑": "-", "−": "-", "⁄": "/", "∕": "/", "∗": "*", "∶": ":", "․": ".", "ǀ": "|", "∣": "|",
}

#: Blanks of every width; each stands for one ordinary blank.
WIDE_BLANKS = "               　"

#: Inclusive ranges of characters that leave no mark on the screen.
INVISIBLE_RANGES = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x7F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)

#: Forms of another width and typographic ligatures: their compatibility form looks the same.
COMPATIBILITY_RANGES = ((0xFB00, 0xFB06), (0xFF01, 0xFF9F), (0xFFE0, 0xFFE6), (0x212A, 0x212B), (0x2126, 0x2126))


def _glyph_table() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOKALIKE_LETTERS.items()}
    table |= {ord(c): " " for c in WIDE_BLANKS}
    for lo, hi in COMPATIBILITY_RANGES:
        table |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(lo, hi + 1)}
    for lo, hi in INVISIBLE_RANGES[:-1]:
        table |= dict.fromkeys(range(lo, hi + 1), "")
    lo, hi = INVISIBLE_RANGES[-1]
    table |= dict.fromkeys([*range(lo, lo + 0x80), *range(0xE0100, 0xE01F0)], "")
    return table


_GLYPHS = _glyph_table()

def _canonical(s: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_GLYPHS))


def _unstable_ranges() -> list[tuple[int, int]]:
    """Characters that fail the quick check, as ranges: those whose own canonical form is another, and those that a
    neighbour may join (marks, and the conjoining letters of Hangul). Planes above the basic one are few in texts
    and always looked at."""
    out: list[tuple[int, int]] = []
    for c in range(0x7F, 0x10000):
        if 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000:  # Hangul syllables are stable; surrogates stand for higher planes
            bad = c >= 0xD800
        else:
            x = chr(c)
            bad = unicodedata.category(x)[0] == "M" or 0x1100 <= c < 0x1200 or _canonical(x) != x
        if bad:
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


_UNSTABLE = r"\x00-\x08\x0e-\x1f" + _class(_unstable_ranges())
#: Quick check (Java): a text without such a character is already in canonical form. ASCII is told apart before the long
#: class is looked through; Java sees higher planes as whole characters.
UNSTABLE_CHAR = r"[\x00-\x08\x0e-\x1f]|[\x7f-\x{10ffff}&&[" + _class(_unstable_ranges()).replace("\\ud800-\\udfff", "") + r"\x{10000}-\x{10ffff}]]"
#: An unstable segment together with the one stable character before it, which a combining mark may join.
_UNSTABLE_SEGMENT = re.compile(f"[^{_UNSTABLE}\U00010000-\U0010ffff]?[{_UNSTABLE}\U00010000-\U0010ffff]+")


def canonical_glyphs(text: str) -> str:
    """The one text that stands for all texts drawn the same way.

    Only unstable segments are normalised and spliced back; the stable rest
    is copied unchanged. Runs are idempotent.
    """
    return text if text.isascii() and text.isprintable() else _UNSTABLE_SEGMENT.sub(lambda m: _canonical(m.group(0)), text)


_KEEP_APART = {0x212A: "", 0x212B: "", 0x2126: ""}  # lower() would merge them with k, å, ω
_COPY_TOKEN = re.compile(
    r"/\*.*?(?:\*/|\Z)|--[^\n]*|'(?:[^']|'')*(?:'|\Z)|[(),;]|[^\x00-\x20!-/:-@\[-^`{-~\x7f]+", re.S
)
_COPY_WORD = re.compile(r"[^\x00-\x20!-/:-@\[-^`{-~\x7f]+")


def copy_form(sql: str) -> str:
    """Words of a script in a form that ignores layout: case, ordinary white
    space, ASCII punctuation, the order of column definitions and of select
    items. Words in comments and literals count. Characters outside ASCII are
    parts of words, so texts that only look alike keep different forms.
    """
    low = sql.lower() if sql.isascii() else sql.translate(_KEEP_APART).lower()
    # a frame is [kind, words of the open item, finished items]; kinds: p(lain), c(olumns), s(elect list)
    stack: list[list] = [["p", [], None]]
    top = stack[0]
    words = top[1]
    create = 0  # 1: CREATE seen at the start of a statement, 2: CREATE .. TABLE, waiting for its list
    start = True

    def close() -> None:
        nonlocal top, words
        kind, rest, items = stack.pop()
        top = stack[-1]
        words = top[1]
        if items is not None:
            if rest:
                items.append(" ".join(rest))
            items.sort()
            words.extend(items)
        else:
            words.extend(rest)

    for t in _COPY_TOKEN.findall(low):
        c = t[0]
        if c == "(":
            kind = "p"
            if create == 2 and len(stack) == 1:
                kind, create = "c", 0
            top = [kind, [], [] if kind == "c" else None]
            stack.append(top)
            words = top[1]
        elif c == ",":
            if top[2] is not None:
                if words:
                    top[2].append(" ".join(words))
                top[1] = words = []
        elif c == ")":
            while top[0] == "s":
                close()
            if len(stack) > 1:
                close()
        elif c == ";":
            while len(stack) > 1:
                close()
            create, start = 0, True
        elif c == "'" or c == "/" or c == "-":
            words.extend(_COPY_WORD.findall(t))
        elif t == "select":
            words.append(t)
            top = ["s", [], []]
            stack.append(top)
            words = top[1]
            create, start = 0, False
        elif t == "from" and top[0] == "s":
            close()
            words.append(t)
        elif t in _LEAD and top[0] == "s" and not words and not top[2]:
            stack[-2][1].append(t)
        else:
            if start:
                create, start = int(t == "create"), False
            elif create == 1 and t == "table":
                create = 2
            elif create == 1 and t not in _CREATE_WORDS:
                create = 0
            words.append(t)
    while len(stack) > 1:
        close()
    return " ".join(stack[0][1])


_LEAD = frozenset(("distinct", "all"))
_CREATE_WORDS = frozenset(
    "or replace temp temporary transient volatile external global local private unlogged managed dynamic hybrid".split()
)


def digest(text: str) -> bytes:
    """128 bits that stand for the text in shuffles."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_WORD = re.compile(r"[a-z0-9_]+")


def word_set(text: str) -> set[str]:
    """Distinct words: runs of a-z, 0-9 and _ in the lower-cased text."""
    return set(_WORD.findall(text.lower()))
