"""Code-page swaps as ciphers: what a reader with the wrong table made of a writer's bytes."""

from __future__ import annotations

from functools import cache

#: Tables that texts are written in, and single-byte tables that they are misread with. Public codec names.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp850", "cp437", "mac_roman", "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
WRITTEN = ("utf-8", *SINGLE, "cp932", "euc_jp", "gb18030", "big5", "cp949")
MULTI_READ = ("cp932", "euc_jp", "gbk", "big5", "cp949")


@cache
def reading(table: str) -> dict[str, int]:
    """Character to byte of a single-byte table; bytes it leaves undefined stand for the control of the same code."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(table)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@cache
def letters(written: str, read: str) -> dict[int, str]:
    """The substitution cipher of two single-byte tables, as a table for ``str.translate``."""
    out = {}
    for c, b in reading(read).items():
        if b >= 128:
            try:
                z = bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
            if z != c:
                out[ord(c)] = z
    return out


@cache
def swaps() -> tuple[tuple[str, str], ...]:
    """(written, read) pairs, each a hypothesis about a passage."""
    singles = [(w, r) for w in WRITTEN for r in SINGLE if w != r]
    multi = [(w, r) for r in MULTI_READ for w in ("utf-8", "cp932", "euc_jp", "cp1252", "cp1251", "gb18030") if w != r]
    return tuple(singles + multi)


def undo(text: str, written: str, read: str) -> str | None:
    """The text as written, if every character can be traced back to bytes; None otherwise."""
    if written in SINGLE and read in SINGLE:
        table = letters(written, read)
        known = reading(read)
        if any(ord(c) > 127 and c not in known for c in text):
            return None
        return text.translate(table)
    try:
        if read in SINGLE:
            known = reading(read)
            raw = bytes([known[c] for c in text])
        else:
            raw = text.encode(read)
        return raw.decode(written)
    except (KeyError, UnicodeError):
        return None


@cache
def _by_reading() -> tuple[tuple, ...]:
    """Each reading table with its characters outside ASCII, its (number, written table) pairs of several bytes a letter,
    its (number, cipher) pairs of single-byte tables, and the letters of those ciphers by byte (one row a cipher)."""
    import numpy as np

    out: dict[str, list[tuple[int, str]]] = {}
    for k, (w, r) in enumerate(swaps()):
        out.setdefault(r, []).append((k, w))
    made = []
    for r, pairs in out.items():
        single = [(k, letters(w, r)) for k, w in pairs if r in SINGLE and w in SINGLE]
        several = [(k, w) for k, w in pairs if not (r in SINGLE and w in SINGLE)]
        table = reading(r) if r in SINGLE else {}
        grid = np.zeros((len(single), 256), np.int64)
        for row, (_, cipher) in enumerate(single):
            for c, b in table.items():
                grid[row, b] = ord(cipher.get(ord(c), c))
        made.append((r, frozenset(c for c in table if ord(c) > 127), tuple(several), tuple(single), grid))
    return tuple(made)


#: Written tables of ideographs; they are tried in languages that have some.
_IDEOGRAPHS = frozenset(("cp932", "euc_jp", "gb18030", "big5", "cp949"))


def readings_of(text: str, freq, rarer: float, ideographs: bool, kept: dict) -> list[tuple[int, str]]:
    """(swap number, text as written) of every swap that the text can be traced back by and that changes it, but for
    single-byte ciphers whose letters are rarer by more than ``rarer`` nats a letter.

    ``freq`` is the log-frequency of characters; ``kept`` remembers the ciphers by the text's foreign letters. A text
    may have been misread as another table more than once where it was written in UTF-8.
    """
    foreign = "".join(sorted(c for c in text if ord(c) > 127))
    possible = kept.get(foreign)
    if possible is None:
        possible = []
        for r, known, several, single, grid in _by_reading():
            if not known:
                possible.append((r, None, several, ()))
            elif known.issuperset(foreign):
                table = reading(r)
                delta = freq[grid[:, [table[c] for c in foreign]]].sum(axis=1) - sum(float(freq[min(ord(c), 0xFFFF)]) for c in foreign)
                possible.append((r, table, several, tuple(x for x, d in zip(single, delta.tolist()) if d > -rarer * len(foreign))))
        if len(kept) < 100_000:
            kept[foreign] = possible
    out = []
    for r, table, several, single in possible:
        for k, cipher in single:
            z = text.translate(cipher)
            if z != text:
                out.append((k, z))
        try:
            raw = text.encode(r) if table is None else bytes([table[c] for c in text])
        except UnicodeError:
            continue
        for k, w in several:
            if w in _IDEOGRAPHS and not ideographs:
                continue
            try:
                z = raw.decode(w)
            except UnicodeError:
                continue
            for _ in range(3):
                if z is None or z == text:
                    break
                out.append((k, z))
                z = undo(z, w, r) if w == "utf-8" and not z.isascii() else None
    return out
