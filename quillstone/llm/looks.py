"""Text as it looks: one consistent form for text that shows the same glyphs.

The visible form of a text keeps letter case, accents, digits, punctuation and word order and levels
everything that does not show:

* full-width and half-width forms and Latin ligatures become the usual characters,
* every space that shows as one blank becomes U+0020, line separators become a line feed,
* characters that show nothing (format controls, variation selectors, soft hyphens ...) vanish,
* Cyrillic, Greek, Armenian and Cherokee letters that look like Latin ones become those,
* hyphens become the hyphen-minus,
* composed and combining accents are equal (NFC).

The table is derived from the Unicode character database of the running Python by rules; only the
look-alike letters are listed. It is used in two ways: as ``translate``/``replace`` arguments for
Spark SQL (:func:`sql_looks`) and as a numpy lookup table over
code points inside Arrow batches (:func:`looks_batch`).

Nulls stay null, the empty string stays empty, and text of any length is mapped as a whole.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter or another look-alike of it.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ԍ": "g", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ӏ": "I", "ү": "y", "ԟ": "k",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
    "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꮞ": "4",
    # Latin letters outside the basic alphabet that are drawn like one of it
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ƽ": "s", "ꞌ": "'",
}
# Dashes drawn as a hyphen (longer dashes are visible and stay), and quotes like an apostrophe.
HYPHENS = "‐‑‒⁃−﹣－˗۔"
APOSTROPHES = "’ʼ‘ʹ′＇"
# Default-ignorable characters that are not format controls (category Cf).
IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
LINE_ENDS = {0x0085, 0x2028, 0x2029}
SIZE = 0x110000
_DROP = SIZE  # marks a dropped code point in the numpy table
_MULTI = SIZE + 1  # marks a code point that becomes several


def _one(cp: int) -> str:
    """The visible form of one code point."""
    c = chr(cp)
    if cp < 0x80:
        return c
    if cp in IGNORED or (unicodedata.category(c) == "Cf" and not 0x0600 <= cp <= 0x0605):
        return ""
    if cp in LINE_ENDS:
        return "\n"
    if c in HYPHENS:
        return "-"
    if c in APOSTROPHES:
        return "'"
    if unicodedata.category(c) == "Zs" and cp != 0x1680:
        return " "
    kind = unicodedata.decomposition(c)
    if kind.startswith(("<wide>", "<narrow>", "<noBreak>")) or 0xFB00 <= cp <= 0xFB06 or cp in (0x0132, 0x0133, 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC):
        return "".join(_one(ord(x)) for x in unicodedata.normalize("NFKC", c))
    if 0xAC00 <= cp <= 0xD7A3 or 0x4E00 <= cp <= 0x9FFF:
        return c
    parts = unicodedata.normalize("NFD", c)
    mapped = "".join(LOOKALIKES.get(x, x) for x in parts)
    if mapped == parts and len(parts) > 1:
        return unicodedata.normalize("NFC", c)
    return unicodedata.normalize("NFC", mapped)


@functools.cache
def table() -> dict[int, str]:
    """Every code point whose visible form differs from itself."""
    spans = [range(0x80, 0x3400), range(0xA640, 0xAC00), range(0xF900, 0xFFF0), range(0x10000, 0x20000), range(0xE0000, 0xE0200)]
    return {cp: to for span in spans for cp in span if (to := _one(cp)) != chr(cp)}


@functools.cache
def lookup() -> np.ndarray:
    """The table as an array over all code points; dropped and expanding ones are marked."""
    out = np.arange(SIZE, dtype=np.uint32)
    for cp, to in table().items():
        out[cp] = _DROP if not to else ord(to) if len(to) == 1 else _MULTI
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def looks(text: str) -> str:
    """The visible form of one text."""
    if text.isascii():
        return text.replace("\r\n", "\n") if "\r" in text else text
    codes = lookup()[_codes(text.replace("\r\n", "\n"))]
    if (codes == _MULTI).any():
        t = table()
        text = "".join(t.get(ord(c), c) for c in text.replace("\r\n", "\n"))
    else:
        text = _text(codes[codes != _DROP])
    return unicodedata.normalize("NFC", text)


@functools.cache
def _small_letters() -> dict[int, str]:
    """Small letters of which only the capital looks like a Latin one, and the small letter of that."""
    return {ord(a.lower()): b.lower() for a, b in LOOKALIKES.items() if a.isupper() and len(a.lower()) == 1 and a.lower() not in LOOKALIKES}


def _caseless_one(text: str) -> str:
    return looks(looks(text).casefold().translate(_small_letters()))


@functools.cache
def _caseless_lookup() -> np.ndarray:
    """What each code point becomes without case; dropped and expanding ones are marked as in :func:`lookup`."""
    out = np.arange(SIZE, dtype=np.uint32)
    for span in [range(0x3400), range(0xA640, 0xAC00), range(0xF900, 0xFFF0), range(0x10000, 0x20000), range(0xE0000, 0xE0200)]:
        for cp in span:
            if not 0xD800 <= cp < 0xE000 and (to := _caseless_one(chr(cp))) != chr(cp):
                out[cp] = _DROP if not to else ord(to) if len(to) == 1 else _MULTI
    return out


def caseless(text: str) -> str:
    """The visible form without letter case: a text in capitals equals the same one in small letters.

    Capitals may look like Latin ones where their small letters don't (Cyrillic); both become the Latin small letter.
    """
    if text.isascii():
        return looks(text).lower()
    codes = _caseless_lookup()[_codes(text.replace("\r\n", "\n").replace("ß", "ss"))]
    if (codes == _MULTI).any():
        return _caseless_one(text)
    return unicodedata.normalize("NFC", _text(codes[codes != _DROP]))


def looks_batch(texts) -> list[str]:
    """:func:`looks` of many texts; null counts as empty. ASCII texts pass without a table lookup."""
    return [looks(t) if t else "" for t in texts]


_MARK = "\ufdd0"  # a noncharacter


@functools.cache
def sql_parts() -> tuple[list[tuple[str, str]], str, list[tuple[str, str]]]:
    """Characters that become one other, those that vanish, and those that become several."""
    t = table()
    single = sorted((chr(k), v) for k, v in t.items() if len(v) == 1)
    # what differs by canonical equivalence only is left for the comparison
    several = sorted((chr(k), v) for k, v in t.items() if len(v) > 1 and unicodedata.normalize("NFD", chr(k)) != unicodedata.normalize("NFD", v))
    return single, "".join(sorted(chr(k) for k, v in t.items() if not v)), several


def sql_looks(col: Column) -> Column:
    """The visible form as a SQL expression, up to canonical equivalence.

    ``translate`` maps and deletes single characters inside the JVM. Composed and combining accents are
    left for the comparison: under the collation UNICODE they are equal.
    """
    single, gone, several = sql_parts()
    before, after = "".join(a for a, _ in single), "".join(b for _, b in single)
    text = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    # one pass for all; characters that become several are rare and leave a mark
    fast = F.translate(text, before + "".join(a for a, _ in several) + gone, after + _MARK * len(several))
    # one loop over a literal array: a chain of calls would be a method too large to compile
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several))
    wide = F.aggregate(pairs, text, lambda t, p: F.replace(t, p["a"], p["b"]))
    mapped = F.when(F.instr(fast, _MARK) > 0, F.translate(wide, before + gone, after)).otherwise(fast)
    return F.when(col.rlike(r"[^\x00-\x7f]|\r\n"), mapped).otherwise(col)


@functools.cache
def _bare_parts() -> tuple[str, str]:
    """Letters and what is left of them without accents; marks come last and have nothing."""
    base, marks = {}, []
    for cp in [*range(0xC0, 0x3400), *range(0xA640, 0xD7A4), *range(0xF900, 0xFFF0), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20)]:
        c = chr(cp)
        if unicodedata.combining(c) or 0x1161 <= cp <= 0x11FF:
            marks.append(c)
        elif (first := unicodedata.normalize("NFD", c)[0]) != c:
            base[c] = first
    return "".join(base) + "".join(marks), "".join(base.values())


def sql_bare(col: Column) -> Column:
    """A coarser form: without accents. Texts that are canonically equivalent have the same one, so it may find what to compare."""
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(col, *_bare_parts())).otherwise(col)
