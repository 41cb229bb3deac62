"""Language labels in whatever spelling, as two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-1 code, then its three-letter codes and names.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais",
    "es": "spa spanish español espanol castilian", "it": "ita italian italiano", "pt": "por portuguese português portugues",
    "nl": "nld dut dutch nederlands flemish", "pl": "pol polish polski", "ru": "rus russian русский",
    "ja": "jpn japanese 日本語", "zh": "zho chi chinese 中文 mandarin cmn", "sv": "swe swedish svenska",
    "tr": "tur turkish türkçe", "ar": "ara arabic العربية", "hi": "hin hindi हिन्दी", "ko": "kor korean 한국어",
    "da": "dan danish dansk", "fi": "fin finnish suomi", "cs": "ces cze czech čeština", "uk": "ukr ukrainian українська",
    "no": "nor norwegian norsk nob nb nno nn", "hu": "hun hungarian magyar", "ro": "ron rum romanian română",
    "el": "ell gre greek ελληνικά", "he": "heb hebrew iw", "id": "ind indonesian", "vi": "vie vietnamese", "th": "tha thai",
}
CODES = {name: code for code, names in NAMES.items() for name in [code, *names.split()]}


def language_code(col: Column) -> Column:
    """``en``, ``EN_gb``, ``eng``, ``English`` ... as ``en``; null where the label names no known language."""
    head = F.regexp_extract(F.lower(F.trim(col)), r"^([\p{L}]+)", 1)
    pairs = [F.lit(x) for kv in CODES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), head)


def language_code_py(label: str | None) -> str | None:
    """:func:`language_code` of one value."""
    import re

    m = re.match(r"[^\W\d_]+", (label or "").strip().lower())
    return CODES.get(m.group()) if m else None
