"""Byte-pair tokenizers over vocabulary files of public tokenizers: valid UTF-8, word pieces, merging, added tokens, truncation."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Fixed value: the word pieces of byte-level tokenizers, for regular expressions with Unicode classes and lookahead.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
_CACHED = 100_000


def utf8_text(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def word_pieces(text: Column) -> Column:
    """The word pieces that byte-level tokenizers merge within; together they are the whole text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PIECES), F.lit(0))


def merged(parts: list, rank: Callable[[object], float | None]) -> list:
    """``parts`` after merging neighbours whose concatenation has a rank, least rank first and leftmost of equals.

    Pairs wait in a heap and neighbours are linked, so a piece of n parts takes n log n steps.
    """
    n = len(parts)
    part = list(parts)
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    heap: list[tuple[float, int, object]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            both = part[i] + part[after[i]]
            r = rank(both)
            if r is not None:
                heapq.heappush(heap, (r, i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or part[i] + part[j] != both:
            continue  # one of them was merged meanwhile
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in part if p is not None]


@dataclass
class Tokenizer:
    """A vocabulary with its way of cutting: byte-level word pieces, or words that begin with a marked blank."""

    ids: Mapping
    ranks: Mapping
    byte_level: bool
    unknown: int | None = None
    byte_ids: Sequence[int] = ()
    prepend: bool = True
    added: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import regex

        self._words = regex.compile(PIECES if self.byte_level else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        names = sorted(self.added, key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, names))) if names else None
        self._seen: dict = {}

    @classmethod
    def from_ranks(cls, path: str, added: Mapping[str, int] | None = None) -> Tokenizer:
        """A file with a base64 token and its rank on each line; ids are ranks."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ranks, ranks, True, added=added or {})

    @classmethod
    def from_pieces(cls, path: str, added: Mapping[str, int] | None = None) -> Tokenizer:
        """A byte-pair model file of sentencepiece."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = [i for i in range(sp.get_piece_size()) if sp.is_byte(i)]
        ids = {sp.id_to_piece(i): i for i in usual}
        return cls(ids, {p: -sp.get_score(i) for p, i in ids.items()}, False, sp.unk_id(), raw if len(raw) == 256 else (), sp.encode("a", out_type=str)[:1] != ["a"], added or {})

    def _word(self, word: str) -> list[int]:
        found = self._seen.get(word)
        if found is None:
            found = []
            if self.byte_level:
                data = word.encode("utf-8", "replace")
                found = [self.ids[data]] if data in self.ids else [self.ids[p] for p in merged([data[i : i + 1] for i in range(len(data))], self.ranks.get)]
            else:
                for p in merged(list(word), self.ranks.get):
                    if p in self.ids:
                        found.append(self.ids[p])
                    elif self.byte_ids:
                        found += [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
                    elif self.unknown is not None and (not found or found[-1] != self.unknown):
                        found.append(self.unknown)
            if len(self._seen) >= _CACHED:
                self._seen.clear()
            if len(word) <= 64:
                self._seen[word] = found
        return found

    def _plain(self, text: str, first: bool) -> list[int]:
        if not self.byte_level:
            text = text.replace(" ", BLANK)
            text = BLANK + text if self.prepend and first and text else text
        return [i for w in self._words.findall(text) for i in self._word(w)]

    def encode(self, text: str | None, most: int | None = None) -> list[int] | None:
        """Token ids; added tokens stand for themselves, and ``most`` cuts the end."""
        if text is None:
            return None
        out, at = [], 0
        for m in self._added.finditer(text) if self._added else ():
            out += self._plain(text[at : m.start()], at == 0)
            out.append(self.added[m[0]])
            at = m.end()
        out += self._plain(text[at:], at == 0)
        return out[:most]


def token_ids(text: Column, load: Callable[[], Tokenizer], most: int | None = None) -> Column:
    """The token ids of each text; ``load`` is called once per worker and batch stream. Null stays null, empty is empty."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load()
        for s in batches:
            yield s.map(lambda x: t.encode(x, most))

    return run(text)
