"""Token budget per source, language and domain under an existing tokenizer.

:class:`PieceCounter` counts the tokens of a unigram segmentation: pieces lie in a double-array trie over
UTF-8 bytes, and a count-only Viterbi pass over each normalized segment keeps the best score and its
number of pieces per position, never the pieces themselves. A segment is a run of blanks with the word
behind it, cut further at characters that occur in no longer piece; no piece crosses such a cut,
so that the counts of the segments add up to the count of the text, and each distinct segment is
segmented once per worker.

A vocabulary file of sentencepiece says how it was trained. Unigram models bring log-probabilities.
Byte-pair models bring the order of merges only; Viterbi then runs on ``-log(rank + offset)``, Zipf's
law for pieces in order of frequency, and its count is an estimate (``tests/llm`` bounds the error).
:class:`RankCounter` counts byte-level byte-pair tokens exactly.

Vocabulary files are parameters and are read on each worker; none is copied or trained.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.languages import language_code

BLANK = "▁"
ZIPF_OFFSET = 100.0
_CACHE = 200_000


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file of the package ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name)


class DoubleArray:
    """A double-array trie: state ``s`` goes with byte ``b`` to ``base[s] + b`` if ``check`` there is ``s``."""

    def __init__(self, keys: dict[bytes, float]):
        tree: dict = {}
        for k, v in keys.items():
            node = tree
            for b in k:
                node = node.setdefault(b, {})
            node[-1] = v
        size = 1 << 16
        self.base, self.check = [0] * size, [-1] * size
        self.value: list[float | None] = [None] * size
        self.check[0] = 0
        free = 1
        stack: list[tuple[int, dict]] = [(0, tree)]
        while stack:
            state, node = stack.pop()
            self.value[state] = node.pop(-1, None)
            labels = sorted(node)
            if not labels:
                continue
            at, tries = max(1, free - labels[0]), 0
            while True:
                if at + 256 >= len(self.check):
                    n = len(self.check)
                    self.base += [0] * n
                    self.check += [-1] * n
                    self.value += [None] * n
                if all(self.check[at + b] < 0 for b in labels):
                    break
                at += 1
                tries += 1
            if tries > 16:  # the stretch is nearly full: look no longer before this place
                free = max(free, at + labels[0] - 8)
            self.base[state] = at
            for b in labels:
                self.check[at + b] = state
            stack += [(at + b, node[b]) for b in labels]


class PieceCounter:
    """Count-only Viterbi over a vocabulary of scored pieces.

    ``scores`` maps pieces (blanks written as U+2581) to log-probabilities; a character without a piece costs
    ``unknown`` and counts as its UTF-8 bytes if ``bytes_as_pieces``, else as one unknown token.
    """

    def __init__(self, scores: dict[str, float], bytes_as_pieces: bool = False, add_blank: bool = True, normalize: Callable[[str], str] | None = None):
        self.trie = DoubleArray({k.encode(): v for k, v in scores.items() if k})
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.bytes_as_pieces, self.add_blank, self.normalize = bytes_as_pieces, add_blank, normalize
        self.glue = frozenset(c for k in scores if len(k) > 1 for c in k)
        self.seen: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        """A vocabulary file of sentencepiece, unigram or byte-pair."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        if all(v.is_integer() for v in raw.values()):  # byte-pair: minus the rank; pieces outside the order of merges come first
            raw = {k: -math.log(ZIPF_OFFSET + (-v if v > -1e6 else 0.0)) for k, v in raw.items()}
        some = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        return cls(raw, some, sp.encode("a", out_type=str)[:1] != ["a"], sp.normalize if sp.normalize("Ａ  b") != "Ａ▁▁b" and sp.normalize("Ａ  b") != "▁Ａ▁▁b" else None)

    def segment(self, text: str) -> int:
        """Pieces on the best path of one segment; among equal scores, the fewest."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = [-math.inf] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -math.inf or data[i] & 0xC0 == 0x80:
                continue
            here, k = best[i], count[i] + 1
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            known = False
            state = 0
            for j in range(i, n):
                to = base[state] + data[j]
                if check[to] != state or to == 0:
                    break
                state = to
                v = value[state]
                if v is not None:
                    known |= j + 1 - i == width
                    if here + v > best[j + 1] or here + v == best[j + 1] and k < count[j + 1]:
                        best[j + 1], count[j + 1] = here + v, k
            if not known and here + self.unknown > best[i + width]:
                best[i + width], count[i + width] = here + self.unknown, count[i] + (width if self.bytes_as_pieces else 1)
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        if self.normalize:
            text = self.normalize(text)
            if not text:
                return 0
        text = (BLANK if self.add_blank and not text.startswith(BLANK) else "") + text.replace(" ", BLANK)
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        total = 0
        # a run of blanks belongs to the word behind it
        words = text.split(BLANK)
        blanks = 0
        for n, w in enumerate(words):
            if n:
                blanks += 1
            if not w:
                continue
            s = BLANK * blanks + w
            blanks = 0
            k = seen.get(s)
            if k is None:
                k = seen[s] = sum(map(self.segment, self.parts(s)))
            total += k
        if blanks:
            total += self.segment(BLANK * blanks)
        return total

    def parts(self, s: str) -> Iterator[str]:
        """A segment cut at characters that occur in no longer piece."""
        start = 0
        for i, c in enumerate(s):
            if c not in self.glue:
                if start < i:
                    yield s[start:i]
                yield c
                start = i + 1
        if start < len(s):
            yield s[start:]


class RankCounter:
    """Exact byte-level byte-pair counts from a file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def load(cls, path: str, pattern: str | None = None) -> RankCounter:
        """A file of ranks; the pattern that cuts texts is that of the package ``public_tokenizers`` unless given."""
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        return len(self.encode(text)) if text else 0


_COUNTERS: dict[tuple[str, str], PieceCounter | RankCounter] = {}


def counter(path: str) -> PieceCounter | RankCounter:
    """The counter of a vocabulary file, loaded once per worker process."""
    kind = "ranks" if path.endswith(".tiktoken") else "pieces"
    if (kind, path) not in _COUNTERS:
        _COUNTERS[kind, path] = RankCounter.load(path) if kind == "ranks" else PieceCounter.load(path)
    return _COUNTERS[kind, path]


def token_count(col: Column, path: str) -> Column:
    """The number of tokens of a text column; null and empty texts have 0."""
    from pyspark.sql.types import LongType

    @F.pandas_udf(LongType())
    def count(s: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c.count(t) for t in s], dtype="int64")

    return count(col)


def clean_name(col: Column) -> Column:
    """A source or domain in one spelling: lower case, no blanks around, no slashes at the end; empty is null."""
    s = F.regexp_replace(F.trim(F.lower(col)), r"[\s/]+$", "")
    return F.when(s != "", s)


def token_budget(items: DataFrame, log: DataFrame, path: str, id_col: str = "item_id", state: str = "state", lang: str = "lang", log_id: str = "item_id", src: str = "src", domain: str = "domain", at: str = "created_at") -> DataFrame:
    """(src, lang, domain, items, chars, tokens): how much text each slice provides.

    An item's source and domain are those of its log row with the highest ``at``; ties fall to the greatest
    source, then domain. Spellings are brought together; null, meaningless and missing names form the slice
    null. Items without a log row count under null. Null states have no tokens; repeated items count as
    often as they occur; an empty table gives an empty result.
    """
    last = log.select(F.col(log_id).alias("_k"), F.col(at).alias("_at"), clean_name(F.col(src)).alias("src"), clean_name(F.col(domain)).alias("domain"))
    last = last.groupBy("_k").agg(F.max(F.struct(F.col("_at"), "src", "domain")).alias("m")).select("_k", "m.src", "m.domain")
    text = items.select(F.col(id_col).alias("_k"), language_code(F.col(lang)).alias("lang"), F.length(state).alias("_n"), token_count(F.col(state), path).alias("_t"))
    return text.join(last, "_k", "left").groupBy("src", "lang", "domain").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chars"), F.sum("_t").alias("tokens"))
