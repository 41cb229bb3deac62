"""Evaluation texts leaking into training text: one Aho-Corasick automaton over the evaluation passages.

Both sides are reduced to their letters and digits as they look, without case, so that spacing, line
breaks and punctuation do not matter. A leak is a run of ``words`` consecutive words of an item (``chars``
letters and digits where most letters belong to scripts without spaces). Any such run contains a whole aligned
block of half that length; the automaton holds the first ``ANCHOR`` characters of every block, one scan of a document
meets every leak, and each hit is extended in both directions to the full run, counted in words of the
item and mapped back to offsets in the original text. Words are cut at blanks and at punctuation.

An automaton is built from at most ``chunk_chars`` characters of passages, which bounds a worker's memory; a
larger evaluation side is spread over several by a hash of the id. Only one chunk at a time is with the driver.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.looks import caseless

WORDS, CHARS = 18, 60
ANCHOR = 24
_OTHER = re.compile(r"[\W_]+")
_DROPPED = bytes(i for i in range(128) if not chr(i).isalnum())
#: Letters of scripts that are written without spaces: kana, Han, Thai, Lao, Khmer, Burmese.
_UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿฀-໿က-႟ក-៿]")


def stream(text: str | None) -> str:
    """The letters and digits of a text as they look, without case."""
    if not text:
        return ""
    return text.lower().encode().translate(None, _DROPPED).decode() if text.isascii() else _OTHER.sub("", caseless(text))


def word_stream(text: str | None) -> tuple[str, list[int]]:
    """The stream of a text and the position in it where each word starts, closed by its length."""
    starts, n = [], 0
    words = [w for w in _OTHER.split(caseless(text or "")) if w]
    for w in words:
        starts.append(n)
        n += len(w)
    return "".join(words), [*starts, n]


def offsets(text: str, lo: int, hi: int) -> tuple[int, int]:
    """Where stream positions ``lo`` to ``hi`` (exclusive) begin and end in the original text."""
    where: list[int] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        where += [i] * len(stream(text[i:j]))
        i = j
    if not where:
        return 0, 0
    end = where[min(hi, len(where)) - 1] + 1
    while end < len(text) and unicodedata.combining(text[end]):
        end += 1
    return where[min(lo, len(where) - 1)], end


class Passages:
    """The automaton of a set of items (id, text) with the unit run that counts as a leak."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, chars: int = CHARS):
        import ahocorasick

        self.items: list[tuple[int, str, list[int], int]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            s, starts = word_stream(text)
            least = words
            if len(_UNSPACED.findall(s)) * 2 > len(s):
                starts, least = list(range(len(s) + 1)), chars
            half = max(1, least // 2)
            if len(starts) - 1 < least:
                continue
            k = len(self.items)
            self.items.append((key, s, starts, least))
            for u in range(0, len(starts) - half, half):
                lo = starts[u]
                at.setdefault(s[lo : min(lo + ANCHOR, starts[u + half])], []).append((k, lo))
        self.auto = ahocorasick.Automaton()
        for block, places in at.items():
            self.auto.add_word(block, (len(block), places))
        if at:
            self.auto.make_automaton()
        self.any = bool(at)

    def scan(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, units, start, end) of the longest run of each item in a text, in the stream of the text."""
        if not self.any or not text:
            return []
        s = stream(text)
        best: dict[int, tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}  # the end of the last run on each diagonal
        for end, (size, places) in self.auto.iter(s):
            for k, p in places:
                t, starts, least = self.items[k][1:]
                diagonal = end - size + 1 - p
                if p < done.get((k, diagonal), 0):  # another block of a run that was met before
                    continue
                lo, hi = p, p + size
                while lo > 0 and lo + diagonal > 0 and t[lo - 1] == s[lo - 1 + diagonal]:
                    lo -= 1
                while hi < len(t) and hi + diagonal < len(s) and t[hi] == s[hi + diagonal]:
                    hi += 1
                done[k, diagonal] = hi
                units = bisect_right(starts, hi) - 1 - bisect_left(starts, lo)
                if units >= least and units > best.get(k, (0, 0, 0))[0]:
                    best[k] = (units, lo + diagonal, hi + diagonal)
        return [(self.items[k][0], *v) for k, v in best.items()]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, chars: int = CHARS, chunk_chars: int = 4_000_000) -> DataFrame:
    """(item_id, doc_id, units, start, end): items of which a run stands in a document, with its place.

    ``units`` counts words (letters and digits in unspaced scripts, whatever a label says) of the longest run; ``start`` and
    ``end`` are code point offsets into the original text. Null and empty texts leak nothing, null ids take no part; an item
    shorter than a run cannot leak; repeated rows count once; empty tables give an empty result.
    No passage is cut, whatever its length.
    """
    rows = items.select(F.col(item_id).cast("bigint").alias("_i"), F.col(item_text).alias("_t")).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).distinct()
    total = rows.agg(F.sum(F.length("_t"))).first()[0] or 0
    chunks = -(-total // chunk_chars) or 1
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("bigint").alias("_d"), F.col(doc_text).alias("_t")).where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull())

    def one(chunk: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(chunk)  # about chunk_chars characters

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages = Passages(shared.value, words, chars)
            for b in batches:
                out = [(i, d, n, *offsets(t, lo, hi)) for d, t in zip(b["_d"], b["_t"]) for i, n, lo, hi in passages.scan(t)]
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "units", "start", "end"])

        return source.mapInPandas(run, "item_id bigint, doc_id bigint, units int, start int, end int")

    parts = [one([tuple(r) for r in rows.where(F.pmod(F.xxhash64("_i"), F.lit(chunks)) == c).toLocalIterator()]) for c in range(chunks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("item_id", "doc_id").agg(F.max_by(F.struct("units", "start", "end"), F.struct("units", -F.col("start"))).alias("m")).select("item_id", "doc_id", "m.*")
