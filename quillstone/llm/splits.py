"""Same or near-same records across splits: an exact join of evaluation and training rows by parity bitmaps.

Rows are compared only under the same instructions. Copies collapse first. Within one set of
instructions, evaluation texts are cut into blocks of a bounded number of shingles, by the size of their shingle sets and by
hash where too many sizes tie, and every training text goes to the blocks whose sizes the length filter allows. Only
bitmaps of the shingle sets travel there (:mod:`quillstone.functions.parity`): they bound the overlap of two sets from above, at a few
nanoseconds a pair. The texts of the pairs that are left are read again and compared on whole sets. Every filter is exact;
nothing is sampled or capped, and small and large groups have the same plan: a small one is a single block.

Memory per task is bounded by ``block`` and ``probe_block``, whatever the size of a group, and a hot group of equal
instructions is spread over many tasks. :func:`prefix_join` is the same join of two lists in memory, by prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import parity
from quillstone.llm.shingles import hash_text, jaccard, letters, plain, shingles
from quillstone.operators.blocks import placed_blocks
from quillstone.session import cut, partitions_for, small, spread

THRESHOLD = 0.8
_STATE = "_id bigint, _role int, ih bigint, th bigint, th2 bigint, n int, map binary"


def keyed_states(df: DataFrame, id_col: str, role: str, instructions: str, state: str, t: float = THRESHOLD) -> DataFrame:
    """(_id, _role, ih, th, th2, n, map): hashes of instructions and state as they look, the size of the set of shingles and its bitmap for ``t``.

    Rows whose id or state is null take no part; null instructions equal empty ones. Two hashes tell texts apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            text = [plain(s) for s in b["_s"]]
            for i in b["_i"].unique():
                if i not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[i] = hash_text(letters(i))
            start, hashes = shingles(text)
            yield pd.DataFrame({"_id": b["_id"], "_role": b["_role"], "ih": [seen[i] for i in b["_i"]], "th": [hash_text(x) for x in text], "th2": [hash_text(x, 1) for x in text], "n": np.diff(start).astype("int32"), "map": parity.bitmaps(start, hashes, t)})

    rows = df.where(F.col(state).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.col(role).cast("int").alias("_role"), F.coalesce(F.col(instructions), F.lit("")).alias("_i"), F.col(state).alias("_s"))
    return rows.mapInPandas(run, _STATE)


def keyed_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(th, th2, text) of states."""
    for b in batches:
        text = [plain(s) for s in b["_st"]]
        yield pd.DataFrame({"th": [hash_text(x) for x in text], "th2": [hash_text(x, 1) for x in text], "text": text}).drop_duplicates(["th", "th2"])


WORDS = 8  # 64-bit words of a parity bitmap


def bitmaps(start: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(texts, WORDS): parities of the shingles of each text by hash bucket.

    Two bitmaps differ in at most as many bits as the sets differ in shingles.
    """
    out = np.empty((len(start) - 1, WORDS), dtype=np.uint64)
    bits = 64 * WORDS
    for c in range(0, len(out), 2000):
        d = min(c + 2000, len(out))
        owner = np.repeat(np.arange(d - c), np.diff(start[c : d + 1]))
        bucket = (hashes[start[c] : start[d]] % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(owner * bits + bucket, minlength=(d - c) * bits) & 1).astype(np.uint8)
        out[c:d] = np.packbits(odd.reshape(d - c, bits), axis=1).view(np.uint64)
    return out


class PrefixIndex:
    """The inverted index of the prefixes of some texts.

    Two sets of sizes a and b need ``o = t / (1 + t) * (a + b)`` common shingles. In an order from rare to
    frequent, their first ``a - o + 1`` and ``b - o + 1`` shingles then have one in common.
    """

    def __init__(self, texts: list[str], t: float = THRESHOLD):
        self.t, self.n = t, len(texts)
        start, _ = shingles(texts)
        self.by_size = np.argsort(np.diff(start), kind="stable")  # texts of allowed sizes are a stretch of every posting list
        self.start, self.hashes = shingles([texts[i] for i in self.by_size])
        self.size = np.diff(self.start)
        self.vocab, token, df = np.unique(self.hashes, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.vocab), dtype=np.int64)  # rare in this block first
        self.rank[np.argsort(df, kind="stable")] = np.arange(len(self.vocab))
        r, post, at = self._prefixes(self.size, self.start, self.rank[token])
        by = np.argsort(r, kind="stable")  # postings by rank, within one rank by size
        self.post, self.at = post[by].astype(np.int32), at[by].astype(np.int32)
        self.keys = r[by] * np.int64(self.n + 1) + self.post
        self.maps = bitmaps(self.start, self.hashes)

    def _prefixes(self, n: np.ndarray, start: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the longest prefix that any partner asks for: ranks, texts and positions, rare first."""
        span = np.int64(len(self.vocab) + 2)
        owner = np.repeat(np.arange(len(n)), n)
        r = np.sort(owner * span + r + 1) - owner * span - 1
        pos = np.arange(len(r)) - np.repeat(start[:-1], n)
        inside = pos < np.repeat(n - np.ceil(self.t * n - 1e-9).astype(np.int64) + 1, n)
        return r[inside], owner[inside], pos[inside]

    def probe(self, texts: list[str], chunk: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (i, j) with Jaccard(indexed[i], texts[j]) >= t, and that similarity; exact."""
        t, size, count = self.t, self.size, self.n
        start, hashes = shingles(texts)
        n = np.diff(start)
        blank, empty = np.flatnonzero(size == 0), np.flatnonzero(n == 0)
        out = [(np.repeat(self.by_size[blank], len(empty)), np.tile(empty, len(blank)), np.ones(len(blank) * len(empty)))]
        if not len(self.hashes) or not len(hashes):
            return out[0]
        place = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        # shingles unknown to the block come first and meet nothing
        r, who, pos = self._prefixes(n, start, np.where(self.vocab[place] == hashes, self.rank[place], -1))
        known = r >= 0
        r, who, pos = r[known], who[known], pos[known]
        least, most = np.searchsorted(size, np.ceil(t * n - 1e-9)), np.searchsorted(size, np.floor(n / t + 1e-9), side="right")
        lo = np.searchsorted(self.keys, r * np.int64(count + 1) + least[who])
        hi = np.searchsorted(self.keys, r * np.int64(count + 1) + most[who])
        own = bitmaps(start, hashes)
        bound = np.searchsorted(who, np.arange(0, len(texts) + chunk, chunk))
        overlap = lambda a, b: np.ceil(t / (1 + t) * (a + b) - 1e-9)
        for k in range(len(bound) - 1):
            part = slice(bound[k], bound[k + 1])
            m = hi[part] - lo[part]
            some = m > 0
            if not some.any():
                continue
            m, first = m[some], lo[part][some]
            flat = np.arange(m.sum()) + np.repeat(first - (np.cumsum(m) - m), m)
            x, y = np.repeat(who[part][some], m), self.post[flat]
            o = overlap(size[y], n[x])
            near = (self.at[flat] <= size[y] - o) & (np.repeat(pos[part][some], m) <= n[x] - o)
            seen = np.zeros(chunk * count, dtype=bool)
            seen[(x[near] - k * chunk) * count + y[near]] = True
            pair = np.flatnonzero(seen)
            j, i = pair // count + k * chunk, pair % count
            o = overlap(size[i], n[j])
            # the bitmaps bound the overlap from above
            can = np.bitwise_count(self.maps[i] ^ own[j]).sum(axis=1, dtype=np.int64) <= size[i] + n[j] - 2 * o
            i, j, o = i[can], j[can], o[can]
            if len(i):
                sets = ((self.hashes[self.start[u] : self.start[u + 1]], hashes[start[v] : start[v + 1]]) for u, v in zip(i, j))
                both = np.fromiter((np.intersect1d(p, q, assume_unique=True).size for p, q in sets), dtype=np.int64, count=len(i))
                good = both >= o
                i, j, both = i[good], j[good], both[good]
                out.append((self.by_size[i], j, both / (size[i] + n[j] - both)))
        return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def prefix_join(index: list[str], probe: list[str], t: float = THRESHOLD, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j) with Jaccard(index[i], probe[j]) >= t over shingle sets, and that similarity; exact."""
    own = PrefixIndex(index, t)
    parts = [own.probe(probe[c : c + batch]) for c in range(0, len(probe), batch)]
    shift = range(0, len(probe), batch)
    return tuple(np.concatenate(x) for x in zip(*((i, j + c, s) for c, (i, j, s) in zip(shift, parts)))) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))  # type: ignore[return-value]


#: Shingles of the evaluation and of the training texts whose bitmaps meet in one task, where a text counts as ``LEAST`` at least.
BLOCK, PROBE_BLOCK, LEAST = 24_000_000, 48_000_000, 200


def split_pairs(df: DataFrame, eval_suites: DataFrame, id_col: str = "item_id", split: str = "split", suite: str = "suite", instructions: str = "instructions", state: str = "state", suite_of: str = "suite", t: float = THRESHOLD, block: int = BLOCK, probe_block: int = PROBE_BLOCK) -> DataFrame:
    """Pairs of a training row and an evaluation row with the same instructions and similar states.

    Returns (eval_id, train_id, similarity), each pair once. Evaluation rows are those of split dev or
    test whose suite occurs in ``eval_suites``; a null id, split, suite or state takes no part; two empty
    states are equal. Empty tables give an empty result; other columns are ignored whatever their names.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.lower(F.trim(F.col(split))).alias("_sp"), F.col(suite).alias("_su"), F.col(instructions).alias("_in"), F.col(state).alias("_st"))
    suites = eval_suites.select(F.col(suite_of).alias("_su")).where(F.col("_su").isNotNull()).distinct().withColumn("_listed", F.lit(True))
    role = F.when(F.col("_sp") == "train", 0).when(F.col("_sp").isin("dev", "test") & F.col("_listed"), 1)
    rows = rows.where(F.col("_sp").isin("train", "dev", "test")).join(suites, "_su", "left").withColumn("_r", role).where(F.col("_r").isNotNull())
    text = ["ih", "th", "th2"]
    members = cut(keyed_states(rows, "_id", "_r", "_in", "_st", t))
    once = members.groupBy("_role", *text).agg(F.first("n").alias("n"), F.first("map").alias("map"))
    with partitions_for(df.sparkSession, members.agg(F.sum(F.octet_length("map") + 60)).first()[0] or 0):
        cand = cut(block_join(once, t, block, probe_block))
    pairs = verified(cand, members, rows, t)
    ev = members.where("_role = 1").select(F.col("_id").alias("eval_id"), "ih", F.col("th").alias("th_e"), F.col("th2").alias("th2_e"))
    tr = members.where("_role = 0").select(F.col("_id").alias("train_id"), "ih", F.col("th").alias("th_t"), F.col("th2").alias("th2_t"))
    return pairs.join(ev, ["ih", "th_e", "th2_e"]).join(tr, ["ih", "th_t", "th2_t"]).select("eval_id", "train_id", "similarity").distinct()


def block_join(docs: DataFrame, t: float, block: int, probe_block: int) -> DataFrame:
    """(ih, th_e, th2_e, th_t, th2_t) of documents of role 1 and of role 0 whose sizes and bitmaps allow a similarity of ``t``.

    ``docs`` holds (_role, ih, th, th2, n, map) of each document.
    """
    placed = placed_blocks(docs, docs, t, block, probe_block, least=LEAST)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e, p = g[g["_role"] == 1], g[g["_role"] == 0]
        i, j = parity.may_reach(e["map"].tolist(), e["n"].to_numpy(), p["map"].tolist(), p["n"].to_numpy(), t)
        pick = lambda x, c, at: x[c].to_numpy()[at]
        return pd.DataFrame({"ih": np.full(len(i), g["ih"].iloc[0]), "th_e": pick(e, "th", i), "th2_e": pick(e, "th2", i), "th_t": pick(p, "th", j), "th2_t": pick(p, "th2", j)})

    return placed.groupBy("ih", "band", "sub", "part").applyInPandas(run, "ih bigint, th_e bigint, th2_e bigint, th_t bigint, th2_t bigint")


def verified(cand: DataFrame, members: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """The pairs of the cut table ``cand`` that reach ``t``, with their similarity; the texts are read again from ``rows``."""
    need = cand.select(F.explode(F.array(*(F.struct("ih", F.col(f"th_{x}").alias("th"), F.col(f"th2_{x}").alias("th2")) for x in "et"))).alias("k")).select("k.*").distinct()
    one = cut(members.join(need, ["ih", "th", "th2"], "left_semi").groupBy("th", "th2").agg(F.min("_id").alias("_id")).select("_id").distinct())
    again = rows.where("_st is not null").select(F.col("_id").cast("bigint").alias("_id"), "_st").join(small(one), "_id", "left_semi").select("_st")
    texts = cut(again.mapInPandas(keyed_texts, "th bigint, th2 bigint, text string").groupBy("th", "th2").agg(F.first("text").alias("text")))
    side = lambda x: texts.select(F.col("th").alias(f"th_{x}"), F.col("th2").alias(f"th2_{x}"), F.col("text").alias(f"text_{x}"))
    both = spread(cand, "th_e").join(side("e"), ["th_e", "th2_e"]).join(side("t"), ["th_t", "th2_t"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = jaccard(x["text_e"].tolist(), x["text_t"].tolist())
            yield x.assign(similarity=s).loc[s >= t - 1e-12, ["ih", "th_e", "th2_e", "th_t", "th2_t", "similarity"]]

    return both.mapInPandas(verify, "ih bigint, th_e bigint, th2_e bigint, th_t bigint, th2_t bigint, similarity double")


def ordered(pairs: DataFrame, a: str, b: str, id_col: str) -> DataFrame:
    """The pairs as (id_a, id_b) with id_a < id_b."""
    return pairs.select(F.least(a, b).alias(f"{id_col}_a"), F.greatest(a, b).alias(f"{id_col}_b"))
