"""Exact, near and semantic duplicates; greedy keeping in id order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import parity
from quillstone.functions import probability as P
from quillstone.functions.text import norm, shown
from quillstone.operators.blocks import placed_blocks
from quillstone.operators.graph import components
from quillstone.session import cut, partitions_for, small, spread, widened

GRAM, NEAR = 5, 0.8
#: Registers of a signature, the most bands, and the probability with which a pair at the threshold may be lost by banding, and by the sketch.
PERMUTATIONS, BANDS, LOSS = 256, 36, 1e-6
#: Bands of fewer rows bring unrelated texts of one kind together; there, bitmaps of the sets are compared instead, in blocks of so many grams.
LEAST_ROWS, LEAST_BLOCK, MOST_BLOCK = 4, 7_000_000, 60_000_000


def band_count(t: float, rows: int) -> int:
    """The fewest bands of so many rows that keep a pair at ``t`` but with a probability of ``LOSS``."""
    return 1 if t >= 1 else math.ceil(math.log(LOSS) / math.log1p(-(t**rows)))


def band_rows(t: float) -> int:
    """The most rows for which ``BANDS`` bands suffice; raises where even one row does not."""
    fit = [r for r in range(1, PERMUTATIONS + 1) if band_count(t, r) <= BANDS and band_count(t, r) * r <= PERMUTATIONS]
    if not fit:
        raise ValueError(f"a threshold of {t} needs more than {BANDS} bands")
    return max(fit)


def sketch_least(t: float, bits: int = PERMUTATIONS, loss: float = LOSS) -> int:
    """So many bits of two sketches are equal for a pair at ``t``, but with a probability of ``loss``."""
    p, tail = (1 + t) / 2, 0.0
    for k in range(bits + 1):
        tail += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if tail > loss:
            return k
    return bits


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each combination of keys; nulls are equal. One partial aggregation."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    whole = F.struct(*df.columns)
    return keyed.groupBy(*names).agg(F.min_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def text_classes(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, class_id, copies): rows of equal normalised text; null texts are left out."""
    rows = df.select(F.col(id_col), F.xxhash64(norm(text)).alias("_a"), F.xxhash64(F.lit(1), norm(text)).alias("_b")).where(text.isNotNull())
    classes = rows.groupBy("_a", "_b").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(classes, ["_a", "_b"]).select(id_col, "class_id", "copies")


def gram_hashes(texts: Sequence[str], n: int = GRAM) -> list[np.ndarray]:
    """Distinct 32-bit hashes of the n-grams of each text; a shorter text is its own gram."""
    out = []
    for t in texts:
        if not t:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(max(1, len(c) - n + 1), dtype=np.uint64)
        for k in range(min(n, len(c))):
            h = h * np.uint64(0x100000001B3) + c[k : k + len(h)]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        out.append(np.unique(h >> np.uint64(24)))
    return out


def minhash(grams: Sequence[np.ndarray], permutations: int = PERMUTATIONS, seed: int = 17) -> np.ndarray:
    """Signatures by multiply-shift hashing of the gram hashes, in pieces of a bounded size."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)[:, None] | np.uint32(1)
    b = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)[:, None]
    out = np.zeros((len(grams), permutations), dtype=np.uint32)
    for i, g in enumerate(grams):
        if len(g):
            x = (g ^ (g >> np.uint64(32))).astype(np.uint32)
            out[i] = np.min([(a * x[c : c + 4096] + b).min(axis=1) for c in range(0, len(x), 4096)], axis=0)
    return out


def _bitmap_pairs(reps: DataFrame, t: float) -> DataFrame:
    """(a, b) with a < b of ``reps`` (_id, _t, _g): all texts of one _g whose sizes and bitmaps allow a similarity of ``t``."""
    kind = dict(reps.dtypes)["_id"]

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = gram_hashes(b["_t"].tolist())
            n = np.array([len(x) for x in g], dtype="int32")
            bits = parity.bitmaps(np.append(0, np.cumsum(n, dtype=np.int64)), np.concatenate([*g, np.zeros(0, dtype=np.uint64)]), t)
            yield pd.DataFrame({"ih": b["_g"], "th": b["_id"], "n": n, "map": bits})

    docs = cut(reps.select("_id", "_t", "_g").mapInPandas(maps, f"ih bigint, th {kind}, n int, map binary"))
    size = docs.agg(F.sum(F.col("n").cast("long")).alias("n"), F.sum(F.octet_length("map") + 60).alias("bytes")).first()
    block = min(max(LEAST_BLOCK, (size["n"] or 0) // 12), MOST_BLOCK)
    # every text is both the larger and the smaller one of its pairs
    roles = docs.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("_role"), "ih", "th", "n", "map")

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["_role"] == 1], g[g["_role"] == 0]
        n, m = x["n"].to_numpy(), y["n"].to_numpy()
        i, j = parity.may_reach(x["map"].tolist(), n, y["map"].tolist(), m, t, upward=True)
        a, b, larger = x["th"].to_numpy()[i], y["th"].to_numpy()[j], n[i] > m[j]
        once = (a != b) & (larger | (a > b))
        a, b = a[once], b[once]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a)})

    with partitions_for(reps.sparkSession, (size["bytes"] or 0) * 4):
        return cut(placed_blocks(roles, roles, t, block, 2 * block, least=200, upward=True).groupBy("ih", "band", "sub", "part").applyInPandas(meet, f"a {kind}, b {kind}").distinct())


def near_links(df: DataFrame, id_col: str, text: str, t: float = NEAR, within: str | None = None) -> DataFrame:
    """(a, b, similarity) with a < b: class representatives whose 5-grams reach ``t``, by banded MinHash and verification.

    With ``within``, only representatives that agree in that column. Below a threshold of about 0.75, where bands tell little, pairs are found by
    bitmaps of the sets, and none is lost. The rows of a band follow from ``t`` (35 bands of 5 rows at 0.8), and so does the number of equal bits that
    sketches of one bit per register must have: each loses a pair at ``t`` with a probability of 1e-6 at most.
    Copies are represented by their least id (:func:`text_classes` has the membership); buckets have no cap.
    """
    depth, least = band_rows(t), sketch_least(t)
    m = band_count(t, depth)
    words = [f"s{i}" for i in range(PERMUTATIONS // 64)]
    rows = df.where(shown(F.col(text))).select(F.col(id_col).alias("_id"), norm(F.col(text)).alias("_t"), (F.xxhash64(within) if within else F.lit(0).cast("bigint")).alias("_g"))
    # texts are read again where they are needed, and never written
    ids = cut(rows.groupBy(F.xxhash64("_t").alias("_a"), F.xxhash64(F.lit(1), "_t").alias("_b")).agg(F.min("_id").alias("_id")).select("_id"))
    reps = widened(rows).join(small(ids), "_id", "left_semi")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for c in range(0, len(whole), 1000):
                b = whole.iloc[c : c + 1000]
                g = gram_hashes(b["_t"].tolist())
                s, group = minhash(g), b["_g"].to_numpy(dtype=np.int64).view(np.uint64)
                key = np.empty((len(b), m), dtype=np.uint64)
                for k in range(m):
                    h = group ^ np.uint64(k + 1)
                    for r in range(depth):
                        h = (h ^ s[:, k * depth + r]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(29)
                    key[:, k] = h
                sketch = np.packbits((s * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8), axis=1).view(np.int64)
                out = {"key": key.reshape(-1).view(np.int64), "_id": np.repeat(b["_id"].to_numpy(), m), "n": np.repeat(np.array([len(x) for x in g], dtype="int32"), m)}
                yield pd.DataFrame(out | {w: np.repeat(sketch[:, i], m) for i, w in enumerate(words)})

    kind = dict(reps.dtypes)["_id"]
    if depth < LEAST_ROWS:
        cand = _bitmap_pairs(reps, t)
    else:
        keyed = reps.mapInPandas(bands, f"key bigint, _id {kind}, n int, {', '.join(f'{w} bigint' for w in words)}")
        a, b = (keyed.select("key", F.col("_id").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(w).alias(f"{w}_{x}") for w in words)) for x in "ab")
        unequal = " + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words)
        near = f"a < b and least(n_a, n_b) >= {t} * greatest(n_a, n_b) - 1e-9 and {unequal} <= {PERMUTATIONS - least}"
        # a sort-merge join: estimates of small inputs must not lead to a broadcast of all bands. Both sides are one exchange right below
        # it, so that adaptive execution can split a hot band over tasks
        with partitions_for(df.sparkSession, ids.count() * m * (20 + 8 * len(words)) * 2):
            cand = cut(a.hint("merge").join(b.hint("merge"), "key").where(near).select("a", "b").distinct())
    need = cut(cand.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    texts = cut(rows.join(small(need), "_id", "left_semi").groupBy("_id").agg(F.first("_t").alias("_t")))
    both = spread(cand, "a").join(texts.select(F.col("_id").alias("a"), F.col("_t").alias("ta")), "a").join(texts.select(F.col("_id").alias("b"), F.col("_t").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            once = dict(zip([*x["a"], *x["b"]], [*x["ta"], *x["tb"]]))  # a text has many candidates
            grams = dict(zip(once, gram_hashes(list(once.values()))))
            ga, gb = [grams[i] for i in x["a"]], [grams[i] for i in x["b"]]
            n = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(ga, gb)]
            s = np.array([k / (len(p) + len(q) - k) for k, p, q in zip(n, ga, gb)])
            yield x.assign(similarity=s)[s >= t][["a", "b", "similarity"]]

    return both.mapInPandas(verify, f"a {kind}, b {kind}, similarity double")


def near_classes(df: DataFrame, id_col: str, text: str, t: float = NEAR) -> DataFrame:
    """(id, class_id, copies, links): each row's near-duplicate class, with its exact copies and its class's links."""
    links = cut(near_links(df, id_col, text, t))
    group = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    member = text_classes(df.where(shown(F.col(text))), id_col, F.col(text)).withColumnRenamed("class_id", "rep")
    out = member.join(degree, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    return out.select(id_col, F.coalesce("component", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def _greedy_dropped(early: np.ndarray, late: np.ndarray) -> list:
    """The ends dropped by going through the ids of these edges in ascending order."""
    by = np.argsort(late, kind="stable")
    gone: set = set()
    for e, x in zip(early[by].tolist(), late[by].tolist()):  # whether an id is kept is known before it is an earlier end
        if x not in gone and e not in gone:
            gone.add(x)
    return list(gone)


def greedy_keep(ids: DataFrame, links: DataFrame, id_col: str, a: str = "a", b: str = "b", local_edges: int = 1_000_000, rounds: int = 16) -> DataFrame:
    """The ids kept by going through them in ascending order and dropping those linked to a kept earlier one.

    Connected components decide for themselves: each one of at most ``local_edges`` edges is solved in one task. Larger ones
    go through ``rounds`` of a fixed point over edges (an id is kept as soon as no undecided earlier neighbour is left, and drops
    its later neighbours), which take decided ids away, and are split into components again, until nothing is left.
    """
    e = cut(links.select(F.least(a, b).alias("early"), F.greatest(a, b).alias("late")).where("early <> late").distinct())
    kind = dict(e.dtypes)["late"]
    dropped = None

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({id_col: _greedy_dropped(g["early"].to_numpy(), g["late"].to_numpy())})

    while not e.isEmpty():
        tagged = cut(e.join(components(e, "early", "late").withColumnRenamed("node", "early"), "early"))
        fits = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= local_edges).select("component")
        out = cut(tagged.join(fits, "component", "left_semi").groupBy("component").applyInPandas(solve, f"{id_col} {kind}"))
        dropped = out if dropped is None else dropped.union(out)
        e = cut(tagged.join(fits, "component", "left_anti").select("early", "late"))
        for _ in range(rounds):
            if e.isEmpty():
                break
            late = e.select(F.col("late").alias("early")).distinct()
            free = e.select("early").distinct().join(late, "early", "left_anti")  # no earlier neighbour left: kept
            out = cut(e.join(free, "early", "left_semi").select(F.col("late").alias(id_col)).distinct())
            dropped = dropped.union(out)
            gone = out.select(F.col(id_col).alias("x"))
            e = cut(e.join(free, "early", "left_anti").join(gone, F.col("late") == F.col("x"), "left_anti").join(gone, F.col("early") == F.col("x"), "left_anti"))
    return ids if dropped is None else ids.join(dropped, id_col, "left_anti")


def cosine_links(df: DataFrame, id_col: str, vector: str, t: float = 0.92, group: Sequence[str] = (), rows: int = 4096) -> DataFrame:
    """(a, b, cosine) with a < b of the same group and cosine at least ``t``; exact.

    Angles obey the triangle inequality: two vectors within acos(t) of each other have angles to any pivot that differ by no
    more. Within a group, rows are cut into shells by their angle to the mean direction, and by hash into tiles of about ``rows``
    rows; tiles of shells within reach meet, and two tiles are compared by one matrix product in one task. Null and zero
    vectors take no part.
    """
    by = list(group)
    src = df.where((F.size(vector) > 0) & (P.norm2(F.col(vector)) > 0))
    u = cut(src.select(F.col(id_col).alias("_id"), *by, (F.to_json(F.struct(*by)) if by else F.lit("")).alias("_g"), P.unit(F.col(vector)).alias("_v")))
    kinds = dict(u.dtypes)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for key, g in b.groupby("_g"):
                total[key] = total.get(key, 0) + np.array(g["_v"].tolist(), dtype=float).sum(axis=0)
        yield pd.DataFrame({"_g": list(total), "m": list(total.values())})

    mean = u.select("_g", "_v").mapInPandas(sums, "_g string, m array<double>").select("_g", F.posexplode("m").alias("p", "x")).groupBy("_g", "p").agg(F.sum("x").alias("x"))
    mean = mean.groupBy("_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("_m"))
    angle = F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), P.dot(F.col("_v"), P.unit(F.col("_m")))))), F.lit(0.0))
    turned = cut(u.join(mean, "_g").withColumn("_a", angle).drop("_m"))
    n = turned.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_a", [i / 64 for i in range(1, 64)], 4096).alias("q"))
    step = F.greatest(F.lit(1), F.floor(64 * rows / F.col("n")))  # as many shells as there are tiles, 64 at most
    shells = n.select("_g", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % step == 0)).alias("cuts"))
    placed = turned.join(shells, "_g").withColumn("_s", F.size(F.filter("cuts", lambda c: c < F.col("_a")))).drop("cuts")
    size = cut(placed.groupBy("_g", "_s").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_of"), F.min("_a").alias("lo"), F.max("_a").alias("hi")))
    tiles = size.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")
    reach = math.acos(min(1.0, max(-1.0, t))) + 1e-9
    x, y = (tiles.select("_g", *(F.col(c).alias(f"{c}{k}") for c in ("_s", "_t", "lo", "hi"))) for k in (1, 2))
    # one row per tile: their pairs are the products to be made
    grid = cut(x.join(y, "_g").where(F.struct("_s1", "_t1") <= F.struct("_s2", "_t2")).where(f"lo2 - hi1 <= {reach}").select("_g", "_s1", "_t1", "_s2", "_t2").withColumn("_pair", F.monotonically_increasing_id()))
    ends = grid.select("_g", "_pair", F.lit(0).alias("_side"), F.col("_s1").alias("_s"), F.col("_t1").alias("_t")).union(grid.select("_g", "_pair", F.lit(1), "_s2", "_t2"))
    met = placed.join(size.select("_g", "_s", "_of"), ["_g", "_s"]).withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_of")).cast("int")).join(ends, ["_g", "_s", "_t"]).select("_pair", "_side", "_id", *by, "_v")

    def products(g: pd.DataFrame) -> pd.DataFrame:
        p, q = g[g["_side"] == 0], g[g["_side"] == 1]
        if p.empty or q.empty:
            return pd.DataFrame({c: [] for c in [*by, "a", "b", "cosine"]})
        v, w = np.array(p["_v"].tolist()), np.array(q["_v"].tolist())
        i, j = np.nonzero(v @ w.T >= t - 1e-9)
        a, b, cos = p["_id"].to_numpy()[i], q["_id"].to_numpy()[j], np.einsum("ij,ij->i", v[i], w[j])
        ok = (a != b) & (cos >= t)
        out = pd.DataFrame({"a": np.where(a < b, a, b)[ok], "b": np.where(a < b, b, a)[ok], "cosine": cos[ok]})
        for c in by:
            out[c] = g[c].iloc[0]
        return out[[*by, "a", "b", "cosine"]]

    keys = "".join(f"{c} {kinds[c]}, " for c in by)
    links = met.groupBy("_pair").applyInPandas(products, f"{keys}a {kinds['_id']}, b {kinds['_id']}, cosine double")
    return links.groupBy(*by, "a", "b").agg(F.max("cosine").alias("cosine"))  # a tile that meets itself has both orders


def neighbour_share(df: DataFrame, id_col: str, vector: str, t: float, group: Sequence[str]) -> DataFrame:
    """Per group: the share of rows whose nearest other row has a cosine of at least ``t``; null for single rows."""
    links = cosine_links(df, id_col, vector, t, group)
    near = links.select(*group, F.explode(F.array("a", "b")).alias("x")).groupBy(*group).agg(F.countDistinct("x").alias("near"))
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return n.join(near, list(group), "left").select(*group, "n", F.when(F.col("n") > 1, F.coalesce("near", F.lit(0)) / F.col("n")).alias("share"))


def vendi_score(df: DataFrame, vector: str, group: Sequence[str]) -> DataFrame:
    """The exponential entropy of the eigenvalues of the cosine kernel per group.

    The kernel of n vectors of d dimensions has the eigenvalues of their d x d second moment matrix, which is
    a sum over rows: moments are aggregated per task and only d x d numbers meet.
    """
    u = df.select(*group, P.unit(F.col(vector)).alias("_v")).where("_v is not null")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for b in batches:
            for key, g in b.groupby(list(group), dropna=False):
                v = np.array(g["_v"].tolist(), dtype=float)
                s = sums.setdefault(key, [0, 0])
                s[0] += len(v)
                s[1] = s[1] + v.T @ v
        yield pd.DataFrame([(*k, n, m.ravel()) for k, (n, m) in sums.items()], columns=[*group, "n", "m"])

    kinds = dict(u.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in group)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        n = g["n"].sum()
        m = sum(np.array(x) for x in g["m"]) / n
        d = math.isqrt(len(m))
        e = np.clip(np.linalg.eigvalsh(m.reshape(d, d)), 0, None)
        e = e[e > 1e-12]
        return pd.DataFrame([[*g[list(group)].iloc[0], n, float(np.exp(-(e * np.log(e)).sum()))]], columns=[*group, "n", "vendi"])

    return u.mapInPandas(moments, f"{schema}, n bigint, m array<double>").groupBy(*group).applyInPandas(score, f"{schema}, n bigint, vendi double")
