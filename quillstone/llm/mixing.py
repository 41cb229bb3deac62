"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded selection.

A document's text may stand in several sources. Texts are grouped by the set of sources that hold
them, their *pattern*; of the copies of a text within a source the first stands there, the others form a
pattern of that source alone. Tokens are aggregated by pattern, and the flow routes them to source quotas.
A source may take each text of a pattern ``max_repeats`` times. Every further use of the same text, in
whatever source, costs more than the one before (layers of a convex cost, as many as there can be uses),
and copies cost more than any first use, so no text is taken twice while others are left. Quotas that
cannot be filled leave residual capacity to the sink: the sources that fall short.

Only the pattern table reaches the driver: at most one row per set of target sources that occurs. Selection
follows the flow: the texts of a pattern lie on a ring in the order of a seeded hash, sources take
consecutive arcs of the lengths that the flow gives them, and a text is taken by a source as often as its
arc passes the text's place. Places are running token sums, made of a sum per hash bucket and one within
the bucket, a ``BUCKETS``-th of a pattern.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.tokens import clean_name, token_count
from quillstone.session import cut

BUCKETS = 1 << 15
#: Marks the patterns of copies within a source.
_COPY = "\x00copies"


def min_cost_flow(edges: list[tuple], source, sink) -> dict[tuple, float]:
    """Flow per edge (u, v, key) of a maximum flow of least cost; ``edges`` are (u, v, key, capacity, cost >= 0).

    Successive shortest paths with potentials; capacities are real numbers.
    """
    nodes = {n: i for i, n in enumerate(dict.fromkeys([source, sink, *(x for e in edges for x in e[:2])]))}
    graph: list[list[list]] = [[] for _ in nodes]
    refs = {}
    for u, v, key, cap, cost in edges:
        a, b = nodes[u], nodes[v]
        graph[a].append([b, float(cap), float(cost), len(graph[b])])
        graph[b].append([a, 0.0, -float(cost), len(graph[a]) - 1])
        refs[u, v, key] = (a, len(graph[a]) - 1, float(cap))
    eps = 1e-9 * max([1.0, *(c for *_, c, _ in edges if c != float("inf"))])
    s, t = nodes[source], nodes[sink]
    height = [0.0] * len(nodes)
    while True:
        dist = [float("inf")] * len(nodes)
        via: list[tuple[int, int] | None] = [None] * len(nodes)
        dist[s] = 0.0
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u] + 1e-12:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                n = d + cost + height[u] - height[v]
                if cap > eps and n < dist[v] - 1e-12:
                    dist[v], via[v] = n, (u, k)
                    heapq.heappush(heap, (n, v))
        if via[t] is None:
            break
        height = [h + (d if d < float("inf") else 0.0) for h, d in zip(height, dist)]
        push, v = float("inf"), t
        while v != s:
            u, k = via[v]  # type: ignore[misc]
            push, v = min(push, graph[u][k][1]), u
        v = t
        while v != s:
            u, k = via[v]  # type: ignore[misc]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return {key: cap - graph[a][k][1] for key, (a, k, cap) in refs.items()}


class Mixture:
    """A planned mixture: ``report`` and ``selection`` are lazy DataFrames."""

    def __init__(self, docs: DataFrame, targets: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str = "weight", max_repeats: str = "max_repeats", seed: int = 7):
        """Plan the mixture of ``docs`` for the rows of ``targets`` (source, weight, max_repeats).

        Sizes are tokens under the vocabulary file ``path``; the total is that of all documents of the
        target sources. Null ids, null sources and sources without a target take no part, null texts have no tokens,
        repeated rows count once, repeated target rows count once (the greatest weight), null weights are 0 and null repeats 1.
        A source without documents falls short if its weight is above 0. Empty tables give empty results.
        """
        self.spark, self.doc_id, self.seed = docs.sparkSession, doc_id, seed
        wanted = targets.select(F.col(source).alias("name"), clean_name(F.col(source)).alias("source"), F.coalesce(F.col(weight), F.lit(0.0)).alias("weight"), F.coalesce(F.col(max_repeats), F.lit(1)).alias("max_repeats"))
        best = {}
        for r in wanted.where("source is not null").collect():
            if r["source"] not in best or (r["weight"], r["max_repeats"]) > (best[r["source"]]["weight"], best[r["source"]]["max_repeats"]):
                best[r["source"]] = r
        self.targets = best
        names = list(best)
        rows = docs.select(F.col(doc_id).alias("_d"), clean_name(F.col(source)).alias("source"), F.col(text).alias("_t")).where(F.col("source").isin(names))
        # a null text is a text without tokens
        rows = cut(rows.where("_d is not null").select("_d", "source", F.coalesce(token_count(F.col("_t"), path), F.lit(0)).alias("tokens"), F.xxhash64("_t").alias("th"), F.xxhash64(F.lit(1), "_t").alias("th2")).distinct())
        held = rows.groupBy("th", "th2", "source").agg(F.min("_d").alias("first"))
        texts = held.groupBy("th", "th2").agg(F.array_join(F.sort_array(F.collect_set("source")), "\n").alias("pattern"), F.collect_list(F.struct("source", "first")).alias("firsts"))
        first = texts.select("th", "th2", "pattern", F.inline("firsts"))
        rows = rows.join(first, ["th", "th2", "source"])
        self.rows = cut(rows.select("_d", "source", "tokens", "th", "th2", F.when(F.col("_d") == F.col("first"), F.col("pattern")).otherwise(F.concat("source", F.lit(_COPY))).alias("pattern")))
        # every source of a pattern holds each of its texts once
        cells = self.rows.groupBy("pattern", "source").agg(F.sum("tokens").alias("tokens")).collect()
        self.cells = {(r["pattern"], r["source"]): r["tokens"] for r in cells}
        self.total = sum(self.cells.values())
        self.flow, self.left = self._route()

    def _route(self) -> tuple[dict[tuple[str, str], float], dict[str, float]]:
        """Tokens by (pattern, source), and what the quota of each source lacks."""
        times = {s: max(0, r["max_repeats"]) for s, r in self.targets.items()}
        uses: dict[str, int] = {}
        for p, s in self.cells:
            uses[p] = uses.get(p, 0) + times[s]
        once = {p: t for (p, _), t in self.cells.items()}
        above = 2 * max(uses.values(), default=0)  # what copies cost more than any first use
        edges = [(("p", p), ("s", s), 0, t * times[s], 0) for (p, s), t in self.cells.items()]
        for p, n in uses.items():
            edges += [("from", ("p", p), k, once[p], 2 * k - 1 + above * p.endswith(_COPY)) for k in range(1, n + 1)]
        edges += [(("s", s), "to", 0, r["weight"] * self.total, 0) for s, r in self.targets.items()]
        flow = min_cost_flow(edges, "from", "to")
        to = {u[1]: f for (u, v, _), f in flow.items() if v == "to"}
        return {(u[1], v[1]): f for (u, v, _), f in flow.items() if u[0] == "p"}, {s: r["weight"] * self.total - to[s] for s, r in self.targets.items()}

    def report(self) -> DataFrame:
        """(source, weight, quota, available, taken, share, repeats, short): one row per target source.

        ``repeats`` is the mean number of times that a token of the source is taken; ``share`` refers to what all
        sources take together; ``short`` says that the flow leaves capacity to the sink: even ``max_repeats`` uses
        of everything do not fill the quota.
        """
        out = []
        all_taken = sum(self.flow.values())
        for s, r in self.targets.items():
            have = sum(t for (_, x), t in self.cells.items() if x == s)
            quota = r["weight"] * self.total
            taken = sum(f for (_, x), f in self.flow.items() if x == s)
            short = self.left[s] > 1e-9 * max(1.0, self.total) or (not have and r["weight"] > 0)
            out.append((r["name"], float(r["weight"]), float(quota), have, float(taken), taken / all_taken if all_taken else 0.0, taken / have if have else 0.0, short))
        return self.spark.createDataFrame(out, "source string, weight double, quota double, available bigint, taken double, share double, repeats double, short boolean")

    def selection(self) -> DataFrame:
        """(doc_id, source, repeats): how often each document is taken, 0 for none."""
        plan, start = [], {}
        for (p, s), f in sorted(self.flow.items()):
            if t := self.cells[p, s]:
                lo = start.get(p, 0.0)
                start[p] = lo + f
                plan.append((p, s, lo / t, (lo + f) / t))
        arcs = self.spark.createDataFrame(plan, "pattern string, source string, lo double, hi double")
        shown = lambda c: F.xxhash64(*c, F.lit(self.seed))
        copies = F.col("pattern").endswith(_COPY)
        # a copy is a place of its own, the rows of other patterns share the place of their text
        rows = self.rows.withColumn("_h", F.when(copies, shown([F.col("_d"), F.lit(1)])).otherwise(shown([F.col("th"), F.col("th2")])))
        rows = rows.withColumn("_k", F.when(copies, F.col("_d").cast("string")).otherwise(F.concat_ws(" ", "th", "th2"))).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
        places = rows.groupBy("pattern", "_b", "_h", "_k").agg(F.first("tokens").alias("n"))
        sums = places.groupBy("pattern", "_b").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select("pattern", "_b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
        within = Window.partitionBy("pattern", "_b").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, -1)
        total = sums.groupBy("pattern").agg(F.sum("n").alias("_total"))
        places = places.withColumn("_at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["pattern", "_b"]).join(total, "pattern")
        places = places.select("pattern", "_k", ((F.col("_before") + F.col("_at")) / F.col("_total")).alias("at"))
        rows = rows.join(places, ["pattern", "_k"]).join(arcs, ["pattern", "source"], "left")
        turns = F.ceil(F.col("hi") - F.col("at") - 1e-12) - F.ceil(F.col("lo") - F.col("at") - 1e-12)
        return rows.select(F.col("_d").alias(self.doc_id), "source", F.coalesce(turns, F.lit(0)).cast("int").alias("repeats"))
