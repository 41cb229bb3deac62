"""Corpus preparation: logs, filters, duplicates, overlap, caps, samples and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import adapters as A
from quillstone.operators import contam as C
from quillstone.operators import dedup as D
from quillstone.operators import pairing as J
from quillstone.operators import policies as L
from quillstone.operators import quality as Q
from quillstone.operators import sampling as S
from quillstone.plans.text import SQL_STRINGS, sql_links, sql_norm
from quillstone.session import shared_dir, table
from quillstone.streaming import batches as B

SEED = 20260927


def latest_log(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "report").select("item_id", "src", "status", "attempts", "created_at", "received_at")
    return Q.latest(r, ["item_id"], ["created_at", "received_at", "attempts", "status", "src"]).select("item_id", "status", "attempts")


def grouped_counts(s: SparkSession, d: str) -> DataFrame:
    c = Q.counts(table(s, d, "verify").select("suite", "type", "split"), [["suite"], ["type"], ["suite", "split"], []])
    return c.select("suite", "type", "split", "n")


def acceptance_rates(s: SparkSession, d: str) -> DataFrame:
    a = Q.acceptance(table(s, d, "report"), ["task", "domain"], F.col("status") == "ok", F.col("attempts"))
    return a.select("attribute", "value", "attempts", "accepted", F.round("rate", 9).alias("rate"))


def acceptance_tree(s: SparkSession, d: str) -> DataFrame:
    last = Q.latest(table(s, d, "report").select("item_id", "task", "domain", "status", "created_at", "received_at", "attempts"), ["item_id"], ["created_at", "received_at", "attempts", "status", "domain", "task"])
    return last.groupBy("task", "domain").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "ok").alias("accepted"), F.round(F.avg((F.col("status") == "ok").cast("double")), 9).alias("rate"))


def rejection_reasons(s: SparkSession, d: str) -> DataFrame:
    return Q.reasons(table(s, d, "report"), "reason", ["task"])


def exact_classes(s: SparkSession, d: str) -> DataFrame:
    return D.text_classes(table(s, d, "documents"), "doc_id", F.col("text"))


def first_copies(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "state", "instructions")
    return D.keep_first(v, [X.norm(F.col("state")), F.col("instructions")], ["item_id"]).select("item_id")


def near_classes(s: SparkSession, d: str) -> DataFrame:
    return D.near_classes(table(s, d, "documents"), "doc_id", "text")


def greedy_kept(s: SparkSession, d: str) -> DataFrame:
    """Documents kept when near-duplicates of kept earlier ones are dropped, exact copies first."""
    docs = table(s, d, "documents").select("doc_id", "text")
    ids = D.text_classes(docs, "doc_id", F.col("text")).select(F.col("class_id").alias("doc_id")).distinct()
    return D.greedy_keep(ids, D.near_links(docs, "doc_id", "text"), "doc_id")


def similar_vectors(s: SparkSession, d: str) -> DataFrame:
    e = D.cosine_links(table(s, d, "embeddings"), "vec_id", "embedding", 0.3, ["label"])
    return e.select("label", "a", "b", F.round("cosine", 6).alias("cosine"))


def neighbour_shares(s: SparkSession, d: str) -> DataFrame:
    return D.neighbour_share(table(s, d, "embeddings"), "vec_id", "embedding", 0.3, ["label"]).select("label", "n", F.round("share", 9).alias("share"))


def vendi_scores(s: SparkSession, d: str) -> DataFrame:
    return D.vendi_score(table(s, d, "embeddings"), "embedding", ["label"]).select("label", "n", F.round("vendi", 6).alias("vendi"))


def unseen_documents(s: SparkSession, d: str) -> DataFrame:
    return C.exclude_texts(table(s, d, "documents"), "text", table(s, d, "benchmark"), "text").select("doc_id")


def contained_passages(s: SparkSession, d: str) -> DataFrame:
    return C.contained(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text")


def shared_shingles(s: SparkSession, d: str) -> DataFrame:
    return C.shared_shingles(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text")


def nested_overlap(s: SparkSession, d: str) -> DataFrame:
    held = table(s, d, "verify").where("split in ('dev', 'test')").select(F.explode(X.nested_strings(F.col("state"))).alias("text"))
    train = table(s, d, "verify").where("split = 'train'").select("item_id", "state")
    return C.nested_overlap(train, "item_id", "state", held, "text")


def capped_seeds(s: SparkSession, d: str) -> DataFrame:
    """No seed key keeps more than a fiftieth of its suite."""
    v = table(s, d, "verify").select("item_id", "suite", "seed_key")
    return S.cap_share(v, ["suite"], "seed_key", 0.02, "item_id", SEED)


def round_robin_sample(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "suite", "gold", "split").where("split = 'test' and gold is not null")
    return S.round_robin(v, ["suite", "gold"], 100, "item_id", SEED).select("item_id", "suite", "gold")


def spot_checks(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "suite", "lang")
    return S.per_group(v, ["suite", "lang"], 5, "item_id", SEED)


def offset_rows(s: SparkSession, d: str) -> DataFrame:
    return S.offset_sample(table(s, d, "verify").select("item_id", "suite"), ["item_id"], 100, SEED)


def block_rows(s: SparkSession, d: str) -> DataFrame:
    return S.block_sample(table(s, d, "verify").select("item_id"), ["item_id"], 200, 4)


def spread_rows(s: SparkSession, d: str) -> DataFrame:
    return S.spread_sample(table(s, d, "verify").select("item_id"), ["item_id"], 70)


def apportioned_suites(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "verify").groupBy("suite").agg(F.count(F.lit(1)).alias("n"))
    return S.apportion(n, ["suite"], "n", 997).select("suite", "n", "quota")


def budget_plan(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.temperature_budget(n, ["source"], "n", 2000, 3.0)


def resampled_sources(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("source is not null").select("doc_id", "source")
    return S.resample(rows, budget_plan(s, d), ["source"], "doc_id", SEED)


def dev_split(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "suite", "state")
    return S.split_dev(v, "suite", X.norm(F.col("state")), 0.1, SEED).select("item_id", "split")


def leak_free_split(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "state")
    return S.drop_leaked(v, 300, ["item_id"], X.norm(F.col("state"))).select("item_id", "split")


def parallel_suites(s: SparkSession, d: str) -> DataFrame:
    """Suites with metrics of both models in the same ten languages or more."""
    c = table(s, d, "categories_multilingual").select("suite", "model").distinct()
    return S.common_keys(c, "suite", "model", 2)


def known_families(s: SparkSession, d: str) -> DataFrame:
    fam = s.createDataFrame([("synth-v1",), ("synth-v1/topic",), ("web-form",), ("human-notes",)], "family string")
    r = table(s, d, "report").select("src")
    return L.one_family(r, "src", fam).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def allowed_sources(s: SparkSession, d: str) -> DataFrame:
    bad = s.createDataFrame([("synth-v0",), ("desk-archive/mail",)], "prefix string")
    r = L.exclude_prefixes(table(s, d, "report").select("src", "status"), "src", bad)
    return r.where(~F.coalesce(L.excluded_source(F.col("src"), ["pilot", "partner"]), F.lit(False))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def valid_items(s: SparkSession, d: str) -> DataFrame:
    keys = F.transform("options", lambda o: o["key"])
    target = F.transform("options", lambda o: (o["key"] == F.col("gold")).cast("double"))
    ok = L.valid_item(F.col("state"), F.col("type"), keys, target)
    return table(s, d, "verify").groupBy("suite").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(L.trivial(F.col("state"))).alias("trivial"))


def agreement(s: SparkSession, d: str) -> DataFrame:
    a = L.agrees(F.col("type"), F.col("gold"), F.col("answer"), F.col("options"))
    return table(s, d, "verify").groupBy("suite", "type").agg(F.count_if(a).alias("agrees"), F.count_if("agree").alias("recorded"))


def adapted_items(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark")
    i = A.classification(b, "text", ["suite"], "benchmark").unionByName(A.always(b, "text", "Is it a note?", "benchmark"))
    best = F.get(F.col("options"), F.array_position("target", F.lit(1.0)).cast("int") - 1)
    return i.groupBy("qtype", "lang", best.alias("gold")).agg(F.count(F.lit(1)).alias("n"))


def half_offset_pairs(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark").select("suite", "item_id")
    return J.half_offset_pairs(b, ["suite"], ["item_id"], "item_id")


def foreign_contexts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark").select("suite", F.col("item_id").alias("question"), F.col("item_id").alias("passage"))
    return J.foreign_contexts(b, "suite", "question", "passage", ["passage"])


def source_classes(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "documents").select("source")
    t = table(s, d, "mix_targets").select("source")
    a = J.source_accounting(v.withColumnRenamed("source", "src"), "src", t.where("source like 'r%'"), t)
    return a.groupBy("class").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    w = B.windowed_metrics(table(s, d, "events"), "ts", ["event_type"], "value", "1 day")
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


def streamed_events(s: SparkSession, d: str) -> DataFrame:
    """The same windows as a stream over the files of the table, run to the end of what is there."""
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    w = B.windowed_metrics(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 day")
    at = f"{shared_dir(s)}/streamed-{uuid.uuid4().hex}"
    q = w.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")).outputMode("complete").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/rows").select("start", "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


def permissive_licences(s: SparkSession, d: str) -> DataFrame:
    """Which licence lists, made of the names of the items' suites, an allow-list admits."""
    v = table(s, d, "verify").select(F.concat_ws(", ", F.upper("suite"), "type").alias("licence"))
    return v.where(L.permissive(F.col("licence"), ["topic", "intent", "safety", "choice"])).groupBy("licence").agg(F.count(F.lit(1)).alias("n"))


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return B.sessions(table(s, d, "events"), "ts", ["user_id"], "2 hours").select("user_id", "start", "events")




def _h(*cols: str) -> str:
    return "sha256('" + str(SEED) + "' || chr(10) || " + " || chr(10) || ".join(f"{c}::VARCHAR" for c in cols) + ")"


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, received_at DESC, attempts DESC, status DESC NULLS LAST{more}) AS rn FROM (SELECT DISTINCT item_id, {cols} FROM report)) WHERE rn = 1"
_PREFIX = "(src = p OR starts_with(src, p || '/'))"

ALL = {
    "latest_log": (latest_log, "SELECT item_id, status, attempts FROM (" + _LAST.format(cols="src, status, attempts, created_at, received_at", more=", src DESC NULLS LAST") + ")"),
    "grouped_counts": (grouped_counts, "SELECT suite, type, split, count(*) AS n FROM verify GROUP BY GROUPING SETS ((suite), (type), (suite, split), ())"),
    "acceptance_rates": (acceptance_rates, "SELECT attribute, value, sum(attempts)::BIGINT AS attempts, count(*) FILTER (WHERE status = 'ok') AS accepted, round(count(*) FILTER (WHERE status = 'ok') / sum(attempts), 9) AS rate FROM (SELECT 'task' AS attribute, task AS value, attempts, status FROM report UNION ALL SELECT 'domain', domain, attempts, status FROM report) WHERE value IS NOT NULL GROUP BY ALL"),
    "acceptance_tree": (acceptance_tree, "SELECT task, domain, count(*) AS items, count(*) FILTER (WHERE status = 'ok') AS accepted, round(avg((status = 'ok')::INT::DOUBLE), 9) AS rate FROM (" + _LAST.format(cols="task, domain, status, created_at, received_at, attempts", more=", domain DESC NULLS LAST, task DESC NULLS LAST") + ") GROUP BY task, domain"),
    "rejection_reasons": (rejection_reasons, "SELECT task, reason, count(*) AS n FROM report WHERE reason IS NOT NULL GROUP BY ALL"),
    "exact_classes": (exact_classes, f"SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY {sql_norm('text')})"),
    "first_copies": (first_copies, f"SELECT min(item_id) AS item_id FROM verify GROUP BY {sql_norm('state')}, instructions"),
    "near_classes": (near_classes, f"WITH RECURSIVE {sql_links('SELECT doc_id AS id, ' + sql_norm('text') + ' AS t FROM documents WHERE text IS NOT NULL', 0.8)}, w AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), walk(node, root) AS (SELECT id, id FROM d UNION SELECT w.b, walk.root FROM walk JOIN w ON w.a = walk.node), c AS (SELECT node, min(root) AS root FROM walk GROUP BY node), e AS (SELECT a, count(*) AS links FROM w GROUP BY a) SELECT doc_id, c.root AS class_id, count(*) OVER (PARTITION BY d.id) AS copies, coalesce(e.links, 0) AS links FROM documents x JOIN d ON d.t = {sql_norm('x.text')} JOIN c ON c.node = d.id LEFT JOIN e ON e.a = d.id"),
    "greedy_kept": (greedy_kept, f"WITH RECURSIVE {sql_links('SELECT doc_id AS id, ' + sql_norm('text') + ' AS t FROM documents WHERE text IS NOT NULL', 0.8)}, e AS (SELECT b AS id, list(a) AS early FROM l GROUP BY b), v AS (SELECT a AS id FROM l UNION SELECT b FROM l), n AS MATERIALIZED (SELECT v.id, coalesce(e.early, []) AS early, row_number() OVER (ORDER BY v.id) AS pos FROM v LEFT JOIN e ON e.id = v.id), walk(pos, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.pos, CASE WHEN len(list_intersect(kept, n.early)) = 0 THEN list_append(kept, n.id) ELSE kept END FROM walk JOIN n ON n.pos = walk.pos + 1), w AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY pos DESC LIMIT 1)) SELECT id AS doc_id FROM d WHERE id NOT IN (SELECT id FROM n) OR id IN (SELECT id FROM w)"),
    "similar_vectors": (similar_vectors, "SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3"),
    "neighbour_shares": (neighbour_shares, "WITH l AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3), k AS (SELECT label, count(DISTINCT a) AS near FROM l GROUP BY label) SELECT e.label, count(*) AS n, round(CASE WHEN count(*) > 1 THEN coalesce(max(near), 0) / count(*) END, 9) AS share FROM embeddings e LEFT JOIN k ON k.label = e.label GROUP BY e.label"),
    "vendi_scores": (vendi_scores, None),
    "unseen_documents": (unseen_documents, f"SELECT doc_id FROM documents WHERE {sql_norm('text')} NOT IN (SELECT {sql_norm('text')} FROM benchmark)"),
    "contained_passages": (contained_passages, f"WITH d AS (SELECT doc_id, {sql_norm('text')} AS t FROM documents), b AS (SELECT item_id, {sql_norm('text')} AS u FROM benchmark) SELECT doc_id, item_id, CASE WHEN t = u THEN 'exact' ELSE 'contains' END AS kind FROM d, b WHERE t = u OR (length(u) >= 80 AND length(t) >= 24 AND (contains(t, u) OR contains(u, t)))"),
    "shared_shingles": (shared_shingles, f"WITH n AS (SELECT 1 AS k, doc_id AS id, {sql_norm('text')} AS t FROM documents UNION ALL SELECT 2, item_id, {sql_norm('text')} FROM benchmark), w AS (SELECT k, id, t, string_split(t, ' ') AS w FROM n), g AS (SELECT k, id, unnest(list_distinct(list_concat(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [] END, CASE WHEN len(w) < 8 OR regexp_matches(t, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]') THEN list_transform(range(1, length(t) - 18), lambda i: substring(t, i, 20)) ELSE [] END))) AS s FROM w) SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g a JOIN g b ON a.s = b.s WHERE a.k = 1 AND b.k = 2 GROUP BY ALL"),
    "nested_overlap": (nested_overlap, f"WITH s AS {SQL_STRINGS}, n AS (SELECT item_id, split, {sql_norm('s')} AS t FROM s), b AS (SELECT DISTINCT t FROM n WHERE split IN ('dev', 'test')) SELECT item_id, count(*) AS strings FROM n WHERE split = 'train' AND length(t) >= 30 AND t IN (SELECT t FROM b) GROUP BY item_id"),
    "capped_seeds": (capped_seeds, f"WITH c AS (SELECT item_id, suite, seed_key, count(*) OVER (PARTITION BY suite) AS n, count(*) OVER (PARTITION BY suite, seed_key) AS c, row_number() OVER (PARTITION BY suite, seed_key ORDER BY {_h('suite', 'item_id')}, item_id) AS r FROM verify), k AS (SELECT suite, count(DISTINCT seed_key) AS k FROM verify GROUP BY suite) SELECT item_id, c.suite, seed_key FROM c JOIN k ON k.suite = c.suite WHERE k = 1 OR r <= greatest(1, floor(n * 0.02 + 1e-9))"),
    "round_robin_sample": (round_robin_sample, f"WITH r AS (SELECT item_id, suite, gold, row_number() OVER (PARTITION BY suite, gold ORDER BY {_h('item_id')}, item_id) AS r FROM verify WHERE split = 'test' AND gold IS NOT NULL) SELECT item_id, suite, gold FROM r ORDER BY r, suite, gold LIMIT 100"),
    "spot_checks": (spot_checks, f"SELECT item_id, suite, lang FROM (SELECT item_id, suite, lang, row_number() OVER (PARTITION BY suite, lang ORDER BY {_h('item_id')}, item_id) AS r FROM verify) WHERE r <= 5"),
    "offset_rows": (offset_rows, f"WITH i AS (SELECT item_id, suite, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM verify), s AS (SELECT *, i * 100 // n AS k, sha256('{SEED}' || chr(10) || (i * 100 // n)::VARCHAR) AS h FROM i), p AS (SELECT *, ceil(k * n / 100)::BIGINT AS lo, ceil((k + 1) * n / 100)::BIGINT AS hi FROM s) SELECT item_id, suite FROM p WHERE n <= 100 OR i = lo + ('0x' || substring(h, 1, 12))::BIGINT % (hi - lo)"),
    "block_rows": (block_rows, "WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM verify) SELECT item_id FROM i WHERE i % greatest(50, n // 4) < 50 AND i // greatest(50, n // 4) < 4"),
    "spread_rows": (spread_rows, "WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM verify) SELECT item_id FROM i WHERE i IN (SELECT k * n // 70 FROM range(70) t(k), (SELECT count(*) AS n FROM verify))"),
    "apportioned_suites": (apportioned_suites, "WITH c AS (SELECT suite, count(*) AS n FROM verify GROUP BY suite), e AS (SELECT suite, n, n * 997 / sum(n) OVER () AS e FROM c), f AS (SELECT *, floor(e) AS f, 997 - sum(floor(e)) OVER () AS l, row_number() OVER (ORDER BY e - floor(e) DESC, suite) AS r FROM e) SELECT suite, n, (f + CASE WHEN r <= l THEN 1 ELSE 0 END)::BIGINT AS quota FROM f"),
    "budget_plan": (budget_plan, "WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), w AS (SELECT source, n, greatest(1, round_even(pow(n, 1.0 / 3) / sum(pow(n, 1.0 / 3)) OVER () * 2000, 0))::BIGINT AS want FROM c) SELECT source, n, want, want // n AS passes, want % n AS rest FROM w"),
    "resampled_sources": (resampled_sources, f"WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), w AS (SELECT source, n, greatest(1, round_even(pow(n, 1.0 / 3) / sum(pow(n, 1.0 / 3)) OVER () * 2000, 0))::BIGINT AS want FROM c), r AS (SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY {_h('doc_id')}, doc_id) AS r, want // n AS p, want % n AS x FROM documents d JOIN w ON w.source = d.source) SELECT doc_id, source, unnest(range(1, p + CASE WHEN r <= x THEN 1 ELSE 0 END + 1))::INT AS pass FROM r"),
    "dev_split": (dev_split, f"WITH k AS (SELECT item_id, suite, sha256({sql_norm('state')}) AS k FROM verify), c AS (SELECT suite, k, count(*) AS c FROM k GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY suite ORDER BY {_h('k')}, k ROWS UNBOUNDED PRECEDING) AS run, sum(c) OVER (PARTITION BY suite) AS n FROM c), dev AS (SELECT DISTINCT k FROM r WHERE run <= floor(n * 0.1)) SELECT item_id, CASE WHEN k IN (SELECT k FROM dev) THEN 'dev' ELSE 'train' END AS split FROM k"),
    "leak_free_split": (leak_free_split, f"WITH r AS (SELECT item_id, {sql_norm('state')} AS k, row_number() OVER (ORDER BY item_id) AS r FROM verify), d AS (SELECT k FROM r WHERE r <= 300) SELECT item_id, CASE WHEN r <= 300 THEN 'dev' ELSE 'train' END AS split FROM r WHERE r <= 300 OR k NOT IN (SELECT k FROM d)"),
    "parallel_suites": (parallel_suites, "SELECT suite FROM categories_multilingual GROUP BY suite HAVING count(DISTINCT model) = 2"),
    "known_families": (known_families, f"WITH f(p) AS (VALUES ('synth-v1'), ('synth-v1/topic'), ('web-form'), ('human-notes')), h AS (SELECT src, min(p) AS family FROM (SELECT DISTINCT src FROM report WHERE src IS NOT NULL) s JOIN f ON {_PREFIX} GROUP BY src HAVING count(*) = 1) SELECT family, count(*) AS n FROM report r JOIN h ON h.src = r.src GROUP BY family"),
    "allowed_sources": (allowed_sources, f"WITH f(p) AS (VALUES ('synth-v0'), ('desk-archive/mail')) SELECT status, count(*) AS n FROM report WHERE (src IS NULL OR NOT regexp_matches(src, '(?i)pilot|partner')) AND NOT coalesce((SELECT bool_or({_PREFIX}) FROM f), false) GROUP BY status"),
    "valid_items": (valid_items, f"WITH a AS (SELECT suite, coalesce(trim(state) <> '' AND type IN ('choice', 'score', 'noul') AND len(options) >= 2 AND len(list_filter(options, lambda o: o.key = gold)) = 1, false) AS ok, {sql_norm('state')} AS t FROM verify) SELECT suite, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid, count(*) FILTER (WHERE length(t) <= 12 OR len(string_split(t, ' ')) <= 2) AS trivial FROM a GROUP BY suite"),
    "agreement": (agreement, "WITH a AS (SELECT suite, type, agree, CASE WHEN type = 'choice' THEN coalesce(answer = gold OR lower(trim(answer)) = lower(trim(gold)) OR (len(list_filter(options, lambda o: lower(o.description) = lower(trim(answer)))) = 1 AND coalesce(list_filter(options, lambda o: lower(o.description) = lower(trim(answer)))[1].key = gold, false)), false) WHEN type = 'noul' THEN coalesce(lower(trim(answer)) = lower(trim(gold)), false) ELSE coalesce(answer = gold, false) END AS ok FROM verify) SELECT suite, type, count(*) FILTER (WHERE ok) AS agrees, count(*) FILTER (WHERE agree) AS recorded FROM a GROUP BY ALL"),
    "adapted_items": (adapted_items, "SELECT 'choice' AS qtype, lang, suite AS gold, count(*) AS n FROM benchmark GROUP BY ALL UNION ALL SELECT 'noul', lang, 'true', count(*) FROM benchmark GROUP BY lang"),
    "half_offset_pairs": (half_offset_pairs, "WITH r AS (SELECT suite, item_id, row_number() OVER (PARTITION BY suite ORDER BY item_id) - 1 AS i, count(*) OVER (PARTITION BY suite) AS n FROM benchmark) SELECT x.suite, x.item_id AS a, y.item_id AS b FROM r x JOIN r y ON x.suite = y.suite AND y.i = (x.i + x.n // 2) % x.n WHERE x.n > 1"),
    "foreign_contexts": (foreign_contexts, "WITH f AS (SELECT suite, min(item_id) AS c, row_number() OVER (ORDER BY suite) AS k, count(*) OVER () AS n FROM benchmark GROUP BY suite) SELECT b.item_id AS question, g.c AS context FROM benchmark b JOIN f ON f.suite = b.suite JOIN f g ON g.k = f.k % f.n + 1"),
    "source_classes": (source_classes, "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT CASE WHEN source IN (SELECT source FROM mix_targets WHERE source LIKE 'r%') THEN 'chosen' WHEN source IN (SELECT source FROM mix_targets) THEN 'other' ELSE 'unknown' END AS class, count(*) AS sources, sum(n)::BIGINT AS n FROM c GROUP BY ALL"),
    "event_windows": (event_windows, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL"),
    "streamed_events": (streamed_events, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL"),
    "permissive_licences": (permissive_licences, "SELECT upper(suite) || ', ' || type AS licence, count(*) AS n FROM verify WHERE suite IN ('topic', 'intent', 'safety') AND type = 'choice' GROUP BY ALL"),
    "event_sessions": (event_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM h GROUP BY user_id, k"),
}
