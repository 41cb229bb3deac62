"""Requests, tokenizers, suites, set operations and adapters over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import probability as P
from quillstone.functions import text as X
from quillstone.functions import tokens as K
from quillstone.functions.languages import CODES, language_code
from quillstone.operators import adapters as A
from quillstone.operators import contam as C
from quillstone.operators import decide as D_
from quillstone.operators import dedup as D
from quillstone.operators import evals as E
from quillstone.operators import pairing as J
from quillstone.operators import policies as L
from quillstone.operators import quality as Q
from quillstone.operators import requests as R
from quillstone.operators import sampling as S
from quillstone.operators import setops as O
from quillstone.operators import suites as U
from quillstone.plans.decisions import QUESTIONS
from quillstone.plans.text import _EN, SHARES, TESTS, _n, _script_sql, sql_links, sql_norm
from quillstone.session import table

SEED = 20261005
def _keys() -> Column:
    return F.transform("options", lambda o: o["key"])


def _bodies(s: SparkSession, d: str) -> DataFrame:
    """Items as requests: choices with their keys as criteria, an ensemble of three and calibration where the text is long."""
    q = F.create_map(F.lit("q"), F.struct("type", "instructions", F.when(F.col("type") != "noul", _keys()).alias("criteria")))
    body = F.to_json(F.struct("state", q.alias("questions"), F.lit(3).alias("ensemble"), (F.length("state") > 400).alias("calibrate"), F.when(F.col("gold").isNull(), F.lit(7)).alias("extra")))
    return table(s, d, "verify").select("item_id", "suite", "type", "state", body.alias("body"))


def parsed_requests(s: SparkSession, d: str) -> DataFrame:
    r = R.parse_requests(_bodies(s, d))
    return r.groupBy("type", "http_status").agg(F.count(F.lit(1)).alias("n"), F.sum("work").alias("work"))


def routed_models(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "verify").select("item_id", F.array("state").alias("states"), F.when(F.col("suite") == "topic", "multilingual").alias("model"), F.when(F.col("type") == "noul", "auto").when(F.col("suite") == "intent", "moods").alias("adapter"), F.when(F.col("suite") == "sarcasm", "emotion").alias("family"))
    models = s.createDataFrame([("english", 0), ("multilingual", 1)], "model string, position int")
    adapters = s.createDataFrame([("multilingual", "moods", 0, ["emotion", "sentiment"])], "model string, adapter string, position int, categories array<string>")
    r = R.route(rows, models, adapters)
    return r.groupBy("served_by", "routing", "served_adapter", "adapter_routing", "refused").agg(F.count(F.lit(1)).alias("n"))


def response_frames(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select(F.col("item_id").alias("request_id"), F.when(F.col("gold").isNotNull(), 200).otherwise(422).alias("http_status"), F.lit("no gold").alias("detail"), F.create_map(F.lit("q"), F.col("type")).alias("answers"))
    return R.responses(v)


def word_piece_counts(s: SparkSession, d: str) -> DataFrame:
    pieces = K.word_pieces(F.col("text"))
    shown = F.filter(pieces, lambda x: x.rlike(r"(?U)\S"))
    whole = F.array_join(pieces, "") == F.col("text")
    return table(s, d, "documents").select("doc_id", F.size(shown).alias("n"), F.aggregate(shown, F.lit(0), lambda a, x: a + F.length(F.trim(x))).alias("characters"), whole.alias("whole"))


def valid_text(s: SparkSession, d: str) -> DataFrame:
    """Texts of which every third has a byte that is no UTF-8 in front."""
    data = F.encode("text", "UTF-8")
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), data)).otherwise(data)
    return table(s, d, "documents").select("doc_id", F.sha2(K.utf8_text(bad), 256).alias("digest"))


def item_tokens(s: SparkSession, d: str) -> DataFrame:
    """Token ids of the items' states under a byte-level vocabulary, at most 96 of them."""
    from public_tokenizers import path

    ids = K.token_ids(F.col("state"), lambda: K.Tokenizer.from_ranks(path("byte_bpe_multi_50k.tiktoken")), 96)
    return table(s, d, "verify").select("item_id", ids.alias("ids")).select("item_id", F.size("ids").alias("n"), F.array_join(F.slice("ids", 1, 8).cast("array<string>"), " ").alias("opening"))


def shared_texts(s: SparkSession, d: str) -> DataFrame:
    return C.shared_texts(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text")


def mixture_order(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "split", "suite")
    parts = {k: v.where(F.col("split") == k) for k in ("dev", "train", "test")}
    return O.mixture(parts, "dev", 40, ["item_id"], "item_id", SEED).select("position", "part", "item_id")


def banned_set(s: SparkSession, d: str) -> DataFrame:
    held = table(s, d, "verify").where("split in ('dev', 'test')")
    return O.banned_texts((table(s, d, "benchmark"), "text"), (held, "state"), (held, "instructions")).select(F.sha2("banned", 256).alias("banned"))


def common_labels(s: SparkSession, d: str) -> DataFrame:
    return O.common_values(table(s, d, "verify").where(F.col("split").isNotNull()), "gold", "split")


def upstream_items(s: SparkSession, d: str) -> DataFrame:
    """Held-out rows of which the training split has the same content and label."""
    v = table(s, d, "verify")
    return O.upstream_rows(v.where("split in ('dev', 'test')"), v.where("split = 'train'"), ["state", "gold"]).select("item_id")


def lineage_faults(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", "suite", "state", "gold", "lang", "split", F.when(F.col("answer").isNull(), 1).alias("redacted"))
    up = v.where("split = 'train'").groupBy("state").agg(F.min("gold").alias("gold"), F.min("suite").alias("suite")).withColumn("id", F.col("state"))
    r = O.lineage(v.where("split <> 'train'").withColumn("id", F.col("state")), up, "id", "state", "gold", "redacted", F.col("lang") == "en", ["positive", "negative", "true", "false", "neutral"])
    return r.groupBy("kept", "fault").agg(F.count(F.lit(1)).alias("n"))


def denied_labels(s: SparkSession, d: str) -> DataFrame:
    n = O.explicit_negatives(F.array("gold"), F.array("answer"), ["positive", "negative", "neutral", "mixed"])
    v = table(s, d, "verify").where("gold is not null and answer is not null").select(F.explode(n).alias("denied"))
    return v.groupBy("denied").agg(F.count(F.lit(1)).alias("n"))


def short_states(s: SparkSession, d: str) -> DataFrame:
    return O.within_length(table(s, d, "verify"), "state", 300).groupBy("suite").agg(F.count(F.lit(1)).alias("n"))


def profile_table(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("user_id") % 7).alias("run"), "event_type", "value")
    kinds = s.createDataFrame([("click", "input"), ("view", "input"), ("purchase", "output")], "event_type string, category string")
    p = O.profile(e, "run", "event_type", "value", kinds)
    return p.select("category", "runs", F.round("median", 4).alias("median"), F.round("share", 6).alias("share"))


def licence_table(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "report").where("src is not null and domain is not null")
    return O.licence_table(r, "src", "task", "domain", (F.col("status") == "ok") & F.col("reason").isNull(), 2)


def glossary_terms(s: SparkSession, d: str) -> DataFrame:
    terms = s.createDataFrame([("positive", "de", "positiv"), ("positive", "en", "favourable"), ("negative", "en", "unfavourable")], "gold string, lang string, term string")
    v = table(s, d, "verify").where("gold is not null").select("gold", language_code(F.col("lang")).alias("lang"))
    return O.glossary(v, terms, "gold", "lang").groupBy("gold", "lang", "term").agg(F.count(F.lit(1)).alias("n"))


def paraphrased_questions(s: SparkSession, d: str) -> DataFrame:
    texts = s.createDataFrame([("topic", 1, "What is {focus} about?"), ("topic", 2, "Name the subject of {focus}."), ("urgency", 1, "How soon?")], "suite string, slot int, text string")
    v = table(s, d, "verify").select("item_id", "suite", "gold")
    return O.paraphrases(v, texts, ["suite"], SEED, "item_id", "gold").select("item_id", "question")


def generated_faults(s: SparkSession, d: str) -> DataFrame:
    f = L.generation_faults(F.col("state"), F.col("instructions"), F.col("type"), F.col("gold"), F.col("options"), meta=["never answered"], unasked=["feeling"], cheats=["useless"])
    return table(s, d, "verify").select("suite", F.explode(f).alias("fault")).groupBy("suite", "fault").agg(F.count(F.lit(1)).alias("n"))


def closed_options(s: SparkSession, d: str) -> DataFrame:
    c = L.closed_labels(F.col("options"), ["Positive", "Negative", "Neutral", "Mixed"])
    return table(s, d, "verify").select("suite", c.alias("c")).groupBy("suite", F.col("c.fault").alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.count("c.options").alias("kept"))


def short_label_scripts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "verify").select("item_id", F.explode(_keys()).alias("key"), language_code(F.col("lang")).alias("code"))
    return rows.groupBy("code").agg(F.count_if(L.script_ok(F.col("key"), F.col("code"))).alias("ok"), F.count(F.lit(1)).alias("n"))


def excluded_sources(s: SparkSession, d: str) -> DataFrame:
    e = s.createDataFrame([("v1", "synth", None, False), ("v2", "web-form", None, False), ("v2", "human-notes", "topic", True)], "registry string, id string, config string, configs_only boolean")
    r = table(s, d, "report").select(F.when(F.col("status") == "ok", "v1").otherwise("v2").alias("registry"), F.col("src").alias("id"), F.concat_ws(" | ", "task", "domain").alias("config"))
    return L.excluded_records(r, e, families=["v1"]).groupBy("registry", "excluded").agg(F.count(F.lit(1)).alias("n"))


def suite_items(s: SparkSession, d: str) -> DataFrame:
    spec = U.Suite("topic", "Which?", "gold", texts={"state": ""}, lang="code", n=40, per_label=True, seed=SEED)
    v = table(s, d, "verify").where("suite = 'topic'").withColumn("code", F.coalesce(language_code(F.col("lang")), F.lit("none")))
    return U.suite(v, spec, "item_id").select("item_id", "lang", "gold", F.size("options").alias("options"))


def suite_choices(s: SparkSession, d: str) -> DataFrame:
    """The items of all choices, with the options of each row and the pool's description."""
    spec = U.Suite("choices", "Which?", "gold", texts={"instructions": "Question", "state": "Text"}, choices="keys", lang="suite")
    v = table(s, d, "verify").where("type = 'choice'").withColumn("keys", _keys())
    m = U.metadata(U.suite(v, spec, "item_id"), spec, "item_id")
    return m.select("lang", "n", "classes", F.array_join(F.transform(F.map_entries("gold_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"))


def suite_yes_no(s: SparkSession, d: str) -> DataFrame:
    spec = U.Suite("mood", "Is it favourable?", "gold", texts={"state": ""}, labels=None, truth=["positive", "praise_staff", "joy"], lang="suite", skip=20, n=60, seed=SEED)
    return U.suite(table(s, d, "verify"), spec, "item_id").groupBy("lang", "gold").agg(F.count(F.lit(1)).alias("n"))


def claim_items(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("state", "lang", F.when(F.col("gold") == "true", " Fact").when(F.col("gold") == "false", "opinion").when(F.col("gold") == "neutral", "neither").otherwise(F.col("gold")).alias("label"))
    i = A.claim_type(v, "state", "label", "notes")
    best = F.get(F.col("options"), F.array_position("target", F.lit(1.0)).cast("int") - 1)
    return i.groupBy("qtype", best.alias("gold")).agg(F.count(F.lit(1)).alias("n"))


def source_tasks(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("suite", F.concat(F.lit("5-"), "suite").alias("a"), F.element_at(F.create_map(*(F.lit(x) for kv in {"topic": "8-topic", "intent": "9-intent-dialogue", "emotion": "2-emotion", "sentiment": "1-sentiment", "safety": "5-safety", "urgency": "10-urgency", "sarcasm": "10-sarcasm"}.items() for x in kv)), F.col("suite")).alias("category"), F.array(F.when(F.col("type") == "score", "Aspect").otherwise("text")).alias("fields"), F.col("lang").alias("source"))
    return v.withColumn("task", A.task_of(F.col("category"), F.col("fields"), F.coalesce("source", F.lit("")), dialogues=["en"])).groupBy("suite", "task").agg(F.count(F.lit(1)).alias("n"))


def adapter_counts(s: SparkSession, d: str) -> DataFrame:
    """Items that each adapter makes of the items' columns, by type and answer."""
    v = table(s, d, "verify").select("item_id", "state", "instructions", "lang", "gold", "answer", "agree", "suite", _keys().alias("keys"), F.length("state").alias("n"))
    v = v.withColumns({"share": (F.col("n") % 101) / 100.0, "errors": F.col("n") % 3, "labels": F.array_compact(F.array(F.when(F.col("gold").isin("joy", "fear"), F.col("gold")))), "kinds": F.array_compact(F.array(F.when(F.col("n") % 5 == 0, "name"))), "texts": F.create_map(F.lit("a"), F.col("state"), F.lit("b"), F.col("instructions")), "liked": F.create_map(F.lit("x"), F.col("agree")), "target": F.transform("keys", lambda k: (k == F.col("gold")).cast("double"))})
    made = {
        "emotion": A.emotion(v, "state", "labels", ["joy", "fear", "anger"], "s"), "nli": A.nli(v.withColumn("rel", F.when(F.col("agree"), "entailment").otherwise("neutral")), "state", "instructions", "rel", "s"),
        "similarity": A.similarity(v, "state", "instructions", "share", "s"), "complaint": A.classification(v.where("suite = 'topic'"), "state", ["gold"], "s"), "safety": A.safety(v, "state", "kinds", ["name", "place"], "s"),
        "positive": A.always(v, "state", "Is it a text?", "s"), "keigo": A.error_free(v, "state", "errors", "s"), "empathic": A.scaled(v, "state", "share", 0.0, 1.0, "How much?", ["low", "some", "high"], "s"),
        "language": A.translations(v.select("texts"), "texts", "s"), "reading": A.reading(v, "state", "instructions", "keys", "gold", "s"), "paired_style": A.paired_style(v, {"state": True, "instructions": False}, "Is it polite?", "s"),
        "typed": A.typed(v.where("gold is not null and array_contains(keys, gold)"), "state", "instructions", "keys", "target", "s"), "redial": A.mentions(v, "state", "liked", "s"), "fact": A.facts(v, "instructions", "state", "suite", "s"), "pii": A.personal_data(v, "state", "kinds", ["name", "phone"], "s"),
    }
    out = None
    for name, i in made.items():
        per = i.groupBy("qtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("options")).alias("options")).select(F.lit(name).alias("adapter"), "qtype", "n", "options")
        out = per if out is None else out.unionByName(per)
    return out


def item_functions(s: SparkSession, d: str) -> DataFrame:
    """Class numbers decoded, targets made soft, labels mapped, scored and weighted, templates filled, masks dropped; one digest per suite."""
    v = table(s, d, "verify").select("item_id", "suite", "state", "gold", "type", _keys().alias("keys"), F.length("state").alias("n"))
    t = F.transform("keys", lambda k: (k == F.col("gold")).cast("double") + 1)
    soft = L.soft_target(t, F.col("keys"), F.col("type"))
    rows = v.select(
        "suite", L.decode_label(F.col("n") % 5, ["a", "b", "c"]).alias("label"), F.round(F.element_at(soft, 1), 6).alias("soft"), F.element_at(L.mapped_labels(F.array("gold"), {"positive": "good", "negative": "bad"}), 1).alias("mapped"),
        L.polarity_label((F.col("n") % 21 - 10) / 10.0).alias("polarity"), L.stars_to_sentiment(F.col("n") % 6).alias("stars"), L.score_bin((F.col("n") % 101) / 100.0).alias("bin"), L.golden_weighted(F.col("item_id"), ["x", "y"], [3, 1]).alias("golden"),
        X.fill(F.lit("{who} on {what}{gone}"), {"who": F.col("suite"), "what": F.col("gold")}).alias("filled"), X.scrub(F.concat("suite", F.lit("[MASK]"), "type")).alias("scrubbed"), X.human(F.concat(F.lit("Label_"), "suite", F.lit("Name"))).alias("human"), X.squash(F.concat("suite", F.lit("-+ 1"))).alias("squashed"),
        Q.acceptance_weight((F.col("n") % 5) / 4.0).alias("weight"), X.valid_request_id(F.concat("type", F.lit(" "), "gold")).alias("valid_id"),
    )
    cols = [c for c in rows.columns if c != "suite"]
    return rows.select("suite", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for c in cols))).alias("x")).select("suite", "x.*").groupBy("suite", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def paired_turns(s: SparkSession, d: str) -> DataFrame:
    """Held-out rows take the training rows of their suite and label in turn, each once."""
    v = table(s, d, "verify").where("gold is not null").select("item_id", "suite", "gold", "split")
    left, right = v.where("split = 'dev'").drop("split"), v.where("split = 'train'").select(F.col("item_id").alias("train_id"), "suite", "gold")
    return J.consume_once(left, right, ["suite", "gold"], ["item_id"], ["train_id"]).select("item_id", "train_id")


def top_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "event_type", "user_id", "value")
    t = J.top_scored(e, ["event_type"], {"value": 1.0, "user_id": 0.001}, "event_id", 12)
    return t.select("event_type", "event_id", F.round("score", 4).alias("score"))


def conversations(s: SparkSession, d: str) -> DataFrame:
    """The log of each item as a conversation, its turns in the order of time."""
    r = table(s, d, "report").select("item_id", "created_at", "status", "task", "attempts").distinct().withColumn("turn", F.struct("created_at", "attempts"))
    c = A.conversation_state(r, "item_id", "turn", "status", "task")
    return c.select("item_id", F.length("state").alias("n"), F.sha2("state", 256).alias("digest"))


def turn_rows(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("item_id", F.transform("options", lambda o: F.struct(o["key"].alias("text"), o["description"].alias("label"))).alias("turns"))
    u = A.utterances(v, "turns")
    return u.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"))


def json_functions(s: SparkSession, d: str) -> DataFrame:
    """Answers as models give them, repaired; fields by path; keys at any depth; strings on lines."""
    e = table(s, d, "events").select("event_id", "props", F.concat(F.lit("<think>{\"k\": 0}</think> so ```json\n"), "props", F.lit("\n```")).alias("said"))
    r = e.select("event_id", F.get_json_object(X.repaired_json(F.col("said")), "$.k").alias("k"), X.dotted(F.col("props"), "k").alias("path"), X.has_key(F.col("props"), "k").alias("has"), X.python_json(F.col("props")).alias("spelled"), X.literal_json(F.concat(F.lit("('a', "), X.dotted(F.col("props"), "k"), F.lit(")"))).alias("literal"), X.content_free(F.lit('{"a": ["x", 1]}'), F.lit("N/A")).alias("free"))
    return r


def flattened_states(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").where("state like '{%'").select("item_id", X.flatten_text(F.col("state"), ("body",)).alias("t"))
    return v.select("item_id", F.sha2("t", 256).alias("digest"))


def action_features(s: SparkSession, d: str) -> DataFrame:
    p = P.softmax(F.transform("options", lambda o: F.length(o["key"]).cast("double")), 4.0)
    f = table(s, d, "verify").where("size(options) > 0 and not exists(options, o -> o.key is null)").select("suite", P.action_features(p).alias("f"))
    return f.groupBy("suite").agg(*(F.round(F.avg(f"f.{c}"), 6).alias(c) for c in ("top1", "margin", "entropy", "options")))


def encoded_prompts(s: SparkSession, d: str) -> DataFrame:
    """Documents with every question as token ids of a public vocabulary."""
    from public_tokenizers import path

    docs = table(s, d, "documents").select(F.col("doc_id").alias("state_id"), F.col("text").alias("state"))
    e = D_.encoded(docs, D_.question_frame(s, QUESTIONS), lambda: K.Tokenizer.from_ranks(path("byte_bpe_50k.tiktoken")), 50257, 50258, 50259, max_len=384)
    return e.select("state_id", "qid", F.size("tokens").alias("n"), F.array_join(F.col("markers").cast("array<string>"), ",").alias("markers"), "fits")


def weighted_turns(s: SparkSession, d: str) -> DataFrame:
    """A draw in which labels that say something are taken twice a turn."""
    v = table(s, d, "verify").where("gold is not null").select("item_id", "suite", "gold")
    return S.round_robin(v, ["gold"], 60, "item_id", SEED, within=["suite"], weights=F.when(F.col("gold").isin("neutral", "mixed"), 1).otherwise(2))


def allowed_languages(s: SparkSession, d: str) -> DataFrame:
    return L.exclude_values(table(s, d, "verify").select("suite", "lang"), "lang", ["de", "pt"]).groupBy("suite").agg(F.count(F.lit(1)).alias("n"))


def packed_batches(s: SparkSession, d: str) -> DataFrame:
    """Documents in batches of at most 16 rows and 20,000 padded characters, a single long one aside."""
    b = J.pack(table(s, d, "documents").select(F.length("text").alias("n")), "n", 16, 20_000).groupBy("batch").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"))
    return b.agg(F.sum("k").alias("rows"), F.min((F.col("k") <= 16) & ((F.col("k") == 1) | (F.col("k") * F.col("top") <= 20_000))).alias("within"))


def changed_speed(s: SparkSession, d: str) -> DataFrame:
    """The first and second half of each user's events as two versions, by type."""
    e = table(s, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("run")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("old"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("new"))
    p = E.performance_verdict(e, ["event_type"])
    return p.select("event_type", "runs", F.round("change", 6).alias("change"), F.round("noise", 6).alias("noise"), "verdict")


def affected_versions(s: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws(".", (F.col("event_id") % 3).cast("string"), (F.col("user_id") % 12).cast("string"))
    v = F.when(F.col("event_id") % 11 == 0, F.concat(v, F.lit("-rc"))).otherwise(v)
    e = table(s, d, "events").select(L.version_affected(v, [(None, "0.10"), ("1.2", "1.9")]).alias("affected"))
    return e.groupBy("affected").agg(F.count(F.lit(1)).alias("n"))


def registry_audit(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "report").where("src is not null").groupBy(F.col("src").alias("source")).agg(F.min("domain").alias("licence"), F.min(F.when(F.col("attempts") > 1, F.col("task"))).alias("owner"))
    return L.registry_violations(r, ["owner"], ["billing"]).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def next_passages(s: SparkSession, d: str) -> DataFrame:
    return A.neighbour_pairs(table(s, d, "documents").select("source", "doc_id"), "doc_id", ["doc_id"], ["source"])


def kept_questions(s: SparkSession, d: str) -> DataFrame:
    """Yes/no items of sources whose answers are nearly all the same are dropped."""
    v = table(s, d, "verify").where("type = 'noul' and gold in ('true', 'false')").select("item_id", F.when(F.col("gold") == "true", "all yes").otherwise("other").alias("src"), F.lit("noul").alias("qtype"), F.when(F.col("gold") == "true", F.array(F.lit(0.0), F.lit(1.0))).when(F.col("item_id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("target"))
    return A.drop_constant(v, ["src"]).select("item_id")


def mean_similarity(s: SparkSession, d: str) -> DataFrame:
    """Mean 5-gram similarity of states that are neighbours in a seeded order, by suite."""
    v = table(s, d, "verify").where("state is not null").select("suite", "item_id", X.char_ngrams(F.col("state")).alias("g"))
    q = Q.pairwise_similarity(v, ["suite"], "item_id", "g", 200, SEED)
    return q.select("suite", "pairs", F.round("similarity", 9).alias("similarity"))


def looser_links(s: SparkSession, d: str) -> DataFrame:
    """Documents of one language whose 5-grams reach a similarity of 0.6."""
    docs = table(s, d, "documents").select("doc_id", "text", F.coalesce(language_code(F.col("lang")), F.lit("none")).alias("code"))
    e = D.near_links(docs, "doc_id", "text", 0.6, "code")
    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("code").alias(f"code_{x}"))
    return e.join(side("a"), "a").join(side("b"), "b").where("code_a = code_b").select("a", "b", F.round("similarity", 9).alias("similarity"))


_CODE = "coalesce((SELECT code FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CODES.items()) + ") c(name, code) WHERE c.name = regexp_extract(lower(trim(v.lang)), '^([\\p{L}]+)', 1)), 'none')"
_K = "list_transform(options, lambda o: o.key)"
_ENGLISH = f"CASE WHEN l = 0 OR o * 50 > l THEN false WHEN len(w) < 4 THEN len(w) > 0 ELSE len(list_filter(w, lambda x: x IN ({_EN}))) * 10 >= len(w) END"
_H = lambda *c: "sha256('" + str(SEED) + "' || chr(10) || " + " || chr(10) || ".join(f"{x}::VARCHAR" for x in c) + ")"

ALL = {
    "parsed_requests": (parsed_requests, f"WITH v AS (SELECT type, CASE WHEN gold IS NULL THEN 422 WHEN type <> 'noul' AND len({_K}) = 0 THEN 422 ELSE 200 END AS st, CASE WHEN type = 'choice' THEN least(3, len(options)) + CASE WHEN length(state) > 400 THEN 3 ELSE 0 END ELSE 1 END AS w FROM verify) SELECT type, st::INT AS http_status, count(*) AS n, sum(CASE WHEN st = 200 THEN w END)::BIGINT AS work FROM v GROUP BY ALL"),
    "routed_models": (routed_models, f"WITH v AS (SELECT suite, type, {_n('state', '[A-Za-z]')} AS l, {_n('state', '[^\\x00-\\x7f]')} AS o, regexp_extract_all(lower(state), '[a-z]+') AS w FROM verify), a AS (SELECT CASE WHEN suite = 'topic' THEN 'multilingual' WHEN type <> 'noul' AND suite = 'intent' THEN 'multilingual' WHEN {_ENGLISH} THEN 'english' ELSE 'multilingual' END AS served_by, CASE WHEN suite = 'topic' THEN 'requested' WHEN type <> 'noul' AND suite = 'intent' THEN 'adapter' WHEN {_ENGLISH} THEN 'lang:en' ELSE 'lang:other' END AS routing, CASE WHEN type = 'noul' THEN 'auto' WHEN suite = 'intent' THEN 'moods' ELSE 'none' END AS want, CASE WHEN suite = 'sarcasm' THEN 'emotion' END AS family FROM v) SELECT served_by, routing, CASE WHEN want = 'moods' THEN 'moods' WHEN want = 'auto' AND family IS NOT NULL AND served_by = 'multilingual' THEN 'moods' END AS served_adapter, CASE WHEN want = 'moods' THEN 'requested' WHEN want = 'none' THEN 'none' WHEN family IS NULL THEN 'auto:no-family' WHEN served_by = 'multilingual' THEN 'auto:emotion' ELSE 'auto:emotion:no-adapter' END AS adapter_routing, NULL::VARCHAR AS refused, count(*) AS n FROM a GROUP BY ALL"),
    "response_frames": (response_frames, "SELECT item_id AS request_id, CASE WHEN gold IS NULL THEN 422 ELSE 200 END::INT AS http_status, CASE WHEN gold IS NULL THEN '{\"request_id\":' || item_id || ',\"detail\":\"no gold\"}' ELSE '{\"request_id\":' || item_id || ',\"answers\":{\"q\":\"' || type || '\"}}' END AS body FROM verify"),
    "word_piece_counts": (word_piece_counts, r"WITH p AS (SELECT doc_id, regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}]+') AS p FROM documents) SELECT doc_id, len(p)::INT AS n, coalesce(list_sum(list_transform(p, lambda x: length(trim(x)))), 0)::INT AS characters, true AS whole FROM p"),
    "valid_text": (valid_text, "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END || text) AS digest FROM documents"),
    "item_tokens": (item_tokens, None),
    "shared_texts": (shared_texts, f"WITH d AS (SELECT doc_id, {sql_norm('text')} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {sql_norm('text')} AS u FROM benchmark) SELECT doc_id, item_id, CASE WHEN t = u THEN 'same' WHEN contains(t, u) THEN 'pool_inside' ELSE 'inside_pool' END AS kind FROM d, b WHERE t <> '' AND u <> '' AND (t = u OR (length(u) >= 40 AND contains(t, u)) OR (length(t) >= 40 AND contains(u, t)))"),
    "mixture_order": (mixture_order, f"WITH r AS (SELECT item_id, split, row_number() OVER (PARTITION BY split ORDER BY item_id) - 1 AS i FROM verify WHERE split IN ('dev', 'train', 'test')), o AS (SELECT item_id, split, CASE WHEN split = 'dev' AND i < 40 THEN 0 ELSE 1 END AS late, CASE WHEN split = 'dev' AND i < 40 THEN lpad(i::VARCHAR, 20, '0') ELSE {_H('split', 'item_id')} END AS o FROM r) SELECT row_number() OVER (ORDER BY late, o, split, item_id) - 1 AS position, split AS part, item_id FROM o"),
    "banned_set": (banned_set, f"WITH a AS (SELECT text AS t FROM benchmark UNION ALL SELECT state FROM verify WHERE split IN ('dev', 'test') UNION ALL SELECT instructions FROM verify WHERE split IN ('dev', 'test')) SELECT DISTINCT sha256({sql_norm('t')}) AS banned FROM a WHERE {sql_norm('t')} <> ''"),
    "common_labels": (common_labels, "SELECT gold FROM verify WHERE gold IS NOT NULL AND split IS NOT NULL GROUP BY gold HAVING count(DISTINCT split) = (SELECT count(DISTINCT split) FROM verify)"),
    "upstream_items": (upstream_items, "SELECT item_id FROM verify v WHERE split IN ('dev', 'test') AND EXISTS (SELECT 1 FROM verify u WHERE u.split = 'train' AND trim(u.state, ' ') = trim(v.state, ' ') AND trim(u.gold, ' ') = trim(v.gold, ' '))"),
    "lineage_faults": (lineage_faults, "WITH u AS (SELECT state, min(gold) AS g FROM verify WHERE split = 'train' GROUP BY state), f AS (SELECT CASE WHEN u.state IS NULL THEN 'unknown' WHEN answer IS NULL OR contains(v.state, 'REDACTED') THEN 'redacted' WHEN NOT coalesce(gold IN ('positive', 'negative', 'true', 'false', 'neutral') AND gold = u.g, false) THEN 'label' END AS fault FROM verify v LEFT JOIN u ON u.state = v.state WHERE split <> 'train') SELECT fault IS NULL AS kept, fault, count(*) AS n FROM f GROUP BY ALL"),
    "denied_labels": (denied_labels, "SELECT answer AS denied, count(*) AS n FROM verify WHERE gold IS NOT NULL AND answer IN ('positive', 'negative', 'neutral', 'mixed') AND answer <> gold GROUP BY ALL"),
    "short_states": (short_states, "SELECT suite, count(*) AS n FROM verify WHERE length(state) <= 300 GROUP BY suite"),
    "profile_table": (profile_table, "WITH p AS (SELECT user_id % 7 AS run, CASE WHEN event_type IN ('click', 'view') THEN 'input' WHEN event_type = 'purchase' THEN 'output' ELSE 'other' END AS category, sum(value) AS s FROM events GROUP BY ALL), w AS (SELECT run, sum(s) AS a FROM p GROUP BY run) SELECT category, count(*) AS runs, round(median(s), 4) AS median, round(median(s / a), 6) AS share FROM p JOIN w ON w.run = p.run GROUP BY category"),
    "licence_table": (licence_table, "WITH g AS (SELECT src, task, count(*) AS kept, list_sort(list_distinct(list(domain))) AS l FROM report WHERE src IS NOT NULL AND domain IS NOT NULL AND status = 'ok' AND reason IS NULL GROUP BY ALL) SELECT src, task, kept, array_to_string(l[1:2], ', ') || CASE WHEN len(l) > 2 THEN ' + ' || (len(l) - 2)::VARCHAR ELSE '' END AS languages FROM g"),
    "glossary_terms": (glossary_terms, f"WITH a AS (SELECT gold, nullif({_CODE}, 'none') AS lang FROM verify v WHERE gold IS NOT NULL) SELECT gold, lang, CASE WHEN gold = 'positive' AND lang = 'de' THEN 'positiv' WHEN gold = 'positive' THEN 'favourable' WHEN gold = 'negative' THEN 'unfavourable' ELSE replace(gold, '_', ' ') END AS term, count(*) AS n FROM a GROUP BY ALL"),
    "paraphrased_questions": (paraphrased_questions, f"SELECT item_id, CASE WHEN suite = 'topic' THEN replace(['What is {{focus}} about?', 'Name the subject of {{focus}}.'][1 + ('0x' || substring({_H('item_id')}, 1, 8))::BIGINT % 2], '{{focus}}', coalesce(gold, '')) WHEN suite = 'urgency' THEN 'How soon?' END AS question FROM verify"),
    "generated_faults": (generated_faults, r"WITH v AS (SELECT suite, type, gold, state, instructions, list_transform(options, lambda o: " + sql_norm("o.key") + ") AS k, list_filter(list_transform(options, lambda o: " + sql_norm("o.description") + "), lambda x: coalesce(x <> '', false)) AS t, " + sql_norm("state") + " AS s, " + sql_norm("instructions") + " AS q FROM verify), f AS (SELECT suite, unnest([" + r"CASE WHEN type = 'choice' AND length(gold) >= 4 AND ((length(gold) >= 12 AND contains(q, " + sql_norm("gold") + r")) OR regexp_matches(instructions, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(gold) || '($|[^\p{L}\p{N}_])')) THEN 'answer_leaked' END, CASE WHEN contains(s, 'never answered') OR contains(q, 'never answered') THEN 'meta_phrase' END, CASE WHEN contains(q, 'feeling') THEN 'unasked' END, CASE WHEN regexp_matches(state, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]') OR regexp_matches(state, '(?i)(^|[^\p{L}\p{N}_])useless($|[^\p{L}\p{N}_])') THEN 'cheat' END, CASE WHEN len(list_distinct(k)) < len(k) OR len(list_filter(k, lambda x: coalesce(x = '', true))) > 0 OR len(list_distinct(t)) < len(t) THEN 'duplicate_options' END, CASE WHEN coalesce(trim(state) = '', true) THEN 'empty_state' END]) AS fault FROM v) SELECT suite, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL"),
    "closed_options": (closed_options, f"WITH f AS (SELECT suite, options, list_transform({_K}, lambda k: trim(regexp_replace(regexp_replace(lower(k), '[-_]', ' ', 'g'), '\\s+', ' ', 'g'))) AS k FROM verify), g AS (SELECT suite, CASE WHEN options IS NULL OR len(k) = 0 THEN 'bad_options' WHEN len(list_filter(k, lambda x: x IS NULL OR x NOT IN ('positive', 'negative', 'neutral', 'mixed'))) > 0 THEN 'bad_key' WHEN len(list_distinct(k)) < len(k) THEN 'duplicate_options' WHEN len(k) < 4 THEN 'option_count' END AS fault FROM f) SELECT suite, fault, count(*) AS n, count(*) FILTER (WHERE fault IS NULL) AS kept FROM g GROUP BY ALL"),
    "short_label_scripts": (short_label_scripts, f"WITH k AS (SELECT nullif({_CODE}, 'none') AS code, unnest({_K}) AS x FROM verify v), c AS (SELECT *, {_script_sql('x')} FROM k), s AS (SELECT *, latin + arabic + devanagari + cyrillic + kana + cjk AS n, (latin + arabic + devanagari + cyrillic + kana + cjk)::DOUBLE AS t FROM c), f AS (SELECT *, {SHARES} FROM s) SELECT code, count(*) FILTER (WHERE CASE WHEN n < 4 THEN true WHEN code = 'zh' AND cjk < 8 THEN cjk >= 0.5 * n AND kana <= 1 WHEN code = 'ja' AND kana < 4 THEN kana + cjk >= 0.5 * n AND arabic < 0.1 * n WHEN code = 'ar' THEN {TESTS['ar']} WHEN code = 'hi' THEN {TESTS['hi']} WHEN code = 'ru' THEN {TESTS['ru']} WHEN code = 'ja' THEN {TESTS['ja']} WHEN code = 'zh' THEN {TESTS['zh']} ELSE {TESTS['latin']} END) AS ok, count(*) AS n FROM f GROUP BY code"),
    "excluded_sources": (excluded_sources, "WITH r AS (SELECT CASE WHEN status = 'ok' THEN 'v1' ELSE 'v2' END AS registry, src, list_transform(string_split_regex(concat_ws(' | ', task, domain), '[|,]'), lambda x: trim(x)) AS c FROM report) SELECT registry, coalesce(CASE WHEN registry = 'v1' THEN starts_with(src, 'synth') ELSE src = 'web-form' OR (src = 'human-notes' AND list_contains(c, 'topic')) END, false) AS excluded, count(*) AS n FROM r GROUP BY ALL"),
    "suite_items": (suite_items, f"WITH v AS (SELECT item_id, gold, state, {_CODE} AS lang FROM verify v WHERE suite = 'topic'), n AS (SELECT list_sort(list_distinct(list(gold) FILTER (WHERE gold IS NOT NULL))) AS names FROM v), i AS (SELECT item_id, lang, list_position(names, gold) - 1 AS gold, len(names) AS options FROM v, n WHERE trim(state) <> '' AND gold IS NOT NULL), r AS (SELECT *, {_H('item_id')} AS h, row_number() OVER (PARTITION BY lang, gold ORDER BY {_H('item_id')}, item_id) AS r FROM i), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, h, item_id) AS t FROM r WHERE r <= 40) SELECT item_id, lang, gold::INT AS gold, options::INT AS options FROM t WHERE t <= 40"),
    "suite_choices": (suite_choices, f"WITH i AS (SELECT suite AS lang, list_position({_K}, gold) - 1 AS g FROM verify WHERE type = 'choice' AND len(options) >= 2 AND trim(state) <> '' AND trim(instructions) <> ''), c AS (SELECT lang, g, count(*) AS c FROM i WHERE g >= 0 GROUP BY ALL) SELECT lang, sum(c)::BIGINT AS n, count(*) AS classes, string_agg(g || ':' || c, ',' ORDER BY g) AS counts FROM c GROUP BY lang"),
    "suite_yes_no": (suite_yes_no, f"WITH i AS (SELECT item_id, suite AS lang, (gold IN ('positive', 'praise_staff', 'joy'))::INT AS gold, row_number() OVER (PARTITION BY suite ORDER BY item_id) AS pos FROM verify WHERE gold IS NOT NULL AND trim(state) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H('item_id')}, item_id) AS r FROM i WHERE pos > 20) SELECT lang, gold, count(*) AS n FROM r WHERE r <= 60 GROUP BY ALL"),
    "claim_items": (claim_items, "WITH v AS (SELECT CASE WHEN gold = 'true' THEN 'fact' WHEN gold = 'false' THEN 'opinion' WHEN gold = 'neutral' THEN 'neither' END AS k FROM verify WHERE trim(state) <> '') SELECT 'choice' AS qtype, k AS gold, count(*) AS n FROM v WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT 'noul', (k = 'fact')::VARCHAR, count(*) FROM v WHERE k IS NOT NULL GROUP BY 2"),
    "source_tasks": (source_tasks, "SELECT suite, CASE suite WHEN 'topic' THEN 'topic' WHEN 'intent' THEN CASE WHEN contains(lower(coalesce(lang, '')), 'en') THEN 'dialogue_act' ELSE 'intent' END WHEN 'emotion' THEN 'emotion' WHEN 'sentiment' THEN CASE WHEN type = 'score' THEN 'aspect_sentiment' ELSE 'sentiment' END WHEN 'safety' THEN 'moderation' WHEN 'urgency' THEN 'urgency' WHEN 'sarcasm' THEN 'sarcasm' END AS task, count(*) AS n FROM verify GROUP BY ALL"),
    "adapter_counts": (adapter_counts, f"""WITH v AS (SELECT *, {_K} AS keys, length(state) AS n FROM verify WHERE trim(state) <> ''), g AS (SELECT *, list_contains(keys, gold) AS held, len(keys) AS k, (n % 101) / 100.0::DOUBLE AS share FROM v), a(adapter, qtype, options, holds) AS (
        SELECT 'emotion', 'choice', 3, gold IN ('joy', 'fear') FROM g UNION ALL SELECT 'emotion', 'noul', 2, true FROM g UNION ALL SELECT 'nli', 'choice', 3, true FROM g UNION ALL SELECT 'nli', 'noul', 2, true FROM g
        UNION ALL SELECT 'similarity', 'score', 5, true FROM g UNION ALL SELECT 'similarity', 'noul', 2, share >= 0.8 OR share <= 0.2 FROM g UNION ALL SELECT 'complaint', 'choice', (SELECT count(DISTINCT gold) FROM verify WHERE suite = 'topic'), suite = 'topic' AND gold IS NOT NULL FROM g
        UNION ALL SELECT 'safety', 'choice', 2, n % 5 = 0 FROM g UNION ALL SELECT 'safety', 'noul', 2, true FROM g UNION ALL SELECT 'positive', 'noul', 2, true FROM g UNION ALL SELECT 'keigo', 'noul', 2, true FROM g UNION ALL SELECT 'empathic', 'score', 3, true FROM g
        UNION ALL SELECT 'language', 'choice', 2, true FROM g UNION ALL SELECT 'language', 'choice', 2, true FROM g UNION ALL SELECT 'reading', 'choice', k, k > 1 AND held FROM g UNION ALL SELECT 'reading', 'noul', 2, k <= 1 FROM g
        UNION ALL SELECT 'paired_style', 'noul', 2, true FROM g UNION ALL SELECT 'paired_style', 'noul', 2, true FROM g UNION ALL SELECT 'typed', 'choice', k, k > 1 AND held FROM g UNION ALL SELECT 'redial', 'choice', 3, true FROM g
        UNION ALL SELECT 'fact', 'noul', 2, true FROM g UNION ALL SELECT 'fact', 'noul', 2, true FROM g UNION ALL SELECT 'pii', 'noul', 2, true FROM g UNION ALL SELECT 'pii', 'noul', 2, true FROM g UNION ALL SELECT 'pii', 'choice', 2, n % 5 = 0 FROM g)
        SELECT adapter, qtype, count(*) AS n, sum(options)::BIGINT AS options FROM a WHERE holds GROUP BY ALL"""),
    "item_functions": (item_functions, f"""WITH v AS (SELECT suite, type, gold, item_id, {_K} AS k, length(state) AS n FROM verify), f AS (SELECT suite, unnest([
        {{'name': 'label', 'value': CASE n % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END}}, {{'name': 'soft', 'value': CASE WHEN gold IS NOT NULL AND len(k) >= 2 AND len(list_distinct(k)) = len(k) THEN round(((k[1] = gold)::INT + 1) / (len(k) + list_contains(k, gold)::INT)::DOUBLE, 6)::VARCHAR END}},
        {{'name': 'mapped', 'value': CASE gold WHEN 'positive' THEN 'good' WHEN 'negative' THEN 'bad' END}}, {{'name': 'polarity', 'value': CASE WHEN n % 21 - 10 > 1 THEN 'positive' WHEN n % 21 - 10 < -1 THEN 'negative' ELSE 'neutral' END}},
        {{'name': 'stars', 'value': CASE WHEN n % 6 <= 2 THEN 'negative' WHEN n % 6 = 3 THEN 'neutral' ELSE 'positive' END}}, {{'name': 'bin', 'value': least(4, floor((n % 101)::DOUBLE / 100.0::DOUBLE * 5))::INT::VARCHAR}},
        {{'name': 'golden', 'value': CASE WHEN (item_id * 0.6180339887498949::DOUBLE) % 1 < 0.75 THEN 'x' ELSE 'y' END}}, {{'name': 'filled', 'value': suite || ' on ' || coalesce(gold, '{{what}}') || '{{gone}}'}}, {{'name': 'scrubbed', 'value': suite || ' ' || type}},
        {{'name': 'human', 'value': 'label ' || regexp_replace(suite, '[_/-]+', ' ', 'g') || ' name'}}, {{'name': 'squashed', 'value': regexp_replace(lower(suite) || '1', '[^a-z0-9]+', '', 'g')}},
        {{'name': 'weight', 'value': CASE n % 5 WHEN 2 THEN '2.0' WHEN 3 THEN '1.3333333333333333' WHEN 4 THEN '1.0' ELSE '4.0' END}}, {{'name': 'valid_id', 'value': CASE WHEN gold IS NOT NULL THEN 'false' END}}]) AS x FROM v)
        SELECT suite, x.name AS name, coalesce(x.value, '-') AS value, count(*) AS n FROM f GROUP BY ALL"""),
    "paired_turns": (paired_turns, "WITH l AS (SELECT item_id, suite, gold, row_number() OVER (PARTITION BY suite, gold ORDER BY item_id) AS t FROM verify WHERE split = 'dev' AND gold IS NOT NULL), r AS (SELECT item_id AS train_id, suite, gold, row_number() OVER (PARTITION BY suite, gold ORDER BY item_id) AS t FROM verify WHERE split = 'train' AND gold IS NOT NULL) SELECT l.item_id, r.train_id FROM l LEFT JOIN r ON r.suite = l.suite AND r.gold = l.gold AND r.t = l.t"),
    "top_events": (top_events, "WITH s AS (SELECT event_type, event_id, coalesce(value, 0) + coalesce(user_id, 0) * 0.001 AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS r FROM s) SELECT event_type, event_id, round(score, 4) AS score FROM r WHERE r <= 12"),
    "conversations": (conversations, "WITH r AS (SELECT DISTINCT item_id, created_at, attempts, status, task FROM report), c AS (SELECT item_id, string_agg(status || ': ' || task, chr(10) ORDER BY created_at, attempts, status, task) AS s FROM r GROUP BY item_id) SELECT item_id, length(s)::INT AS n, sha256(s) AS digest FROM c"),
    "turn_rows": (turn_rows, "WITH t AS (SELECT unnest(range(0, len(options))) AS turn, unnest(options) AS o FROM verify) SELECT turn::INT AS turn, count(*) AS n, count(o.description) AS labelled FROM t GROUP BY turn"),
    "json_functions": (json_functions, "SELECT event_id, k, k AS path, true AS has, '{\"k\": ' || k || '}' AS spelled, '[\"a\", ' || k || ']' AS literal, '{\"a\": [\"N/A\", 1]}' AS free FROM (SELECT event_id, props ->> '$.k' AS k FROM events)"),
    "flattened_states": (flattened_states, "SELECT item_id, sha256(CASE WHEN json_valid(state) THEN coalesce(state ->> '$.body', array_to_string(json_extract_string(state, '$.*'), chr(10))) ELSE state END) AS digest FROM verify WHERE state LIKE '{%'"),
    "action_features": (action_features, f"WITH v AS (SELECT suite, list_transform({_K}, lambda k: length(k)::DOUBLE) AS z FROM verify WHERE len(options) > 0 AND len(list_filter({_K}, lambda k: k IS NULL)) = 0), e AS (SELECT suite, list_transform(z, lambda x: exp((x - list_max(z)) / 4.0)) AS e FROM v), p AS (SELECT suite, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), f AS (SELECT suite, list_max(p) AS top1, CASE WHEN len(p) > 1 THEN list_reverse_sort(p)[1] - list_reverse_sort(p)[2] ELSE p[1] END AS margin, CASE WHEN len(p) > 1 THEN list_sum(list_transform(p, lambda x: -x * ln(least(1.0, greatest(x, 1e-12))))) / ln(len(p)::DOUBLE) ELSE 0.0 END AS entropy, len(p) / 255.0 AS options FROM p) SELECT suite, round(avg(top1), 6) AS top1, round(avg(margin), 6) AS margin, round(avg(entropy), 6) AS entropy, round(avg(options), 6)::DOUBLE AS options FROM f GROUP BY suite"),
    "looser_links": (looser_links, f"WITH {sql_links('SELECT doc_id AS id, ' + sql_norm('text') + ' AS t FROM documents WHERE text IS NOT NULL', 0.6)}, c AS (SELECT doc_id, {_CODE} AS code FROM documents v) SELECT a, b, round(s, 9) AS similarity FROM l JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE x.code = y.code"),
    "encoded_prompts": (encoded_prompts, None),
    "mean_similarity": (mean_similarity, f"WITH v AS (SELECT suite, item_id, {_H('item_id')} AS h, {sql_norm('state')} AS t FROM verify WHERE state IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY h, item_id) AS r FROM v), g AS (SELECT suite, r, CASE WHEN length(t) <= 5 THEN list_filter([t], lambda x: x <> '') ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) END AS g FROM r WHERE r <= 201), p AS (SELECT a.suite, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS x, len(b.g) AS y FROM g a JOIN g b ON b.suite = a.suite AND b.r = a.r - 1) SELECT suite, count(*) AS pairs, round(avg(CASE WHEN x + y = 0 THEN 1.0 ELSE i / (x + y - i)::DOUBLE END), 9) AS similarity FROM p GROUP BY suite"),
    "weighted_turns": (weighted_turns, f"WITH r AS (SELECT item_id, suite, gold, row_number() OVER (PARTITION BY suite, gold ORDER BY {_H('item_id')}, item_id) AS r FROM verify WHERE gold IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY ceil(r / CASE WHEN gold IN ('neutral', 'mixed') THEN 1 ELSE 2 END), gold, r) AS p FROM r) SELECT item_id, suite, gold FROM t WHERE p <= 60"),
    "allowed_languages": (allowed_languages, "SELECT suite, count(*) AS n FROM verify WHERE lang IS NULL OR string_split(replace(lower(trim(lang)), '_', '-'), '-')[1] NOT IN ('de', 'pt') GROUP BY suite"),
    "packed_batches": (packed_batches, "SELECT count(*)::BIGINT AS rows, true AS within FROM documents"),
    "changed_speed": (changed_speed, "WITH e AS (SELECT event_type, user_id % 5 AS run, avg(value) FILTER (WHERE event_id % 2 = 0) AS o, avg(value) FILTER (WHERE event_id % 2 = 1) AS w FROM events GROUP BY ALL), d AS (SELECT event_type, (w - o) / o AS d FROM e), m AS (SELECT event_type, count(*) AS runs, median(d) AS c, min(d) AS lo, max(d) AS hi FROM d GROUP BY event_type), n AS (SELECT d.event_type, median(abs(d - c)) AS s FROM d JOIN m ON m.event_type = d.event_type GROUP BY d.event_type) SELECT m.event_type, runs, round(c, 6) AS change, round(s, 6) AS noise, CASE WHEN c > greatest(0.03, 3 * s) AND lo > 0 THEN 'slower' WHEN c < -greatest(0.03, 3 * s) AND hi < 0 THEN 'faster' ELSE 'same' END AS verdict FROM m JOIN n ON n.event_type = m.event_type"),
    "affected_versions": (affected_versions, "WITH v AS (SELECT event_id % 3 AS a, user_id % 12 AS b, event_id % 11 = 0 AS odd FROM events) SELECT odd OR (a = 0 AND b < 10) OR (a = 1 AND b >= 2 AND b < 9) AS affected, count(*) AS n FROM v GROUP BY 1"),
    "registry_audit": (registry_audit, "WITH r AS (SELECT src, min(domain) AS licence, min(task) FILTER (WHERE attempts > 1) AS owner FROM report WHERE src IS NOT NULL GROUP BY src) SELECT violation, count(*) AS n FROM (SELECT 'missing owner' AS violation FROM r WHERE owner IS NULL UNION ALL SELECT 'licence' FROM r WHERE coalesce(lower(trim(licence)), '') <> 'billing') GROUP BY violation"),
    "next_passages": (next_passages, "SELECT source, a, b FROM (SELECT source, doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE b IS NOT NULL"),
    "kept_questions": (kept_questions, "SELECT item_id FROM verify WHERE type = 'noul' AND (gold = 'false' OR (gold = 'true' AND (SELECT count(*) FROM verify WHERE type = 'noul' AND gold = 'true') < 20))"),
}
