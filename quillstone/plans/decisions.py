"""Typed decisions over items and documents with the lexical scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import probability as P
from quillstone.operators import decide as D
from quillstone.plans.text import _families_sql
from quillstone.session import table

QUESTIONS = {
    "mood": {"type": "choice", "instructions": "What does the text talk about?", "criteria": {"device": "the lamp kettle monitor screen or blender", "place": "the library bakery clinic garage or kitchen", "paper": "the note ticket invoice receipt or release", "none": None}},
    "urgency": {"type": "score", "instructions": "How soon must somebody answer?", "criteria": ["until later", "by the weekend", "this morning", "before it is closed"]},
    "praise": {"type": "noul", "instructions": "Does the text praise something?", "criteria": {"true": "wonderful and reliable, works better", "false": "broken, keeps failing, never answered"}},
    "kind": {"type": "choice", "instructions": "What is it?", "criteria": ["note", "list", "table", "log", "answer", "question", "release"]},
}
TEMPS = {"by_type": {"choice": 1.5, "score": 2.0}, "by_bucket": {"choice:6-10": 0.7, "noul:2": 9.0}}


def _states(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("state_id"), F.col("text").alias("state"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return D.score(_states(s, d), D.question_frame(s, QUESTIONS))


def decide_answers(s: SparkSession, d: str) -> DataFrame:
    rows = D.decide(_states(s, d), D.question_frame(s, QUESTIONS), min_confidence=0.5, **TEMPS)
    a = F.col("answer")
    return rows.select("state_id", "qid", "qtype", a["choice"].alias("choice"), a["score"].alias("score"), a["noul"].alias("noul"), a["confidence"].alias("confidence"), a["answer_confidence"].alias("answer_confidence"), "escalate")


def decide_expansion(s: SparkSession, d: str) -> DataFrame:
    r = _scored(s, d)
    return r.groupBy("qid").agg(F.count(F.lit(1)).alias("states"), F.sum(F.size("options")).alias("options"), F.round(F.sum(P.total(F.col("logits"))), 6).alias("score"))


def top_margins(s: SparkSession, d: str) -> DataFrame:
    p = P.softmax(F.col("logits"))
    return _scored(s, d).select("state_id", "qid", P.argmax(F.col("logits")).alias("best"), F.round(P.margin(p), 6).alias("margin"))


def option_probabilities(s: SparkSession, d: str) -> DataFrame:
    r = _scored(s, d).select("qid", F.posexplode(P.softmax(F.col("logits"), 2.0)).alias("pos", "p"))
    return r.groupBy("qid", "pos").agg(F.round(F.avg("p"), 6).alias("p"))


def confidence_by_question(s: SparkSession, d: str) -> DataFrame:
    p = P.softmax(F.col("logits"))
    return _scored(s, d).groupBy("qid").agg(F.round(F.avg(P.confidence(p)), 6).alias("confidence"), F.round(F.avg(P.expectation(p)), 6).alias("expectation"))


def ensemble_views(s: SparkSession, d: str) -> DataFrame:
    return D.views(_scored(s, d), 3, 0.4).select("state_id", "qid", "view", "shift", F.col("options")[0].alias("first"))


def ensemble_answers(s: SparkSession, d: str) -> DataFrame:
    r = D.decide(_states(s, d), D.question_frame(s, QUESTIONS), n=3, margin=0.4)
    return r.where("qtype = 'choice'").select("state_id", "qid", F.col("answer.choice").alias("choice"), F.round(F.col("answer.answer_confidence"), 3).alias("confidence"))


def calibrated_answers(s: SparkSession, d: str) -> DataFrame:
    r = D.decide(_states(s, d), D.question_frame(s, QUESTIONS), calibrated=True)
    return r.select("state_id", "qid", F.col("answer.choice").alias("choice"), F.col("answer.answer_confidence").alias("confidence"))


def consensus_answers(s: SparkSession, d: str) -> DataFrame:
    """The lexical scorer and the same with squared scores, weighted 0.7 and 0.3."""
    a = _scored(s, d)
    b = a.withColumn("logits", F.transform("logits", lambda x: x * x))
    f = D.fuse([a, b], [0.7, 0.3])
    return f.select("state_id", "qid", F.col("answer.choice").alias("choice"), F.round(F.col("answer.answer_confidence"), 3).alias("confidence"))


def selective_answers(s: SparkSession, d: str) -> DataFrame:
    r = decide_answers(s, d)
    return r.groupBy("qid").agg(F.count_if("escalate").alias("escalated"), F.count(F.lit(1)).alias("n"))


def routed_requests(s: SparkSession, d: str) -> DataFrame:
    fam = table(s, d, "verify").select("suite", D.question_family(F.lit("q"), F.col("instructions")).alias("_f"))
    req = D.request_family(fam, ["suite"], F.col("_f"))
    adapters = s.createDataFrame([("moods", 1, ["emotion", "sentiment"]), ("themes", 2, ["topic", "intent", "sentiment"])], "adapter string, position int, categories array<string>")
    return D.route_adapter(req, adapters).select("suite", "family", "adapter")


def prompt_layout(s: SparkSession, d: str) -> DataFrame:
    r = D.expand(_states(s, d), D.question_frame(s, QUESTIONS))
    w = lambda c: F.split(c, " ")
    head = w(F.concat("qtype", F.lit(" question: "), "instructions"))
    t, m, ok = D.layout(head, F.transform("options", lambda o: F.split(o, " ")), w(F.col("state")), 96, 48, F.lit(False))
    return r.select("state_id", "qid", t.alias("t"), m.alias("m"), ok.alias("fits")).select("state_id", "qid", F.size("t").alias("n"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("markers"), "fits")


def gathered_decisions(s: SparkSession, d: str) -> DataFrame:
    g = D.gather(D.decide(_states(s, d), D.question_frame(s, QUESTIONS)))
    return g.select("state_id", F.array_join(F.map_keys("answers"), ",").alias("questions"), F.col("answers")["mood"]["choice"].alias("mood"))


def _qs() -> str:
    rows = []
    for i, q in enumerate(D.parse_questions(QUESTIONS)):
        opts = ", ".join("'" + o.replace("'", "''") + "'" for o in q.options)
        labs = ", ".join("'" + o.replace("'", "''") + "'" for o in q.labels)
        rows.append(f"({i}, '{q.id}', '{q.type}', '{q.instructions}', [{labs}], [{opts}])")
    words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
    return f"""q(qpos, qid, qtype, instructions, labels, options) AS (VALUES {', '.join(rows)}),
        st AS (SELECT doc_id AS state_id, text AS state, {words('text')} AS w FROM documents),
        z AS (SELECT state_id, qpos, qid, qtype, instructions, labels, options, list_transform(options, lambda o: len(list_intersect({words('o')}, w))::DOUBLE) AS logits FROM st, q)"""


def _soft(z: str, t: str = "1.0") -> str:
    return f"list_transform({z}, lambda x: exp((x - list_max({z})) / {t}) / list_sum(list_transform({z}, lambda y: exp((y - list_max({z})) / {t}))))"


_R4 = lambda x: f"round_even({x} * 10000, 0) / 10000"
_CONF = "CASE WHEN len(p) < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(p, lambda x: -x * ln(least(1.0, greatest(x, 1e-12))))) / ln(len(p)::DOUBLE))) END"
_EXP = "list_sum(list_transform(p, lambda x, i: x * (i - 1)))"
_T = "CASE WHEN qtype || ':' || CASE WHEN len(options) <= 2 THEN '2' WHEN len(options) <= 5 THEN '3-5' WHEN len(options) <= 10 THEN '6-10' ELSE '11+' END = 'choice:6-10' THEN 0.7 WHEN qtype = 'noul' THEN 5.0 WHEN qtype = 'choice' THEN 1.5 WHEN qtype = 'score' THEN 2.0 ELSE 1.0 END"
_SUB = "WITH " + _qs() + ", pp AS (SELECT *, " + _soft("logits") + " AS p FROM z)"
_DEC = "WITH " + _qs() + f", y AS (SELECT *, {_T} AS tt FROM z), pp AS (SELECT *, " + _soft("logits", "tt") + " AS p FROM y)"
_ANS = f"""SELECT state_id, qid, qtype, CASE WHEN qtype = 'choice' THEN labels[list_position(p, list_max(p))] END AS choice, CASE WHEN qtype = 'score' THEN {_R4(_EXP)} END AS score,
    CASE WHEN qtype = 'noul' THEN {_R4('p[2]')} END AS noul, {_R4(f"CASE WHEN qtype = 'noul' THEN greatest(p[2], 1 - p[2]) ELSE {_CONF} END")} AS confidence, {_R4('least(1.0, list_max(p))')} AS answer_confidence,
    {_R4('least(1.0, list_max(p))')} < 0.5 AS escalate FROM pp"""
_MARGIN = "list_reverse_sort(p)[1] - list_reverse_sort(p)[2]"
_LS = lambda z: f"list_transform({z}, lambda x: x - list_max({z}) - ln(list_sum(list_transform({z}, lambda y: exp(y - list_max({z}))))))"

ALL = {
    "decide_answers": (decide_answers, f"{_DEC} {_ANS}"),
    "decide_expansion": (decide_expansion, "WITH " + _qs() + " SELECT qid, count(*) AS states, sum(len(options))::BIGINT AS options, round(sum(list_sum(logits)), 6) AS score FROM z GROUP BY qid"),
    "top_margins": (top_margins, f"{_SUB} SELECT state_id, qid, (list_position(logits, list_max(logits)) - 1)::INT AS best, round({_MARGIN}, 6) AS margin FROM pp"),
    "option_probabilities": (option_probabilities, "WITH " + _qs() + ", pp AS (SELECT qid, " + _soft("logits", "2.0") + " AS p FROM z), e AS (SELECT qid, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS pos FROM pp) SELECT qid, pos::INT AS pos, round(avg(p), 6) AS p FROM e GROUP BY ALL"),
    "confidence_by_question": (confidence_by_question, f"{_SUB} SELECT qid, round(avg({_CONF}), 6) AS confidence, round(avg({_EXP}), 6) AS expectation FROM pp GROUP BY qid"),
    "ensemble_views": (ensemble_views, f"{_SUB}, v AS (SELECT *, least(3, len(options)) AS n FROM pp WHERE qtype = 'choice' AND len(options) >= 2 AND {_MARGIN} < 0.4), w AS (SELECT *, unnest(range(1, n)) AS view FROM v) SELECT state_id, qid, view::INT AS view, (view * len(options) // n)::INT AS shift, options[(view * len(options) // n) + 1] AS first FROM w"),
    "ensemble_answers": (ensemble_answers, f"{_SUB}, a AS (SELECT *, {_LS('logits')} AS l FROM pp WHERE qtype = 'choice'), b AS (SELECT state_id, qid, labels[list_position(l, list_max(l))] AS choice, round({_R4('list_max(' + _soft('l') + ')')}, 3) AS confidence FROM a) SELECT * FROM b"),
    "calibrated_answers": (calibrated_answers, None),
    "consensus_answers": (consensus_answers, "WITH " + _qs() + f", a AS (SELECT *, {_LS('logits')} AS l1, list_transform(logits, lambda x: x * x) AS sq FROM z), b AS (SELECT *, {_LS('sq')} AS l2 FROM a), c AS (SELECT *, list_transform(l1, lambda x, i: 0.7 * x + 0.3 * l2[i]) AS f FROM b), pp AS (SELECT *, {_soft('f')} AS p FROM c) SELECT state_id, qid, CASE WHEN qtype = 'choice' THEN labels[list_position(p, list_max(p))] END AS choice, round({_R4('list_max(p)')}, 3) AS confidence FROM pp"),
    "selective_answers": (selective_answers, f"{_DEC}, an AS ({_ANS}) SELECT qid, count(*) FILTER (WHERE escalate) AS escalated, count(*) AS n FROM an GROUP BY qid"),
    "routed_requests": (routed_requests, f"WITH f AS ({_families_sql()}), r AS (SELECT suite, CASE WHEN count(*) = count(family) AND min(family) = max(family) THEN min(family) END AS family FROM verify v JOIN f ON f.item_id = v.item_id GROUP BY suite) SELECT suite, family, CASE WHEN family IN ('emotion', 'sentiment') THEN 'moods' WHEN family IN ('topic', 'intent') THEN 'themes' END AS adapter FROM r"),
    "prompt_layout": (prompt_layout, "WITH " + _qs() + """, a AS (SELECT state_id, qid, len(string_split(qtype || ' question: ' || instructions, ' ')) AS h, list_transform(options, lambda o: least(48, len(string_split(o, ' '))) + 1) AS o, len(string_split(state, ' ')) AS s FROM st, q),
        b AS (SELECT *, CASE WHEN 48 - list_sum(o) < 16 THEN list_transform(o, lambda x: least(x, greatest(4, 32 // len(o)))) ELSE o END AS c FROM a),
        e AS (SELECT *, least(h, greatest(8, 48 - list_sum(c)))::BIGINT AS kept FROM b), f AS (SELECT *, kept + 3 + list_sum(c)::BIGINT AS front, list_transform(c, lambda x, i: (kept + 2 + coalesce(list_sum(c[1:i - 1]), 0))::BIGINT) AS m FROM e)
        SELECT state_id, qid, least(96, front + least(s, greatest(0, 96 - front - 1)) + 1)::INT AS n, array_to_string(m, ',') AS markers, len(list_filter(m, lambda x: x >= 96)) = 0 AS fits FROM f"""),
    "gathered_decisions": (gathered_decisions, f"{_SUB} SELECT state_id, string_agg(qid, ',' ORDER BY qpos) AS questions, max(CASE WHEN qid = 'mood' THEN labels[list_position(p, list_max(p))] END) AS mood FROM pp GROUP BY state_id"),
}
