"""The request surface over DataFrames of raw JSON bodies: limits, fields, work budgets, routing and response frames.

One Arrow pass reads each body once and yields a typed row; what follows is column expressions and joins.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import looks_english
from quillstone.operators.decide import QuestionError, parse_questions

# Names that a request and a question may have.
REQUEST_FIELDS = ["state", "states", "questions", "model", "lang", "ensemble", "ensemble_margin", "calibrate", "return_logits", "max_len", "head_max_len", "min_confidence", "adapter"]
QUESTION_FIELDS = ["type", "instructions", "criteria", "labels"]


@dataclass(frozen=True)
class Limits:
    """Bounds of one request; bytes are UTF-8."""

    depth: int = 64
    nodes: int = 100_000
    members: int = 4096
    key_bytes: int = 4096
    questions: int = 64
    states: int = 256
    state_chars: int = 50_000
    name_bytes: int = 256
    instruction_bytes: int = 16_384
    label_bytes: int = 1024
    criterion_bytes: int = 4096
    ensemble: int = 8
    least_len: int = 32
    most_len: int = 8192
    state_room: int = 128
    capacity: int = 8192
    work: int = 4096
    tokens: int = 2_000_000
    attention_bytes: int = 1 << 31
    padded_tokens: int = 8192
    batch_rows: int = 32
    heads: int = 12
    response_bytes: int = 64 << 20
    max_len: int = 1024
    head_max_len: int = 256


class Refused(Exception):
    """An HTTP status and why."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def _size(v: Any) -> int:
    return len((v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)).encode("utf-8", "surrogatepass"))


def read_json(raw: str | None, limits: Limits) -> Any:
    """A JSON value within bounds of depth, nodes, members and keys, without repeated keys."""
    nodes = 0

    def members(pairs: list[tuple[str, Any]]) -> dict:
        if len(pairs) > limits.members:
            raise Refused(413, "too many members in an object")
        if any(_size(k) > limits.key_bytes for k, _ in pairs):
            raise Refused(413, "a key is too long")
        out = dict(pairs)
        if len(out) != len(pairs):
            raise Refused(400, "a key occurs twice")
        return out

    def walk(v: Any, level: int) -> None:
        nonlocal nodes
        nodes += 1 + (len(v) if isinstance(v, dict) else 0)
        if nodes > limits.nodes:
            raise Refused(413, "too many values")
        if isinstance(v, (dict, list)):
            if level >= limits.depth:
                raise Refused(413, "nested too deep")
            for x in v.values() if isinstance(v, dict) else v:
                walk(x, level + 1)

    try:
        value = json.loads(raw or "", object_pairs_hook=members)
        walk(value, 0)
    except RecursionError:
        raise Refused(413, "nested too deep") from None
    except ValueError:
        raise Refused(400, "invalid JSON") from None
    return value


def _whole(body: Mapping, name: str, low: int, high: int, default: int) -> int:
    v = body.get(name, default)
    if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
        raise Refused(422, f"{name} must be a whole number from {low} to {high}")
    return v


def _known(v: Any, names: list[str], what: str) -> None:
    if not isinstance(v, Mapping):
        raise Refused(422, f"{what} must be an object")
    extra = sorted(set(v) - set(names))
    if extra:
        raise Refused(422, f"{what} has unknown fields: {', '.join(extra)}")


def check_fields(body: Any, limits: Limits) -> None:
    """Names, types and sizes of a request's fields and of its questions'."""
    _known(body, REQUEST_FIELDS, "the request")
    questions = body.get("questions")
    if not isinstance(questions, Mapping):
        raise Refused(400, "questions must be an object")
    for name in ("model", "lang", "adapter"):
        v = body.get(name)
        if name in body and not (v is None and name == "adapter") and not (isinstance(v, str) and _size(v) <= limits.name_bytes):
            raise Refused(422, f"{name} must be a text of at most {limits.name_bytes} bytes")
    if len(questions) > limits.questions:
        raise Refused(413, f"more than {limits.questions} questions")
    for qid, q in questions.items():
        if _size(qid) > limits.name_bytes:
            raise Refused(413, "a question's name is too long")
        _known(q, QUESTION_FIELDS, f"question {qid!r}")
        if _size(q.get("instructions", "")) > limits.instruction_bytes:
            raise Refused(413, "instructions are too long")
        for part in (q.get("criteria"), q.get("labels")):
            if isinstance(part, Mapping) and any(_size(k) > limits.label_bytes for k in part):
                raise Refused(413, "a label is too long")
            if isinstance(part, (Mapping, list)) and any(_size(x) > limits.criterion_bytes for x in (part.values() if isinstance(part, Mapping) else part)):
                raise Refused(413, "a description is too long")
    try:
        parse_questions(questions)
    except QuestionError as e:
        raise Refused(413 if "more than" in str(e) or "too large" in str(e) else 422, str(e)) from None


def work_of(questions: Mapping, ensemble: int, calibrate: bool) -> int:
    """Views of one state: a choice counts its ensemble, at most one view per option, and three more to calibrate."""
    views = 0
    for q in questions.values():
        if q.get("type") == "choice":
            views += min(ensemble, max(1, len(q.get("criteria") or ()))) + (3 if calibrate else 0)
        else:
            views += 1
    return views


def check_budget(body: Mapping, states: int, models: int, limits: Limits) -> dict:
    """Options of a request and its work; refuses what exceeds a budget of work, tokens, attention or response."""
    ensemble = _whole(body, "ensemble", 1, limits.ensemble, 1)
    head = _whole(body, "head_max_len", limits.least_len, limits.most_len, limits.head_max_len)
    length = max(_whole(body, "max_len", limits.least_len, limits.most_len, limits.max_len), head + limits.state_room)
    if length > limits.capacity:
        raise Refused(422, "max_len exceeds the capacity of the model")
    confidence = body.get("min_confidence", 0)
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        raise Refused(422, "min_confidence must be within 0 and 1")
    margin = body.get("ensemble_margin")
    margin = min(1.0, max(0.0, float(margin))) if isinstance(margin, (int, float)) and not isinstance(margin, bool) else None
    calibrate, logits = body.get("calibrate") is True, body.get("return_logits") is True
    work = states * models * work_of(body["questions"], ensemble, calibrate)
    if states > limits.states:
        raise Refused(413, f"more than {limits.states} states")
    if work > limits.work:
        raise Refused(413, f"work {work} exceeds {limits.work}")
    if work * length > limits.tokens:
        raise Refused(413, f"{work * length} tokens exceed {limits.tokens}")
    # rows of a packed pass, each as long as its longest: two float matrices per head
    if work and min(limits.batch_rows * length, limits.padded_tokens) * length * limits.heads * 8 > limits.attention_bytes:
        raise Refused(413, "attention needs too much memory")
    answer = 1024 + sum(4096 + 8 * (_size(k) + _size(q)) for k, q in body["questions"].items())
    if answer * states > limits.response_bytes:
        raise Refused(413, "the response would be too large")
    return {"ensemble": ensemble, "ensemble_margin": margin, "calibrate": calibrate, "return_logits": logits, "max_len": length, "head_max_len": head, "min_confidence": float(confidence), "work": work}


REQUEST = "http_status int, detail string, states array<string>, questions string, model string, lang string, adapter string, ensemble int, ensemble_margin double, calibrate boolean, return_logits boolean, max_len int, head_max_len int, min_confidence double, work bigint"
_NAMES = [x.split()[0] for x in REQUEST.split(", ")]


def parse_request(raw: str | None, batch: bool, models: int, limits: Limits) -> dict:
    """A typed request, or a status and a detail and nothing else."""
    try:
        body = read_json(raw, limits)
        check_fields(body, limits)
        if batch:
            states = body.get("states")
            if not isinstance(states, list):
                raise Refused(400, "states must be a list")
        else:
            states = [body.get("state")]
        texts = [s if isinstance(s, str) else json.dumps(s, ensure_ascii=False) for s in states]
        if any(s is None for s in states):
            raise Refused(422, "a state is missing")
        if any(len(t) > limits.state_chars for t in texts):
            raise Refused(413, "a state is too long")
        options = check_budget(body, len(states), models, limits)
    except Refused as e:
        return {"http_status": e.status, "detail": e.detail}
    named = {k: body.get(k) for k in ("model", "lang", "adapter")}
    return {"http_status": 200, "states": texts, "questions": json.dumps(body["questions"], ensure_ascii=False)} | named | options


def parse_requests(df: DataFrame, body: str = "body", batch: bool = False, models: int = 1, limits: Limits | None = None) -> DataFrame:
    """Adds the columns of ``REQUEST``: status 200 and a typed request, or 400, 413 or 422 and why. A null body is invalid JSON."""
    bounds = limits or Limits()

    @F.pandas_udf(REQUEST)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_request(x, batch, models, bounds) for x in s], columns=_NAMES).astype(object).where(lambda d: d.notna(), None)

    return df.withColumn("_request", run(body)).select(*df.columns, "_request.*")


def route(requests: DataFrame, models: DataFrame, adapters: DataFrame, english: str = "english", other: str = "multilingual", consensus: bool = False) -> DataFrame:
    """Adds ``served_by``, ``routing``, ``served_adapter``, ``adapter_routing`` and ``refused`` to parsed requests with a ``family``.

    ``models`` has (model, position), ``adapters`` (model, adapter, position, categories); both are configuration, a few rows. A
    request names a model, or an adapter that one model has, or its states decide by their language, or the first model
    serves it. ``consensus`` lets both language models answer where nothing is named. An adapter is named, or ``auto`` takes the
    first of the model that serves the request's family.
    """
    known = {r["model"]: r["position"] for r in models.collect()}  # configuration
    owned = adapters.collect()
    by_adapter: dict[str, set] = {}
    for a in owned:
        by_adapter.setdefault(a["adapter"], set()).add(a["model"])
    table = lambda m: F.create_map(*(F.lit(x) for kv in (m or {"": ""}).items() for x in kv))
    only = table({a: next(iter(ms)) for a, ms in by_adapter.items() if len(ms) == 1})
    both = english in known and other in known
    want = F.coalesce(F.col("adapter"), F.lit("none"))
    named = ~want.isin("none", "auto")
    fuse = F.lit(both) & (F.coalesce(F.col("model") == "consensus", F.lit(False)) | (F.lit(consensus) & F.col("model").isNull() & ~named))
    asked = F.coalesce(F.col("model").isin(list(known)), F.lit(False))
    by_text = looks_english(F.array_join("states", ""))
    first = min(known, key=known.get) if known else None
    model = F.when(fuse, "consensus").when(asked, F.col("model")).when(named & F.element_at(only, want).isNotNull(), F.element_at(only, want))
    model = (model.when(by_text, english).otherwise(F.lit(other)) if both else model.otherwise(F.lit(first)))
    why = F.when(fuse, "consensus").when(asked, "requested").when(named & F.element_at(only, want).isNotNull(), "adapter")
    why = why.when(by_text, "lang:en").otherwise(F.lit("lang:other")) if both else why.otherwise(F.lit("default"))
    rows = requests.withColumns({"served_by": model, "routing": why})
    family: dict[str, tuple] = {}
    for a in owned:
        for c in a["categories"]:
            k = f"{a['model']}\n{c}"
            family[k] = min(family.get(k, (a["position"], a["adapter"])), (a["position"], a["adapter"]))
    auto = F.element_at(table({k: v[1] for k, v in family.items()}), F.concat_ws("\n", "served_by", "family"))
    has = F.concat_ws("\n", "served_by", want).isin([f"{a['model']}\n{a['adapter']}" for a in owned] or [""])
    fused = F.col("served_by") == "consensus"
    refused = F.when(fused & named, F.concat(F.lit("adapter "), want, F.lit(" cannot be combined with consensus"))).when(named & ~has, F.concat(F.lit("unknown adapter "), want))
    chosen = F.when(refused.isNotNull() | fused, F.lit(None)).when(want == "auto", auto).when(named, want)
    reason = F.when(named, "requested").when(want != "auto", "none").when(fused, "auto:consensus").when(F.col("family").isNull(), "auto:no-family").when(auto.isNull(), F.concat(F.lit("auto:"), "family", F.lit(":no-adapter"))).otherwise(F.concat(F.lit("auto:"), "family"))
    return rows.withColumns({"served_adapter": chosen, "adapter_routing": F.when(refused.isNull(), reason), "refused": refused})


def responses(df: DataFrame, request_id: str = "request_id", status: str = "http_status", detail: str = "detail", answers: str = "answers", extra: Column | None = None) -> DataFrame:
    """(request_id, http_status, body): answers of a good request in one JSON object, or the detail of a refused one."""
    good = F.to_json(F.struct(F.col(request_id).alias("request_id"), F.col(answers).alias("answers"), *([extra.alias("info")] if extra is not None else [])))
    bad = F.to_json(F.struct(F.col(request_id).alias("request_id"), F.col(detail).alias("detail")))
    return df.select(request_id, status, F.when(F.col(status) == 200, good).otherwise(bad).alias("body"))
