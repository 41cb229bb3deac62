"""Licence and source filters, item validity and label parsers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import probability as P
from quillstone.functions.text import language_ok, norm, script_counts

# Licences that allow use and redistribution.
PERMISSIVE = ["apache-2.0", "mit", "cc-by-4.0", "cc-by-3.0", "cc0-1.0", "cc0", "bsd-3-clause", "odc-by", "cc-by-sa-3.0", "cc-by-sa-4.0"]


def permissive(licence: Column, allowed: Sequence[str] = PERMISSIVE) -> Column:
    """All comma-separated parts of a licence are allowed, and there is one."""
    parts = F.filter(F.transform(F.split(licence, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(list(allowed))), F.lit(False))


def excluded_source(src: Column, words: Sequence[str]) -> Column:
    """A source whose name has one of the words, in any case."""
    return src.rlike("(?i)" + "|".join(map(re.escape, words)))


def one_family(df: DataFrame, src: str, families: DataFrame, family: str = "family") -> DataFrame:
    """Rows whose source is, or lies below, exactly one of the families; adds the family.

    Families are matched by the prefixes of a source up to each slash: an equi-join, whatever their number.
    """
    parts = F.split(F.col(src), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    sources = df.select(src).where(F.col(src).isNotNull()).distinct().withColumn("_p", F.explode(prefixes))
    hits = sources.join(families.select(F.col(family).alias("_p")).distinct(), "_p").groupBy(src).agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias(family)).where("_n = 1").drop("_n")
    return df.join(hits, src)


def exclude_prefixes(df: DataFrame, src: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Rows whose source neither is nor lies below a prefix."""
    parts = F.split(F.col(src), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    bad = df.select(src).where(F.col(src).isNotNull()).distinct().withColumn("_p", F.explode(heads)).join(prefixes.select(F.col(prefix).alias("_p")), "_p", "left_semi").select(src).distinct()
    return df.join(bad, src, "left_anti")


def primary_language(lang: Column) -> Column:
    """``pt_BR`` as ``pt``."""
    return F.substring_index(F.replace(F.lower(F.trim(lang)), F.lit("_"), F.lit("-")), "-", 1)


def exclude_values(df: DataFrame, field: str, denied: Sequence[str]) -> DataFrame:
    """Rows whose field is none of the denied values; languages by their primary subtag; a missing column is an error."""
    if field not in df.columns:
        raise ValueError(f"no column {field!r}")
    value = primary_language(F.col(field)) if field == "lang" else F.col(field)
    return df.where(value.isNull() | ~value.isin(list(denied)))


def valid_item(state: Column, kind: Column, options: Column, target: Column) -> Column:
    """State not blank, known type, two options at least, one target per option, exactly one 1, sum 1."""
    return F.coalesce(
        (F.trim(state) != "") & kind.isin("choice", "score", "noul") & (F.size(options) >= 2) & (F.size(options) == F.size(target))
        & (F.size(F.filter(target, lambda x: x == 1.0)) == 1) & (F.abs(P.total(target) - 1.0) < 1e-9), F.lit(False),
    )


def soft_target(target: Column, options: Column, kind: Column) -> Column:
    """Weights that sum to 1; a single probability of a noul item as (no, yes); null if it cannot be one."""
    t = F.when((kind == "noul") & (F.size(target) == 1), F.array(1 - target[0], target[0])).otherwise(target)
    s = P.total(t)
    ok = (s > 0) & (F.size(F.array_distinct(options)) == F.size(options)) & (F.size(t) >= 2) & (F.size(t) == F.size(options))
    return F.when(ok, F.transform(t, lambda x: x / s))


def trivial(text: Column) -> Column:
    """At most twelve characters or two words after normalisation."""
    t = norm(text)
    return (F.length(t) <= 12) | (F.size(F.split(t, " ")) <= 2)


def agrees(kind: Column, gold: Column, answer: Column, options: Column) -> Column:
    """Whether an answer names the gold label: exactly, in another case, or by its description if that is unique."""
    same = answer == gold
    folded = F.lower(F.trim(answer)) == F.lower(F.trim(gold))
    by_text = F.filter(options, lambda o: F.lower(o["description"]) == F.lower(F.trim(answer)))
    described = (F.size(by_text) == 1) & (by_text[0]["key"] == gold)
    return F.when(kind == "choice", F.coalesce(same | folded | F.coalesce(described, F.lit(False)), F.lit(False))).when(kind == "noul", F.coalesce(folded, F.lit(False))).otherwise(F.coalesce(same, F.lit(False)))


def fold_key(text: Column) -> Column:
    """A label without case, hyphens, underscores and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[-_]", " "), r"\s+", " "))


def closed_labels(options: Column, allowed: Sequence[str]) -> Column:
    """Options whose keys are, folded, exactly the allowed labels, respelled as these: (options, fault); one of both is null."""
    table = F.create_map(fold_key(F.lit(allowed[0])), F.lit(allowed[0]), *(x for a in allowed[1:] for x in (fold_key(F.lit(a)), F.lit(a))))
    canon = F.transform(options, lambda o: F.struct(F.element_at(table, fold_key(o["key"])).alias("key"), o["description"].alias("description")))
    keys = F.transform(canon, lambda o: o["key"])
    fault = (
        F.when(options.isNull() | (F.size(options) == 0), "bad_options").when(F.exists(keys, lambda k: k.isNull()), "bad_key")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_options").when(F.size(keys) < len(allowed), "option_count")
    )
    return F.struct(F.when(fault.isNull(), canon).alias("options"), fault.alias("fault"))


def names_answer(question: Column, piece: Column) -> Column:
    """Whether a question gives a label away: as a whole word, or anywhere if it is long; labels under four characters don't count."""
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(piece, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.coalesce((F.length(piece) >= 4) & (((F.length(piece) >= 12) & F.contains(norm(question), norm(piece))) | F.regexp_like(question, quoted)), F.lit(False))


def script_ok(text: Column, lang: Column) -> Column:
    """:func:`language_ok` with the quotas of long texts relaxed for a short label."""
    c = script_counts(text)
    total = c["latin"] + c["arabic"] + c["devanagari"] + c["cyrillic"] + c["kana"] + c["cjk"]
    short_zh = (lang == "zh") & (c["cjk"] < 8)
    short_ja = (lang == "ja") & (c["kana"] < 4)
    return F.when(total < 4, True).when(short_zh, (c["cjk"] >= 0.5 * total) & (c["kana"] <= 1)).when(short_ja, (c["kana"] + c["cjk"] >= 0.5 * total) & (c["arabic"] < 0.1 * total)).otherwise(language_ok(text, lang))


#: Emoticons and pictures; marks of irony.
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


def generation_faults(state: Column, question: Column, kind: Column, gold: Column, options: Column, meta: Sequence[str] = ("as an ai", "language model", "the correct answer"), unasked: Sequence[str] = (), cheats: Sequence[str] = ("/s", "sarcasm", "sarcastic", "irony", "ironic")) -> Column:
    """Why a generated item is unusable; empty if it isn't.

    ``answer_leaked``: the question names the gold label. ``meta_phrase``: state or question talk about the task. ``unasked``: a phrase that no
    question may have (where emotions are labels: a question for emotions). ``cheat``: the state gives irony away by a tag, a picture or its
    name. ``duplicate_options``: keys or descriptions repeat, or a key is blank. ``empty_state``.
    """
    keys = F.transform(options, lambda o: norm(o["key"]))
    texts = F.filter(F.transform(options, lambda o: norm(o["description"])), lambda d: F.coalesce(d != "", F.lit(False)))
    some = lambda col, words: F.coalesce(norm(col).rlike("|".join(map(re.escape, words))), F.lit(False)) if words else F.lit(False)
    words = "|".join(re.escape(w) for w in cheats)
    checks = {
        "answer_leaked": (kind == "choice") & names_answer(question, gold), "meta_phrase": some(state, meta) | some(question, meta), "unasked": some(question, unasked),
        "cheat": F.coalesce(state.rlike(_EMOJI) | state.rlike(rf"(?iU)(?<!\w)(?:{words})(?!\w)"), F.lit(False)),
        "duplicate_options": (F.size(F.array_distinct(keys)) < F.size(keys)) | F.exists(keys, lambda k: F.coalesce(k == "", F.lit(True))) | (F.size(F.array_distinct(texts)) < F.size(texts)),
        "empty_state": F.coalesce(F.trim(state) == "", F.lit(True)),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))


def config_names(config: Column) -> Column:
    """The configurations that a text separated by bars or commas names; a null one is ``default``."""
    return F.coalesce(F.filter(F.transform(F.split(config, r"[|,]"), lambda x: F.trim(x)), lambda x: x != ""), F.array(F.lit("default")))


def excluded_records(df: DataFrame, exclusions: DataFrame, registry: str = "registry", source: str = "id", config: str = "config", families: Sequence[str] = ()) -> DataFrame:
    """Rows with ``excluded``: whether a policy covers their registry, source and configuration.

    ``exclusions`` has (registry, id, config, configs_only) and is configuration. In the registries of ``families`` an id covers all sources that
    begin with it, in others the source of that name; with ``configs_only`` only rows that name the excluded configuration.
    """
    e = exclusions.select(F.col("registry").alias("_r"), F.col("id").alias("_id"), F.col("config").alias("_c"), F.coalesce("configs_only", F.lit(False)).alias("_only"))
    names = df.select(registry, source, config).distinct()
    family = F.col("_r").isin(list(families)) if families else F.lit(False)
    by_name = F.when(family, F.startswith(F.col(source), F.col("_id"))).otherwise(F.col(source) == F.col("_id"))
    covered = by_name & (~F.col("_only") | F.col("_c").isNull() | F.array_contains(config_names(F.col(config)), F.col("_c")))
    # equi-join on the registry; the exclusions of one are a few rows
    hit = names.join(e, F.col(registry) == F.col("_r")).where(covered).select(*(F.col(c).alias(f"_k_{c}") for c in (registry, source, config))).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, [df[c].eqNullSafe(hit[f"_k_{c}"]) for c in (registry, source, config)], "left").select(*df.columns, F.coalesce("_hit", F.lit(False)).alias("excluded"))


def stars_to_sentiment(stars: Column) -> Column:
    return F.when(stars <= 2, "negative").when(stars == 3, "neutral").when(stars >= 4, "positive")


def polarity_label(x: Column, band: float = 0.1) -> Column:
    return F.when(x > band, "positive").when(x < -band, "negative").when(x.isNotNull(), "neutral")


def score_bin(x: Column, bins: int = 5) -> Column:
    """A value within 0 and 1 as a level of ``bins``."""
    return F.when(x.isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(x * bins)))).cast("int")


def mapped_labels(labels: Column, table: Mapping[str, str]) -> Column:
    """Labels through a table; null if one of them has no entry."""
    m = F.create_map(*(x for kv in table.items() for x in map(F.lit, kv)))
    out = F.transform(labels, lambda x: F.element_at(m, x))
    return F.when(F.forall(out, lambda x: x.isNotNull()), out)


def decode_label(value: Column, names: Sequence[str]) -> Column:
    """A class number as its name; null outside of the names."""
    return F.when((value >= 0) & (value < len(names)), F.get(F.array(*map(F.lit, names)), value.cast("int")))


def golden_weighted(index: Column, labels: Sequence[str], weights: Sequence[float]) -> Column:
    """The label of the ``index``-th of a quasi-random sequence with the given weights; prefixes stay the same."""
    total = sum(weights)
    u = F.pmod(index * 0.6180339887498949, F.lit(1.0))
    out, acc = F.lit(labels[-1]), sum(weights)
    for name, w in reversed(list(zip(labels, weights))):
        acc -= w
        out = F.when(u >= (acc + w) / total, out).otherwise(F.lit(name))
    return out


def version_affected(version: Column, ranges: Sequence[tuple[str | None, str | None]]) -> Column:
    """Whether a dotted version lies in one of the half-open ranges; what is no version counts as affected."""

    def parts(c: Column) -> Column:
        return F.transform(F.split(c, r"\."), lambda x: x.cast("int"))

    ok = version.rlike(r"\A\d+(\.\d+)*\z")
    inside = F.lit(False)
    for lo, hi in ranges:
        a = parts(version) >= parts(F.lit(lo)) if lo else F.lit(True)
        b = parts(version) < parts(F.lit(hi)) if hi else F.lit(True)
        inside = inside | (a & b)
    return F.when(ok, inside).otherwise(F.lit(True))


def registry_violations(sources: DataFrame, required: Sequence[str], allowed: Sequence[str] = PERMISSIVE) -> DataFrame:
    """(source, violation): missing fields, licences outside the list, check dates that are none or lie ahead, repeated names."""
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in required]
    if "licence" in sources.columns:
        checks.append(F.when(~permissive(F.col("licence"), allowed), F.lit("licence")))
    if "checked" in sources.columns:
        d = F.try_to_date(F.col("checked"), "yyyy-MM-dd")
        checks.append(F.when(d.isNull() | (d > F.current_date()), F.lit("date")))
    rows = sources.select("source", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    twice = sources.groupBy("source").count().where("count > 1").select("source", F.lit("repeated").alias("violation"))
    return rows.union(twice)
