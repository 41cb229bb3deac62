"""The queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.languages import CODES
from quillstone.llm.langid import document_languages, segment_languages, train_language_model, unnamed_languages
from quillstone.llm.leaks import leaks
from quillstone.llm.looks import sql_parts
from quillstone.llm.lookalikes import consistent, look_pairs, look_summary
from quillstone.llm.mixing import Mixture
from quillstone.llm.neardup import near_groups, near_pairs
from quillstone.llm.quality import document_quality
from quillstone.llm.sampling import CategorySample
from quillstone.llm.splits import ordered, split_pairs
from quillstone.llm.tokens import clean_name, token_budget, tokenizer_path
from quillstone.session import table

_TRAIN_SQL = "split = 'train'"
#: Vocabulary files of the public tokenizers that the queries count with.
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def _sample(spark: SparkSession, d: str) -> CategorySample:
    return CategorySample(table(spark, d, "verify"), table(spark, d, "sample_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the sample that cannot be met."""
    return _sample(spark, d).report().where("not met").select("lang", "gold")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).sample()


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(table(spark, d, "verify"), table(spark, d, "report"), tokenizer_path(PIECES))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return look_pairs(table(spark, d, "verify"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_summary(table(spark, d, "verify"))


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return consistent(table(spark, d, "verify"))


def _split_pairs(spark: SparkSession, d: str) -> DataFrame:
    return split_pairs(table(spark, d, "verify"), table(spark, d, "categories_multilingual"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ordered(_split_pairs(spark, d), "eval_id", "train_id", "item_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of overlaps per split of the evaluation row and source of the training row."""
    items = table(spark, d, "verify").select(F.col("item_id").alias("eval_id"), "split")
    log = table(spark, d, "report").select(F.col("item_id").alias("train_id"), "created_at", clean_name(F.col("src")).alias("src"))
    last = log.groupBy("train_id").agg(F.max(F.struct("created_at", "src")).alias("m")).select("train_id", "m.src")
    pairs = _split_pairs(spark, d).join(items, "eval_id").join(last, "train_id", "left")
    return pairs.groupBy("split", "src").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_items"), F.count_if(F.col("similarity") == 1).alias("same"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verify").where("split = 'train'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(_train(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(_train(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify")
    return segment_languages(v, train_language_model(v))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unnamed_languages(_segments(spark, d))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(_segments(spark, d))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("item_id", "doc_id")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer_path(RANKS))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report().where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).selection()


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return document_quality(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).where("not is_prose").select("doc_id")


_ALL = [p1_found, p1_report, p1_sample, p2_token_budget, p3_found, p3_classes, p3_consistent, p4_found, p4_report, p5_found, p5_groups, p6_found, p6_segments, p6_documents, p7_found, p7_leaks, p8_found, p8_report, p8_selection, p9_found, p9_statistics]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_visible(c: str) -> str:
    """The visible form of a column in DuckDB: replacements, ``translate`` and NFC."""
    single, gone, several = sql_parts()
    text = f"replace({c}, chr(13) || chr(10), chr(10))"
    for a, b in several:
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    before, after = "".join(a for a, _ in single) + gone, "".join(b for _, b in single)
    return f"nfc_normalize(translate({text}, {_quoted(before)}, {_quoted(after)}))"


_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]+"
_WORD = r"[\p{L}\p{N}]+"


def _near_sql() -> str:
    """(item_id, split, suite, ih, t, g): items with their instructions, plain state and hashed shingles, one list per distinct text."""
    plain = f"regexp_replace(lower({sql_visible('state')}), '{_SPACES}', ' ', 'g')"
    letters = f"array_to_string(regexp_extract_all(lower({sql_visible('i')}), '{_WORD}'), '')"
    return f"""n AS MATERIALIZED (SELECT i, {letters} AS ih FROM (SELECT DISTINCT coalesce(instructions, '') AS i FROM verify)),
        v AS MATERIALIZED (SELECT item_id, split, suite, ih, {plain} AS t FROM verify JOIN n ON n.i = coalesce(instructions, '') WHERE state IS NOT NULL),
        x AS MATERIALIZED (SELECT t, CASE WHEN length(t) < 5 THEN list_filter([hash(t)], lambda h: t <> '') ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: hash(substring(t, i, 5)))) END AS g FROM (SELECT DISTINCT t FROM v))"""


def _pairs_sql(left: str, right: str, order: str) -> str:
    """(ih, ta, tb, s): texts of two sides of one set of instructions that reach 0.8."""
    return f"""l AS (SELECT DISTINCT ih, t FROM v WHERE {left}), r AS (SELECT DISTINCT ih, t FROM v WHERE {right}),
        c AS (SELECT l.ih, l.t AS ta, r.t AS tb, a.g AS ga, b.g AS gb FROM l JOIN r ON r.ih = l.ih {order} JOIN x a ON a.t = l.t JOIN x b ON b.t = r.t WHERE l.t = r.t OR least(len(a.g), len(b.g)) >= 0.8 * greatest(len(a.g), len(b.g)) - 1e-9),
        s AS (SELECT ih, ta, tb, CASE WHEN ta = tb THEN 1.0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE END AS s FROM c)"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; the other queries are tested against brute force in ``tests/llm``."""
    codes = ", ".join(f"('{k}', '{v}')" for k, v in CODES.items())
    head = "regexp_extract(lower(trim(lang)), '^([\\p{L}]+)', 1)"
    field = lambda c: f"{sql_visible(f'coalesce({c}, {_quoted(str())})')}"
    held = "v.split IN ('dev', 'test') AND v.suite IN (SELECT suite FROM categories_multilingual WHERE suite IS NOT NULL)"
    between = f"{_near_sql()}, {_pairs_sql(held.replace('v.', ''), _TRAIN_SQL, '')}"
    matched = f"SELECT e.item_id AS e, t.item_id AS t, e.split, s.s FROM s JOIN v e ON e.ih = s.ih AND e.t = s.ta JOIN v t ON t.ih = s.ih AND t.t = s.tb WHERE s.s >= 0.8 - 1e-12 AND {held.replace('v.', 'e.')} AND t.{_TRAIN_SQL}"
    caseless = f"lower({sql_visible('text')})"
    visible = f"""o AS (SELECT item_id, state, array_to_string(list_transform(options, lambda o: coalesce(o.key, '') || chr(57344) || coalesce(o.description, '')), chr(57345)) AS o FROM verify WHERE state IS NOT NULL),
            v AS MATERIALIZED (SELECT item_id, state, coalesce(o, '') AS o, {sql_visible('state')} AS ls, {field('o')} AS lo FROM o)"""
    near = f"{_near_sql()}, {_pairs_sql(_TRAIN_SQL, _TRAIN_SQL, 'AND l.t <= r.t')}"
    return {
        "p1_found": f"""
            WITH codes(name, code) AS (VALUES {codes}),
            have AS (SELECT c.code, v.gold, count(*) AS n FROM (SELECT {head} AS name, gold FROM verify) v JOIN codes c ON v.name = c.name GROUP BY ALL),
            size AS (SELECT count(*) // 10 AS s FROM verify)
            SELECT t.lang, t.gold FROM sample_targets t CROSS JOIN size LEFT JOIN have h ON h.code = t.lang AND h.gold = t.gold
            WHERE coalesce(h.n, 0) < greatest(t.min_rows, t.share * s) - 1e-9""",
        "p3_found": f"""
            WITH {visible} SELECT a.item_id AS item_id_a, b.item_id AS item_id_b FROM v a JOIN v b ON a.ls = b.ls AND a.lo = b.lo AND a.item_id < b.item_id WHERE a.state <> b.state OR a.o <> b.o""",
        "p3_classes": f"""
            WITH {visible}, c AS (SELECT ls, lo, min({{'s': state, 'o': o}}) AS c, count(DISTINCT {{'s': state, 'o': o}}) AS spellings, count(*) AS records FROM v GROUP BY ls, lo HAVING count(DISTINCT {{'s': state, 'o': o}}) > 1)
            SELECT sha256(c.c.s || chr(57345) || chr(57344) || c.c.o) AS class_id, min(v.item_id) AS item_id, any_value(spellings) AS spellings, any_value(records) AS records
            FROM c JOIN v ON v.state = c.c.s AND v.o = c.c.o GROUP BY 1""",
        "p4_found": f"WITH {between}, m AS ({matched}) SELECT DISTINCT least(e, t) AS item_id_a, greatest(e, t) AS item_id_b FROM m",
        "p4_report": f"""
            WITH {between}, m AS ({matched}), latest AS (SELECT item_id, max({{'a': created_at, 'n': src IS NOT NULL, 's': coalesce(src, '')}}) AS last FROM (SELECT item_id, created_at, nullif(regexp_replace(trim(lower(src)), '[\\s/]+$', ''), '') AS src FROM report) GROUP BY item_id)
            SELECT m.split, CASE WHEN latest.last.n THEN latest.last.s END AS src, count(*) AS pairs, count(DISTINCT e) AS eval_items, count(*) FILTER (WHERE s = 1) AS same FROM m LEFT JOIN latest ON latest.item_id = m.t GROUP BY ALL""",
        "p5_found": f"""
            WITH {near} SELECT DISTINCT least(a.item_id, b.item_id) AS item_id_a, greatest(a.item_id, b.item_id) AS item_id_b
            FROM s JOIN v a ON a.ih = s.ih AND a.t = s.ta JOIN v b ON b.ih = s.ih AND b.t = s.tb WHERE s.s >= 0.8 - 1e-12 AND a.{_TRAIN_SQL} AND b.{_TRAIN_SQL} AND a.item_id <> b.item_id""",
        "p5_groups": f"""
            WITH RECURSIVE {near}, k AS MATERIALIZED (SELECT ih, t, min(item_id) AS rep, count(*) AS copies FROM v WHERE {_TRAIN_SQL} GROUP BY ih, t),
            e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM s JOIN k a ON a.ih = s.ih AND a.t = s.ta JOIN k b ON b.ih = s.ih AND b.t = s.tb WHERE s.s >= 0.8 - 1e-12 AND s.ta <> s.tb), w AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
            walk(node, root) AS (SELECT rep, rep FROM k UNION SELECT w.b, walk.root FROM walk JOIN w ON w.a = walk.node), g AS (SELECT node, min(root) AS root FROM walk GROUP BY node), deg AS (SELECT a, count(*) AS links FROM w GROUP BY a)
            SELECT v.item_id, g.root AS group_id, k.copies, coalesce(deg.links, 0) AS links FROM v JOIN k ON k.ih = v.ih AND k.t = v.t JOIN g ON g.node = k.rep LEFT JOIN deg ON deg.a = k.rep WHERE v.{_TRAIN_SQL}""",
        "p7_found": f"""
            WITH b AS (SELECT item_id, lang IN ('ja', 'zh') AS u, regexp_extract_all({caseless}, '{_WORD}') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all({caseless}, '{_WORD}') AS w FROM documents WHERE text IS NOT NULL),
            runs AS (SELECT item_id, unnest(CASE WHEN u THEN list_transform(range(1, length(array_to_string(w, '')) - 58), lambda i: substring(array_to_string(w, ''), i, 60)) ELSE list_transform(range(1, len(w) - 16), lambda i: array_to_string(w[i:i + 17], ' ')) END) AS g FROM b),
            found AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(array_to_string(w, '')) - 58), lambda i: substring(array_to_string(w, ''), i, 60)), list_transform(range(1, len(w) - 16), lambda i: array_to_string(w[i:i + 17], ' ')))) AS g FROM d)
            SELECT DISTINCT item_id, doc_id FROM runs JOIN found USING (g)""",
    }
