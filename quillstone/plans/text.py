"""Text functions over the documents and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.languages import CODES, language_code
from quillstone.operators.decide import question_family
from quillstone.session import table

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]+"


def sql_norm(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{SPACE}', ' ', 'g')))"


def _n(c: str, cls: str) -> str:
    return f"len(regexp_extract_all({c}, '{cls}'))"


def _script_sql(c: str) -> str:
    return ", ".join(f"{_n(c, f'[{r}]')} AS {k}" for k, r in X.SCRIPTS.items())


def sql_links(rows: str, t: float) -> str:
    """CTEs for ``l`` (a, b, s): distinct texts of ``rows`` (id, t) whose 5-grams reach ``t``, found by the prefixes of their rarest grams."""
    return f"""d AS MATERIALIZED (SELECT min(id) AS id, t FROM ({rows}) WHERE t <> '' GROUP BY t),
        g AS MATERIALIZED (SELECT id, CASE WHEN length(t) <= 5 THEN [hash(t)] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: hash(substring(t, i, 5)))) END AS g FROM d),
        u AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS h FROM g), f AS (SELECT h, count(*) AS c FROM u GROUP BY h),
        p AS MATERIALIZED (SELECT id, n, h FROM (SELECT u.id, n, u.h, row_number() OVER (PARTITION BY u.id ORDER BY c, u.h) AS p FROM u JOIN f ON f.h = u.h) WHERE p <= n - ceil({t} * n - 1e-9) + 1),
        k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.h = b.h AND a.id < b.id WHERE least(a.n, b.n) >= {t} * greatest(a.n, b.n) - 1e-9),
        l AS MATERIALIZED (SELECT a, b, i / (na + nb - i)::DOUBLE AS s FROM (SELECT k.a, k.b, len(list_intersect(x.g, y.g)) AS i, len(x.g) AS na, len(y.g) AS nb FROM k JOIN g x ON x.id = k.a JOIN g y ON y.id = k.b) WHERE i / (na + nb - i)::DOUBLE >= {t})"""


SHARES = "latin/t AS pl, arabic/t AS pa, devanagari/t AS pd, cyrillic/t AS pc, kana/t AS pk, cjk/t AS pj"
TESTS = {
    "ar": "pa >= 0.6 AND pl < 0.25", "hi": "pd >= 0.6 AND pl < 0.25", "ru": "pc >= 0.6 AND pl < 0.25",
    "ja": "kana >= 4 AND pk >= 0.05 AND pk + pj >= 0.5 AND pa < 0.1", "zh": "cjk >= 8 AND pj >= 0.5 AND kana <= 1 AND pk < 0.02",
    "latin": "pl >= 0.7 AND pa + pd + pc + pk + pj <= 0.15",
}


def _family_sql() -> str:
    return "CASE WHEN t < 4 THEN NULL " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in TESTS.items()) + " END"


def _counted(t: str, key: str, col: str, extra: str = "") -> str:
    return f"SELECT *, {SHARES} FROM (SELECT *, (latin + arabic + devanagari + cyrillic + kana + cjk)::DOUBLE AS t FROM (SELECT {key}, {col} AS x{extra}, {_script_sql(col)} FROM {t}))"


def norm_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.sha2(X.norm(F.col("text")), 256).alias("digest"), F.length(X.norm(F.col("text"))).alias("n"))


def word_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


def script_letters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verify").select("item_id", X.script_counts(F.col("state")).alias("c")).select("item_id", "c.*")


def language_fits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verify").select("item_id", X.language_ok(F.col("state"), language_code(F.col("lang"))).alias("ok"))


def script_families(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.script_family(F.col("text")).alias("family"))


def guessed_languages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.guess_lang(F.col("text")).alias("guess"))


def english_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.looks_english(F.col("text")).alias("english"))


def language_codes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verify").groupBy(language_code(F.col("lang")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def opening_tokens(s: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(language_code(F.col("lang")), F.lit("en"))
    t = X.tokens(F.col("instructions"), code)
    return table(s, d, "verify").select("item_id", F.size(t).alias("n"), X.first_prefix(F.col("instructions"), code).alias("prefix"))


def gram_similarity(s: SparkSession, d: str) -> DataFrame:
    """5-gram similarity of each evaluation passage and the next one."""
    b = table(s, d, "benchmark").select("item_id", X.char_ngrams(F.col("text")).alias("g"))
    o = b.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return b.join(o, "item_id").select("item_id", F.size("g").alias("n"), F.round(X.jaccard(F.col("g"), F.col("h")), 9).alias("similarity"))


def nested_texts(s: SparkSession, d: str) -> DataFrame:
    """Strings at any depth of the items' states: how many there are, and their characters, by suite."""
    v = table(s, d, "verify").select("suite", F.explode(X.nested_strings(F.col("state"))).alias("s"))
    return v.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("distinct_strings"), F.sum(F.length("s")).alias("characters"))


def canonical_objects(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", X.canonical_json(F.col("props")).alias("json"))


def instruction_families(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verify").select("item_id", question_family(F.lit("q"), F.col("instructions")).alias("family"))


def _guess_sql() -> str:
    score = lambda ws: " + ".join(f"(instr(p, '{w}') > 0)::INT" for w in ws)
    cols = ", ".join(f"{score(ws)} AS s_{k}" for k, ws in X.FUNCTION_WORDS.items())
    names = list(X.FUNCTION_WORDS)
    top = f"greatest({', '.join('s_' + k for k in names)})"
    win = " + ".join(f"(s_{k} = m)::INT" for k in names)
    pick = "CASE " + " ".join(f"WHEN s_{k} = m THEN '{k}'" for k in names) + " END"
    return f"""WITH f AS ({_counted('documents', 'doc_id', 'text')}), g AS (SELECT doc_id, {_family_sql()} AS fam, ' ' || {sql_norm('x')} || ' ' AS p FROM f),
        h AS (SELECT doc_id, fam, {cols} FROM g), i AS (SELECT *, {top} AS m FROM h)
        SELECT doc_id, CASE WHEN fam = 'latin' THEN CASE WHEN m >= 2 AND {win} = 1 THEN {pick} ELSE '' END ELSE coalesce(fam, '') END AS guess FROM i"""


_CODE = "(SELECT code FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CODES.items()) + ") c(name, code) WHERE c.name = regexp_extract(lower(trim(v.lang)), '^([\\p{L}]+)', 1))"
#: Strings of JSON states, and plain states as their own string.
SQL_STRINGS = "(SELECT item_id, suite, split, t.atom ->> '$' AS s FROM (SELECT item_id, suite, split, state FROM verify WHERE json_valid(state)) v, json_tree(v.state) t WHERE t.type = 'VARCHAR' UNION ALL SELECT item_id, suite, split, state FROM verify WHERE NOT json_valid(state))"
_EN = ", ".join(f"'{w}'" for w in X.ENGLISH_WORDS)
_TOK = "regexp_extract_all(lower(instructions), CASE WHEN code IN ('ja', 'zh') THEN '[\\p{L}\\p{N}]' ELSE '[\\p{L}\\p{N}\\p{M}]+' END)"


def _families_sql() -> str:
    from quillstone.operators.decide import FAMILIES

    hits = ", ".join(f"CASE WHEN list_has_any(w, ['" + "', '".join(k) + f"']) THEN '{f}' END" for f, k in FAMILIES.items())
    return f"WITH a AS (SELECT item_id, regexp_extract_all(lower(instructions), '[a-z0-9]+') AS w FROM verify), b AS (SELECT item_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS h FROM a) SELECT item_id, CASE WHEN len(h) = 1 THEN h[1] END AS family FROM b"


ALL = {
    "norm_text": (norm_text, f"SELECT doc_id, sha256({sql_norm('text')}) AS digest, length({sql_norm('text')}) AS n FROM documents"),
    "word_counts": (word_counts, f"SELECT doc_id, {_n('nfc_normalize(text)', X.WORD_CHARACTERS)} + len(list_filter(string_split(trim(regexp_replace(regexp_replace(nfc_normalize(text), '{X.WORD_CHARACTERS}', ' ', 'g'), '{SPACE}', ' ', 'g')), ' '), lambda x: x <> '')) AS words FROM documents"),
    "script_letters": (script_letters, f"SELECT item_id, {_script_sql('state')} FROM verify"),
    "language_fits": (language_fits, f"WITH f AS ({_counted('verify v', 'item_id', 'state', f', {_CODE} AS code')}) SELECT item_id, CASE WHEN t < 4 THEN false WHEN code = 'ar' THEN {TESTS['ar']} WHEN code = 'hi' THEN {TESTS['hi']} WHEN code = 'ru' THEN {TESTS['ru']} WHEN code = 'ja' THEN {TESTS['ja']} WHEN code = 'zh' THEN {TESTS['zh']} ELSE {TESTS['latin']} END AS ok FROM f"),
    "script_families": (script_families, f"WITH f AS ({_counted('documents', 'doc_id', 'text')}) SELECT doc_id, {_family_sql()} AS family FROM f"),
    "guessed_languages": (guessed_languages, _guess_sql()),
    "english_texts": (english_texts, f"WITH a AS (SELECT doc_id, {_n('text', '[A-Za-z]')} AS l, {_n('text', '[^\\x00-\\x7f]')} AS o, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) SELECT doc_id, CASE WHEN l = 0 OR o * 50 > l THEN false WHEN len(w) < 4 THEN len(w) > 0 ELSE len(list_filter(w, lambda x: x IN ({_EN}))) * 10 >= len(w) END AS english FROM a"),
    "language_codes": (language_codes, f"SELECT {_CODE} AS code, count(*) AS n FROM verify v GROUP BY 1"),
    "opening_tokens": (opening_tokens, f"WITH a AS (SELECT item_id, instructions, coalesce({_CODE}, 'en') AS code FROM verify v), b AS (SELECT item_id, code, {_TOK} AS t FROM a) SELECT item_id, len(t)::INT AS n, CASE WHEN code IN ('ja', 'zh') THEN array_to_string(t[1:3], '') ELSE array_to_string(t[1:3], ' ') END AS prefix FROM b"),
    "gram_similarity": (gram_similarity, f"WITH a AS (SELECT item_id, {sql_norm('text')} AS t FROM benchmark), b AS (SELECT item_id, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS g FROM a) SELECT b.item_id, len(b.g)::INT AS n, round(len(list_intersect(b.g, c.g)) / len(list_distinct(list_concat(b.g, c.g)))::DOUBLE, 9) AS similarity FROM b JOIN b c ON c.item_id = b.item_id + 1"),
    "nested_texts": (nested_texts, f"SELECT suite, count(*) AS n, count(DISTINCT s) AS distinct_strings, sum(length(s))::BIGINT AS characters FROM {SQL_STRINGS} GROUP BY suite"),
    "canonical_objects": (canonical_objects, "WITH t AS (SELECT event_id, list_sort(json_keys(props)) AS k, props FROM events) SELECT event_id, '{' || array_to_string(list_transform(k, lambda x: '\"' || x || '\":' || (props -> ('$.' || x))::VARCHAR), ',') || '}' AS json FROM t"),
    "instruction_families": (instruction_families, _families_sql()),
}
