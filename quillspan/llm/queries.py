"""The queries of this subpackage: each applies its operator, as in production, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_automaton, filter_audit, fingerprints, language_id, mixing, quality_classifier, quality_rules, secret_scan, setsketch, simhash, token_files, toxicity, vector_codes
from .common import documents, labels


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir), quality_classifier.held_out())


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), language_id.held_out())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir), toxicity.held_out())


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.components(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_quality_rules, op2_quality_classifier, op3_bpe_automaton, op4_mixing, op5_language_id, op6_simhash, op7_fingerprints)
    every = (*first, op8_secret_scan, op9_token_files, op10_toxicity, op11_setsketch, op12_vector_codes, op13_filter_audit)
    return {f.__name__: f for f in every}


#: op4: md5 is in both engines, sizes and weights are integers and the rest is the same double arithmetic.
_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, source_size / w AS ratio,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY source_size / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT ratio AS free_ratio, level AS free_level FROM leveled WHERE level <= 3 * ratio ORDER BY ratio, source NULLS FIRST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN free_ratio IS NULL OR (ratio < free_ratio AND level > 3 * ratio) THEN CAST(3 * source_size AS DOUBLE) ELSE free_level * w END AS target
  FROM leveled LEFT JOIN free ON true
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each_copies,
         CAST('0x' || substr(md5('mix' || coalesce(s.source, chr(0) || 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS start,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5('mix' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(place * each_copies + start) - floor((place - 1) * each_copies + start)) AS BIGINT) AS taken
FROM ranked
"""


def _rules_sql() -> str:
    """op1: the statistics, the votes, and the rounds of expectation-maximisation as a recursion over one row."""
    m = 10  # votes in the order of quality_rules.rules()
    vote = lambda bad, good: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    over = lambda a, b: f"({a} / CAST(greatest({b}, 1) AS DOUBLE))"
    symbols, letters, dup, repeats = over("n_symbols", "n_words"), over("n_letters", "word_chars"), over("n_dup_lines", "n_lines"), over("n_repeat_words", "n_words")
    upper, length, ends, variety = over("n_upper", "word_chars"), over("word_chars", "n_words"), over("n_ends", "n_words"), over("n_distinct", "n_words")
    bare = over("n_bare", "n_words")
    votes = [
        vote("n_words < 20", "n_words >= 50"), vote(f"{symbols} > 0.2", f"{symbols} <= 0.05"), vote(f"{letters} < 0.88", f"{letters} >= 0.92"),
        vote(f"{dup} > 0.3", f"{dup} <= 0.1"), vote(f"{repeats} > 0.4", f"{repeats} <= 0.2"), vote(f"{upper} > 0.4", f"{upper} <= 0.2"),
        vote(f"{length} < 2 OR {length} > 15", f"{length} >= 3 AND {length} <= 10"),
        vote(f"{ends} > 0.7 OR (n_ends = 0 AND n_words >= 50)", f"{ends} > 0.01 AND {ends} <= 0.35"), vote(f"{variety} < 0.1 AND n_words >= 50", f"{variety} >= 0.25"),
        vote(f"{bare} > 0.2", f"{bare} <= 0.1"),
    ]
    each = lambda f: ", ".join(f(j) for j in range(1, m + 1))
    logit = "ln(prior / (1 - prior))" + "".join(f" + CASE WHEN v[{j}] > 0 THEN ln(good[{j}] / (1 - bad[{j}])) WHEN v[{j}] < 0 THEN ln((1 - good[{j}]) / bad[{j}]) ELSE 0 END" for j in range(1, m + 1))
    start = "CASE WHEN NOT list_contains(v, -1) AND list_contains(v, 1) THEN 0.98 WHEN len(list_filter(v, lambda x: x = -1)) = 1 THEN 0.5 ELSE 0.02 END"
    sums = each(lambda j: f"sum(c * q * CAST(v[{j}] <> 0 AS INT)) AS voted{j}, sum(c * q * CAST(v[{j}] > 0 AS INT)) AS right{j}, sum(c * (1 - q) * CAST(v[{j}] <> 0 AS INT)) AS had{j}, sum(c * (1 - q) * CAST(v[{j}] < 0 AS INT)) AS caught{j}")
    good = lambda j: f"least(greatest((right{j} + 0.99 * pseudo) / (voted{j} + pseudo), 0.5), 0.9995)"
    bad = lambda j: f"least(greatest((caught{j} + 3) / (had{j} + 10), 1.01 - {good(j)}), 0.999)"
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
), stats AS (
  SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '\PL+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^.!?]+', '', 'g')) AS BIGINT) AS n_ends,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
         CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '\pL'))) AS BIGINT) AS n_bare,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.rid = d.rid
), voted AS (
  SELECT *, [{', '.join(votes)}] AS v FROM stats
), patterns AS (
  SELECT v, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM voted GROUP BY v
), em(round, prior, good, bad, done) AS (
  SELECT 0, CAST(0.8 AS DOUBLE), CAST([{each(lambda j: '0.95')}] AS DOUBLE[]), CAST([{each(lambda j: '0.5')}] AS DOUBLE[]), false
  UNION ALL
  SELECT round + 1, least(greatest(share, 0.05), 0.99), [{each(good)}], [{each(bad)}], abs(least(greatest(share, 0.05), 0.99) - prior) < 1e-9
  FROM (
    SELECT round, prior, 10 + 0.02 * max(total) AS pseudo, (sum(c * q) + 8) / (max(total) + 10) AS share, {sums}
    FROM (SELECT round, prior, c, total, v, CAST(CASE WHEN round = 0 THEN {start} ELSE 1 / (1 + exp(-least(greatest({logit}, -500), 500))) END AS DOUBLE) AS q FROM em, patterns WHERE round < 100 AND NOT done)
    GROUP BY round, prior
  )
), model AS (SELECT * FROM em ORDER BY round DESC LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior
FROM (SELECT voted.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({logit}))) AS p FROM voted, model)
"""


#: op11: all pairs that share a shingle, and what is reached over those with the wanted index.
_SETS = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d
), x AS (
  SELECT rid, len(g) AS n, unnest(g) AS shingle FROM s
), link AS (
  SELECT a.rid AS a, b.rid AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.rid < b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(rid, other) AS (
  SELECT rid, rid FROM s
  UNION
  SELECT rid, e.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) e ON e.a = reach.other
), least AS (
  SELECT r.rid, min(o.doc_id) AS least FROM reach r JOIN s o ON o.rid = r.other GROUP BY r.rid
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least AS component_id, doc_id IS NOT DISTINCT FROM least AS kept FROM s JOIN least USING (rid)
"""

#: op13: every document meets every order; its first failing filter is where it goes.
_AUDIT = r"""
WITH l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT row_number() OVER () AS rid, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         ['A', 'B', 'C', 'D', 'E'] AS names,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), met AS (
  SELECT part, filter_order, good, toxic, names, fails, list_position(list_transform(string_split(filter_order, ''), lambda x: fails[list_position(names, x)]), true) AS gone,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM d, orders
), parts AS (
  SELECT DISTINCT part FROM d
), every AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f FROM parts, orders, range(1, 6) r(step)
), rows AS (
  SELECT e.part, e.filter_order, e.step, e.f,
         count(*) FILTER (gone IS NULL OR gone = 0 OR gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
         count(*) FILTER (fails[list_position(names, f)] AND gone < step) AS redundant, count(*) FILTER (fails[list_position(names, f)] AND n_fails = 1) AS unique_fails,
         count(*) FILTER (gone = step AND good = 1) AS good_lost, count(*) FILTER (gone = step AND toxic = 1) AS toxic_lost
  FROM every e JOIN met m ON m.part = e.part AND m.filter_order = e.filter_order
  GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM rows
"""


def _codes_sql(parts: int = 4, rounds: int = 4) -> str:
    """op12: each round a full search; |x - c|^2 in whole numbers, which doubles hold."""
    nearest = lambda book: f"""
  SELECT vec_id, p, x, entry, CAST(d AS BIGINT) AS d FROM (
    SELECT v.vec_id, v.p, v.x, b.entry, v.xx - 2 * list_inner_product(v.x, b.c) + b.cc AS d,
           row_number() OVER (PARTITION BY v.vec_id, v.p ORDER BY v.xx - 2 * list_inner_product(v.x, b.c) + b.cc, b.entry) AS r
    FROM cut v JOIN (SELECT p, entry, c, list_inner_product(c, c) AS cc FROM {book}) b ON b.p = v.p
  ) WHERE r = 1"""  # noqa: E731
    turns = []
    for k in range(1, rounds + 1):
        turns.append(f"near{k} AS MATERIALIZED ({nearest(f'book{k - 1}')}\n)")
        turns.append(f"""book{k} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{k - 1} b LEFT JOIN (
    SELECT p, entry, list(c ORDER BY i) AS c FROM (SELECT p, entry, i, floor(sum(x[i]) / count(*)) AS c FROM near{k}, unnest(range(1, len(x) + 1)) r(i) GROUP BY p, entry, i) GROUP BY p, entry
  ) m ON m.p = b.p AND m.entry = b.entry
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), cut AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
), {', '.join(turns)}, final AS MATERIALIZED ({nearest(f'book{rounds}')}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY vec_id
)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, entry)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN coded USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _rules_sql(), "op4_mixing": _MIXING, "op11_setsketch": _SETS, "op12_vector_codes": _codes_sql(), "op13_filter_audit": _AUDIT}
