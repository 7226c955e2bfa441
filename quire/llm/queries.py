"""The queries opN_<name> over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import collocations, decontaminate, edit_counts, exact_dedup, jaccard, language, licenses, packing, repeats, secrets, sharding, spelling, toxicity
from quire.llm.common import documents


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op2_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(documents(spark, sf_dir)).drop("row")


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edit_table(documents(spark, sf_dir))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(documents(spark, sf_dir))


def op5_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_table(documents(spark, sf_dir))


def op6_wu_manber_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_table(documents(spark, sf_dir))


def op9_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_assigned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_table(documents(spark, sf_dir))


def op12_apriori_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_balanced_shards": op1_balanced_shards,
    "op2_jaccard_groups": op2_jaccard_groups,
    "op3_edit_token_counts": op3_edit_token_counts,
    "op4_language_mixture": op4_language_mixture,
    "op5_run_length_repeats": op5_run_length_repeats,
    "op6_wu_manber_leaks": op6_wu_manber_leaks,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_toxic_grammar": op9_toxic_grammar,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_assigned_secrets": op11_assigned_secrets,
    "op12_apriori_phrases": op12_apriori_phrases,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """,
    "op6_wu_manber_leaks": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
                FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        pos AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
                FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
        hit AS (SELECT doc_id, win.size AS size, i, item FROM pos JOIN win ON win.g = pos.g AND win.size = pos.size),
        cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY 1),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
        SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op12_apriori_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
        n AS (SELECT lang, cast(sum(len(w)) AS bigint) AS n FROM w GROUP BY 1),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        parts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS left_part, array_to_string(w[j + 1 : k], ' ') AS right_part FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        cuts AS (SELECT p.lang, p.phrase, a, j, x.f AS l, y.f AS r, cast((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS bigint) AS score
                 FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.left_part JOIN f y ON y.lang = p.lang AND y.phrase = p.right_part),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[1 : 2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM c WHERE k = 3) GROUP BY 1, 2),
        kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
}
