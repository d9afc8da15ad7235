"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, exact, hardneg, htmltext, langid, neardup, packing, phrases, quality, substring, toxicity, urlfilter, warc
from cairn.llm.tables import read, small_batches

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(modulus: int, key: str = "doc_id"):
    """crc32 of the key as text, by modulus."""
    return F.crc32(F.col(key).cast("string")) % modulus


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold(4) != 2))
    return langid.identify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(warc.responses(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "content_type", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "action string, host string, path string")
    return urlfilter.judge(read(spark, sf_dir, "pages"), rules)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode_digests(bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.measured(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").where(hardneg.valid(F.col("label"), F.col("embedding")))
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


# stages of the pipeline -----------------------------------------------------------------------------------------------
def set_apart(docs: DataFrame) -> DataFrame:
    """docs with each column as own_<name>, so that none clashes with what an operator adds."""
    return docs.toDF(*(f"own_{c}" for c in docs.columns))


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under 0.5; the model learns from the labelled documents of the whole table."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return restored(toxicity.score(set_apart(docs), model, keep=set_apart(docs).columns, text="own_text").where("score < 0.5"), docs)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the method accepts; it learns from the lang column of what it is given."""
    small_batches(spark)
    own = set_apart(docs)
    return restored(langid.identify(own, langid.train(docs.select("doc_id", "text", "lang")), text="own_text", keep=own.columns).where("NOT rejected"), docs)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. Other columns travel with their row, so rows without a possible copy
    don't shuffle."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    return restored(exact.exact_groups(docs, keep=keep).where("kept").withColumnRenamed("doc_id", "own_doc_id"), docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return neardup.representatives(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_warc_derivatives, op4_url_filter, op5_bpe_round_trip, op6_toxicity, op7_exact_dedup, op8_html_text, op9_near_dedup, op10_quality_rules, op11_hard_negatives, op12_phrases, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": r"""
            WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                              coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
                 r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
                 m AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
                       FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
            SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
            FROM u LEFT JOIN (SELECT DISTINCT * FROM m) m ON u.page_id = m.page_id AND u.host = m.host AND u.path = m.path""",
        "op7_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)""",
        "op10_quality_rules": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
            m AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS lines FROM d),
            g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
            p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM g, range(5) k(j) WHERE n > 1 GROUP BY r),
            b AS (SELECT m.r, doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
                    len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
                    coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN p ON m.r = p.r),
            f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                NOT (base_failed OR n_symbols * 10 > word_chars OR n_dup_lines * 2 > n_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words
                    OR length(regexp_replace(t, '[^\p{L}]+', '', 'g')) * 2 < word_chars OR length(t) - length(replace(t, '�', '')) > n_words) AS kept
            FROM f""",
        "op11_hard_negatives": r"""
            WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id AS id, b.k, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.k <> b.k),
            p AS (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5)
            SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ak, p.place ORDER BY s.score DESC, s.id)::INT AS rank
            FROM p JOIN s ON p.ak = s.ak AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
        "op12_phrases": r"""
            WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
            g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 4) c(m))),
            f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
            n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
            c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
            k AS (SELECT c.lang, c.phrase, c.m, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
                  FROM (SELECT c.*, d.k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, 3) d(k) WHERE d.k < c.m) c
                  JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
            s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM c WHERE m = 3) GROUP BY ALL)
            SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score::BIGINT AS score
            FROM s JOIN n ON n.lang = s.lang LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000""",
        "op13_substring_dedup": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
            f AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
            g AS (SELECT DISTINCT r, i + j AS i FROM p JOIN f USING (k), range(50) c(j) WHERE doc_id > least),
            s AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
            k AS (SELECT s.r, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY s.i) FILTER (g.i IS NULL) AS kept FROM s LEFT JOIN g ON s.r = g.r AND s.i = g.i GROUP BY s.r)
            SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    }
