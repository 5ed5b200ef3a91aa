"""One named query per operator, each over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import (
    bpe_tree,
    decontaminate,
    graph_index,
    html_paths,
    license_scan as licences,
    line_dedup,
    lz_spans,
    prefix_counts,
    quality_trees,
    simhash_tree,
    source_divergence,
    token_alignment,
    warc,
)
from gradeframe.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH texts AS (
        SELECT DISTINCT doc_id, list_filter(
            string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+'), lambda w: w <> '') AS words
        FROM documents
    ), items AS (
        SELECT item_id, list_filter(
            string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+'), lambda w: w <> '') AS words
        FROM benchmark
    ), places AS (
        SELECT doc_id, len(words) - 4 AS total, words, unnest(range(1, len(words) - 3)) AS pos
        FROM texts WHERE len(words) >= 5
    ), shingles AS (
        SELECT doc_id, total, pos, array_to_string(words[pos:pos + 4], ' ') AS shingle FROM places
    ), item_places AS (
        SELECT item_id, len(words) - 4 AS n, words, unnest(range(1, len(words) - 3)) AS pos
        FROM items WHERE len(words) >= 5
    ), item_shingles AS (
        SELECT item_id, n, array_to_string(words[pos:pos + 4], ' ') AS shingle, count(*) AS times
        FROM item_places GROUP BY ALL
    ), starts AS (
        SELECT DISTINCT doc_id, total, pos AS start, item_id, n FROM shingles JOIN item_shingles USING (shingle)
    ), held AS (
        SELECT doc_id, total, start, item_id, n, shingle, count(*) AS times
        FROM starts JOIN shingles s USING (doc_id, total) WHERE s.pos BETWEEN start AND start + n - 1 GROUP BY ALL
    ), shared AS (
        SELECT h.doc_id, h.item_id, h.start, h.n, h.total, sum(least(h.times, i.times)) AS shared
        FROM held h JOIN item_shingles i USING (item_id, shingle) GROUP BY ALL
    ), scored AS (
        SELECT doc_id, item_id, start,
            shared::DOUBLE / (n + least(n, total - start + 1) - shared)::DOUBLE AS similarity FROM shared
    )
    SELECT doc_id, item_id, max(similarity) AS similarity, (arg_min(start, (-similarity, start)) - 1)::INTEGER AS start
    FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
    """
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start")


@query()
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query()
def op4_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op5_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tree.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(table(spark, sf_dir, "pages"))


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe_tree.Tokenizer(spark, TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # one use of the ids, so that encoding and digests share a Python worker
    return tokenizer.encode(docs).select("doc_id", tokenizer.digests("ids").alias("_d")).select("doc_id", "_d.*")


@query(
    r"""
    WITH docs AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
        FROM documents
    ), windows AS (
        SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM docs WHERE len(words) >= 50
    ), phrases AS (
        SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS phrase FROM windows
    ), owners AS (
        SELECT phrase, min(doc_id) AS low FROM phrases GROUP BY phrase
    ), gone AS (
        SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 50)))) AS places
        FROM phrases JOIN owners USING (phrase) WHERE doc_id > low GROUP BY doc_id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
        sha256(array_to_string(
            CASE WHEN places IS NULL THEN words
            ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
    FROM docs LEFT JOIN gone USING (doc_id)
    """
)
def op10_lz_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lz_spans.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.col("n_removed").cast("long"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = prefix_counts.PrefixTokens(spark, PIECES).token_counts(docs, TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = token_alignment.TokenAligner(spark, TOKENIZER, PIECES)
    return aligner.valued(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    r"""
    WITH docs AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS number,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents
    ), places AS (
        SELECT lang, source, number, unnest(words) AS term FROM docs
    ), kept AS (
        SELECT lang, term, count(*) AS total FROM places GROUP BY ALL HAVING count(DISTINCT number) >= 10
    ), langs AS (
        SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
    ), counts AS (
        SELECT lang, source, term, count(*) AS times FROM places JOIN kept USING (lang, term) GROUP BY ALL
    ), sizes AS (
        SELECT g.lang, g.source, coalesce(sum(times), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
    ), shares AS (
        SELECT lang, s.source, k.term, coalesce(c.times, 0) AS times,
            (1 + (1000000000::HUGEINT * (coalesce(c.times, 0) + 2)) // (s.n + 2 * l.v))::HUGEINT AS p,
            (1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v))::HUGEINT AS q
        FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
    ), distances AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
        SELECT s.lang, s.source, 'pair' AS part, t.source AS item, coalesce(d.value, 0)::BIGINT AS value
        FROM sizes s JOIN sizes t ON s.lang = t.lang AND s.source <> t.source
        LEFT JOIN distances d ON d.lang = s.lang AND d.source = s.source AND d.item = t.source
        UNION ALL
        SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE times > 0 AND p > q
    ), ranked AS (
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS "rank" FROM parts
    )
    SELECT * FROM ranked WHERE part = 'pair' OR "rank" <= 10
    """
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))
