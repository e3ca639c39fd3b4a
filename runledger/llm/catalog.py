"""Queries that apply each operator to its whole table, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.chat import rotate_perspectives
from runledger.llm.contamination import contained_items
from runledger.llm.langid import languages_of
from runledger.llm.lexical import ranked_documents
from runledger.llm.linedup import without_repeated_lines
from runledger.llm.mixing import mix_sources
from runledger.llm.neardup import near_duplicates
from runledger.llm.negatives import mine_hard_negatives, whole_vectors
from runledger.llm.neighbours import nearest_neighbours
from runledger.llm.secrets import scan_secrets
from runledger.llm.sharding import shard_documents
from runledger.llm.simhash import near_fingerprints
from runledger.llm.toxicity import score_toxicity, trained_on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (~trained_on()).alias("held_out"), "score", "predicted"
    )


def op4_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (17, 20))


def op5_kneser_ney_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages_of(docs).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "n_signs", "rejected"
    )


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    short = without_repeated_lines(docs, 3, 50)
    return short.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op10_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents"))


def op13_shared_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_superminhash_groups": op4_superminhash_groups,
    "op5_kneser_ney_languages": op5_kneser_ney_languages,
    "op6_perspectives": op6_perspectives,
    "op7_benchmark_containment": op7_benchmark_containment,
    "op8_line_runs": op8_line_runs,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_permutation_neighbours": op10_permutation_neighbours,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash_groups": op12_simhash_groups,
    "op13_shared_ranking": op13_shared_ranking,
}

OP1_SQL = r"""
WITH docs AS (
    SELECT doc_id,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        CASE WHEN source IS NULL THEN 'w' ELSE 'v' || source END AS src,
        md5('17:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS draw
    FROM documents
), sized AS (
    SELECT src, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS rk
    FROM docs GROUP BY src
), weighed AS (
    SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight
    FROM sized
), climbed AS (
    SELECT *,
        3 * sum(source_size) OVER () - coalesce(4 * sum(source_size) OVER below, 0) AS words,
        sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS free
    FROM weighed
    WINDOW below AS (ORDER BY source_size / weight, src
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), clamped AS (
    SELECT *, weight * words > 4 * source_size * free AS full_up FROM climbed
), level AS (
    SELECT 3 * sum(source_size) - coalesce(4 * sum(source_size) FILTER (full_up), 0) AS words,
        greatest(coalesce(sum(weight) FILTER (NOT full_up), 0), 1) AS free
    FROM clamped
), targets AS (
    SELECT c.src, c.source_size,
        CASE WHEN c.full_up THEN (2 * c.source_size)::DOUBLE
        ELSE (c.weight * l.words)::DOUBLE / (2 * l.free)::DOUBLE END AS target
    FROM clamped c CROSS JOIN level l
), planned AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
    FROM targets
), running AS (
    SELECT src, draw, sum(size) AS size,
        sum(sum(size)) OVER (PARTITION BY src ORDER BY draw) AS upto
    FROM docs GROUP BY src, draw
), drawn AS (
    SELECT r.src, r.draw, p.source_size, p.target, p.whole,
        2 * r.upto - r.size <= 2 * (p.target - p.whole * p.source_size) AS extra
    FROM running r JOIN planned p ON r.src = p.src
)
SELECT d.doc_id, d.size, w.source_size::BIGINT AS source_size, w.target,
    CASE WHEN d.size = 0 THEN 0
    ELSE (least(w.whole + w.extra::INT, 2) * d.size) END::BIGINT AS taken
FROM docs d JOIN drawn w ON d.src = w.src AND d.draw = w.draw
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingled AS (
    SELECT doc_id, unnest(
        CASE WHEN len(w) >= 3
        THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM words
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, shingle FROM shingled
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY 1, 2
), links AS MATERIALIZED (
    SELECT x, y FROM common
    JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
    WHERE 100 * shared >= 85 * (s.n + t.n - shared)
), edges AS MATERIALIZED (
    SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.seen = e.x
), lowest AS (
    SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id,
    d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l ON d.doc_id = l.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""

OP7_SQL = r"""
WITH texts AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
    SELECT kind, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM texts
), short AS (
    SELECT DISTINCT len(w) AS n FROM words WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4
), shingles AS MATERIALIZED (
    SELECT DISTINCT kind, id, shingle FROM (
        SELECT kind, id, unnest(
            CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
        FROM words
        UNION ALL
        SELECT kind, id, unnest(list_transform(range(1, len(w) - n + 2),
            lambda i: array_to_string(w[i:i + n - 1], ' ')))
        FROM words, short WHERE kind = 'd' AND len(w) >= n)
), sizes AS (
    SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
), shared AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
    FROM shingles d JOIN shingles i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'i'
    GROUP BY 1, 2
)
SELECT doc_id, item_id, n AS n_shingles, n_shared
FROM shared JOIN sizes ON sizes.id = item_id WHERE 5 * n_shared >= 4 * n
"""

OP6_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
        replace(coalesce(text, ''), '<|', '<\|') AS text, md5(coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT * EXCLUDE (digest), row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, speaker, digest) - 1 AS place
    FROM turns
), people AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM placed WHERE speaker <> 'system'
), seen AS (
    SELECT t.*, p.perspective,
        CASE WHEN speaker = 'system' THEN 'system'
        WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
    FROM placed t JOIN people p ON t.conv_id = p.conv_id
), headed AS (
    SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
        '<|im_start|>' || role || CASE WHEN role = 'user'
        THEN ' name=' || regexp_replace(replace(speaker, '<|', '<\|'), '[\r\n]+', ' ', 'g') ELSE '' END
        || chr(10) AS head
    FROM seen
), rendered AS (
    SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM headed
), spans AS (
    SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY place)
        - length(rendered))::BIGINT AS start
    FROM rendered
)
SELECT conv_id, perspective, place, turn, speaker, role, name, rendered, start,
    start + length(rendered) AS stop,
    CASE WHEN role = 'assistant' AND text <> '' THEN start + length(head) END AS train_start,
    CASE WHEN role = 'assistant' AND text <> ''
    THEN start + length(head) + length(text) + 10 END AS train_stop
FROM spans
"""

OP8_SQL = r"""
WITH lines AS MATERIALIZED (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents WHERE text IS NOT NULL
), full_lines AS (
    SELECT doc_id, line_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
        row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS spot
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
    SELECT doc_id, spot, 1 AS depth, line AS run, words FROM full_lines
    UNION ALL
    SELECT doc_id, spot, 2, line || chr(10) || lead(line) OVER doc, words + lead(words) OVER doc
    FROM full_lines WINDOW doc AS (PARTITION BY doc_id ORDER BY spot)
    UNION ALL
    SELECT doc_id, spot, 3, line || chr(10) || lead(line) OVER doc || chr(10)
        || lead(line, 2) OVER doc, 0
    FROM full_lines WINDOW doc AS (PARTITION BY doc_id ORDER BY spot)
), later AS (
    SELECT doc_id, spot, depth FROM (
        SELECT *, row_number() OVER (PARTITION BY depth, run ORDER BY doc_id, spot) AS n
        FROM runs WHERE run IS NOT NULL AND (depth = 3 OR words > 50))
    WHERE n > 1
), gone AS (
    SELECT DISTINCT f.doc_id, f.line_no
    FROM (SELECT doc_id, unnest(range(spot, spot + depth)) AS spot FROM later) l
    JOIN full_lines f ON f.doc_id = l.doc_id AND f.spot = l.spot
), cut AS (
    SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
        coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no)
            FILTER (g.line_no IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no
    GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
    md5(c.text) AS text_md5
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""

OP11_SQL = r"""
WITH usable AS (
    SELECT vec_id, embedding,
        CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), common AS (
    SELECT len(embedding) AS n FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), whole AS MATERIALIZED (
    SELECT row_number() OVER () AS place, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM usable WHERE len(embedding) = (SELECT n FROM common)
), scored AS MATERIALIZED (
    SELECT a.place AS anchor, a.vec_id AS anchor_id, b.vec_id, b.place,
        a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.place <> b.place
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, place AS positive, score AS positive_score
    FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (
        PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.alike
        AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH texts AS (
    SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
    UNION ALL SELECT 'i', 0, item_id, text FROM benchmark WHERE item_id IS NOT NULL
), terms AS MATERIALIZED (
    SELECT kind, row, id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM texts
), counts AS (
    SELECT row, id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL
), sizes AS (
    SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, totals GROUP BY term, docs
), scores AS (
    SELECT i.id AS item_id, c.id AS doc_id, c.row,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
    FROM (SELECT DISTINCT id, term FROM terms WHERE kind = 'i') i
    JOIN counts c ON c.term = i.term JOIN weights w ON w.term = i.term
    JOIN sizes s ON s.row = c.row, totals
    GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scores WHERE score > 0 AND doc_id IS NOT NULL)
WHERE rank <= 50
"""

ORACLE: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op4_superminhash_groups": OP4_SQL,
    "op6_perspectives": OP6_SQL,
    "op7_benchmark_containment": OP7_SQL,
    "op8_line_runs": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_shared_ranking": OP13_SQL,
}
