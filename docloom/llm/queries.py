"""The registered queries of the operators, over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocknames, classifier, mixing, overlap, packing, periodic, pieces, quotation, secrets, suffixes, topk, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_exact_top_k(spark, d):
    rows = topk.vector_rows(table(spark, d, "embeddings"))
    return topk.exact_top_k(rows.where(F.col("id") % 50 == 0), rows)


ORACLES["op2_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op3_quality_classifier(spark, d):
    scored = classifier.classify_quality(table(spark, d, "documents"), table(spark, d, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op6_mixture_packing(spark, d):
    return packing.piece_rows(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op7_factorization_machine(spark, d):
    scored = toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op8_secret_scans(spark, d):
    return secrets.secret_digests(table(spark, d, "documents"))


@query
def op9_block_naming(spark, d):
    found = blocknames.exact_dedup(table(spark, d, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op9_block_naming"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query
def op10_piece_encoding(spark, d):
    return pieces.piece_digests(table(spark, d, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op5_t_occurrence_join(spark, d):
    return overlap.near_components(table(spark, d, "documents"))


@query
def op4_suffix_sort_dedup(spark, d):
    found = suffixes.remove_repeats(table(spark, d, "documents"), contents=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op1_quotation_linking(spark, d):
    """The turns of ``conversations`` quote nothing, so they are first put into the form of mail with nested quotes."""
    mail = quotation.as_mail(table(spark, d, "conversations"))
    found = quotation.link_quotations(mail)
    return found.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "position", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLES["op1_quotation_linking"] = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
parts AS (SELECT conv_id, turn, text AS part FROM m UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM m),
units AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS unit FROM parts),
firsts AS (SELECT conv_id, unit, min(turn) AS original FROM units WHERE unit <> '' GROUP BY ALL),
quotes AS (SELECT conv_id, turn + back AS turn, back, unit FROM units, (VALUES (1), (2)) b(back) WHERE unit <> ''),
sums AS (SELECT q.conv_id, q.turn, back, original, sum(length(unit)) AS size FROM quotes q JOIN firsts USING (conv_id, unit)
         JOIN (SELECT DISTINCT conv_id, turn FROM m) k ON k.conv_id = q.conv_id AND k.turn = q.turn WHERE original < q.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, original FROM sums QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY back, size DESC, original) = 1),
links AS (SELECT DISTINCT m.conv_id, m.turn, original FROM m LEFT JOIN best USING (conv_id, turn)),
trees AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM links WHERE original IS NULL
          UNION ALL SELECT l.conv_id, l.turn, t.thread, t.depth + 1 FROM links l JOIN trees t ON l.conv_id = t.conv_id AND l.original = t.turn)
SELECT m.conv_id, m.turn, m.role, original AS reply_to, thread, CAST(depth AS BIGINT) AS depth,
       CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY thread, depth, m.turn, m.role, m.text) - 1 AS INTEGER) AS position, sha256(m.text) AS text_sha256
FROM m JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn JOIN trees t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""


@query
def op11_source_mixing(spark, d):
    found = mixing.placements(table(spark, d, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


@query
def op12_periodic_runs(spark, d):
    docs = periodic.with_repeats(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))
    return periodic.run_digests(periodic.find_runs(docs))


@query
def op13_embedding_whitening(spark, d):
    return whitening.whitened(table(spark, d, "embeddings"))


@query
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
