"""Registered queries: each dealt operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootseek.llm import bytebpe, collocations, jaccard, language, maintext, neighbours, packing, repeats, sentencepieces, tokencount, tokenfiles, topk, whitening
from rootseek.llm.common import read
from rootseek.session import new_folder

WORDS, PIECES, RANKS = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
#: The id appended to each document in token files.
END_ID = 2
#: Tokens beyond which a document is flagged.
TOKEN_LIMIT = 2048


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives the text back."""
    path, docs = public_tokenizers.path(PIECES), read(spark, sf_dir, "documents")
    return sentencepieces.round_trip(docs, path)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokenfiles")
    tokenfiles.write_files(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), folder, end_id=END_ID)
    return tokenfiles.decode_files(spark, folder, with_ids=False)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out()))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), percent=85, width=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_exact_top_k, op3_token_files, op4_nearest, op5_repeats, op6_main_text, op7_token_counts, op8_language,
    op9_similar_documents, op10_packing, op11_whitening, op12_collocations, op13_byte_bpe,
)}

# Vectors meet in SQL as pairs; quadratic, yet small enough at the scale of the checks.
ORACLE = {
    "op2_exact_top_k": """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, w[i : i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30
), candidates AS (
  SELECT * FROM counts WHERE len(g) >= 2
), cuts AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.g = c.g[1 : k]
  JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i : i + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM candidates, (VALUES (2), (3)) sizes(m) WHERE len(g) > m)
  GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.g = lowest.g
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
""",
}
