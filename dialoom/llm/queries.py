"""The queries of this subpackage, thin over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, minhash, mixing, packing, pagetext, prefixtrie, quality, sentencepieces, suffixdedup, tokenfile, topk, toxicity, whitening
from .samples import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.NearDup(words=3, percent=85, rows=6))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pagetext.extract_pages(pages, pagetext.train(pages))


def op9_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trips(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_minhash_neardup, op2_pivotal_mixing, op3_gru_toxicity, op4_hierarchical_langid, op5_nnls_packing,
        op6_ngram_quality, op7_segment_topk, op8_page_text, op9_simple8b_tokens, op10_suffix_dedup,
        op11_prefix_trie, op12_backtracking_pieces, op13_chebyshev_whitening,
    ]
    return {f.__name__: f for f in found}


#: Links by an inverted index of the shingles, components by repeated joins.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
      THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT b, root FROM reach JOIN edge ON a = node
), c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

#: Prefixes as lists; the checksum of an id bit by bit.
OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (
  SELECT *, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM c
), r AS (
  SELECT k.conv_id, list_concat(coalesce(b.turns[1:h], []), k.turns[h + 1:]) AS turns
  FROM k LEFT JOIN c b ON b.conv_id = k.conv_id - k.conv_id % 5
), m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM r
), n AS (
  SELECT depth, turns[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM m GROUP BY ALL
), t AS (
  SELECT *, CASE WHEN depth > 0 THEN prefix[1:depth - 1] END AS parent, (n_convs - 1) * coalesce(strlen(prefix[depth].text), 0) AS saved FROM n
), kids AS (SELECT parent AS prefix, count(*) AS n_children FROM t WHERE depth > 0 GROUP BY parent
), u AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM t LEFT JOIN kids USING (prefix)
), s AS (
  SELECT prefix[1:d] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM u) GROUP BY 1
)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM u JOIN s USING (prefix) LEFT JOIN n p ON p.prefix = u.parent
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    return {"op1_minhash_neardup": OP1_SQL, "op7_segment_topk": OP7_SQL, "op11_prefix_trie": OP11_SQL}
