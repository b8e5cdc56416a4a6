"""The numbered queries: each operator over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (chat, collocations, decontaminate, exact_topk, graph_ann, near_dup, packing, pieces, product_codes, resample,
                        secret_scan, token_files, toxicity)
from parley.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the SentencePiece model and back."""
    done = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       pieces.ids_sha256(F.col("ids")).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token id files of all documents, written to the shared folder and read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE, folder, end_id=0)
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", token_files.ids_count(F.col("ids")).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed_pieces(packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1, capacity=2048))


def packed_pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids"), F.col("width")).alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; the vocabulary's ids are those of its tiktoken ranks."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), BYTE_BPE)
    spans, base = F.col("spans"), F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", *(secret_scan.count_of(k, spans).alias(f"n_{k}") for k in ("assign", "access", "hex")),
                        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(spans).alias("spans"), secret_scan.count_of("random", spans).alias("n_random"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op9_near_dup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


@query("op5_quality_resample")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and the draw."""
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of every twentieth vector, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


@query("op8_graph_ann")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op1_chat_format", """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
s AS (SELECT conv_id, pos, n, string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
      FROM p),
k AS (SELECT min(conv_id) AS conv_id, prefix FROM s WHERE pos = n GROUP BY prefix),
m AS (SELECT conv_id FROM k ANTI JOIN (SELECT DISTINCT prefix FROM s WHERE pos < n) AS b USING (prefix))
SELECT p.conv_id, CAST(floor((pos - 1) / 256) AS BIGINT) AS part, CAST(max(n) AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10)
                  || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
                  || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


_WORD_GRAMS = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
"""


@query("op11_collocations", _WORD_GRAMS + """
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
cut AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(w[:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
        FROM c, (VALUES (1), (2), (3)) AS s(j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, j, x.a AS l, y.a AS r,
             CAST((CAST(2000000 AS HUGEINT) * cut.a) // (x.a + y.a) AS BIGINT) AS score
      FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.first
               JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.rest),
low AS (SELECT lang, phrase, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score
        FROM s GROUP BY lang, phrase),
dropped AS (SELECT DISTINCT c.lang, c.phrase
            FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS part
                  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) AS s(m) WHERE m < k)) AS x
            JOIN c ON c.lang = x.lang AND c.phrase = x.part AND 100 * x.a >= 80 * c.a),
ranked AS (SELECT c.lang, c.phrase, c.a, l, r, score,
                  row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, c.phrase) AS rank
           FROM c JOIN low USING (lang, phrase) ANTI JOIN dropped USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"), least=30, most=2000)


_WORDS_OF = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w"""


@query("op12_decontaminate", f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS_OF} FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_OF} FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
hit AS MATERIALIZED (SELECT DISTINCT row, i, m, item
       FROM (SELECT row, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
             FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) AS s))
       JOIN win USING (m, win)),
n AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS place FROM hit) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


_NEAREST = """(SELECT p.row, p.part, p.x, min((list_sum(list_transform(range(1, len(p.x) + 1), lambda i:
             (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), entry)) AS best FROM p JOIN c{r} AS c USING (part) GROUP BY p.row, p.part, p.x)"""
_ROUND = """s{r} AS (SELECT part, best[2] AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
  FROM {nearest}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) AS k WHERE i <= len(x) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY part, entry),
c{next} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m USING (part, entry)),
"""


@query("op13_product_codes", """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label,
       list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT row, vec_id, part, e[part * len(e) // 8 + 1:(part + 1) * len(e) // 8] AS x
                   FROM v, (SELECT unnest(range(8)) AS part) AS k),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
                    QUALIFY entry < 16),
""" + "".join(_ROUND.format(r=r, next=r + 1, nearest=_NEAREST.format(r=r)) for r in range(6)) + f"""
a AS MATERIALIZED (SELECT row, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
                   FROM {_NEAREST.format(r=6)} GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN a USING (row), books
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return product_codes.compress(table(spark, sf_dir, "embeddings"), scale=4096.0)
