"""Queries of this subpackage: name → (spark, sf_dir) → DataFrame, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import bagminhash, collocations, conversations, langid, linededup, mixing, nndescent, packing, pieces, pii, secrets, vafile, wavelet
from evenhand.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LINE_SQL = """
WITH parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, i AS no, p[i + 1] AS line FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM parts)
  WHERE length(trim(p[i + 1], ' ')) > 0),
firsts AS (
  SELECT line, length(line) AS n, min({'d': doc_id, 'i': no}) AS first FROM lines GROUP BY line),
cut AS (
  SELECT line, n, first, i, hash(substr(line, 1, i) || substr(line, i + 2)) AS v
  FROM (SELECT *, unnest(range(n)) AS i FROM firsts WHERE n >= 20)),
changed AS (
  SELECT v, i, min(first) AS earliest FROM cut GROUP BY v, i HAVING count(*) > 1),
late AS (
  SELECT c.line FROM cut c JOIN changed m ON c.v = m.v AND c.i = m.i WHERE m.earliest < c.first
  UNION
  SELECT CASE WHEN c.first < f.first THEN f.line ELSE c.line END FROM cut c JOIN firsts f ON c.v = hash(f.line) AND f.n >= 20),
gone AS (
  SELECT l.doc_id, list(l.no) AS nos FROM lines l JOIN firsts f ON l.line = f.line
  WHERE l.line IN (SELECT line FROM late) OR {'d': l.doc_id, 'i': l.no} > f.first GROUP BY l.doc_id)
SELECT d.doc_id,
  CASE WHEN g.nos IS NULL THEN d.text
       ELSE COALESCE(array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(g.nos, i)),
            lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) AS BIGINT) END AS n_lines,
  COALESCE(CAST(len(g.nos) AS BIGINT), 0) AS n_dropped
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""


@query("op1_line_dedup", LINE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


TOP_K_SQL = """
WITH base AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM base q JOIN base c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_exact_top_k", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(table(spark, sf_dir, "documents")))


@query("op7_nn_descent")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.grouped(table(spark, sf_dir, "embeddings"))


@query("op8_context_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scored(table(spark, sf_dir, "documents"))


@query("op9_bagminhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.grouped(table(spark, sf_dir, "documents")).drop("node")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


@query("op13_wavelet_matrix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents")).drop("ids")


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM worded WHERE len(w) > 0) WHERE len(w) >= m),
counted AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
phrases AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, m, w, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM phrases WHERE m > 2))
  GROUP BY ALL),
kept AS (
  SELECT p.* FROM phrases p LEFT JOIN inner_parts o ON p.lang = o.lang AND p.phrase = o.phrase
  WHERE o.around IS NULL OR 100 * o.around < 100 * p.a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts c JOIN counted h ON c.lang = h.lang AND c.head = h.phrase JOIN counted t ON c.lang = t.lang AND c.tail = t.phrase
    JOIN totals ON c.lang = totals.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op12_phrase_collocations", PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))
