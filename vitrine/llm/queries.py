"""Registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.alignment import align_tokenizers
from vitrine.llm.collocations import mine_collocations
from vitrine.llm.common import table
from vitrine.llm.curve_packing import pack_along_curve
from vitrine.llm.html_tree import extract_main_text
from vitrine.llm.hyperlang import held_out, identify_languages, train_prototypes
from vitrine.llm.mixing import sampled_mixture
from vitrine.llm.outliers import quality_verdicts
from vitrine.llm.packing import pack_best_fit, token_pieces
from vitrine.llm.repeats import remove_repeats
from vitrine.llm.simhash import fingerprint_hex, simhash_components
from vitrine.llm.token_count import count_tokens
from vitrine.llm.topk import exact_top_k
from vitrine.llm.url_rules import match_url_rules

SEQUENCE = 2048
TOKEN_LIMIT = 512
NEIGHBOURS = 5
QUERY_STEP = 50
SHINGLE, BIT_DISTANCE = 3, 3
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_mixture(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).drop("distance")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    prototypes = train_prototypes(docs.where(~held_out(F.col("doc_id"))))
    found = identify_languages(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(
        table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), SEQUENCE
    )
    return pack_best_fit(pieces, SEQUENCE)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(
        table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), limit=TOKEN_LIMIT
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), NEIGHBOURS)


def op8_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"), SHINGLE, BIT_DISTANCE)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return match_url_rules(table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents", "text", "lang"), least=30, top=2000)


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack_along_curve(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return align_tokenizers(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_source_mixing, op2_html_main_text, op3_quality_rules, op4_language_id, op5_best_fit_packing,
            op6_token_counts, op7_exact_top_k, op8_simhash_near_dups, op9_suffix_array_dedup, op10_url_filters,
            op11_phrase_collocations, op12_curve_packing, op13_tokenizer_alignment,
        )
    }


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT row_number() OVER () AS i, page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), h AS (
  SELECT i, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT h.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY i ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), spans AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k
), f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS n
  FROM spans GROUP BY ALL HAVING count(*) >= 30
), cand AS (
  SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM cand
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, c.cut, x.n AS l, y.n AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.n + y.n) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_of AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3)) AS v(m) WHERE m < k)
), cover AS (
  SELECT lang, phrase, max(longer) AS longer FROM inner_of GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN cover c ON c.lang = s.lang AND c.phrase = s.phrase
  WHERE c.longer IS NULL OR CAST(100 AS HUGEINT) * c.longer < CAST(80 AS HUGEINT) * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_top_k": OP7_SQL, "op10_url_filters": OP10_SQL, "op11_phrase_collocations": OP11_SQL}
