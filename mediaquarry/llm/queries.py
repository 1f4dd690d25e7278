"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, chosen_path, dialogues, hilbert, langid, licenses, lzparse, mixing, phrases, pieces, pii, secrets, tokenbin
from .common import shared_dir, table

#: The id that ends each document in op3's files.
END_ID = 2


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("same", "all_spans")


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    tokenbin.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokenbin.read_documents(spark, path)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_texts(table(spark, sf_dir, "documents")).drop("k1", "k2", "first")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best_phrases(table(spark, sf_dir, "documents"))


def op12_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_lzparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzparse.without_repeats(table(spark, sf_dir, "documents"), texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_cap_filters, op3_token_planes, op4_licenses, op5_sentencepiece, op6_chosen_path, op7_language_id, op8_mixing, op9_hilbert_neighbours, op10_secrets, op11_phrases, op12_dialogues, op13_lzparse)}

#: White space that parts words, as a class of DuckDB's regular expressions.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: All pairs, compared one by one, and what they reach.
REACHED = """, reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b), least AS (SELECT a AS id, min(b) AS least FROM reach GROUP BY 1), links AS (SELECT x AS id, count(*) AS n FROM e GROUP BY 1)"""

# The others rest on models, tokenizers or draws by hash, or have columns that a method makes.
ORACLE_SQL: dict[str, str] = {
    "op2_cap_filters": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), nodes AS (SELECT id FROM v), u AS (SELECT id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND len(list_filter(x, lambda i: i IS NULL OR NOT isfinite(i))) = 0 AND list_inner_product(x, x) > 0),
 e AS (SELECT p.id AS x, q.id AS y FROM u p JOIN u q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) WHERE list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.93){REACHED}
 SELECT least.id AS vec_id, coalesce(links.n, 0) AS n_links, least AS component_id, least = least.id AS kept FROM least LEFT JOIN links ON links.id = least.id""",
    "op6_chosen_path": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id AS id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END) AS g FROM w), sizes AS (SELECT id, count(*) AS n FROM s GROUP BY 1), nodes AS (SELECT doc_id AS id FROM documents),
 shared AS (SELECT p.id AS x, q.id AS y, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.id <> q.id GROUP BY 1, 2), e AS (SELECT x, y FROM shared JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE 5 * c >= 4 * (p.n + q.n - c)){REACHED}
 SELECT least.id AS doc_id, coalesce(links.n, 0) AS n_links, least AS class_id, CAST(coalesce(sizes.n, 0) AS INT) AS n_shingles FROM least LEFT JOIN links ON links.id = least.id LEFT JOIN sizes ON sizes.id = least.id""",
    "op11_phrases": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
 g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
 c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3), totals AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM c WHERE k > 1 AND f >= 10),
 cuts AS (SELECT lang, phrase, a, i, array_to_string(s[1:i], ' ') AS lw, array_to_string(s[i + 1:], ' ') AS rw FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)),
 scored AS (SELECT cuts.lang, cuts.phrase, a, i, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM cuts JOIN c x ON x.lang = cuts.lang AND x.phrase = lw JOIN c y ON y.lang = cuts.lang AND y.phrase = rw),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
 inner_parts AS (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM cand WHERE k = 3), kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts q WHERE q.lang = b.lang AND q.phrase = b.phrase AND 100 * q.a >= 50 * b.a)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000""",
    "op13_lzparse": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)), firsts AS (SELECT x, min(doc_id) AS first FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM win JOIN firsts USING (x) WHERE first < doc_id), lists AS (SELECT doc_id, count(*) AS n, list(p) AS p FROM gone GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(p, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256 FROM w LEFT JOIN lists USING (doc_id)""",
}
