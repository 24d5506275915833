"""The registered queries over the training-data tables and the SQL that checks them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, media, packing, pii, ppm, quality, simhash, substring, topk, warc, wordbpe
from quadrille.llm.common import crc_mod


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return common.table(common.configure(spark), d, name)


def byte_tools() -> tuple[str, str, str]:
    import public_tokenizers as files

    return files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN


def word_file() -> str:
    import public_tokenizers as files

    return files.path("word_bpe_49k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The setting spark.quadrille.pseudonym.key; where it is unset, a random key for as long as the application runs, so nobody can undo the pseudonyms and none link beyond it."""
    if not (key := spark.conf.get("spark.quadrille.pseudonym.key", None)):
        key = _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return key


_KEYS: dict[str, str] = {}


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    net = quality.train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return quality.score(docs.select("doc_id", "text"), net).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_ppm(spark: SparkSession, d: str) -> DataFrame:
    return ppm.score(table(spark, d, "documents"), crc_mod("doc_id", 10) != 0)


def op3_media(spark: SparkSession, d: str) -> DataFrame:
    return media.document_media(table(spark, d, "documents"))


def op4_substring(spark: SparkSession, d: str) -> DataFrame:
    out = substring.apply(table(spark, d, "documents"))
    return out.select("doc_id", "text", "n_units", F.size("spans").alias("n_removed"), "spans")


def op5_wordbpe(spark: SparkSession, d: str) -> DataFrame:
    return wordbpe.encode_digests(table(spark, d, "documents"), word_file())


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), byte_tools())


def op8_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.col("id") % 100 == 0)


def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.apply(table(spark, d, "documents"), pseudonym_key(spark)).select("doc_id", "text", "n_pseudonyms")


def op10_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents")).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


# --- the parts of these that SQL can express -------------------------------------------------

#: Bits of the sign patterns that stand in for fingerprints, and the radius at which some of them link.
SIGNS, SIGN_RADIUS = 62, 18


def part2_base_score(spark: SparkSession, d: str) -> DataFrame:
    """The columns of op2 that word counts decide; scores to three digits, as sums run in different orders."""
    return op2_ppm(spark, d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def part3_payload(spark: SparkSession, d: str) -> DataFrame:
    """The columns of op3 that the payload decides, as read back from the stored media."""
    return op3_media(spark, d).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def part10_components(spark: SparkSession, d: str) -> DataFrame:
    """Tiles, links and components over given fingerprints: the signs of the embeddings' components."""
    signs = F.aggregate(F.sequence(F.lit(1), F.lit(SIGNS)), F.lit(0).cast("long"), lambda t, i: t + F.when(F.element_at("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")))
    return simhash.linked(table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), signs.alias("fp")), SIGN_RADIUS)


QUERIES = {f.__name__: f for f in (op1_quality, op2_ppm, op3_media, op4_substring, op5_wordbpe, op6_warc, op7_packing, op8_topk, op9_pii, op10_simhash, part2_base_score, part3_payload, part10_components)}

#: CRC-32 of a text of ASCII letters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"

ORACLES = {
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
    "op8_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "part2_base_score": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, doc_id IS NOT NULL AND {_CRC.format("CAST(doc_id AS VARCHAR)")} % 10 = 0 OR doc_id IS NULL AS held_out,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        u AS MATERIALIZED (SELECT r, unnest(words) AS w FROM d),
        c AS MATERIALIZED (SELECT w, count(*) AS c FROM u JOIN d USING (r) WHERE NOT held_out GROUP BY w),
        n AS MATERIALIZED (SELECT (SELECT count(*) FROM d WHERE NOT held_out) AS ends, coalesce((SELECT sum(c) FROM c), 0) + (SELECT count(*) FROM d WHERE NOT held_out) AS total, (SELECT count(*) FROM c) + (SELECT CAST(count(*) > 0 AS INTEGER) FROM d WHERE NOT held_out) AS kinds),
        s AS (SELECT r, count(*) AS k, count(c.w) AS known, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (kinds + 1)))) AS s FROM u LEFT JOIN c ON c.w = u.w CROSS JOIN n GROUP BY r)
        SELECT doc_id, held_out, coalesce(k, 0) + 1 AS n_tokens, coalesce(known, 0) + CAST(ends > 0 AS INTEGER) AS n_known, CAST(total AS BIGINT) AS train_tokens,
               round(coalesce(s, 0) + log10((ends + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (kinds + 1))), 3) AS base_score
        FROM d LEFT JOIN s USING (r) CROSS JOIN n
    """,
    "part3_payload": """
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256
        FROM (SELECT *, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents))
    """,
    "part10_components": f"""
        WITH RECURSIVE f AS MATERIALIZED (SELECT vec_id AS doc_id, CAST(list_sum(list_transform(embedding[1:{SIGNS}], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END)) AS BIGINT) AS fp FROM embeddings WHERE embedding IS NOT NULL),
        e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON bit_count(xor(a.fp, b.fp)) <= {SIGN_RADIUS}),
        reach AS (SELECT doc_id, doc_id AS other FROM f UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
        SELECT f.doc_id, fp, component_id FROM f JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
    """,
}
