"""The opN_<name> queries of this subpackage: thin digests of its operators over whole tables.

SQL can express op10_warc, and of others the parts that *_base and media_payloads
return.  The rest rests on vocabulary files, hashing, file formats, training or
iteration; tests/llm holds it against brute-force versions instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontaminate, langid, licenses, media, packing, quality, repair, secrets, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents: text, declared lang and the source's host."""
    return langid.identify(_table(spark, sf_dir, "documents"), ["doc_id"], F.col("lang"), F.col("source"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages: markup language and address suffix."""
    return langid.identify(langid.of_pages(_table(spark, sf_dir, "pages")), ["page_id"], F.col("declared"), F.col("url"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of documents."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as telephony audio."""
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents, from Re-Pair shards."""
    return repair.token_table(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents."""
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of documents."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pages, from archives read back and merged."""
    return warc_histories(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index of the same archives: capture histories in global order, by range and position."""
    return warc.capture_histories(_table(spark, sf_dir, "pages"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the base kinds that the secret scan finds."""
    return secrets.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and base phrases that the license scan finds."""
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as read back from the stored media."""
    return media.media_columns(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_language_id, op2_packing, op3_secret_scan, op4_media_columns, op5_repair, op6_quality, op7_decontamination, op8_simhash, op9_license_scan, op10_warc, language_id_pages, warc_histories, secrets_base, licenses_base, media_payloads,
    )
    return {f.__name__: f for f in named}


_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT) AS INT), 1)), '')"


def _places(phrase: str) -> str:
    """Places of a phrase in the list w, as SQL."""
    words = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words, 1))
    return f"list_filter(range(0, greatest(len(w) - {len(words) - 1}, 0)), lambda i: {here})"


def oracle_sql() -> dict[str, str]:
    upper, lower = licenses.UPPER, licenses.LOWER
    places = [(_places(phrase), label) for phrase, label in licenses.PHRASES]
    every = f"list_concat(list_concat({places[0][0]}, {places[1][0]}), {places[2][0]})"
    labels = " || ".join(f"CASE WHEN len({p}) > 0 THEN '{label},' ELSE '' END" for p, label in sorted(places, key=lambda x: x[1]))
    assign = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    return {
        "op10_warc": f"WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h) SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN f USING (h)",
        "secrets_base": f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{assign}', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign, CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "licenses_base": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(e) AS BIGINT) AS n_base, list_min(e) AS first_word, list_max(e) AS last_word, rtrim(l, ',') AS base_labels FROM (SELECT *, {every} AS e, {labels} AS l FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents))",
        "media_payloads": f"SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(octet_length(t) + pad AS BIGINT) AS payload_bytes, sha256(t || repeat('\\xFF'::BLOB, CAST(pad AS INT))) AS payload_sha256 FROM (SELECT *, greatest({media.BLOCK}, (octet_length(t) + {media.BLOCK - 1}) // {media.BLOCK} * {media.BLOCK}) - octet_length(t) AS pad FROM (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents))",
    }
