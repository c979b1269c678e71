"""One query per operator over whole tables, and the SQL that they are checked against where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import (
    centroids, decontaminate, mixing, packing, quality, repeats, resampling, shards, simhash, surrogates, token_counts, token_files, warc,
)
from tablecheck.llm.sql import RESAMPLING, centroids as centroids_sql
from tablecheck.llm.staging import new_folder, staged


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.taken(_table(spark, folder, "documents"), mixing.labelled_quality(_table(spark, folder, "labels")))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(_table(spark, folder, "documents")))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy",
    )


def token_files_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encoded(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counts(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def surrogates_query(spark: SparkSession, folder: str) -> DataFrame:
    found = surrogates.replaced(_table(spark, folder, "documents"), key="surrogates-1")
    return found.select("doc.doc_id", "text", F.size("replaced").alias("n_replaced"), F.array_distinct("replaced.kind").alias("kinds"))


def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write(_table(spark, folder, "pages"), path)
    # The archives are parsed once; payloads stay in them.
    found = warc.followed(warc.captures(staged(warc.records(spark, path, with_payload=False), "warc-records")))
    page, original = (F.col(f"{at}metadata.fields")["pageId"].cast("long") for at in ("", "original."))
    return found.select(
        page.alias("page_id"), F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"), "response.payload_digest",
        "response.record_type", original.alias("refers_to"),
    )


def shards_query(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.placed(_table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version",
    )


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def decontaminate_query(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate.judged(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return judged.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def repeats_query(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.cut(_table(spark, folder, "documents"))


def centroids_query(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_summary(*centroids.clustered(_table(spark, folder, "embeddings")))


def resampling_query(spark: SparkSession, folder: str) -> DataFrame:
    scored = resampling.resampled(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return scored.select(F.col("doc.id").alias("doc_id"), "n_features", "weight", "score", "rank")


def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


QUERIES = {
    "op1_mix_sources": mixing_query,
    "op2_quality_rules": quality_query,
    "op3_token_files": token_files_query,
    "op4_token_counts": token_counts_query,
    "op5_surrogates": surrogates_query,
    "op6_warc_captures": warc_query,
    "op7_virtual_slots": shards_query,
    "op8_simhash": simhash_query,
    "op9_decontaminate": decontaminate_query,
    "op10_repeated_passages": repeats_query,
    "op11_incremental_centroids": centroids_query,
    "op12_importance_resampling": resampling_query,
    "op13_mixture_packing": packing_query,
}

ORACLES: dict[str, str] = {
    "op11_incremental_centroids": centroids_sql(),
    "op12_importance_resampling": RESAMPLING,
    "op1_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                (('0x' || substr(md5('mix-1/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
            FROM documents
        ), q AS (
            SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS q FROM labels
            WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
        ), keyed AS (SELECT d.*, -ln(u) / coalesce(q.q, 1.0)::DOUBLE AS k FROM d LEFT JOIN q USING (doc_id)),
        s AS (SELECT src, sum(size)::BIGINT AS source_size FROM keyed GROUP BY src),
        w AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight FROM s),
        l AS (
            SELECT *, 3 * source_size / weight AS ratio,
                (sum(source_size) OVER ()
                 - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM w
        ), f AS (SELECT level AS final FROM l WHERE weight * level <= 3 * source_size ORDER BY ratio, src LIMIT 1),
        t AS (SELECT src, source_size, least(weight * final, 3.0::DOUBLE * source_size) AS target FROM l, f),
        p AS (
            SELECT doc_id, size, source_size, target,
                coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
            FROM keyed JOIN t USING (src)
        )
        SELECT doc_id, size, source_size, target,
            (size * (whole + (size > 0 AND before + size / 2 <= target - whole * source_size)::INT))::BIGINT AS taken
        FROM p""",
    "op2_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                row_number() OVER () AS n
            FROM documents
        ), g AS (SELECT n, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
        grams AS (SELECT n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM g),
        twice AS (SELECT n, i FROM grams QUALIFY count(*) OVER (PARTITION BY n, gram) > 1),
        repeated AS (SELECT n, count(DISTINCT i + o) AS r FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY n),
        m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN repeated USING (n)
        ), b AS (
            SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
                + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS fail_bits
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
            fail_bits = 0 AS kept, fail_bits, 'strict-1' AS policy
        FROM b""",
    "op9_decontaminate": r"""
        WITH norm AS (
            SELECT doc_id, row_number() OVER () AS n,
                list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), item AS (
            SELECT item_id::VARCHAR AS item,
                list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark
        ), win AS (
            SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS size
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM item WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT size FROM win),
        place AS (
            SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
            FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM norm, sizes WHERE len(w) >= size)
        ), hit AS (SELECT n, i, p.size, item FROM place p JOIN win USING (win)),
        words AS (SELECT n, count(DISTINCT i) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS i FROM hit) GROUP BY n),
        items AS (SELECT n, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY n)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM norm LEFT JOIN words USING (n) LEFT JOIN items USING (n)""",
    "op6_warc_captures": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last FROM p
        )
        SELECT page_id, payload_bytes,
            translate(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8)
                || to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
                '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
            CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < last THEN last END AS refers_to
        FROM d""",
    "op10_repeated_passages": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT n, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
            FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ), again AS (SELECT n, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
        gone AS (SELECT DISTINCT n, unnest(range(i, i + 50)) AS i FROM again),
        lost AS (SELECT n, count(*) AS n_removed FROM gone GROUP BY n),
        kept AS (
            SELECT n, string_agg(word, ' ' ORDER BY i) AS words
            FROM (SELECT n, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d) LEFT JOIN (SELECT n, i, true AS gone FROM gone) USING (n, i)
            WHERE gone IS NULL GROUP BY n
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (n) LEFT JOIN kept USING (n)""",
    "op7_virtual_slots": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_prepend(i, list_transform(range(8), lambda z: 0::BIGINT)),
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)
        ), c AS (
            SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
                xor(list_reduce(list_prepend(4294967295::BIGINT,
                    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
            FROM documents, crc
        ), d AS (
            SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || text_crc32), 1, 8))::BIGINT % 4096 AS virtual_slot FROM c
        ), sizes AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n FROM d GROUP BY 1),
        deck AS (
            SELECT range AS virtual_slot, coalesce(bytes, 0)::BIGINT AS bytes, row_number() OVER (ORDER BY coalesce(bytes, 0) DESC, range) AS k
            FROM range(4096) LEFT JOIN sizes ON virtual_slot = range
        ), fold AS (
            SELECT 0::BIGINT AS k, list_transform(range(16), lambda z: 0::BIGINT) AS loads, 0::BIGINT AS box
            UNION ALL
            SELECT deck.k, list_transform(f.loads, lambda x, i: x + CASE WHEN i = f.next THEN deck.bytes ELSE 0 END), f.next
            FROM (SELECT k, loads, list_position(loads, list_min(loads))::BIGINT AS next FROM fold) f JOIN deck ON deck.k = f.k + 1
        ), slot_map AS (SELECT virtual_slot, box - 1 AS shard FROM fold JOIN deck USING (k)),
        starts AS (
            SELECT virtual_slot, shard,
                coalesce(sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM slot_map JOIN sizes USING (virtual_slot)
        )
        SELECT doc_id, size, text_crc32, virtual_slot::INT AS virtual_slot, 1 AS map_version, 'bytes' AS law, shard::INT AS shard,
            (start + row_number() OVER (PARTITION BY virtual_slot ORDER BY text_crc32, doc_id, size) - 1)::BIGINT AS slot,
            NULL::INT AS grown_shard
        FROM d JOIN starts USING (virtual_slot)""",
}
