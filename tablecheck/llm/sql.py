"""SQL for the checks that is put together from rounds or shared by operators."""

from __future__ import annotations

#: The CRC-32 table of one byte, as a list ``t``.
CRC_TABLE = """(
            SELECT list(list_reduce(list_prepend(i, list_transform(range(8), lambda z: 0::BIGINT)),
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)
        )"""


def _floored(total: str, count: str) -> str:
    return f"(({total} - (({total} % {count}) + {count}) % {count}) // {count})::BIGINT"


def centroids(rounds: int = 10) -> str:
    """Lloyd's rounds in whole numbers, every distance computed anew."""
    parts = [r"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v
            FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 8)
        )"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
            SELECT n, vec_id, v, c, d FROM (
                SELECT kept.n, vec_id, kept.v, c,
                    list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                FROM kept, c{k}
            ) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1
        )""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
            SELECT c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
                SELECT c, list({_floored('s', 'k')} ORDER BY i) AS v FROM (
                    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS k
                    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i
                ) GROUP BY c
            ) m USING (c)
        )""")
    return "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
            (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"

RESAMPLING = rf"""
        WITH crc AS {CRC_TABLE}, d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
        f AS MATERIALIZED (SELECT n, {_RUNS} AS f FROM d),
        b AS MATERIALIZED (SELECT {_RUNS} AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
        k AS MATERIALIZED (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)),
                lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
            FROM (SELECT f FROM f UNION SELECT f FROM b), crc
        ), s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (f) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY bucket),
        gain AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE
                / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), w AS (
            SELECT n, k AS n_features, {_floored('s', 'k')} AS weight
            FROM (SELECT n, count(*) AS k, sum(gain)::BIGINT AS s FROM f JOIN k USING (f) JOIN gain USING (bucket) GROUP BY n)
        ), scored AS (
            SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE
                    / 4294967296.0::DOUBLE))))::BIGINT AS score
            FROM d LEFT JOIN w USING (n)
        ), ranked AS (
            SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS place, count(*) OVER () AS all_of FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, (CASE WHEN place <= 25 * all_of // 100 THEN place END)::BIGINT AS rank
        FROM scored LEFT JOIN ranked USING (n)"""
