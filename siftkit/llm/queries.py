"""The registered query of each operator, with production parameters, and SQL where it can express one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, ffd_packing, fingerprints, jaccard_join, language_id, mixing, packing, periodic_runs, sharding,
               threshold_kmeans, token_files, toxicity, warc)
from .common import documents, scratch

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.assign(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.deduplicate(warc.records(documents(spark, sf_dir, "pages"))), path)
    return warc.resolve_revisits(warc.read_archives(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


@query
def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    docs = documents(spark, sf_dir)
    sharding.write_shards(docs, path)
    rows = sharding.read_shards(spark, path, docs.schema)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return rows.select("record.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_join.classes(documents(spark, sf_dir))
    return rows.select("doc_id", "class_id", "links", "copy_id")


@query
def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(documents(spark, sf_dir))


@query
def op9_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model)


@query
def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.repeat_tail(documents(spark, sf_dir))))


@query
def op12_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query
def op13_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_kmeans.report(*threshold_kmeans.cluster(documents(spark, sf_dir, "embeddings")))


def _clusters_sql(rounds: int = threshold_kmeans.ROUNDS, k: int = threshold_kmeans.CLUSTERS) -> str:
    """The rounds of operator 13, one after the other, all distances measured."""
    steps = [f"""
        v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({threshold_kmeans.SCALE} * x::DOUBLE)::BIGINT) AS x
              FROM (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {threshold_kmeans.DIMENSIONS}
                    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {threshold_kmeans.DIMENSIONS})),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v ORDER BY c LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS (SELECT r, vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                 SELECT r, vec_id, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                 FROM v, c{i}) GROUP BY r, vec_id)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT c, list(floor_div ORDER BY j) AS x FROM (
                 SELECT c, j, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (
                 SELECT a{i}.c, unnest(v.x) AS e, unnest(range(len(v.x))) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j) GROUP BY c),
        c{i + 1} AS (SELECT c, coalesce(m{i}.x::BIGINT[], c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""")
    return "WITH " + ",".join(steps) + f"""
        SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE: dict[str, str] = {
    "op13_threshold_clusters": _clusters_sql(),
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM t""",
    "op2_mix_sources": r"""
        WITH t AS (
            SELECT doc_id, text, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS size FROM t GROUP BY source),
        w AS (SELECT source, size, 3 * size AS top,
                     [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
        r AS (SELECT *, row_number() OVER (ORDER BY top / weight, encode(source) NULLS LAST) AS k FROM w),
        lv AS (SELECT (sum(size) OVER () - coalesce(sum(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, top, weight, k FROM r),
        f AS (SELECT level FROM lv WHERE weight * level <= top ORDER BY k LIMIT 1),
        g AS (SELECT source, size AS source_size, least(weight * level, top) AS target FROM r, f),
        d AS (SELECT doc_id, t.source, t.size, g.source_size, g.target,
                     CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
                     sha256('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h
              FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
        e AS (SELECT d.*, k, floor(rate) + CASE WHEN ('0x' || substr(h, 8 * k + 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate)
                     THEN 1 ELSE 0 END AS copies FROM d, range(8) r(k)),
        p AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - max(target)), k) AS rn
                                     FROM e GROUP BY source, k) WHERE rn = 1)
        SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken
        FROM e JOIN p ON e.k = p.k AND e.source IS NOT DISTINCT FROM p.source""",
    "op8_multiset_hash": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        nx AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM t WINDOW w AS (ORDER BY doc_id)),
        ed AS (SELECT doc_id, text, length(text) AS n,
                      substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM nx),
        texts AS (SELECT doc_id, 0 AS k, text AS body FROM ed UNION ALL SELECT doc_id, 1, edited FROM ed),
        p AS (SELECT doc_id, k, x FROM (
                SELECT doc_id, k, unnest(string_split(replace(replace(replace(body, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10))) AS x
                FROM texts) WHERE x <> ''),
        h AS (SELECT doc_id, k, sha256(x) AS s, ('0x' || substr(md5(x), 1, 15))::BIGINT AS lo, ('0x' || substr(md5(x), 16, 15))::BIGINT AS hi FROM p),
        lanes AS (
            SELECT doc_id, k, 0 AS lane, count(*) AS v, 0::BIGINT AS bit FROM h GROUP BY ALL
            UNION ALL SELECT doc_id, k, 1 + i, sum(('0x' || substr(s, 8 * i + 1, 8))::BIGINT)::BIGINT % 4294967296, 0 FROM h, range(8) r(i) GROUP BY doc_id, k, i
            UNION ALL SELECT doc_id, k, 9 + j, sum((lo >> (j + 20 * f)) & 1)::BIGINT % 524288, f FROM h, range(20) r(j), range(3) q(f) GROUP BY doc_id, k, j, f
            UNION ALL SELECT doc_id, k, 29 + j, sum((hi >> (j + 20 * f)) & 1)::BIGINT % 524288, f FROM h, range(20) r(j), range(3) q(f) GROUP BY doc_id, k, j, f),
        packed AS (SELECT doc_id, k, lane, sum(v << (20 * bit))::BIGINT AS v FROM lanes GROUP BY doc_id, k, lane),
        every AS (SELECT t.doc_id, t.k, l.lane, coalesce(v, 0) AS v FROM (SELECT doc_id, k FROM texts) t CROSS JOIN (SELECT range AS lane FROM range(49)) l
                  LEFT JOIN packed USING (doc_id, k, lane)),
        fp AS (SELECT doc_id, k, string_agg(lpad(lower(hex(v)), 16, '0'), '' ORDER BY lane) AS fp,
                      max(CASE WHEN lane = 0 THEN v END) AS n FROM every GROUP BY doc_id, k),
        sg AS (SELECT e.doc_id, e.k, list(2 * ((e.v >> (20 * f)) & 524287) - fp.n ORDER BY lane, f) AS s
               FROM every e JOIN fp USING (doc_id, k), range(3) q(f) WHERE e.lane >= 9 GROUP BY e.doc_id, e.k),
        own AS (SELECT doc_id, s, coalesce(lead(s) OVER w, first_value(s) OVER w) AS s_next FROM sg WHERE k = 0 WINDOW w AS (ORDER BY doc_id)),
        near AS (SELECT own.doc_id, own.s AS a, own.s_next AS c, e.s AS b FROM own JOIN sg e ON e.doc_id = own.doc_id AND e.k = 1),
        d AS (SELECT doc_id, a, b, c, list_dot_product(a::DOUBLE[], a::DOUBLE[]) AS aa,
                     list_dot_product(b::DOUBLE[], b::DOUBLE[]) AS bb,
                     list_dot_product(c::DOUBLE[], c::DOUBLE[]) AS cc,
                     list_dot_product(a::DOUBLE[], b::DOUBLE[]) AS ab,
                     list_dot_product(a::DOUBLE[], c::DOUBLE[]) AS ac FROM near)
        SELECT ed.doc_id, ed.n AS n_chars, sha256(edited) AS edited_sha256, f.fp AS fingerprint, g.fp AS edited_fingerprint,
               CASE WHEN a = b THEN 1.0 WHEN aa * bb = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ab / sqrt(aa * bb))) END::DOUBLE AS near_edited,
               CASE WHEN a = c THEN 1.0 WHEN aa * cc = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ac / sqrt(aa * cc))) END::DOUBLE AS near_next
        FROM ed JOIN d USING (doc_id) JOIN fp f ON f.doc_id = ed.doc_id AND f.k = 0 JOIN fp g ON g.doc_id = ed.doc_id AND g.k = 1""",
    "op4_warc_revisits": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM t),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f""",
}
