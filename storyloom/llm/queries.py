"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ann, centroids, containment, fim, language_id, license_scan, pii, pieces, ppm, quality, simhash, token_counts, url_filter
from .common import crc_remainder, table

#: The key of the registered query; a deployment passes its own secret.
PSEUDONYM_KEY = "storyloom-pseudonyms-v1"
MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_pii_pseudonyms(spark, sf_dir) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_url_filter(spark, sf_dir) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark, sf_dir) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), model_path())


def op4_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_path())


def op5_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


def op6_simhash(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_ppm_scores(spark, sf_dir) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir) -> DataFrame:
    found = containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


def op10_nearest_vectors(spark, sf_dir) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_centroid_clusters(spark, sf_dir) -> DataFrame:
    found, last = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = F.array(*[F.lit(centroids.centroid_digest(c)) for c in last])
    digest = F.get(digests, F.col("cluster")) if last else F.lit(None).cast("string")
    return found.withColumn("centroid_sha256", digest)


def op12_fill_in_middle(spark, sf_dir) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    back = fim.restore(made, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"])
    return back.withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


def op13_quality_scores(spark, sf_dir) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_url_filter, op3_sentencepiece, op4_token_counts, op5_language_id,
        op6_simhash, op7_ppm_scores, op8_license_scan, op9_decontamination, op10_nearest_vectors,
        op11_centroid_clusters, op12_fill_in_middle, op13_quality_scores,
    )
}

def _shingles_sql(name: str, key: str) -> str:
    """CTE of the distinct five-word shingles of each text of a table."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""{name} AS (SELECT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM (SELECT {key}, {words} AS w FROM {'documents' if key == 'doc_id' else 'benchmark'}))"""


def _clusters_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Every round as two CTEs: nearest centroids of all vectors, then the floored means."""
    assign = """a{r} AS MATERIALIZED (SELECT id, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM (
        SELECT id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, m{r}) GROUP BY id)"""
    move = """m{n} AS MATERIALIZED (SELECT c, coalesce(moved, m) AS m FROM m{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM (
        SELECT c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} JOIN kept USING (id), range(1, {dims} + 1) AS t(i) GROUP BY c, i) GROUP BY c) USING (c))"""
    parts = []
    for r in range(rounds):
        parts += [assign.format(r=r, k=k), move.format(r=r, n=r + 1, dims=dims)]
    parts.append(assign.format(r=rounds, k=k))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      m0 AS MATERIALIZED (SELECT c, v AS m FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1 AS c, v FROM kept) WHERE c < {k}),
      {", ".join(parts)}
      SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
      FROM a{rounds} JOIN kept USING (id) JOIN m{rounds} USING (c)"""


_MIDDLE_SQL = """WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
      numbers AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT) AS hs FROM drawn),
      cuts AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS lo, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
      pieces AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:n], ''), '') AS s FROM cuts)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM pieces"""

ORACLES = {
    "op11_centroid_clusters": _clusters_sql(),
    "op12_fill_in_middle": _MIDDLE_SQL,
    "op9_decontamination": f"""WITH {_shingles_sql('d', 'doc_id')}, {_shingles_sql('i', 'item_id')},
      sizes AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
      found AS (SELECT doc_id, item_id, count(*) / any_value(n)::double AS c FROM d JOIN i USING (shingle) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)),
      listed AS (SELECT doc_id, string_agg(item_id::varchar, ',' ORDER BY item_id) AS items, count(*) AS n_items, max(c) AS containment FROM found GROUP BY doc_id)
      SELECT doc_id, coalesce(items, '') AS items, coalesce(n_items, 0) AS n_items, coalesce(containment, 0.0) AS containment, n_items IS NOT NULL AS contaminated
      FROM documents LEFT JOIN listed USING (doc_id)""",
}
