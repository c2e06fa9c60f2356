"""The thin queries of this subpackage, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stepweave.llm import ann_codes, centroids, exact_dedup, html_text, importance, language, mixing, ngram_join, quality_gam, secret_scan, sentence_pieces, simhash, url_filter
from stepweave.session import table

#: The tokenizer that queries use; operators take any model's bytes.
MODEL = "piece_bpe_32k.model"


def tokenizer() -> bytes:
    import public_tokenizers

    return sentence_pieces.model_bytes(public_tokenizers.path(MODEL))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs).select("row.doc_id", "source", "block", "slot", "position")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "secret")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.train(pages))


#: Rules (host, path, verdict) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_gam.scores(docs, model)
    return scored.select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_pairs(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_codes.neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_sentencepiece, op3_mixing, op4_secret_scan, op5_html_text, op6_url_filter, op7_quality, op8_simhash, op9_language_id, op10_ngram_jaccard, op11_importance, op12_centroids, op13_neighbours)}


def _clusters_sql(rounds: int) -> str:
    """The clustering of op12 as a chain of assignments and updates, a component a row."""
    nearest = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.vec_id, z.c, sum((x.v - z.v) * (x.v - z.v))::BIGINT AS d FROM x JOIN z{0} AS z USING (j) GROUP BY ALL) GROUP BY vec_id"
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "x AS MATERIALIZED (SELECT vec_id, unnest(v) AS v, unnest(range(64)) AS j FROM kept)",
        "z0 AS MATERIALIZED (SELECT c, unnest(v) AS v, unnest(range(64)) AS j FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 40))",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        parts.append(f"m{i} AS (SELECT c, j, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id) GROUP BY c, j)")
        parts.append(f"z{i + 1} AS MATERIALIZED (SELECT z.c, z.j, CASE WHEN m.n IS NULL THEN z.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v FROM z{i} AS z LEFT JOIN m{i} AS m ON z.c = m.c AND z.j = m.j)")
    return f"""WITH {', '.join(parts)}, a AS MATERIALIZED ({nearest.format(rounds)}),
        h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM z{rounds} GROUP BY c)
        SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a JOIN h ON a.c = h.c"""


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op11_importance": r"""
        WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
        texts AS (SELECT doc_id, text, false AS t FROM documents UNION ALL SELECT NULL, text, true FROM benchmark),
        feature AS (SELECT doc_id, t, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
        word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM feature)),
        byte AS (SELECT w, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM word),
        hashed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM byte, tab),
        found AS (SELECT doc_id, t, bucket FROM feature JOIN hashed USING (w)),
        total AS (SELECT count(*) FILTER (NOT t) AS s_all, count(*) FILTER (t) AS t_all FROM found),
        gain AS (SELECT bucket, floor(1000 * ln((count(*) FILTER (t) + 1)::DOUBLE * (any_value(s_all) + 10000) / ((count(*) FILTER (NOT t) + 1)::DOUBLE * (any_value(t_all) + 10000))))::BIGINT AS gain FROM found, total GROUP BY bucket),
        weight AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE NOT t GROUP BY doc_id),
        scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weight USING (doc_id)),
        placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed""",
    "op12_centroids": _clusters_sql(5),
    "op13_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
