"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.llm.centroid_clustering import Clustering, centroid_clusters
from dataward.llm.decontaminate import contamination
from dataward.llm.fill_in_middle import fill_in_middle, restored
from dataward.llm.fingerprints import fingerprints
from dataward.llm.html_text import page_texts
from dataward.llm.language_id import languages
from dataward.llm.minhash_dedup import near_duplicates
from dataward.llm.packing import packed
from dataward.llm.paragraph_dedup import repeated_paragraphs
from dataward.llm.personal_data import personal_data
from dataward.llm.registry import QUERIES, SQL, query
from dataward.llm.simhash_dedup import simhash_duplicates
from dataward.llm.suffix_dedup import repeated_passages
from dataward.llm.toxicity import toxicity


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_html_text")
def op1_html_text(spark, sf):
    return page_texts(_table(spark, sf, "pages"))


@query("op2_personal_data")
def op2_personal_data(spark, sf):
    return personal_data(_table(spark, sf, "documents"))


@query("op3_language_id")
def op3_language_id(spark, sf):
    return languages(_table(spark, sf, "documents"))


@query("op4_paragraph_dedup")
def op4_paragraph_dedup(spark, sf):
    return repeated_paragraphs(_table(spark, sf, "documents"))


@query("op5_fingerprints")
def op5_fingerprints(spark, sf):
    return fingerprints(_table(spark, sf, "documents"))


@query("op6_decontaminate")
def op6_decontaminate(spark, sf):
    found = contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_toxicity")
def op7_toxicity(spark, sf):
    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query("op8_minhash_dedup")
def op8_minhash_dedup(spark, sf):
    return near_duplicates(_table(spark, sf, "documents"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf):
    return repeated_passages(_table(spark, sf, "documents"))


@query("op10_packing")
def op10_packing(spark, sf):
    import public_tokenizers

    return packed(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_simhash_dedup")
def op11_simhash_dedup(spark, sf):
    found = simhash_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


FILL_IN_MIDDLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
drawn AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM units),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
cut AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(u[b + 1:], ''), '') AS s
    FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


@query("op12_fill_in_middle", FILL_IN_MIDDLE)
def op12_fill_in_middle(spark, sf):
    found = fill_in_middle(_table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _clustering_sql(spec: Clustering) -> str:
    """Rounds of assigning and moving, each as its own pair of steps."""
    steps = [f"""kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({spec.scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {spec.dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY r, v) - 1)::INT AS c, v
    FROM (SELECT sha256('{spec.seed}:' || coalesce(vec_id::VARCHAR, '')) AS r, v FROM kept ORDER BY r, v LIMIT {spec.k}))"""]
    for k in range(spec.rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
    FROM (SELECT x.i, x.vec_id, x.v, c{k}.c, list_sum(list_transform(list_zip(x.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
          FROM (SELECT row_number() OVER () AS i, * FROM kept) x, c{k})
    GROUP BY i)""")
        if k < spec.rounds:
            steps.append(f"""s{k} AS (
    SELECT best.c AS c, unnest(v) AS x, unnest(range(1, {spec.dims + 1})) AS place FROM a{k}),
m{k} AS (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS v
    FROM (SELECT c, place, sum(x) AS s, count(*) AS n FROM s{k} GROUP BY c, place) GROUP BY c),
c{k + 1} AS MATERIALIZED (
    SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))""")
    last = spec.rounds
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.c = best.c
"""


@query("op13_centroid_clustering", _clustering_sql(Clustering()))
def op13_centroid_clustering(spark, sf):
    found = centroid_clusters(_table(spark, sf, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256).alias("centroid_sha256"))


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
