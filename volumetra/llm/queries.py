"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetra.llm import additive_search, automaton_dedup, binary_output, curriculum, dual_tree, exact_dedup, filter_audit, jaccard_join, pattern_packing, simhash, suffix_dedup, token_counts, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.curriculum(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("placements", F.lit(0))["position"], 9).alias("first_position"))
    return curriculum.range_sorted(rows, "first_position", "doc_id")


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = automaton_dedup.dedup_word_windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.packed_matrices(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = additive_search.build_index(table(spark, sf_dir, "embeddings"))
    return additive_search.search(index, books, index.where("vec_id % 50 = 0"), 5)


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors, after ten rounds."""
    return dual_tree.clusters(table(spark, sf_dir, "embeddings"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints that differ in at most three bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, for each language."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_curriculum_mix, op2_pattern_packing, op3_suffix_dedup, op4_jaccard_join, op5_automaton_dedup,
    op6_toxicity, op7_packed_matrices, op8_exact_dedup, op9_token_counts, op10_additive_search, op11_dual_tree_lloyd, op12_simhash_dedup, op13_filter_audit,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    """Rounds of Lloyd as one table each; distances and sums go component by component."""
    near = "SELECT vec_id, row, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.vec_id, x.row, x.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - m.m[i]) * (x.v[i] - m.m[i]))) AS d FROM x, c{} m) GROUP BY ALL"
    near = near.replace("arg_min(c, (d, c))", "first(c ORDER BY d, c)").replace("GROUP BY ALL", "GROUP BY vec_id, row, v")
    out = [
        "p AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, row, list_transform(e, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM p)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds):
        out += [
            f"a{n} AS MATERIALIZED ({near.format(n)})",
            f"s{n} AS MATERIALIZED (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT c, i, sum(v[i]) AS t, count(*) AS n FROM a{n}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c)",
            f"c{n + 1} AS MATERIALIZED (SELECT c, CAST(coalesce(s.m, b.m) AS BIGINT[]) AS m FROM c{n} b LEFT JOIN s{n} s USING (c))",
        ]
    out.append(f"z AS MATERIALIZED ({near.format(rounds)})")
    return "WITH " + ", ".join(out) + f""" SELECT vec_id, CAST(z.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c{rounds} m ON m.c = z.c"""


ORACLES = {
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        r AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                     row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS n FROM t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op11_dual_tree_lloyd": _lloyd_sql(),
    "op13_filter_audit": """
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
                     regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e FROM w),
        g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY 1, 2),
        l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) x(f, i)),
        o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.i, w.i, x.i, y.i, z.i] AS o FROM l v, l w, l x, l y, l z WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
        s AS (SELECT part, filter_order, s.step, fails[o[s.step]] AS own, len(list_filter(o[:s.step - 1], lambda k: fails[k])) > 0 AS early, len(list_filter(fails, lambda k: k)) = 1 AS one, n, good, toxic, o[s.step] AS f
              FROM m, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
        r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT early THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT early THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN own AND early THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND one THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN own AND NOT early THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT early THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}
