"""One registered query per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filmloom.llm import (bit_sliced, bpe, collocations, conversations, lm, metric_join, minhash, packing, piece_bpe, quality, secret_scan,
                          suffix_dedup, toxicity)
from filmloom.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and inferred secrets of every text, as counts, digest and spans."""
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text after deobfuscation."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by weighted rules."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every vector."""
    return metric_join.linked(table(spark, sf_dir, "embeddings"))


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of each hundredth vector."""
    return bit_sliced.search(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes take from every document."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and survivor of every document."""
    return minhash.linked(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under the n-gram trie, with exact counts behind the base score."""
    return lm.score(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they give back, as digests."""
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the given damage."""
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under a model of BPE pieces and the text that they give back, as digests."""
    return bpe.digests(piece_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_metric_range_join": op5_metric_range_join,
    "op6_bit_sliced_top_k": op6_bit_sliced_top_k,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_tensored_minhash": op8_tensored_minhash,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sentencepiece_round_trip": op13_sentencepiece_round_trip,
}

ORACLES: dict[str, str] = {
    "op5_metric_range_join": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(id, low) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
        FROM embeddings v JOIN (SELECT id, min(low) AS component_id FROM reach GROUP BY id) r ON r.id = v.vec_id
        LEFT JOIN counted c ON c.a = v.vec_id""",
    "op6_bit_sliced_top_k": """
        WITH parts AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS p FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
                   CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.p, v.p)]) AS BIGINT) AS score
            FROM parts q JOIN parts v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        WHERE rank <= 10""",
    "op7_suffix_dedup": """
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
          strings AS (SELECT r, s, md5(substr(h, 2 * s - 1, 400)) AS k FROM (SELECT r, h, unnest(range(1, length(h) // 2 - 198)) AS s FROM texts WHERE length(h) >= 400)),
          often AS (SELECT k FROM strings GROUP BY k HAVING count(*) > 1),
          starts AS (SELECT r, s, lag(s + 199) OVER (PARTITION BY r ORDER BY s) AS before FROM strings SEMI JOIN often USING (k)),
          runs AS (SELECT r, s, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS run FROM starts),
          spans AS (SELECT r, min(s) AS a, max(s) + 199 AS b FROM runs GROUP BY r, run),
          parts AS (SELECT t.r, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - 1 - coalesce(lag(b) OVER w, 0))) AS part FROM spans s JOIN texts t ON t.r = s.r WINDOW w AS (PARTITION BY s.r ORDER BY a)),
          cut AS (SELECT r, sum(b - a + 1) AS gone, count(*) AS n, max(b) AS stop, string_agg(part, '' ORDER BY a) AS head FROM parts GROUP BY r)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
          sha256(unhex(coalesce(head || substr(h, 2 * stop + 1), h))) AS kept_sha256 FROM texts LEFT JOIN cut USING (r)""",
    "op8_tensored_minhash": r"""
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
          shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM words WHERE len(w) > 0)),
          sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
          shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
          links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
          reach(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN (SELECT id, min(low) AS component_id FROM reach GROUP BY 1) ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS p FROM documents),
          words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
          grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS t(k))),
          counts AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
          totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
          longer AS (SELECT lang, h, max(f) AS f FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS h, f FROM counts WHERE k = 3 AND f >= 10) GROUP BY ALL),
          cuts AS (SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, s.s,
              CAST(1000000 * CAST(c.f AS HUGEINT) * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM counts c JOIN (VALUES (1), (2)) AS s(s) ON s.s < c.k
            JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:s.s] JOIN counts y ON y.lang = c.lang AND y.g = c.g[s.s + 1:c.k]
            LEFT JOIN longer m ON m.lang = c.lang AND m.h = c.g
            WHERE c.k > 1 AND c.f >= 10 AND (m.f IS NULL OR 100 * m.f < 50 * c.f)),
          least AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, s) AS o FROM cuts),
          ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
              row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM least WHERE o = 1)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
