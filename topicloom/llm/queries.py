"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.decontamination import leak_pairs

    return leak_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.quality import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.near_dedup import near_components

    return near_components(_table(spark, sf_dir, "documents"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.fingerprints import fingerprint_report

    return fingerprint_report(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.substring_dedup import dedup_digests

    return dedup_digests(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from topicloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.sharding import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from topicloom.llm.bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from topicloom.llm.token_alignment import align

    return align(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.lexical_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.simhash_dedup import near_components

    return near_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_sharding": op7_sharding,
        "op8_html_extraction": op8_html_extraction,
        "op9_warc_round_trip": op9_warc_round_trip,
        "op10_bpe_encode_decode": op10_bpe_encode_decode,
        "op11_token_alignment": op11_token_alignment,
        "op12_lexical_search": op12_lexical_search,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


_OP6_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS a FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i : i + 4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n m ON m.doc_id = p.a JOIN n o ON o.doc_id = p.b WHERE 100 * p.c >= 75 * (m.n + o.n - p.c)),
r(v, t) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t),
c AS (SELECT v, min(t) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id
"""


_OP2_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS a FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(a) - 11)) AS p, unnest(list_transform(range(1, len(a) - 11), lambda i: array_to_string(a[i : i + 12], ' '))) AS g FROM w WHERE len(a) >= 13),
m AS MATERIALIZED (SELECT g, min(doc_id) AS m FROM g GROUP BY 1),
x AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM g JOIN m USING (g) WHERE m.m < doc_id),
k AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS t FROM w),
s AS (SELECT k.doc_id, count(*) - count(x.p) AS n, count(x.p) AS r, string_agg(k.t, ' ' ORDER BY k.p) FILTER (WHERE x.p IS NULL) AS t FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.p = k.p GROUP BY 1)
SELECT d.doc_id, coalesce(s.n + s.r, 0)::BIGINT AS n_words, coalesce(s.r, 0)::BIGINT AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""

# DuckDB's sha1 is hexadecimal; five bits at a time make base 32.
_OP9_SQL = """
WITH p AS MATERIALIZED (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS m FROM p GROUP BY 1),
b AS (SELECT h, m, array_to_string(list_transform(range(0, 40), lambda i: ((strpos('0123456789abcdef', h[i + 1 : i + 1]) - 1)::UTINYINT::BIT::VARCHAR)[5:8]), '') AS bits FROM m)
SELECT page_id, n::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: chr((CASE WHEN v(bits, i) < 26 THEN 65 + v(bits, i) ELSE 24 + v(bits, i) END)::INTEGER)), '') AS payload_digest,
CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p JOIN b USING (h)
"""
_FIVE = "list_sum(list_transform(range(0, 5), lambda j: (bits[5 * i + j + 1 : 5 * i + j + 1])::INTEGER * (16 >> j::INTEGER)))"
_OP9_SQL = _OP9_SQL.replace("v(bits, i)", _FIVE)


_OP12_TERMS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_OP12_TERMS.format("text")} AS a FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n_docs, sum(len(a))::BIGINT AS n_terms FROM d WHERE len(a) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_OP12_TERMS.format("text")}) AS t FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(a) AS n, unnest(a) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
w AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY 1),
r AS (SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * s.n_docs) // s.n_terms))))::BIGINT AS score FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t, s GROUP BY 1, 2),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": _OP2_SQL,
        "op6_minhash_near_dedup": _OP6_SQL,
        "op9_warc_round_trip": _OP9_SQL,
        "op12_lexical_search": _OP12_SQL,
    }
