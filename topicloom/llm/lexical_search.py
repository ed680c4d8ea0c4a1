"""Ranked lexical search, impact-ordered and score-at-a-time, exact.

1. Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in
   lower case. One pass over all documents gives the number of documents with terms, the
   number of terms and, for the queries' terms, the documents that hold them.
2. Queries are taken in blocks of at most QUERY_BYTES of text (one query at least), so what a task
   gets of them is bounded; every block is ranked against all documents.
3. A task indexes its documents in blocks: a posting's impact is the term's weight times
   floor(10**9 tf / (1000 tf + 8 m)), an integer, and each term's postings are grouped by exact
   impact, descending. A query reads its terms' groups from the highest impacts down, a level
   at a time; a group is never split, so what is unread of a term is bounded by its next group.
4. It stops only when these bounds prove that no document that was not met can be among
   the first k (ties included); then the documents that still can be get their complete scores.
   What earlier blocks of the task have reached is the least score that matters.
5. Each task's first k of a query are merged in two steps, so no task gets all tasks' rows.

Defined results: a null text or one without terms is no document of the statistics and is
never returned, as is a query without terms; fewer than k documents with a score above 0 give
fewer rows. Equal scores rank by doc_id, a null doc_id last. Repeated rows of
documents are documents of their own; repeated rows of queries give their rows again. An empty
table gives no rows. A text is split at once, whatever its length. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm._spark import cut, partitions, small_batches, tidy
from topicloom.llm._words import as_bytes

K = 10
#: Text of the queries that are sent to all tasks at once.
QUERY_BYTES = 1 << 20
#: Documents, and postings, of one index.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
#: The next level is this share of the highest impact that is unread.
LEVEL = 0.75
NULL_ID = 2**63 - 1
# The bytes that separate terms, and A-Z in lower case.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _gather(ids: dict[bytes, int], texts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; number of the text, term and occurrences of its terms in ids."""
    n, size, term, tf = [], [], [], []
    for t in texts:
        words = terms(t)
        held = Counter(map(ids.get, words))
        held.pop(None, None)
        n.append(len(words))
        size.append(len(held))
        term.extend(held)
        tf.extend(held.values())
    return np.array(n, np.int64), np.repeat(np.arange(len(size)), size), np.array(term, np.int64), np.array(tf, np.int64)


class Index:
    """Impact-ordered postings of some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """doc, term, tf: postings by ascending doc."""
        self.ids, self.n = ids, len(ids)
        m = 10 + 90 * n * n_docs // n_terms
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.by_doc, self.by_doc_part = term[order] * self.n + doc[order], part[order]
        order = np.lexsort((-part, term))
        self.doc, self.part, self.weights = doc[order], part[order], weights
        self.negative = -self.part
        self.edges = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def search(self, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) and scores of at least `least` that hold all of the first k."""
        at, end, w = self.edges[query].copy(), self.edges[query + 1], self.weights[query]
        score = np.zeros(self.n, np.int64)
        while True:
            left = np.flatnonzero((at < end) & (w > 0))
            bounds = w[left] * self.part[at[left]]
            rest = int(bounds.sum())
            positive = score[score > 0]
            best = max(least, int(np.partition(positive, len(positive) - k)[len(positive) - k]) if len(positive) >= k else 0)
            if rest < max(best, 1):
                break
            level = int(bounds.max() * LEVEL)
            for i, bound in zip(left.tolist(), bounds.tolist(), strict=True):
                if bound >= level:  # all groups of this term with an impact of at least level
                    a, b = at[i], end[i]
                    stop = a + np.searchsorted(self.negative[a:b], -(-(-level // int(w[i]))), "right")
                    score[self.doc[a:stop]] += w[i] * self.part[a:stop]
                    at[i] = stop
        some = np.flatnonzero((score > 0) & (score + rest >= best))
        for i in left.tolist():  # complete the scores of those that can still be among the first
            want = query[i] * self.n + some
            j = np.searchsorted(self.by_doc, want)
            j[j == len(self.by_doc)] = 0
            unread = (self.by_doc[j] == want) & (self.by_doc_part[j] <= self.part[at[i]])
            score[some] += np.where(unread, w[i] * self.by_doc_part[j], 0)
        some = some[score[some] >= max(best, 1)]
        return some, score[some]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _count(ids):
    """Of a task: documents with terms, their terms (term -1), and documents that hold each term of ids (a broadcast)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids.value
        df, docs, words = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            n, _, term, _ = _gather(known, as_bytes(batch.column("text")))
            docs, words = docs + int((n > 0).sum()), words + int(n.sum())
            df += np.bincount(term, minlength=len(known))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int64()), pa.array([docs, *df[held].tolist()], pa.int64()), pa.array([words] + [0] * len(held), pa.int64())], ["term", "docs", "words"])

    return run


def _rank(sent, k: int):
    """Of a task: the first k documents of every query. sent (a broadcast): term numbers, weights, N, L, terms of the queries."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, n_docs, n_terms, queries = sent.value
        top_ids, top_scores = ([np.zeros(0, np.int64)] * len(queries) for _ in range(2))

        def block() -> Iterator[tuple]:
            """Documents of one index."""
            held, rows, postings = [], 0, 0
            for batch in batches:
                step = 512
                for x in range(0, batch.num_rows, step):
                    part = batch.slice(x, step)
                    held.append((part.column("_id").to_numpy(), *_gather(known, as_bytes(part.column("text")))))
                    rows, postings = rows + part.num_rows, postings + len(held[-1][2])
                    if rows >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                        yield held
                        held, rows, postings = [], 0, 0
            if held:
                yield held

        for held in block():
            first = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
            doc = np.concatenate([h[2] + f for h, f in zip(held, first, strict=True)])
            ids, n, term, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3, 4))
            if not len(doc):
                continue
            index = Index(ids, n, doc, term, tf, weights, n_docs, n_terms)
            for q, query in enumerate(queries):
                least = int(top_scores[q][-1]) if len(top_scores[q]) == k else 0
                some, score = index.search(query, k, least)
                if len(some):
                    own, score = np.concatenate([top_ids[q], ids[some]]), np.concatenate([top_scores[q], score])
                    best = _first(own, score, k)
                    top_ids[q], top_scores[q] = own[best], score[best]
        size = [len(x) for x in top_ids]
        if sum(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), size)), pa.array(np.concatenate(top_ids)), pa.array(np.concatenate(top_scores))], ["query", "_id", "score"])

    return run


def _query_blocks(queries: DataFrame, item: str) -> Iterator[list[tuple]]:
    """Item ids and texts in blocks of at most QUERY_BYTES of text (one query at least)."""
    spark = queries.sparkSession
    rows = queries.select(F.col(item).alias("item"), F.col("text"), F.octet_length("text").cast("long").alias("size")).filter("size > 0")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = int(total // QUERY_BYTES) + 1
    if parts > 1:
        rows = rows.repartitionByRange(parts, "item", F.xxhash64("text"))
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    before = F.sum("size").over(Window.partitionBy("part").orderBy("item", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))  # of a part's rows, about QUERY_BYTES
    rows = cut(rows.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / QUERY_BYTES).cast("long")))
    for found in rows.select("part", "block").distinct().toLocalIterator():
        yield [(r.item, r.text) for r in rows.filter((F.col("part") == found.part) & (F.col("block") == found.block)).select("item", "text").collect()]


def _search_block(spark: SparkSession, docs: DataFrame, queries: list[tuple], item: str, kind: str, k: int) -> DataFrame | None:
    """docs: _id, text."""
    found = [(i, sorted(set(terms(t.encode())))) for i, t in queries]
    found = [(i, t) for i, t in found if t]
    ids = {t: n for n, t in enumerate(dict.fromkeys(t for _, own in found for t in own))}
    if not ids:
        return None
    counted = docs.select("text").mapInArrow(_count(spark.sparkContext.broadcast(ids)), "term long, docs long, words long")
    totals = counted.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()  # a row per term of the block's queries
    all_docs, all_words = next(((r.docs, r.words) for r in totals if r.term == -1), (0, 0))
    if not all_words:
        return None
    weights = np.zeros(len(ids), np.int64)
    for r in totals:
        if r.term >= 0:
            weights[r.term] = weight(all_docs, r.docs)
    sent = spark.sparkContext.broadcast((ids, weights, all_docs, all_words, [np.array([ids[t] for t in own], np.int64) for _, own in found]))
    tops = docs.mapInArrow(_rank(sent, k), "query long, _id long, score long").withColumn("task", F.spark_partition_id())
    order = lambda *by: F.row_number().over(Window.partitionBy("query", *by).orderBy(F.desc("score"), "_id"))
    salts = max(1, partitions(spark, docs) // 64)
    first = tops.withColumn("salt", F.pmod("task", F.lit(salts))).withColumn("place", order("salt")).filter(F.col("place") <= k)
    first = first.withColumn("rank", order()).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(found)], f"query long, {item} {kind}")
    return first.join(F.broadcast(names), "query").select(item, F.col("rank").cast("int").alias("rank"), F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K, item: str = "item_id") -> DataFrame:
    """item (of queries: item, text), rank from 1, doc_id, score: the k highest-scoring documents of each query with scores above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("_id"), "text")
    kind, out = dict(queries.dtypes)[item], None
    for block in _query_blocks(queries, item):
        found = _search_block(spark, rows, block, item, kind, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{item} {kind}, rank int, doc_id long, score long")
