"""Online variational Bayes for LDA on DataFrames.

A minibatch is one job: packed bags go to Arrow batches, each task infers its documents
together in numpy (their words as one sparse table, converged documents left alone)
and adds up the sufficient statistics of its own documents, so that one row per word and
task is shuffled, not one per document. Training writes the bags once, by minibatch, in
the shared folder, and each step reads its own.

Two strategies: "broadcast" keeps lambda (K by V doubles) on the driver and sends each
minibatch exp(E[log beta]), checked against BROADCAST_BYTES (above it, each chunk of documents is
brought the topic vectors of its own words by a shuffle join); "join" keeps lambda as a
table of a row per word that no machine holds whole: the E-step joins it by chunks of documents, the M-step is
a join with the statistics, and each step's table is written in the shared folder.

Draws depend on (seed, doc_id) only, so results depend neither on the order of
documents nor on partitions, up to the last bits of sums.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions.special import digamma, dirichlet_expectation
from topicloom.operators import bow as B
from topicloom.operators import kernel
from topicloom.operators.packets import SMALL_BATCH, Packets
from topicloom.operators.shared import Scratch, checkpoint
from topicloom.operators.skew import frequent_keys, with_keys, without_keys

BROADCAST_BYTES = 256 << 20
#: A lambda that fit_rows keeps on the driver: its large minibatches take it there several times over, as dense matrices, statistics and broadcasts.
DRIVER_BYTES = 16 << 20
#: Progress, and topics every log_every minibatches; switched by its level.
log = logging.getLogger("topicloom")


@dataclass(frozen=True)
class LdaParams:
    """strategy: "broadcast" or "join" (where lambda lives, see above); log_every: topics are logged after so many
    minibatches (0: never); alpha, eta: priors of documents and topics; decay and learning_rate: tau and kappa of the step (tau + t)**-kappa;
    total_docs: the corpus size assumed; compat: "local" (standard) or "distributed" (see fit)."""

    num_topics: int = 20
    alpha: float | None = None
    eta: float | None = None
    decay: float = 1024.0
    learning_rate: float = 0.7
    max_iter: int = 100
    convergence_threshold: float = 0.001
    total_docs: int | None = None
    seed: int = 42
    compat: str = "local"
    perplexity: bool = False
    strategy: str = "broadcast"
    log_every: int = 0

    def __post_init__(self):
        if self.strategy not in ("broadcast", "join"):
            raise ValueError("strategy is 'broadcast' or 'join'")
        if self.compat not in ("local", "distributed"):
            raise ValueError("compat is 'local' or 'distributed'")
        if self.num_topics < 1:
            raise ValueError("num_topics is at least 1")
        object.__setattr__(self, "alpha", 1.0 / self.num_topics if self.alpha is None else self.alpha)
        object.__setattr__(self, "eta", 1.0 / self.num_topics if self.eta is None else self.eta)


@dataclass
class LdaModel:
    """lam: K by V; vocab: words by id; perplexities: per-word figures of the minibatches, if asked for."""

    lam: np.ndarray
    vocab: list[str]
    params: LdaParams
    num_updates: int = 0
    perplexities: list[float] = field(default_factory=list)

    @property
    def num_topics(self) -> int:
        return self.lam.shape[0]

    def metadata(self) -> dict:
        return {"num_updates": self.num_updates, "params": asdict(self.params)}

    def lambda_long(self, spark: SparkSession) -> DataFrame:
        """topic, word_id, value."""
        k, v = self.lam.shape
        return spark.createDataFrame(pa.table({"topic": np.repeat(np.arange(k), v), "word_id": np.tile(np.arange(v), k), "value": self.lam.ravel()}))

    def lambda_rows(self, spark: SparkSession) -> DataFrame:
        """word_id, weights (K of them)."""
        k, v = self.lam.shape
        weights = pa.ListArray.from_arrays(pa.array(np.arange(v + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(self.lam.T).ravel()))
        return spark.createDataFrame(pa.table({"word_id": pa.array(np.arange(v, dtype=np.int32)), "weights": weights}))

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({"word_id": pa.array(np.arange(len(self.vocab)), pa.int32()), "word": pa.array(self.vocab, pa.string())}))


@dataclass
class TableModel:
    """lambda as a table: rows (word_id, weights), vocab (word_id, word). close() removes its files, if they are a run's own."""

    rows: DataFrame
    vocab: DataFrame
    params: LdaParams
    num_updates: int
    scratch: Scratch | None = None
    perplexities: list[float] = field(default_factory=list)

    def lambda_long(self) -> DataFrame:
        """topic, word_id, value."""
        return self.rows.select(F.posexplode("weights").alias("topic", "value"), "word_id").select("topic", "word_id", "value")

    def metadata(self) -> dict:
        return {"num_updates": self.num_updates, "params": asdict(self.params), "perplexities": self.perplexities}

    def top_words(self, n: int = 10) -> list[list[str]]:
        """The top words of each topic, ties to the lower id; n rows a topic leave the tasks."""
        from topicloom.operators.topics import top_words

        got = top_words(self.lambda_long(), self.vocab, n, normalise=False).collect()
        return [[r["word"] for r in got if r["topic"] == t] for t in range(self.params.num_topics)]

    def close(self) -> None:
        if self.scratch:
            self.scratch.drop()


def start_rows(vocab: DataFrame, p: LdaParams) -> DataFrame:
    """(word_id, weights): draws from Gamma(100, 1/100) that depend on the seed and the word's id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = kernel.start_weights(p.seed, batch.column("word_id").to_numpy(), p.num_topics)
            yield pa.RecordBatch.from_arrays([batch.column("word_id"), _lists(m)], ["word_id", "weights"])

    return vocab.select(F.col("word_id").cast("int").alias("word_id")).mapInArrow(run, "word_id int, weights array<double>")


def top_of(model: LdaModel, n: int = 10) -> list[list[str]]:
    """The top words of each topic, ties to the lower id."""
    return [[model.vocab[i] for i in np.lexsort((np.arange(len(row)), -row))[:n]] for row in model.lam]


#: Documents of a minibatch that one file holds.
FILE_DOCS = 500


@contextmanager
def _minibatches(docs: DataFrame, bags: DataFrame, batch_size: int):
    """The minibatches' packed bags, written once by batch_id so that a step reads its own only."""
    scratch = Scratch(docs.sparkSession)
    try:
        placed = bags.join(B.minibatches(docs.select("doc_id"), batch_size), "doc_id")
        files = max(1, batch_size // FILE_DOCS)
        rows = placed.repartition("batch_id", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
        scratch.save(rows, "bags", "batch_id")
        n = scratch.read("bags").agg(F.max("batch_id")).first()[0]
        kind = "doc_id long, word_ids array<int>, counts array<int>"
        yield (docs.sparkSession.read.schema(kind).parquet(f"{scratch.root}/bags/batch_id={i}") for i in range(0 if n is None else n + 1))
    finally:
        scratch.drop()


def rows_to_dense(rows: DataFrame, n_words: int | None = None) -> np.ndarray:
    """K by V from (word_id, weights)."""
    got = rows.orderBy("word_id").select("weights").toArrow().column("weights").combine_chunks()
    m = got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1).T.copy()
    if n_words is not None and m.shape[1] != n_words:
        raise ValueError("word ids are not 0 to V - 1")
    return m


def _beta(lam: np.ndarray) -> np.ndarray:
    return np.exp(dirichlet_expectation(lam))


def _local_beta(rows: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The distributed variant's, for words (n by K) of documents: normalised over a document's own words; one word alone counts as one Dirichlet over topics."""
    totals = np.zeros((n_docs, rows.shape[1]))
    np.add.at(totals, doc, rows)
    alone = (np.bincount(doc, minlength=n_docs) == 1)[doc]
    total = np.where(alone[:, None], rows.sum(1, keepdims=True), totals[doc])
    return np.exp(digamma(rows) - digamma(total))


class _Statistics:
    """Sums of word statistics of a task."""

    #: Rows that are held before they are added up.
    HELD = 1 << 20

    def __init__(self, k: int):
        self.words, self.sums, self.n = [np.zeros(0, np.int64)], [np.zeros((0, k))], 0

    def add(self, words: np.ndarray, values: np.ndarray) -> None:
        self.words.append(words), self.sums.append(values)
        self.n += len(words)
        if self.n > self.HELD:
            self.total()
            self.n = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        words, values = np.concatenate(self.words), np.concatenate(self.sums)
        words, at = np.unique(words, return_inverse=True)
        sums = np.stack([np.bincount(at, values[:, j], len(words)) for j in range(values.shape[1])], axis=1) if len(words) else values
        self.words, self.sums = [words], [sums]
        return words, sums


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and their number in each row (0 for null)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), sizes


_ESTEP = "doc_id long, gamma array<double>, n_words long, change double, bound double, word_id int, ss array<double>"
_NAMES = ["doc_id", "gamma", "n_words", "change", "bound", "word_id", "ss"]
_ESTEP_ARROW = pa.schema(list(zip(_NAMES, [pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.float64())], strict=True)))


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _document_rows(ids: pa.Array, gamma: np.ndarray, n_words: np.ndarray, change: np.ndarray, bound: np.ndarray | None) -> pa.RecordBatch:
    n = len(ids)
    own = [ids, _lists(gamma), pa.array(n_words.astype(np.int64)), pa.array(change), pa.nulls(n, pa.float64()) if bound is None else pa.array(bound)]
    return pa.RecordBatch.from_arrays([*own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64()))], _NAMES)


def _word_rows(words: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    n = len(words)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([*none, pa.array(words.astype(np.int32)), _lists(sums)], _NAMES)


@dataclass(frozen=True)
class Progress:
    """What the job that trains tells of its minibatch: documents, words, mean last change of gamma, documents' part of the bound (None: not asked for)."""

    size: int
    n_words: int
    change: float
    bound: float | None

    @staticmethod
    def watch(rows: DataFrame) -> tuple[DataFrame, Observation]:
        """rows of an E-step, and what is observed of them when a job first runs over them."""
        seen = Observation()
        told = [F.count("doc_id").alias("size"), F.sum("n_words").alias("n_words"), F.sum("change").alias("change"), F.sum("bound").alias("bound")]
        return rows.observe(seen, *told), seen

    @staticmethod
    def of(seen: Observation) -> Progress:
        got = seen.get
        size = got["size"] or 0
        return Progress(size, got["n_words"] or 0, (got["change"] or 0.0) / max(size, 1), got["bound"])


def _infer_batches(batches: Iterator[pa.RecordBatch], p: LdaParams, k: int, statistics: bool, vectors) -> Iterator[pa.RecordBatch]:
    """The E-step of a task.

    vectors: from (batch, word ids, documents of the words, number of documents) to beta of the words, n by K, as the
    variant normalises it and over the whole vocabulary.
    """
    own, held = p.compat == "distributed", _Statistics(k)
    for batch in batches:
        values, sizes = _list(batch.column("word_ids"))
        words, counts = values.to_numpy(zero_copy_only=False).astype(np.int64), _list(batch.column("counts"))[0].to_numpy(zero_copy_only=False).astype(float)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        beta, whole = vectors(batch, words, doc, len(sizes))
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        gamma0 = kernel.start_gammas(p.seed, np.zeros_like(ids) if own else ids, k)
        if "gamma0" in batch.schema.names:
            given = batch.column("gamma0")
            there = given.is_valid().to_numpy(zero_copy_only=False)
            gamma0[there] = _list(given)[0].to_numpy(zero_copy_only=False).reshape(-1, k)
        gamma, ss, change = kernel.vb_documents(counts, beta, doc, gamma0, p.alpha, p.max_iter, p.convergence_threshold)
        if statistics:
            held.add(words, ss * beta)
        bound = kernel.document_bounds(counts, whole, doc, gamma, p.alpha) if p.perplexity else None
        yield _document_rows(batch.column("doc_id"), gamma, np.bincount(doc, counts, len(sizes)), change, bound)
    words, sums = held.total()
    if len(words):
        yield _word_rows(words, sums)


def infer(bags: DataFrame, lam: np.ndarray, params: LdaParams, gamma0: DataFrame | None = None, statistics: bool = True) -> DataFrame:
    """E-step of packed bags (doc_id, word_ids, counts): rows doc_id, gamma, n_words, change, bound, and rows word_id, ss (per task; sum them by word).

    gamma0 (doc_id, gamma) replaces the seeded draws. ss is already multiplied by beta. What was sent to the executors is
    the result's attribute `sent`, to be destroyed after its last use.
    """
    spark = bags.sparkSession
    if lam.nbytes > BROADCAST_BYTES:
        rows = LdaModel(lam, [], params).lambda_rows(spark)
        return infer_by_join(bags, bags, rows, replace(params, num_topics=lam.shape[0]), gamma0, statistics)
    k, p, own = lam.shape[0], params, params.compat == "distributed"
    shared = spark.sparkContext.broadcast(np.ascontiguousarray((lam if own else _beta(lam)).T))
    if gamma0 is not None:
        bags = bags.join(gamma0.select("doc_id", F.col("gamma").alias("gamma0")), "doc_id", "left")

    totals = digamma(lam.sum(1)) if own else None

    def vectors(_, words, doc, n_docs):
        rows = shared.value[words]
        return (_local_beta(rows, doc, n_docs), np.exp(digamma(rows) - totals)) if own else (rows, rows)

    out = bags.mapInArrow(lambda batches: _infer_batches(batches, p, k, statistics, vectors), _ESTEP)
    out.sent = shared
    return out


def sum_statistics(rows: DataFrame, k: int) -> DataFrame:
    """word_id, ss: the tasks' statistics added up, topic by topic (partial sums before the shuffle)."""
    sums = [F.sum(F.col("ss")[i]).alias(f"s{i}") for i in range(k)]
    return rows.groupBy("word_id").agg(*sums).select("word_id", F.array(*[F.col(f"s{i}") for i in range(k)]).alias("ss"))


def _frequent_rows(bow: DataFrame, lambda_rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The words that many documents hold (a table), and their ids in order and lambda rows as numpy: so many as a broadcast may hold."""
    frequent = frequent_keys(bow, "word_id")
    most = max(1, BROADCAST_BYTES // (8 * k))
    if frequent.count() > most:
        frequent = checkpoint(frequent.orderBy(F.desc("n_rows"), "word_id").limit(most))
    got = with_keys(lambda_rows, frequent, "word_id").select("word_id", "weights").toPandas().sort_values("word_id")
    return frequent, got["word_id"].to_numpy(np.int64), np.stack(got["weights"].to_list()) if len(got) else np.zeros((0, k))


#: Words of documents (distinct in each) that a chunk of the joined E-step holds, and those that are inferred at once.
CHUNK_WORDS, PART_WORDS = 1 << 19, 1 << 16
_CHUNK = "chunk long, words array<int>, packet binary"


def _chunks(size: int, part_size: int):
    """Packed bags as chunks of whole documents: a number, the distinct words, the rows in Arrow's format by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def passed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            words = np.unique(np.concatenate([_list(part.column("word_ids"))[0].to_numpy(zero_copy_only=False) for part in held])).astype(np.int32)
            row = [pa.array([first + done], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.int32())), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["chunk", "words", "packet"])

        for batch in batches:
            ends = np.cumsum(_list(batch.column("word_ids"))[1] + 1)  # a document without words has a place too
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + part_size, "right")))
                held.append(batch.slice(at, to - at))
                n += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if n >= size:
                    yield passed()
                    held, n, done = [], 0, done + 1
        if held:
            yield passed()

    return run


def _known(batch: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
    """A batch of packed bags without the words that are not in ids (in order)."""
    values, sizes = _list(batch.column("word_ids"))
    there = np.isin(values.to_numpy(zero_copy_only=False), ids)
    if there.all():
        return batch
    doc = np.repeat(np.arange(len(sizes)), sizes)[there]
    ends, kept = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))]), pa.int32()), pa.array(there)
    lists = {name: pa.ListArray.from_arrays(ends, _list(batch.column(name))[0].filter(kept)) for name in ("word_ids", "counts")}
    return pa.RecordBatch.from_arrays([lists.get(name, batch.column(name)) for name in batch.schema.names], batch.schema.names)


def infer_by_join(docs: DataFrame, bow: DataFrame, lambda_rows: DataFrame, params: LdaParams, gamma0: DataFrame | None = None, statistics: bool = True) -> DataFrame:
    """The E-step for a lambda that fits nowhere: rows as of infer, from bow (doc_id, word_id, n) and (word_id, weights).

    bow may be packed bags of all docs (doc_id, word_ids, counts), which are not shuffled for it. Documents are put together
    in chunks, written once in the shared folder; a chunk is brought the lambda row of each of its distinct words by a join,
    however many of its documents hold the word, and infers its documents by parts. So a word's rows in that join are the
    chunks that hold it, no more, and what is shuffled grows with chunks and their vocabularies, not with
    documents and theirs. The normalisers are K sums; statistics are added up in the chunk.
    """
    k, p, own = params.num_topics, params, params.compat == "distributed"
    sums = lambda_rows.agg(*[F.sum(F.col("weights")[i]) for i in range(k)]).first()
    totals = digamma(np.array([1.0 if x is None else x for x in sums], float))
    bags = (bow if "word_ids" in bow.columns else B.packed_bags(docs, bow)).select("doc_id", "word_ids", "counts")
    if gamma0 is not None:
        bags = bags.join(gamma0.select("doc_id", F.col("gamma").alias("gamma0")), "doc_id", "left")
    chunks = checkpoint(bags.mapInArrow(_chunks(CHUNK_WORDS, PART_WORDS), _CHUNK))  # their numbers hold for both sides of the join
    asked = chunks.select(F.col("chunk").alias("of"), F.explode("words").alias("word_id")).join(lambda_rows.select("word_id", "weights"), "word_id")

    def run(packets: pa.Table, met: pa.Table) -> pa.Table:
        ids = met.column("word_id").to_numpy().astype(np.int64)
        order = np.argsort(ids)
        ids, found = ids[order], met.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[order]
        whole = np.exp(digamma(found) - totals)

        def vectors(_, words, doc, n_docs):
            at = np.searchsorted(ids, words)
            return (_local_beta(found[at], doc, n_docs), whole[at]) if own else (whole[at], whole[at])

        parts = (_known(part, ids) for packet in packets.column("packet") for part in pa.ipc.open_stream(packet.as_buffer()))
        return pa.Table.from_batches(list(_infer_batches(parts, p, k, statistics, vectors))).cast(_ESTEP_ARROW)

    return chunks.select("chunk", "packet").groupBy("chunk").cogroup(asked.select("of", "word_id", "weights").groupBy("of")).applyInArrow(run, _ESTEP)


def m_step_table(lambda_rows: DataFrame, ss: DataFrame, params: LdaParams, batch_size: int, updates: int) -> DataFrame:
    """The M-step of (word_id, weights) with (word_id, ss): words without statistics count as zeros."""
    p, k = params, params.num_topics
    d = p.compat == "distributed"
    rho = kernel.learning_rate(p.decay, updates + d, p.learning_rate)
    step = rho * (p.total_docs or batch_size) / batch_size
    floor = p.eta if d else rho * p.eta
    filled = F.coalesce("ss", F.array_repeat(F.lit(0.0), k))
    return lambda_rows.join(ss, "word_id", "left").select("word_id", F.zip_with("weights", filled, lambda x, s: (1 - rho) * x + step * s + floor).alias("weights"))


class OnlineLda:
    """fit, partial_fit and transform over DataFrames of (doc_id, text).

    compat="distributed" reproduces a variant that normalises topics over each document's own words, shares one
    starting gamma, does not scale eta by the step and counts updates from one.
    """

    def __init__(self, params: LdaParams, tokenizer: T.Tokenizer = T.cleaned_words):
        self.params, self.tokenizer = params, tokenizer

    def start(self, vocab: Iterable[str], lam: np.ndarray | None = None) -> LdaModel:
        words = list(dict.fromkeys(vocab))
        return LdaModel(kernel.start_lambda(self.params.seed, self.params.num_topics, len(words)) if lam is None else np.array(lam, float), words, self.params)

    def bags(self, docs: DataFrame, model: LdaModel) -> DataFrame:
        vocab = model.vocabulary(docs.sparkSession)
        return B.bags(docs, vocab, self.tokenizer, len(model.vocab))

    def partial_fit(self, model: LdaModel, bags: DataFrame, gamma0: DataFrame | None = None) -> LdaModel:
        """One minibatch of packed bags, in one job: its size, words, change and bound are observed while it trains."""
        rows = infer(bags, model.lam, self.params, gamma0)
        sent = getattr(rows, "sent", None)
        rows, seen = Progress.watch(rows)
        got = sum_statistics(rows.filter("word_id is not null"), model.num_topics).toArrow()
        told = Progress.of(seen)
        if sent is not None:
            sent.destroy()
        if not told.size:
            return model
        ss = np.zeros_like(model.lam)
        if len(got):
            ss[:, got.column("word_id").to_numpy()] = got.column("ss").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, model.num_topics).T
        return self._updated(model, told, ss)

    def _updated(self, model: LdaModel, told: Progress, ss: np.ndarray) -> LdaModel:
        p = self.params
        total_docs, figures = p.total_docs or told.size, self._figures(model, model.lam, told)
        lam = kernel.m_step(model.lam, ss, told.size, eta=p.eta, tau=p.decay, kappa=p.learning_rate, total_docs=total_docs, updates=model.num_updates, compat=p.compat)
        self._log_update(model.num_updates + 1, told, figures)
        return LdaModel(lam, model.vocab, self.params, model.num_updates + 1, figures)

    def _figures(self, model: LdaModel, lam: np.ndarray, told: Progress) -> list[float]:
        """The perplexities with that of the next step from lam, if they are asked for."""
        p, figures = self.params, list(model.perplexities)
        if p.perplexity:
            figures.append(kernel.per_word_perplexity(told.bound, kernel.topic_bound(lam, p.eta), told.size, told.n_words, p.total_docs or told.size))
        return figures

    def _log_update(self, update: int, told: Progress, figures: list[float]) -> None:
        log.info("update %d: %d documents, %d words, mean change %.2g%s", update, told.size, told.n_words, told.change, f", perplexity {figures[-1]:.2f}" if self.params.perplexity else "")

    def fit_packets(self, model: LdaModel, packets: Packets) -> LdaModel:
        """All minibatches of packets, one after the other; a step is sent the vectors of its own words, and touches no others' (see kernel.ScaledLambda)."""
        p, k, own = self.params, model.num_topics, self.params.compat == "distributed"
        lam, model = kernel.ScaledLambda(model.lam), replace(model, lam=model.lam[:, :0])
        for i in range(packets.n):
            words, totals = packets.words(i), digamma(lam.totals)
            rows = lam.rows(words)
            vectors = rows if own else np.exp(digamma(rows) - totals)

            def step(batches, sent, totals=totals):
                def of(_, words, doc, n_docs):
                    rows = sent[1][np.searchsorted(sent[0], words)]
                    return (_local_beta(rows, doc, n_docs), np.exp(digamma(rows) - totals)) if own else (rows, rows)

                return _infer_batches(batches, p, k, True, of)

            ss, size, n_words, change, bound = np.zeros((len(words), k)), 0, 0, 0.0, 0.0
            for found in packets.step(i, vectors, step):
                documents = found.filter(found.column("n_words").is_valid())
                size, n_words = size + len(documents), n_words + sum(documents.column("n_words").to_pylist())
                change, bound = change + sum(documents.column("change").to_pylist()), bound + sum(x or 0.0 for x in documents.column("bound").to_pylist())
                of_words = found.filter(found.column("word_id").is_valid())
                ss[np.searchsorted(words, of_words.column("word_id").to_numpy())] += _list(of_words.column("ss"))[0].to_numpy().reshape(-1, k)
            if size:
                told = Progress(size, n_words, change / size, bound if p.perplexity else None)
                figures = self._figures(model, lam.dense() if p.perplexity else model.lam, told)
                lam.step(words, ss, size, eta=p.eta, tau=p.decay, kappa=p.learning_rate, total_docs=p.total_docs or size, updates=model.num_updates, compat=p.compat)
                model = LdaModel(model.lam, model.vocab, p, model.num_updates + 1, figures)
                self._log_update(model.num_updates, told, figures)
                self._log_topics(model.num_updates, lambda: top_of(replace(model, lam=lam.dense())))  # noqa: B023
        return replace(model, lam=lam.dense())

    def fit(self, docs: DataFrame, vocab: Iterable[str], batch_size: int = 100, lam: np.ndarray | None = None, gamma0: DataFrame | None = None) -> LdaModel:
        """Minibatches of batch_size documents by doc_id, one after the other; lambda on the driver (see fit_table for strategy "join")."""
        model = self.start(vocab, lam)
        if self.params.strategy == "join":
            spark = docs.sparkSession
            got = self.fit_table(docs, model.vocabulary(spark), batch_size, model.lambda_rows(spark), gamma0)
            lam = rows_to_dense(got.rows, len(model.vocab)) if model.vocab else model.lam
            got.close()
            return LdaModel(lam, model.vocab, self.params, got.num_updates, got.perplexities)
        if batch_size <= SMALL_BATCH:  # a step is sent its own words, whatever lambda's size
            packets = Packets(docs, self.bags(docs, model), batch_size, gamma0)
            try:
                return self.fit_packets(model, packets)
            finally:
                packets.close()
        with _minibatches(docs, self.bags(docs, model), batch_size) as batches:
            for bags in batches:
                model = self.partial_fit(model, bags, gamma0)
                self._log_topics(model.num_updates, lambda: top_of(model))
        return model

    def fit_rows(self, docs: DataFrame, vocab: DataFrame, batch_size: int, lambda_rows: DataFrame, gamma0: DataFrame | None = None) -> LdaModel | TableModel:
        """fit from lambda_rows, without collecting what the driver should not hold: large minibatches of a lambda over DRIVER_BYTES leave it a table. vocab: word_id, word."""
        n_words = vocab.count()
        if batch_size > SMALL_BATCH and 8 * self.params.num_topics * n_words > DRIVER_BYTES:
            return self.fit_table(docs, vocab, batch_size, lambda_rows, gamma0)
        words = vocab.orderBy("word_id").select("word").toArrow().column("word").to_pylist()
        return self.fit(docs, words, batch_size, rows_to_dense(lambda_rows, n_words) if n_words else None, gamma0)

    def fit_table(self, docs: DataFrame, vocab: DataFrame, batch_size: int = 100, lambda_rows: DataFrame | None = None, gamma0: DataFrame | None = None) -> TableModel:
        """Strategy "join": lambda is a table (word_id, weights) from start to end. vocab: word_id, word.

        It starts from lambda_rows, or from draws of (seed, word_id). Each step's table is written in the shared folder
        and the one before removed, so a step never depends on more than the last.
        """
        scratch = Scratch(docs.sparkSession)
        n_words = vocab.count()
        rows = scratch.save(start_rows(vocab, self.params) if lambda_rows is None else lambda_rows.select("word_id", "weights"), "lambda-0")
        model = TableModel(rows, vocab, self.params, 0, scratch)
        with _minibatches(docs, B.bags(docs, vocab, self.tokenizer, n_words), batch_size) as batches:
            for bags in batches:
                model = self.table_step(model, bags, n_words, gamma0)
        return model

    def table_step(self, model: TableModel, bags: DataFrame, n_words: int, gamma0: DataFrame | None = None) -> TableModel:
        """One minibatch of packed bags with lambda as a table of n_words rows: statistics and the next lambda are written in model.scratch, the last ones removed."""
        p, scratch, updates = self.params, model.scratch, model.num_updates
        rows, seen = Progress.watch(infer_by_join(bags, bags, model.rows, p, gamma0))
        ss = scratch.save(sum_statistics(rows.filter("word_id is not null"), p.num_topics), f"statistics-{updates}")
        told = Progress.of(seen)
        if not told.size:
            return model
        step, figures = replace(p, total_docs=p.total_docs or told.size), list(model.perplexities)
        if p.perplexity:
            from topicloom.operators.evaluate import topic_terms

            topics = topic_terms(model.lambda_long(), p.eta, n_words).agg(F.sum("prior")).first()[0] or 0.0
            figures.append(kernel.per_word_perplexity(told.bound, topics, told.size, told.n_words, step.total_docs))
        found = scratch.save(m_step_table(model.rows, ss, step, told.size, updates), f"lambda-{updates + 1}")
        scratch.drop(f"statistics-{updates}"), scratch.drop(f"lambda-{updates}")
        out = TableModel(found, model.vocab, p, updates + 1, scratch, figures)
        log.info("update %d: %d documents, %d words, mean change %.2g%s", out.num_updates, told.size, told.n_words, told.change, f", perplexity {figures[-1]:.2f}" if p.perplexity else "")
        self._log_topics(out.num_updates, out.top_words)
        return out

    def packs(self, lambda_rows: DataFrame, n_words: int, batch_size: int) -> bool:
        """Whether minibatches of lambda as a table may go by packets: they are small, and so is lambda, with a row for each id below n_words."""
        if batch_size > SMALL_BATCH or 8 * self.params.num_topics * n_words > BROADCAST_BYTES or not n_words:
            return False
        low, high, n = lambda_rows.agg(F.min("word_id"), F.max("word_id"), F.count("*")).first()
        return (low, high, n) == (0, n_words - 1, n_words)

    def fit_table_packets(self, model: TableModel, docs: DataFrame, bags: DataFrame, batch_size: int, gamma0: DataFrame | None = None) -> TableModel:
        """The minibatches of packed bags by packets: lambda is on the driver from the first to the last, then a table of model.scratch again."""
        packets = Packets(docs, bags, batch_size, gamma0)
        try:
            # words are known by their ids here; topics are logged from the table
            got = OnlineLda(replace(self.params, log_every=0)).fit_packets(LdaModel(rows_to_dense(model.rows), [], self.params, model.num_updates, list(model.perplexities)), packets)
        finally:
            packets.close()
        rows = model.scratch.save(got.lambda_rows(docs.sparkSession), f"lambda-packets-{got.num_updates}")
        out = TableModel(rows, model.vocab, self.params, got.num_updates, model.scratch, got.perplexities)
        if self.params.log_every and got.num_updates // self.params.log_every > model.num_updates // self.params.log_every:
            for topic, words in enumerate(out.top_words()):
                log.info("topic %d: %s", topic, " ".join(words))
        return out

    def _log_topics(self, updates: int, tops: Callable[[], list[list[str]]]) -> None:
        if self.params.log_every and updates % self.params.log_every == 0:
            for topic, words in enumerate(tops()):
                log.info("topic %d: %s", topic, " ".join(words))

    def transform(self, docs: DataFrame, model: LdaModel | TableModel, double: bool = False, gamma0: DataFrame | None = None) -> DataFrame:
        """doc_id, topic, proportion. double=True takes the Dirichlet expectation of lambda twice, as a known variant does."""
        if isinstance(model, TableModel):
            return proportions(infer_by_join(docs, B.bags(docs, model.vocab, self.tokenizer), model.rows, self.params, gamma0, False).select("doc_id", "gamma"))
        lam = _beta(model.lam) if double else model.lam
        return proportions(infer(self.bags(docs, model), lam, self.params, gamma0, statistics=False).select("doc_id", "gamma"))


def proportions(gamma: DataFrame) -> DataFrame:
    """doc_id, topic, proportion from (doc_id, gamma)."""
    total = F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x)
    return gamma.select("doc_id", F.posexplode(F.transform("gamma", lambda x: x / total)).alias("topic", "proportion"))


def mllib_lda(docs: DataFrame, bow: DataFrame, n_words: int, params: LdaParams, max_iter: int = 20):
    """Spark's own online LDA on the same bags, as a cross-check (its minibatches are samples)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import array_to_vector

    # array_to_vector makes dense vectors: a cross-check is for vocabularies of a few thousand words
    places = F.sequence(F.lit(0), F.lit(n_words - 1))
    counted = F.map_from_arrays("word_ids", "counts")
    rows = B.packed_bags(docs, bow).select("doc_id", array_to_vector(F.transform(places, lambda i: F.coalesce(F.try_element_at(counted, i), F.lit(0)).cast("double"))).alias("features"))
    lda = LDA(k=params.num_topics, maxIter=max_iter, seed=params.seed, optimizer="online", learningOffset=params.decay, learningDecay=params.learning_rate, docConcentration=[params.alpha] * params.num_topics, topicConcentration=params.eta)
    return lda.fit(rows)
