"""MinHash near-dedup by one-permutation hashing with optimal densification.

1. Every text becomes its set of five-word shingles (64-bit hashes) and one
   permutation of it: the hash space is cut into BINS bins, the smallest hash of a
   bin is its value, an empty bin borrows from the first full bin of its own fixed
   random probe order (optimal densification).
2. Rows of equal sets fall together first. What is linked from here on are distinct
   sets (vertices, numbered in the order of their smallest rows), whatever ids their
   rows have; the row with the smallest doc_id lends its text.
3. BANDS bands of ROWS bins make buckets; a bucket's smallest vertex is its hub and
   every other member a leaf. Only these star-shaped edges leave the buckets, so a
   bucket of n members gives n - 1 candidates.
4. A hub's leaves are compared on full sets: hub with leaf, and every leaf that
   the hub doesn't confirm with all the hub's leaves. No link between two members
   of a bucket is lost; leaves that are linked through the hub need no more tests.
   Of a task's links those are kept that join what was apart (a spanning forest).
   A hub with over CHUNK leaves is dealt out in chunks. There its leaves are laid out
   by their distance from the hub and their size: Jaccard distance is a metric, so a
   block of unconfirmed leaves meets only the chunks that the triangle inequality and
   the ratio of sizes leave possible.
5. Links become components by min-label propagation with pointer jumping.

A pair at the threshold misses all buckets with probability
(1 - 0.75**ROWS)**BANDS = 5e-6, a pair at 0.8 with 5e-8.

Defined results: a null or blank text has an empty set (n_shingles 0), is linked
with nothing and is kept; repeated rows give repeated rows of `near_components` and
one row of `keep_one`; rows that share a doc_id are linked by their own texts; a null
doc_id counts as the largest, so a component of such rows only has a null
component_id, and `keep_one` keeps one of its rows. An empty table gives no rows. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm._spark import THIN_IDS, cut, partitions, small_batches, text_key, tidy, without
from topicloom.llm._words import U, as_bytes, hash_words, mix, roll, split_points

SHINGLE = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
CHUNK = 256
NULL_ID = 2**63 - 1
_PROBES = np.stack([np.concatenate(([i], np.random.default_rng(i).permutation(BINS))) for i in range(BINS)])
_BAND = mix(np.arange(1, BANDS + 1, dtype=U))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case."""
    for a, b in split_points(np.array([len(t) for t in texts]), 1 << 22):
        words, counts = hash_words(texts[a:b], lower=True)
        rolled = roll(words, k)
        at = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(rolled[at : at + n - k + 1])
            elif n:
                short = U(n)
                for w in words[at : at + n]:
                    short = mix(np.array([(int(short) * 0x100000001B3 + int(w)) % 2**64], U))[0]
                yield np.array([short], U)
            else:
                yield np.zeros(0, U)
            at += n


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation values of a sorted set, densified."""
    bins = (s >> U(57)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    full = np.zeros(BINS, bool)
    value = np.zeros(BINS, U)
    full[bins[first]] = True
    value[bins[first]] = s[first]
    return value[_PROBES[np.arange(BINS), full[_PROBES].argmax(1)]]


def bands(s: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    v = signature(s).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix(key * U(0xC2B2AE3D27D4EB4F) + v[:, j])
    return key.view(np.int64)


@tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, keys = [], [], []
        for s in shingle_sets(as_bytes(batch.column("text"))):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(bands(s) if len(s) else np.zeros(0, np.int64))
        sizes = [len(k) for k in keys]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_th"),
                pa.array(n, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
            ],
            ["_id", "_th", "n_shingles", "digest", "keys"],
        )


@tidy
def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(as_bytes(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("chunk"), batch.column("side"), batch.column("doc"), pa.array(sets, pa.binary())], ["hub", "chunk", "side", "doc", "shingles"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    out = np.zeros((len(left), len(right)), np.int64)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    va, vb = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(va, vb)
    if not len(common):
        return out
    ka, kb = (np.minimum(np.searchsorted(common, v), len(common) - 1) for v in (va, vb))
    ha, hb = common[ka] == va, common[kb] == vb
    ra, ka, rb, kb = ra[ha], ka[ha], rb[hb], kb[hb]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ra, ka, rb, kb = ra[oa], ka[oa], rb[ob], kb[ob]
    for lo in range(0, len(common), 4096):
        hi = min(lo + 4096, len(common))
        a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
        i, j = np.searchsorted(ka, [lo, hi]), np.searchsorted(kb, [lo, hi])
        a[ra[i[0] : i[1]], ka[i[0] : i[1]] - lo] = 1
        b[rb[j[0] : j[1]], kb[j[0] : j[1]] - lo] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def linked(inter: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    na, nb = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
    return 100 * inter >= percent * (na + nb - inter)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the pairs, those that join what earlier ones left apart: one less than the vertices of a component."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = root[v]
        return v

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """Groups of consecutive rows with equal keys."""
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in keys]
        side, doc = batch.column("side").to_pylist(), batch.column("doc").to_pylist()
        sets = batch.column("shingles")
        for i, k in enumerate(zip(*cols, strict=True)):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append((side[i], doc[i], np.frombuffer(sets[i].as_buffer(), U)))
    if rows:
        yield key, rows


#: Cells of a large hub's leaves: so many to the largest distance, and to the largest ratio of sizes, that a link spans. Cells at most one more apart may hold linked leaves.
DISTANCES, SIZES = 4, 2
HUB, LARGE_HUB, LEAF = 0, 2, 1


def _cells(inter: np.ndarray, centre: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of leaves by distance from the hub and by size."""
    n = np.array([len(s) for s in sets])
    distance = 1 - inter / (len(centre) + n - inter)
    far, ratio = max(1 - percent / 100, 1e-9), max(-np.log(percent / 100), 1e-9)
    return np.floor(distance / far * DISTANCES).astype(np.int64), np.floor(np.log(n) / ratio * SIZES).astype(np.int64)


def _confirm(percent: int):
    """Of a hub's chunk: its links, and of a large hub all leaves with their cells and whether the hub confirms them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if i == 5 else pa.int64()) for i, x in enumerate(out)], ["a", "b", "hub", "distance", "size", "odd"])

        for (hub, _), rows in _grouped(batches, ("hub", "chunk")):
            centre = [s for side, _, s in rows if side != LEAF][:1]
            leaves = {d: s for side, d, s in rows if side == LEAF}
            if not centre or not leaves:
                continue
            ids, sets = list(leaves), list(leaves.values())
            inter = _overlaps(centre, sets)
            ok = linked(inter, centre, sets, percent)[0]
            rest = np.flatnonzero(~ok)
            pairs = [(hub, d) for d, yes in zip(ids, ok.tolist(), strict=True) if yes]
            if len(rest) and len(ids) > 1:
                odd = [sets[i] for i in rest]
                pairs += [(ids[rest[x]], ids[y]) for x, y in zip(*np.nonzero(linked(_overlaps(odd, sets), odd, sets, percent)), strict=True)]
            told = [(x, y, None, None, None, None) for x, y in _forest(pairs)]
            if any(side == LARGE_HUB for side, _, _ in rows):
                distance, size = _cells(inter[0], centre[0], sets, percent)
                told += zip(ids, [None] * len(ids), [hub] * len(ids), distance.tolist(), size.tolist(), (~ok).tolist(), strict=True)
            for row in told:
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            if len(out[0]) > 5000:
                yield flush()
                for x in out:
                    x.clear()
        yield flush()

    return run


def _confirm_blocks(percent: int):
    """Of a block of unconfirmed leaves and a chunk of leaves: their links."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _), rows in _grouped(batches, ("hub", "chunk")):
            odd, rest = ({d: s for side, d, s in rows if side == k} for k in (0, 1))
            if odd and rest:
                i, j, left, right = list(odd), list(rest), list(odd.values()), list(rest.values())
                hits = _forest((i[x], j[y]) for x, y in zip(*np.nonzero(linked(_overlaps(left, right), left, right, percent)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(v, l): the smallest vertex that v reaches, for the vertices of links (a, b)."""
    links = cut(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")))
    before = None
    while True:
        total = now.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return now
        before = total
        told = both.join(now, both.a == now.v).select(F.col("b").alias("v"), "l")
        low = cut(told.unionByName(now).groupBy("v").agg(F.min("l").alias("l")))
        up = low.select(F.col("v").alias("l"), F.col("l").alias("top"))
        now = cut(low.join(up, "l", "left").select("v", F.least("l", F.coalesce("top", "l")).alias("l")))


def _bounded(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if their number allows it."""
    return F.broadcast(rows) if rows.count() <= THIN_IDS else rows


def _blocks(texts: DataFrame, wanted: DataFrame, n_parts: int) -> DataFrame:
    """Shingle sets of the wanted (hub, chunk, side, doc), dealt out by hub and chunk. texts: vertex, text."""
    rows = wanted.join(texts, F.col("doc") == F.col("vertex")).select("hub", "chunk", "side", "doc", "text")
    sets = rows.mapInArrow(_to_sets, "hub long, chunk long, side int, doc long, shingles binary")
    return sets.repartition(n_parts, "hub", "chunk").sortWithinPartitions("hub", "chunk", "side")


def _far_leaves(texts: DataFrame, met: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """Links (a, b) of the unconfirmed leaves of large hubs with all leaves of theirs. met: hub, doc, distance, size, odd."""
    cell = ["hub", "distance", "size"]
    counts = met.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("odd").alias("n_odd"))
    order = Window.partitionBy("hub").orderBy("distance", "size").rowsBetween(Window.unboundedPreceding, -1)  # of a hub's cells
    cells = cut(counts.select("*", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("n", "n_odd")]))
    # neighbouring cells share a chunk, a full cell has several; a leaf's place in its cell is by hash
    of = lambda c, place: F.floor((F.col(f"{c}_before") + place) / CHUNK).cast("long")

    def ranges(c: str, name: str, d: str, z: str) -> DataFrame:
        spread = cells.filter(F.col(c) > 0).select("hub", "distance", "size", F.explode(F.sequence(of(c, F.lit(0)), of(c, F.col(c) - 1))).alias(name))
        return spread.groupBy("hub", name).agg(F.struct(F.min("distance").alias("lo"), F.max("distance").alias("hi")).alias(d), F.struct(F.min("size").alias("lo"), F.max("size").alias("hi")).alias(z))

    near = lambda x, y, reach: (F.col(f"{x}.lo") - F.col(f"{y}.hi") <= reach) & (F.col(f"{y}.lo") - F.col(f"{x}.hi") <= reach)
    pairs = ranges("n_odd", "block", "d", "z").join(ranges("n", "part", "e", "y"), "hub").filter(near("d", "e", DISTANCES + 1) & near("z", "y", SIZES + 1))
    pairs = cut(pairs.select("hub", "block", "part", F.xxhash64("block", "part").alias("chunk")))
    placed = met.join(_bounded(cells), cell)
    place = lambda c: of(c, F.pmod(F.xxhash64("doc", F.lit(7)), F.col(c)))
    odd = placed.filter("odd").withColumn("block", place("n_odd")).join(_bounded(pairs), ["hub", "block"]).select("hub", "chunk", F.lit(0).alias("side"), "doc")
    all_of = placed.withColumn("part", place("n")).join(_bounded(pairs), ["hub", "part"]).select("hub", "chunk", F.lit(1).alias("side"), "doc")
    return _blocks(texts, odd.unionByName(all_of), n_parts).mapInArrow(_confirm_blocks(percent), "a long, b long")


def _grouped_rows(docs: DataFrame, percent: int) -> DataFrame:
    """A row per row of docs: _id, _th, n_shingles, and its component's smallest row (top_id, top_th)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    n_parts = partitions(spark, docs)
    rows = docs.select(*text_key(), "text")
    told = cut(rows.mapInArrow(_describe, "_id long, _th long, n_shingles long, digest binary, keys array<long>"))
    sets = told.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("_id", "_th")).alias("row"), F.first("keys").alias("keys"))
    sets = cut(sets.select("digest", F.col("row._id").alias("id"), F.col("row._th").alias("th"), "keys"))
    # numbers follow the ids (an original is often older than its copies, so a good hub); they are read from the checkpoint only, so they stay as they are
    sets = cut(sets.repartitionByRange(partitions(spark), "id", "th").sortWithinPartitions("id", "th").withColumn("vertex", F.monotonically_increasing_id()))
    buckets = sets.select("vertex", F.explode("keys").alias("key"))
    hubs = cut(buckets.groupBy("key").agg(F.min("vertex").alias("hub"), F.max("vertex").alias("last")).filter("hub < last").select("key", "hub"))
    stars = cut(buckets.join(hubs, "key").filter("vertex <> hub").select("hub", F.col("vertex").alias("doc")).distinct())
    sizes = cut(stars.groupBy("hub").count().select("hub", F.ceil(F.col("count") / CHUNK).alias("n_chunks")))
    large = sizes.filter("n_chunks > 1")
    # a hub of over CHUNK leaves is one of at most (leaves / CHUNK); its leaves are not brought together by hub
    chunk = F.when(F.col("n_chunks").isNotNull(), F.pmod(F.xxhash64("doc"), F.col("n_chunks"))).otherwise(F.lit(0).cast("long"))
    leaves = stars.join(_bounded(large), "hub", "left").select("hub", chunk.alias("chunk"), F.lit(LEAF).alias("side"), "doc")
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"), F.when(F.col("n_chunks") > 1, LARGE_HUB).otherwise(HUB).alias("side"), F.col("hub").alias("doc"))
    wanted = leaves.unionByName(centres)
    lent = cut(sets.join(wanted.select("doc").distinct(), F.col("vertex") == F.col("doc"), "left_semi").select("vertex", "id", "th"))
    texts = rows.join(_bounded(lent), (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th"))).select("vertex", "text")
    if not told.groupBy("_id", "_th").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["vertex"])
    found = cut(_blocks(texts, wanted, n_parts).mapInArrow(_confirm(percent), "a long, b long, hub long, distance long, size long, odd boolean"))
    links = found.filter("b is not null").select("a", "b")
    met = found.filter("b is null").select("hub", F.col("a").alias("doc"), "distance", "size", "odd")
    if not met.filter("odd").isEmpty():
        links = links.unionByName(_far_leaves(texts, met, percent, n_parts))
    comp = components(links.distinct())

    # of a component the smallest row, and of every set the component's
    own = sets.select("digest", "vertex", F.struct("id", "th").alias("row")).join(comp, F.col("vertex") == F.col("v"), "left")
    tops = cut(own.filter("l is not null").groupBy("l").agg(F.min("row").alias("top")))
    placed = own.join(tops, "l", "left").select("digest", F.coalesce("top", "row").alias("top"))
    member = told.select("_id", "_th", "n_shingles", "digest").join(placed, "digest", "left")
    return member.select("_id", "_th", "n_shingles", F.coalesce(F.col("top.id"), F.col("_id")).alias("top_id"), F.coalesce(F.col("top.th"), F.col("_th")).alias("top_th"))


def near_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    none = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    rows = _grouped_rows(docs, percent).select(none("_id").alias("doc_id"), "n_shingles", none("top_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each component, the smallest by doc_id and a hash of the text; all columns stay."""
    rows = cut(_grouped_rows(docs, percent))
    out = without(docs, text_key(), rows.filter("_id <> top_id or _th <> top_th").select("_id", "_th"))
    twice = cut(rows.filter("n_shingles > 0 and _id = top_id and _th = top_th").groupBy("_id", "_th").count().filter("count > 1").select(F.col("_id").alias("_i"), F.col("_th").alias("_t")))
    if twice.isEmpty():
        return out
    packed = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row"), *text_key())
    same = [F.col("_id") == F.col("_i"), F.col("_th") == F.col("_t")]
    once = packed.join(_bounded(twice), same, "left_semi").dropDuplicates(["_id", "_th"])
    return packed.join(_bounded(twice), same, "left_anti").unionByName(once).select("row.*")
