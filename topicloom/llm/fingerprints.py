"""SimHash document fingerprints, and a search within a Hamming radius by permuted block tables.

A text's terms are its words ([^\\x20\\x09-\\x0D]+). Each occurrence votes with the
64 bits of its hash, weighted by the word's length (long words tell documents
apart, short ones are in all of them); a bit is set where the set votes outweigh
the others. Votes of two bits share one long (bit i below, bit i + 32 above), so a
fingerprint is 33 sums over exploded words, all in generated code, and rows are
pre-aggregated by the task that explodes them.

Search: with radius r a fingerprint is cut into 2r blocks; two fingerprints within
the radius agree on r blocks at least, so each choice of r blocks is a table with
those blocks as its key, and a join per key finds all of them, whatever the size
of the table. Equal fingerprints are counted first and searched once.

Everything is DataFrame operations. Defined results: a null or blank text has no
terms and the fingerprint 0; equal texts have equal fingerprints; a null doc_id
counts as the largest; among equal doc_ids the order is by a hash of the text, and of
equal rows each has an equal one next, but the last; an empty table gives no rows.
Other columns are not read.

The next document is found among keys alone (id, hash of the text), sorted by range;
texts are shuffled once by key, and each lends the start that the row before needs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._spark import cut, partitions, text_key

BITS, LANE = 64, 32
SPACES = r"[\x20\x09-\x0D]+"
RADIUS = 3
NULL_ID = 2**63 - 1
#: Queries are the rows whose id is divisible by this.
EVERY = 50


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp: the SimHash of the texts of each key."""
    words = rows.select(*keys, F.explode(F.split(F.col(text), SPACES)).alias("w")).filter("w <> ''")
    h, weight = F.xxhash64("w"), F.length("w").cast("long")
    terms = words.select(*keys, h.alias("h"), weight.alias("weight"))
    both = F.lit((1 << LANE) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(both) * F.col("weight")).alias(f"s{i}") for i in range(LANE)]
    low = (1 << LANE) - 1
    bits: Column = F.lit(0).cast("long")
    for i in range(LANE):
        s = F.col(f"s{i}")
        for place, ones in ((i, s.bitwiseAND(F.lit(low))), (i + LANE, F.shiftrightunsigned(s, LANE))):
            value = (1 << place) - (1 << 64 if place == 63 else 0)
            bits = bits.bitwiseOR(F.when(ones * 2 > F.col("weights"), F.lit(value)).otherwise(F.lit(0).cast("long")))
    return terms.groupBy(*keys).agg(*sums, F.sum("weight").alias("weights")).select(*keys, bits.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(radius: int) -> list[int]:
    """One mask per table: the bits of each choice of radius out of 2 * radius blocks."""
    n = max(2, 2 * radius)
    edges = [round(k * BITS / n) for k in range(n + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in c) for c in combinations(range(n), n - radius)]


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q, fp, rows: for each distinct query q all fingerprints (column fp of both) within the radius, and how many rows have them."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius)]
    tables = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(len(masks))]).alias("t"), F.array(*[F.lit(m).cast("long") for m in masks]).alias("m")))
    keyed = lambda df: df.withColumn("_t", tables).withColumn("_key", F.xxhash64("_t.t", F.col("fp").bitwiseAND(F.col("_t.m")))).drop("_t")
    counted = keyed(fingerprints.groupBy("fp").agg(F.count("*").alias("rows")))
    asked = keyed(queries.select("fp").distinct()).select(F.col("fp").alias("q"), F.col("_key").alias("_k"))
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    return counted.join(asked, (F.col("_key") == F.col("_k")) & near).select("q", "fp", "rows").distinct()


def _next_rows(docs: DataFrame) -> DataFrame:
    """id, th, copies (equal rows), n (code points), next_id, next_th: the distinct rows, each with the next by descending id, then hash (after the last: the first).

    Only keys are sorted: dealt out by range, ordered inside a range, and the last of a range meets the first of the
    next by the range's number. Ranges are as many as tasks, whatever the plan.
    """
    n = F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n")
    keys = cut(docs.select(*text_key(), "text").groupBy("_id", "_th").agg(F.count("*").alias("copies"), n))
    ranges = partitions(docs.sparkSession, keys)
    dealt = cut(keys.repartitionByRange(ranges, F.desc("_id"), "_th").withColumn("_r", F.spark_partition_id()))
    order = Window.partitionBy("_r").orderBy(F.desc("_id"), "_th")
    key = F.struct("_id", "_th")
    inside = dealt.withColumn("after", F.lead(key).over(order))
    # descending ids: the first of a range has the largest id and, of that, the smallest hash
    firsts = dealt.groupBy("_r").agg(F.min(F.struct(F.bitwise_not("_id").alias("down"), "_th")).alias("f")).select("_r", F.struct(F.bitwise_not("f.down").alias("_id"), F.col("f._th").alias("_th")).alias("first"))
    along = Window.orderBy("_r")  # a row per task
    both = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = cut(firsts.select("_r", F.coalesce(F.lead("first").over(along), F.first("first").over(both)).alias("first")))
    full = inside.join(F.broadcast(firsts), "_r").withColumn("after", F.coalesce("after", "first"))
    return full.select(F.col("_id").alias("id"), F.col("_th").alias("th"), "copies", "n", F.col("after._id").alias("next_id"), F.col("after._th").alias("next_th"))


def _with_edits(docs: DataFrame) -> DataFrame:
    """A row per distinct row and next: _id, _th, copies, n, next_id, next_th, text, edited. Of equal rows all but one have an equal one next."""
    links = cut(_next_rows(docs))
    texts = docs.select(*text_key(), F.coalesce("text", F.lit("")).alias("text"))
    if not links.filter("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["_id", "_th"])
    third = F.expr("cast(floor(n / 3) as int)")
    start = lambda c: F.substring(c, F.lit(1), third)
    lent = texts.join(links, (F.col("_id") == F.col("next_id")) & (F.col("_th") == F.col("next_th"))).select("id", "th", "copies", "n", "next_id", "next_th", start("text").alias("lent"))
    rows = texts.join(lent, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")))
    kept = F.substring("text", F.lit(1), F.col("n") - third)
    real = F.struct(F.lit(1).cast("long").alias("copies"), "next_id", "next_th", F.concat(kept, "lent").alias("edited"))
    twin = F.struct((F.col("copies") - 1).alias("copies"), F.col("_id").alias("next_id"), F.col("_th").alias("next_th"), F.concat(kept, start("text")).alias("edited"))
    return rows.select("_id", "_th", "n", "text", F.explode(F.when(F.col("copies") > 1, F.array(real, twin)).otherwise(F.array(real))).alias("e")).select("_id", "_th", "n", "text", "e.*")


def fingerprint_report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and n_near: for rows whose doc_id is divisible by EVERY, how many other rows have a fingerprint within the radius."""
    rows = _with_edits(docs)
    key = ["_id", "_th", "next_id", "next_th"]
    # both branches read the same columns of rows, so Spark shuffles the texts once and reuses that
    texts = rows.select(*key, F.posexplode(F.array("text", "edited")).alias("edit", "t"))
    marks = votes(texts, [*key, "edit"], "t").groupBy(*key).agg(F.max(F.when(F.col("edit") == 0, F.col("fp"))).alias("a"), F.max(F.when(F.col("edit") == 1, F.col("fp"))).alias("b"))
    meta = rows.select(*key, "copies", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    zero = F.lit(0).cast("long")
    doc = F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")
    each = meta.join(marks, key, "left").select(doc, *key, "n_chars", "edited_sha256", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    done = cut(each.drop("copy"))
    queries = done.filter(F.col("doc_id") % EVERY == 0).select(F.col("a").alias("fp"))
    counts = within(queries, done.select(F.col("a").alias("fp")), radius).groupBy("q").agg((F.sum("rows") - 1).alias("n_near"))
    after = done.select(F.col("_id").alias("next_id"), F.col("_th").alias("next_th"), F.col("a").alias("c")).dropDuplicates(["next_id", "next_th"])
    full = done.join(after, ["next_id", "next_th"], "left").join(cut(counts), F.col("a") == F.col("q"), "left")
    return full.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("a")).alias("fingerprint"), hex_of(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.coalesce("c", zero)).alias("near_next"), F.when(F.col("doc_id") % EVERY == 0, F.col("n_near")).alias("n_near"),
    )
