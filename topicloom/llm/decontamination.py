"""Benchmark decontamination by templates: typed placeholders, window hashes, slot consistency.

Texts become tokens without punctuation and in lower case, and templates in which
numbers (in digits or in words), the units after them and names (capitalised words
inside a sentence, also after a line break, a quote or a bracket) are placeholders of
their type; a run of numbers or of names is one placeholder. White space is made one
blank first. A second
template has no names, for copies in another case; an item's first word, which may stand
inside a sentence of the document, is taken both as a word and as a name that must be
the same. Windows of WINDOW template tokens of the benchmark (SHORT of items with
fewer) meet those of all documents by hash; windows that are mostly placeholders say
nothing as templates. Besides, all windows of plain words meet those of the documents,
whatever they hold. Windows of one document and item that lie on one diagonal, or on
diagonals at most SHIFT words apart (a word more or less), belong to one occurrence. It
is a leak if it covers COVER tokens (all of a shorter item), half as many of them
outside placeholders, and its slots are consistent: one value of the item stands for
one value of the document throughout, and the other way round. Runs of equally many
names, or of numbers in digits, are compared word by word, so a name inside a run is held
against the same name alone; other runs, and a number in words, are one value. Matches by
hash are held against the words: all outside placeholders must be equal. So an item with new
numbers or names is caught, a text that shares its phrases with changing values is not,
unless windows of plain words cover COVER tokens of the item.

Items with fewer tokens than SHORT ("yes", "paris") are in many sentences by chance:
they leak where they are a whole line of a document.

Everything is DataFrame operations. All sizes and templates of a document are made in
one pass: each token is hashed once, and a window's hash is one of its tokens' hashes.
The benchmark's windows are broadcast up to BROADCAST_ROWS of them (some 300 bytes
each); beyond that their hashes alone thin the documents' windows, up to
BROADCAST_HASHES (8 bytes each), and then a shuffle joins, in which the rows of a window
that is common in documents are dealt to several tasks. Matches are pre-reduced to the
pairs of windows. Those of plain words are held against the texts that have any, in a
second reading; where too many documents have some for a broadcast, these texts are shuffled.

Defined results: null and blank texts have no windows; repeated rows count once; rows
that share an id count by their texts; a null doc_id is reported as null; an empty
table, or benchmark, gives no rows. Other columns are not read; `keep_clean` keeps them
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._skew import salted_join
from topicloom.llm._spark import cut, text_key, thinned, without

WINDOW, COVER = 8, 13
#: Windows of items with fewer than WINDOW tokens; items with fewer than this must be a whole line.
SHORT = 4
#: Occurrences whose diagonals are at most so many words apart are added up.
SHIFT = 4
BROADCAST_ROWS = 200_000
BROADCAST_HASHES = 4_000_000
NULL_ID = 2**63 - 1

_NAME, _NUMBER, _UNIT, _JOINED = "\x01", "\x02", "\x03", "\x04"
#: Words that are units when a number stands before them.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents yen percent degree degrees celsius fahrenheit kelvin hz khz mhz ghz w kw mw watt watts v volt volts j kj kcal calorie calories n pa kpa bar mph kmh kb mb gb tb bit bits byte bytes"
)
_DIGITS = "one|two|three|four|five|six|seven|eight|nine"
#: Numbers in words, without hyphens.
NUMBER_WORDS = f"(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:{_DIGITS})?|zero|{_DIGITS}|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|hundred|thousand|million|billion"


def tokens_of(text: Column) -> tuple[Column, Column, Column]:
    """Plain tokens of a text and its two templates, place by place: numbers and units, and names besides.

    A run of numbers or of names is one placeholder; its later places hold _JOINED.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x20\x85\p{Z}]{2,}|[\x01-\x1F\x85\p{Z}&&[^ ]]", " ")
    named = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{Nd},;:)\]\"'\u2019\u201D\u00BB] [\"'(\[\u2018\u201C\u00AB]?)", _NAME)
    marked = F.regexp_replace(F.lower(named), r"[^a-z0-9\x01 \p{L}\p{N}]+", "")
    marked = F.trim(F.regexp_replace(marked, "  +", " "))
    numbers = F.regexp_replace(marked, rf"(?=[\p{{Nd}}\x01befhmnostz])(?<![^ ])(?:\p{{Nd}}[^ ]*|\x01?(?:{NUMBER_WORDS})(?![^ ]))", _NUMBER)
    numbers = F.regexp_replace(numbers, rf"(?<=\x02 )\x01?(?:{'|'.join(UNITS.split())})(?![^ ])", _UNIT)
    numbers = F.regexp_replace(numbers, r"(?<=[\x02\x04] )\x02", _JOINED)
    names = F.regexp_replace(numbers, r"\x01[^ ]*", _NAME)
    names = F.regexp_replace(names, r"(?<=\x01 )\x01", _JOINED)
    return F.split(F.translate(marked, _NAME, ""), " "), F.split(F.translate(numbers, _NAME, ""), " "), F.split(names, " ")


def _joined(column: str) -> list[Column]:
    """c and s of a template: its tokens, and where they start among the plain ones (null: each at its own place)."""
    some = F.array_contains(column, _JOINED)
    starts = F.filter(F.sequence(F.lit(0), F.size(column) - 1), lambda i: F.get(column, i) != _JOINED)
    return [F.when(some, F.filter(column, lambda x: x != _JOINED)).otherwise(F.col(column)).alias(f"c{column}"), F.when(some, starts).alias(f"s{column}")]


def _starts() -> Column:
    """Places of the tokens of a window among the plain ones, and of the token after it (see _windows)."""
    span = F.sequence(F.lit(0), F.col("size"))
    return F.when(F.col("starts").isNull(), F.transform(span, lambda j: F.col("at") + j)).otherwise(F.transform(span, lambda j: F.coalesce(F.get("starts", j), F.col("at") + F.size("words"))))


def _values(starts: str) -> Column:
    """The words of each token of a window."""
    return F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda i: F.array_join(F.slice("words", F.element_at(starts, i) - F.col("at") + 1, F.element_at(starts, i + 1) - F.element_at(starts, i)), " "))


def _slot_pairs() -> Column:
    """What a slot's values dw (document) and iw (item) must be consistent in: each of their words, or the runs as a whole."""
    d, i = F.split("dw", " "), F.split("iw", " ")
    apart = (F.size(d) == F.size(i)) & ((F.col("tw") == _NAME) | ~F.concat_ws(" ", "dw", "iw").rlike(r"(?:^| )\P{Nd}"))
    return F.when(apart, F.zip_with(d, i, lambda x, y: F.struct(x.alias("dw"), y.alias("iw")))).otherwise(F.array(F.struct("dw", "iw")))


def _is_slot(token: Column) -> Column:
    return token.isin(_NAME, _NUMBER, _UNIT)


def _hashes(tokens) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _window_hash(i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(size)])


def _windows(size: int) -> Column:
    """All windows of size tokens (h: their hashes, s: their places in the plain tokens p), in order: hash, at, words, starts.

    A window takes its own words along and no others, so rows stay in proportion to the texts; words is null where p is,
    starts where each token is one word.
    """

    def one(i: Column) -> Column:
        at = F.coalesce(F.get("s", i), i)
        end = F.coalesce(F.get("s", i + size), F.when(F.col("s").isNull(), i + size).otherwise(F.size("p")))
        return F.struct(_window_hash(i, size).alias("hash"), at.alias("at"), F.slice("p", at + 1, end - at).alias("words"), F.slice("s", i + 1, size + 1).alias("starts"))

    return F.when(F.size("h") >= size, F.transform(F.sequence(F.lit(0), F.size("h") - size), one))


def _wanted(items: DataFrame, window: int, short: int) -> DataFrame:
    """The windows of the items: hash, kind, size, item_id, ipos, n_tokens, fixed, iat (see _starts), the words iw and for templates the tokens tw.

    All windows of plain words (kind 0), and those with numbers (1) or names (2) that are not mostly placeholders (of a
    short item: windows of an item that is not). An item's first word is a name or not by what stands before it: in a
    fixed window it is one, but must be the same.
    """
    n, out = F.size("p"), None
    for kind, column, fixed in ((0, "p", False), (1, "t1", False), (2, "t2", False), (2, "b2", True)):
        rows = items.filter((F.element_at("b2", 1) == _NAME) & (F.element_at("t2", 1) != _NAME)) if fixed else items
        rows = rows.select("item_id", "p", n.alias("n_tokens"), *_joined(column)).withColumnsRenamed({f"c{column}": "c", f"s{column}": "s"}).withColumn("h", _hashes("c"))
        for size in dict.fromkeys((window, short)):
            some = rows.filter(F.size("c") >= size if size == window else F.size("c").between(size, window - 1)).withColumn("size", F.lit(size))
            some = some.select("*", F.posexplode(_windows(size)).alias("k", "w")).select("*", "w.*").withColumn("iat", _starts()).withColumn("iw", _values("iat"))
            if kind:
                some = some.withColumn("tw", F.slice("c", F.col("k") + 1, F.col("size")))
                if fixed:
                    some = some.filter("k = 0").withColumn("tw", F.concat(F.slice("iw", 1, 1), F.slice("tw", 2, size)))
                slots = F.filter("tw", _is_slot)
                whole = F.size(slots) if size == window else F.size(F.filter("c", _is_slot))
                some = some.filter((F.array_contains(slots, _NAME) if kind == 2 else F.size(slots) > 0) & (F.size(slots) < F.col("size")) & (2 * whole <= (F.col("size") if size == window else F.size("c"))))
            else:
                some = some.withColumn("tw", F.lit(None).cast("array<string>"))
            some = some.select("hash", F.lit(kind).alias("kind"), "size", "item_id", F.col("iat")[0].alias("ipos"), "n_tokens", F.lit(fixed).alias("fixed"), "iat", "iw", "tw")
            out = some if out is None else out.unionByName(some)
    return out


def _line_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, th, item_id, covered, n_tokens of items that are a whole line of a document. items: item_id, p."""
    lines = docs.select(*text_key(), F.explode(F.split("text", r"[\n\r\x0B\x0C\x85\u2028\u2029]")).alias("line")).select("_id", "_th", F.array_join(tokens_of(F.col("line"))[0], " ").alias("line"))
    short = items.select("item_id", F.size("p").alias("n_tokens"), F.array_join("p", " ").alias("words"))
    if short.count() <= BROADCAST_ROWS:
        short = F.broadcast(short)
    return lines.join(short, F.col("line") == F.col("words")).select(F.col("_id").alias("id"), F.col("_th").alias("th"), "item_id", F.col("n_tokens").alias("covered"), "n_tokens").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER, short: int = SHORT) -> DataFrame:
    """id, th (the row of docs, see text_key), item_id, covered (tokens), n_tokens of the item: one row per leaked item."""
    plain, numbers, names = tokens_of(F.col("text"))
    within = tokens_of(F.concat(F.lit("x "), "text"))[2]
    items = benchmark.select("item_id", plain.alias("p"), numbers.alias("t1"), names.alias("t2"), F.slice(within, 2, F.size(within)).alias("b2"))
    items = cut(items.filter(F.element_at("p", 1) != "").dropDuplicates(["item_id", "p", "t2"]))
    short = min(short, window)
    lines = items.filter(F.size("p") < short).select("item_id", "p")
    lines = _line_leaks(docs, lines) if not lines.isEmpty() else None
    wanted = cut(_wanted(items, window, short))
    kinds = [(r["kind"], r["size"]) for r in wanted.select("kind", "size").distinct().collect()]  # at most six
    if not kinds:
        none = docs.select(*text_key()).select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("covered"), F.lit(0).alias("n_tokens")).limit(0)
        return lines if lines is not None else none
    n_wanted, hashes = wanted.count(), None
    if n_wanted <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:
        found = cut(wanted.select("hash").distinct())
        hashes = F.broadcast(found) if found.count() <= BROADCAST_HASHES else None
    base = docs.select(*text_key(), plain.alias("p"), numbers.alias("t1"), names.alias("t2"))
    # a template that equals the one before has no windows of its own; plain windows, the most, take no words along
    base = base.select("_id", "_th", "p", (F.col("t1") != F.col("p")).alias("d1"), (F.col("t2") != F.col("t1")).alias("d2"), *_joined("t1"), *_joined("t2"))
    tokens = {0: F.col("p"), 1: F.when(F.col("d1"), F.col("ct1")), 2: F.when(F.col("d2"), F.col("ct2"))}
    starts = {0: F.lit(None).cast("array<int>"), 1: F.col("st1"), 2: F.col("st2")}
    words = {0: F.lit(None).cast("array<string>"), 1: F.col("p"), 2: F.col("p")}
    branches = [F.struct(F.lit(size).alias("z"), _hashes(tokens[kind]).alias("h"), starts[kind].alias("s"), words[kind].alias("p")) for kind, size in sorted(kinds)]
    places = base.select("_id", "_th", F.explode(F.array(*branches)).alias("b")).select("_id", "_th", "b.*").filter(F.size("h") >= F.col("z"))
    sizes = {size for _, size in kinds}
    of_size = _windows(window) if sizes == {window} else _windows(short) if sizes == {short} else F.when(F.col("z") == window, _windows(window)).otherwise(_windows(short))
    places = places.select("_id", "_th", F.explode(of_size).alias("w")).select("_id", "_th", "w.*")
    if n_wanted <= BROADCAST_ROWS:
        met = places.join(wanted, "hash")
    elif hashes is not None:
        met = salted_join(cut(places.join(hashes, "hash", "left_semi")), wanted, "hash", ["_id", "_th", "at"])
    else:
        met = salted_join(places, wanted, "hash", ["_id", "_th", "at"])
    met = met.withColumn("dat", _starts()).withColumn("dw", _values("dat"))
    met = met.withColumn("diagonal", F.col("dat")[0] - F.col("ipos"))
    pair = ["_id", "_th", "item_id", "n_tokens"]
    matches = cut(met.select(*pair, "kind", "fixed", "diagonal", "ipos", "dat", "iat", "dw", "iw", F.coalesce("tw", "iw").alias("tw")).dropDuplicates([*pair, "kind", "fixed", "diagonal", "ipos"]))
    # a hash says that windows may be equal; the words decide
    equal = F.forall(F.arrays_zip("dw", "iw", "tw"), lambda c: (c["dw"] == c["iw"]) | _is_slot(c["tw"]))
    templates, same = matches.filter("kind > 0").filter((F.size("dw") == F.size("iw")) & equal), matches.filter("kind = 0")
    texts = thinned(docs.select(*text_key(), "text"), "_id", same, "_id").select("_id", "_th", plain.alias("p"))
    # word by word: a slice would copy all words of a text for each match
    alike = F.forall(F.sequence(F.lit(0), F.size("iw") - 1), lambda j: F.get("p", F.col("dat")[0] + j) == F.get("iw", j))
    same = texts.join(same, ["_id", "_th"]).filter(alike)
    matches = cut(templates.unionByName(same.select(*templates.columns)))

    # occurrences: each diagonal alone, and neighbouring ones together
    order = Window.partitionBy(*pair).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT, F.lit(False))
    chains = matches.select(*pair, "diagonal").distinct().withColumn("apart", apart.cast("int")).select(*pair, "diagonal", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"))
    both = F.array(F.struct(F.lit(True).alias("alone"), F.col("diagonal").cast("long").alias("n")), F.struct(F.lit(False).alias("alone"), F.col("chain").alias("n")))
    matches = cut(matches.join(chains, [*pair, "diagonal"]).withColumn("part", F.explode(both)))
    where = [*pair, "part"]
    # a place of the item and one of the document count once, so that repeats in one do not fill the other
    cell = F.flatten(F.transform(F.sequence(F.lit(0), F.size("iat") - 2), lambda j: F.transform(F.sequence(F.get("iat", j), F.get("iat", j + 1) - 1), lambda i: F.struct(i.alias("at"), (F.get("dat", j).cast("long") * 2**20 + i - F.get("iat", j)).alias("there"), (~_is_slot(F.get("tw", j))).alias("word")))))
    cells = matches.select(*where, (F.col("kind") == 0).alias("same"), F.explode(cell).alias("c"))
    sides = [cells.groupBy(*where, F.col(f"c.{c}").alias("at")).agg(F.bool_or("same").alias("same"), F.bool_or("c.word").alias("word")).groupBy(*where).agg(F.count("*").alias("n"), F.count_if("same").alias("e"), F.count_if("word").alias("w")) for c in ("at", "there")]
    covered = sides[0].unionByName(sides[1]).groupBy(*where).agg(F.min("n").alias("covered"), F.min("e").alias("exact"), F.min("w").alias("words"))
    slots = cut(matches.filter("kind > 0").select(*where, F.explode(F.arrays_zip("dw", "iw", "tw")).alias("c")).select(*where, "c.*").filter(_is_slot(F.col("tw"))).select(*where, "tw", F.inline(_slot_pairs())).distinct())
    twice = slots.groupBy(*where, "tw", "iw").count().select(*where, "count").unionByName(slots.groupBy(*where, "tw", "dw").count().select(*where, "count"))
    odd = twice.groupBy(*where).agg((F.max("count") > 1).alias("odd"))
    need = F.least(F.lit(cover), F.col("n_tokens"))
    hits = covered.join(odd, where, "left").filter((F.col("exact") >= need) | (F.col("covered") >= need) & (2 * F.col("words") >= need) & ~F.coalesce("odd", F.lit(False)))
    hits = hits.groupBy("_id", "_th", "item_id").agg(F.max("covered").alias("covered"), F.max("n_tokens").alias("n_tokens")).withColumnsRenamed({"_id": "id", "_th": "th"})
    if lines is None:
        return hits
    both = hits.unionByName(lines.withColumn("covered", F.col("covered").cast("long")))
    return both.groupBy("id", "th", "item_id").agg(F.max("covered").alias("covered"), F.max("n_tokens").alias("n_tokens"))


def leak_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """One row per document and item that leaked into it: doc_id, item_id, covered and n_tokens (of the item)."""
    hits = leaks(docs, benchmark, window, cover)
    doc = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    return hits.groupBy(doc, "item_id").agg(F.max("covered").cast("long").alias("covered"), F.max("n_tokens").cast("long").alias("n_tokens"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay."""
    return without(docs, text_key(), leaks(docs, benchmark, window, cover).select("id", "th"))
