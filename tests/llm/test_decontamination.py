from __future__ import annotations

import random

from pyspark.sql import functions as F

from topicloom.llm import decontamination as D
from topicloom.llm._skew import salted_join

ITEM = "A train leaves the station at 40 miles per hour and meets Anna after 3 hours on the road to the old mill. How far is that?"
OTHER = "Compute the area of a square garden whose fence is 12 meters long and give the answer in whole numbers please"
FILL = "nothing here has to do with any question at all but it is long enough to be a text"


def leaked(spark, texts, items=(ITEM, OTHER), **kw):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, item_id string, _id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in D.leak_pairs(docs, bench, **kw).collect()}


def test_exact_and_reparameterised(spark):
    new = ITEM.replace("40 miles", "65 miles").replace("3 hours", "7 hours").replace("Anna", "Boris")
    unit = ITEM.replace("40 miles per hour", "40 km per hour")
    assert leaked(spark, [f"{FILL}. {ITEM} {FILL}", f"{FILL}\n{new}", f"{FILL} {unit.upper()}", FILL, None, "", OTHER]) == {(0, 0), (1, 0), (2, 0), (6, 1)}


def test_inconsistent_slots_are_no_leak(spark):
    item = "if 5 cats eat 5 fish in 5 days then 5 dogs will chase 5 birds for 5 nights"
    same = item.replace("5", "8")
    mixed = "if 1 cats eat 2 fish in 3 days then 4 dogs will chase 6 birds for 7 nights"
    assert leaked(spark, [same, mixed, item], [item]) == {(0, 0), (2, 0)}


def test_short_items_and_short_overlaps(spark):
    short = "what is the capital of the moon"
    assert leaked(spark, [f"he asked {short} and left", "what is the capital of mars"], [short]) == {(0, 0)}
    part = " ".join(ITEM.split()[:10])
    assert leaked(spark, [f"{FILL} {part} {FILL}"]) == set()


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    texts = [f"{FILL}. {ITEM}", FILL, OTHER]
    want = leaked(spark, texts)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert leaked(spark, texts) == want == {(0, 0), (2, 1)}
    monkeypatch.setattr(D, "BROADCAST_HASHES", 0)
    assert leaked(spark, texts) == want


def test_numbers_only_and_items_of_few_words(spark):
    """Sixteen numbers word for word; items of one to three words are leaks as a line only."""
    numbers = " ".join(str(i) for i in range(101, 117))
    items = [numbers, "yes", "new york city", "Paris"]
    texts = [f"{FILL} {numbers} {FILL}", "oh yes, of course", f"{FILL}\nYes!\n{FILL}", "in new york city they said", "New York City.", "we saw Paris\nin spring", "\u2028 paris \r\n", numbers.replace("110", "910")]
    assert leaked(spark, texts, items) == {(0, 0), (2, 1), (4, 2), (6, 3)}


def test_items_of_all_lengths_at_once(spark):
    """Eight lengths: each item is found where all its words are (13 of a longer one), and not in a text that lacks one."""
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
    items = [" ".join(words[:n]) for n in (4, 5, 6, 7, 8, 9, 12, 16)]
    texts = [f"{FILL} {i} {FILL}" for i in items]
    want = {(d, k) for d in range(8) for k in range(8) if len(items[k].split()) <= len(items[d].split())} | {(7, 7)}
    assert leaked(spark, texts, items) == want


def test_names_after_quotes_and_brackets(spark):
    item = 'every day the teacher asked "Anna to bring (Boris the red book from the shelf near the window'
    texts = [item.replace("Anna", "Clara").replace("Boris", "David"), item.replace('"Anna', "Clara\n").replace("(Boris", "David")]
    assert leaked(spark, texts, [item]) == {(0, 0), (1, 0)}


def test_against_brute_force(spark):
    """Without placeholders a leak is COVER tokens on one diagonal."""
    rng = random.Random(8)
    vocab = [f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop"]
    vocab = [v.replace("0", "") for v in vocab]
    items = [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(40)]
        w = rng.choice(items).split()
        a, n = rng.randrange(10), rng.choice([5, 9, 12, 13, 14, 15])
        texts.append(" ".join(t[:20] + w[a : a + n] + t[20:]))

    def covered(t, i):
        t, i, best = t.split(), i.split(), 0
        for diagonal in range(-len(i), len(t)):
            places = set()
            for p in range(len(i) - 7):
                if 0 <= p + diagonal <= len(t) - 8 and t[p + diagonal : p + diagonal + 8] == i[p : p + 8]:
                    places |= set(range(p, p + 8))
            best = max(best, len(places))
        return best

    want = {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if covered(t, i) >= 13}
    assert leaked(spark, texts, items) == want and len(want) > 10


def _by_hand(text, item, window=8, cover=13):
    """Leaks of an item by trying all pairs of windows; runs of placeholders are one token."""
    is_name, is_number = (lambda w: w[:1].isupper()), (lambda w: w[:1].isdigit())
    t, i = text.split(), item.split()
    as_name = lambda ws, p: p > 0 and is_name(ws[p]) and (ws[p - 1][-1].islower() or ws[p - 1][-1].isdigit())

    def template(ws, kind):
        """Tokens, and the places where they start and the last one ends."""
        tokens, starts = [], []
        for p, w in enumerate(ws):
            token = chr(2) if kind and is_number(w) else chr(1) if kind == 2 and as_name(ws, p) else w.lower()
            if not (tokens and token in (chr(1), chr(2)) and token == tokens[-1]):
                tokens.append(token)
                starts.append(p)
        return tokens, [*starts, len(ws)]

    found = []
    for kind in (0, 1, 2):
        (a, at), (b, bt) = template(t, kind), template(i, kind)
        for q in range(len(b) - window + 1):
            slots = sum(x in (chr(1), chr(2)) for x in b[q : q + window])
            if kind and (2 * slots > window or not slots or kind == 2 and chr(1) not in b[q : q + window]):
                continue
            found += [(at[p] - bt[q], kind, tuple(b[q : q + window]), at[p : p + window + 1], bt[q : q + window + 1]) for p in range(len(a) - window + 1) if a[p : p + window] == b[q : q + window]]
    diagonals = sorted({d for d, *_ in found})
    chains, now = [], []
    for d in diagonals:
        if now and d - now[-1] > 4:
            chains.append(now)
            now = []
        now.append(d)
    need = min(cover, len(i))
    for part in [[d] for d in diagonals] + chains + [now]:
        rows = [f for f in found if f[0] in part]
        sides = []
        for side in (0, 1):
            cells = {}
            for _, kind, w, there_at, here_at in rows:
                for j, x in enumerate(w):
                    for k in range(here_at[j], here_at[j + 1]):
                        place = (there_at[j], k - here_at[j]) if side else k  # a slot counts as many words as the item has in it
                        same, word = cells.get(place, (False, False))
                        cells[place] = (same or kind == 0, word or kind == 0 or x not in (chr(1), chr(2)))
            sides.append((len(cells), sum(s for s, _ in cells.values()), sum(w for _, w in cells.values())))
        covered, exact, words = (min(s[k] for s in sides) for k in range(3))
        there, back = {}, {}
        for _, kind, w, there_at, here_at in rows:
            for j, x in enumerate(w):
                if kind and x in (chr(1), chr(2)):
                    mine = [v.lower() for v in i[here_at[j] : here_at[j + 1]]]
                    theirs = [v.lower() for v in t[there_at[j] : there_at[j + 1]]]
                    for m, o in zip(mine, theirs, strict=True) if len(mine) == len(theirs) else [(" ".join(mine), " ".join(theirs))]:
                        there.setdefault((x, m), set()).add(o)
                        back.setdefault((x, o), set()).add(m)
        odd = any(len(v) > 1 for v in [*there.values(), *back.values()])
        if exact >= need or covered >= need and 2 * words >= need and not odd:
            return True
    return False


def test_against_brute_force_with_placeholders(spark):
    """Items with numbers and names; texts hold pieces of them with other values, consistent or not."""
    rng = random.Random(9)
    low = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    low = [w for w in low if w not in D.UNITS.split()]
    names, items = ["Anna", "Boris", "Clara", "David"], []
    for _ in range(10):
        ws = []
        for k in range(24):
            ws.append(rng.choice(low) if k % 3 else rng.choice([rng.choice(names), str(rng.randint(2, 9)), rng.choice(low), rng.choice(low)]) if k else rng.choice(low))
        items.append(" ".join(ws))
    texts = []
    for _ in range(70):
        ws = rng.choice(items).split()
        a, n = rng.randrange(9), rng.choice([9, 12, 13, 14, 15, 15])
        swap, how = {}, rng.random()
        piece = []
        for w in ws[a : a + n]:
            if w[0].isdigit() or w[0].isupper():
                pick = lambda w=w: str(rng.randint(10, 99)) if w[0].isdigit() else rng.choice(["Emma", "Frank", "Greta", "Hans"])
                w = w if how < 0.2 else swap.setdefault(w, pick()) if how < 0.8 else pick()
            piece.append(w)
        before = [rng.choice(low) for _ in range(12)]
        texts.append(" ".join([*before, *piece, *[rng.choice(low) for _ in range(12)]]))
    want = {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if _by_hand(t, i)}
    assert leaked(spark, texts, items) == want and 15 < len(want) < 60


def test_against_brute_force_with_runs_of_placeholders(spark):
    """Adjacent names and numbers; runs keep or change their length."""
    rng = random.Random(19)
    low = [w for w in {"".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)} if w not in D.UNITS.split()]
    low.sort()
    people, others, items, texts = ["Anna", "Boris", "Clara", "David"], ["Emma", "Frank", "Greta", "Hans"], [], []
    for _ in range(10):
        ws = [rng.choice(low)]
        while len(ws) < 26:
            run = [rng.choice(people) for _ in range(rng.randint(1, 3))] if rng.random() < 0.5 else [str(rng.randint(2, 9)) for _ in range(rng.randint(1, 3))]
            ws += [*run, *[rng.choice(low) for _ in range(3)]]
        items.append(" ".join(ws))
    for _ in range(90):
        ws = rng.choice(items).split()
        a, n = rng.randrange(6), rng.choice([12, 14, 15, 18, 20])
        swap, how, piece = {}, rng.random(), []
        for w in ws[a : a + n]:
            if w[0].isdigit() or w[0].isupper():
                pick = str(rng.randint(10, 99)) if w[0].isdigit() else rng.choice(others)
                w = w if how < 0.1 else swap.setdefault(w, pick) if how < 0.7 else pick
                piece += [w, w] if how > 0.9 and rng.random() < 0.1 else [w]
            else:
                piece.append(w)
        texts.append(" ".join([*[rng.choice(low) for _ in range(12)], *piece, *[rng.choice(low) for _ in range(12)]]))
    want = {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if _by_hand(t, i)}
    assert leaked(spark, texts, items) == want and 15 < len(want) < 80


def test_names_inside_runs_are_held_against_the_same_names_alone(spark):
    item = "Anna has 3 apples , Tom has 5 pears and Eve has 7 plums so how many fruits have Anna , Tom and Eve"
    swap = lambda a, b, c: item.replace("Anna", a).replace("Tom", b).replace("Eve", c)
    head, tail = swap("Maria", "Paul", "Lea").rsplit(" have ", 1)
    texts = [f"{head} have {tail}", f"{head} have Paul , Paul and Lea", f"{head} have Zoe , Zoe and Lea"]
    assert leaked(spark, [f"{FILL}. So {t} {FILL}" for t in texts], [item]) == {(0, 0)}


def test_numbers_in_words(spark):
    item = "a farmer who owns twelve sheep buys five more and walks 120 km in 2 hours to bring the whole flock home"
    texts = [
        item.replace("twelve", "thirty").replace("five", "nine"), item.replace("twelve", "Twenty-One").replace("five", "9"),
        item.replace("120 km in 2 hours", "ninety miles in three hours"), item.replace("twelve", "five").replace("2 hours", "five hours"), item.replace("twelve", "one hundred and six"),
    ]
    assert leaked(spark, [f"{FILL}. {t} {FILL}" for t in texts], [item]) == {(0, 0), (1, 0), (2, 0), (4, 0)}


def test_equal_hashes_of_other_words_are_no_match(spark, monkeypatch):
    """With one hash for all windows the words alone decide."""
    monkeypatch.setattr(D, "_window_hash", lambda i, size: F.lit(7).cast("long"))
    new = ITEM.replace("40 miles", "65 miles").replace("Anna", "Boris")
    assert leaked(spark, [ITEM, new, FILL, OTHER]) == {(0, 0), (1, 0), (3, 1)}


def test_a_window_that_all_documents_share(spark, monkeypatch):
    """The rows of a hot window meet the items in several tasks, none lost and none twice."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    texts = [f"{FILL} {i}. {ITEM}" for i in range(60)]
    assert leaked(spark, texts) == {(i, 0) for i in range(60)}
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id")).alias("key"), "id")
    table = spark.createDataFrame([(1, "a"), (1, "b"), (38, "c"), (None, "d")], "key long, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put small partitions into one task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = salted_join(rows, table, "key", ["id"])
    assert got.groupBy("v").count().orderBy("v").collect() == [("a", 2800), ("b", 2800), ("c", 1)]
    parts = got.filter("key = 1").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) > 1


def test_copies_dense_in_placeholders(spark):
    """Word for word copies are leaks however many of their tokens are placeholders; other values in them are none."""
    items = ["What is 12 * 7 + 3", "add 11 12 13 14 15 16 17 18 19 20 21 22 23", "the guests were Anna Boris Clara David Emma Frank Greta Hans Irene Jonas"]
    texts = [f"{FILL}. {i} {FILL}" for i in items]
    assert leaked(spark, [*texts, f"{FILL}. What is 12 * 8 + 4 {FILL}", f"{FILL} add 31 32 33 34 35 36 37 38 39 40 41 42 43"], items) == {(0, 0), (1, 1), (2, 2)}


def test_copies_in_other_contexts(spark):
    """A capitalised first word inside a sentence, other line breaks and another case; other first words are no copy."""
    items = ["What is the capital of the moon", "What is the capital of France", ITEM]
    wrapped = ITEM.replace(" meets ", " meets\n").replace(" on ", "  on ").replace("40 miles", "65 miles").replace("after", "after\u00a0")
    texts = [
        f"he asked {items[0]} and left", f"we said, {items[0]} then", f"in 1990 {items[0]}", f"he asked What is the capital of Spain", "so Madrid is the capital of Spain",
        wrapped, ITEM.replace("40 miles", "65 miles").upper(), f"{FILL}\n{items[0]}", "so\nWhat is\nthe capital  of the moon",
    ]
    assert leaked(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 2), (6, 2), (7, 0), (8, 0)}


def test_values_of_other_lengths_and_inserted_words(spark):
    """Values of another number of words and a word more are leaks; repeats in a document do not fill an item."""
    item = "each of the children gave Anna a total of 1000 coins for the trip to the sea"
    short = "then Anna paid 1000 coins for all of the tickets"
    plain = "every morning the old keeper climbs the long stairs and lights a lamp for ships passing in the night"
    beat = " ".join(["left right"] * 15)
    longer = [t.replace("Anna", "Mary Ann").replace("1000", "1 000") for t in (item, short)]
    inserted = plain.replace("stairs and", "stairs slowly and")
    texts = [*longer, inserted, " ".join(["left right"] * 5), beat, longer[0].replace("a total of", "in all some"), item]
    assert leaked(spark, [f"{FILL}. {t} {FILL}" for t in texts], [item, short, plain, beat]) == {(0, 0), (1, 1), (2, 2), (4, 3), (6, 0)}


def test_keep_clean_keeps_columns_and_rows(spark, clashing, nothing):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = D.keep_clean(clashing, bench)
    assert out.columns == clashing.columns
    gone = {r["doc_id"] for r in clashing.collect()} - {r["doc_id"] for r in out.collect()}
    assert gone == {8, 9}
    assert D.keep_clean(nothing, bench).count() == 0
    assert D.keep_clean(clashing, bench.limit(0)).count() == clashing.count()
