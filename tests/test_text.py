from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions import tagger
from topicloom.functions.lemma import lemmas, lemmatizer
from topicloom.functions.tagger import sentences, tag
from topicloom.operators import bow as B
from topicloom.operators import vocabulary as V
from topicloom.operators.ranking import row_numbers, word_ids
from topicloom.sources import files


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0]


def test_cleaning_glues_what_it_drops_and_line_breaks_part(spark):
    assert one(spark, T.cleaned_words, "Path-planning\nis  café 42!") == ["pathplanning", "is", "caf"]
    assert one(spark, T.cleaned_words, "") == []
    assert one(spark, T.join_lines, "a\r\nb\rc\n") == "a b c"


def test_treebank(spark):
    assert one(spark, T.treebank_words, "They cannot go, don't (ask).") == ["they", "can", "not", "go", ",", "do", "n't", "-lrb-", "ask", "-rrb-", "."]


# Tokens checked by hand against the Treebank's conventions.
PENN = [
    ("They can't go, won't they?", "they ca n't go , wo n't they ?"),
    ('"Hello," said Mr. O\'Brien.', "`` hello , '' said mr. o'brien ."),
    ("It costs $3.50 (about 10%).", "it costs $ 3.50 -lrb- about 10 % -rrb- ."),
    ("The U.S. economy isn't John's.", "the u.s. economy is n't john 's ."),
    ("I cannot; we're gonna wait...", "i can not ; we 're gon na wait ..."),
    ("Dr. Smith's at 10:30 a.m. today", "dr. smith 's at 10:30 a.m. today"),
    ("He left. The end. It was I. Then A. Jones came.", "he left . the end . it was i . then a. jones came ."),
    ("the dogs' bowls -- state-of-the-art, and/or 1,000-page", "the dogs ' bowls -- state-of-the-art , and/or 1,000-page"),
    ("see http://a.b/c?d=1, or x.y@z.org.", "see http://a.b/c?d=1 , or x.y@z.org ."),
    ("the 21st of [May] {x}", "the 21st of -lsb- may -rsb- -lcb- x -rcb-"),
    ('he ("she") said: "no"', "he -lrb- `` she '' -rrb- said : `` no ''"),
    ("Größe 漢字 naïve’s DON’T", "größe 漢字 naïve ’s do n’t"),
    ("cannots wannabe mannot", "cannots wannabe mannot"),
    ("", ""),
    ("  \n ", ""),
]


def test_penn_words(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PENN)] + [(99, None)], "i int, t string").select("i", T.penn_words(F.col("t")).alias("w"), T.penn_pieces(F.col("t")).alias("p"), "t").collect()
    got = {r["i"]: r for r in rows}
    for i, (text, want) in enumerate(PENN):
        assert got[i]["w"] == want.split(), text
        assert "".join(got[i]["p"]) == "".join(text.split())  # nothing but white space is lost
    assert got[99]["w"] == []


def test_lemmas():
    # The expected lemmas of two short texts.
    assert lemmas("Today I went to the store. I also ran to the cinema.") == "today I go to the store . I also run to the cinema .".split()
    assert lemmas(None) == []


@pytest.mark.parametrize(
    "text, want",
    [  # Checked by hand: the same form under the tag that its neighbours give it.
        ("She saw the old saw.", "she see the old saw ."),
        ("He cut the wood with a saw.", "he cut the wood with a saw ."),
        ("The leaves fall.", "the leaf fall ."),
        ("He leaves the house at five.", "he leave the house at five ."),
        ("I left the left glove.", "I leave the left glove ."),
        ("Anna saw leaves on the trees. He leaves.", "Anna see leaf on the tree . he leave ."),
        ("The wolves were hiding behind the shelves.", "the wolf be hide behind the shelf ."),
        ("The men were running quickly, and the children stopped.", "the man be run quickly , and the child stop ."),
        ("She wants to lead the teams.", "she want to lead the team ."),
    ],
)
def test_lemmas_hang_on_context(text, want):
    assert lemmas(text) == want.split()


def test_sentences():
    parts = sentences('Mr. Smith met Dr. A. Jones... Really?! "Why?" he asked. It cost 3.50 (net.) I')
    assert [" ".join(p) for p in parts] == ["Mr . Smith met Dr . A . Jones ...", "Really ? !", '" Why ? "', "he asked .", "It cost 3.50 ( net . )", "I"]
    assert sentences("") == [] and sentences(" .") == [["."]]


def test_viterbi_against_all_paths():
    """The tags of short sentences are those of the best of all paths; a batch of unequal lengths gives the same as one by one."""
    few = ["She saw leaves", "The left saw", "leaves", "He leaves the"]
    parts = [t.split() for t in few]
    got = tag(parts)
    assert got == [tag([p])[0] for p in parts]
    for words, tags in zip(parts, got, strict=True):
        weights = [tagger._known(w, i == 0) for i, w in enumerate(words)]
        best = max(itertools.product(range(len(tagger.TAGS)), repeat=len(words)), key=lambda path: tagger._START[path[0]] + sum(w[t] for w, t in zip(weights, path, strict=True)) + sum(tagger._NEXT[a, b] for a, b in zip(path, path[1:], strict=False)))
        assert tags == [tagger.TAGS[t] for t in best]


def test_lemmas_of_long_and_odd_texts(spark):
    long = "He leaves " * 3000
    assert lemmas(long)[:4] == ["he", "leave", "he", "leave"] and len(lemmas(long)) == 6000
    assert lemmas("\n\t ") == [] and lemmas("ÄÖ 漢字 3,000 x") == [*"ÄÖ漢字", "3,000", "x"]
    assert [r[0] for r in spark.createDataFrame([("He left.",), (None,), ("",)], "t string").select(lemmatizer()(F.col("t"))).collect()] == [["he", "leave", "."], [], []]


def test_bag_of_words_with_lemmatiser(spark):
    docs = spark.createDataFrame([(1, "I went to the store.  Then I went to the movies.")], "doc_id long, text string")
    words = ["i", "go", "to", "the", "store", "then", "movie"]
    vocab = spark.createDataFrame(list(enumerate(words)), "word_id int, word string")
    lower = lambda c: F.transform(lemmatizer()(c), lambda w: F.lower(w))
    got = {r["word_id"]: r["n"] for r in B.bag_of_words(docs, vocab, lower).collect()}
    assert got == {0: 2, 5: 1, 1: 2, 6: 1, 2: 2, 3: 2, 4: 1}


def test_vocabulary_is_deterministic_and_filters(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha alpha beta zz", "alpha beta The the the", None, ""])], "doc_id long, text string")
    got = [tuple(r) for r in V.build_vocabulary(docs, 2, 2).orderBy("word_id").collect()]
    assert got == [(0, "alpha", 3, 2), (1, "beta", 2, 2)]


def test_empty_bags_stay(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "nothing"), (3, None)], "doc_id long, text string")
    vocab = spark.createDataFrame([(0, "alpha")], "word_id int, word string")
    bags = {r["doc_id"]: (r["word_ids"], r["counts"]) for r in B.packed_bags(docs, B.bag_of_words(docs, vocab)).collect()}
    assert bags == {1: ([0], [1]), 2: ([], []), 3: ([], [])}


def test_shuffled_and_broadcast_vocabulary_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta alpha")], "doc_id long, text string")
    vocab = spark.createDataFrame([(0, "alpha"), (1, "beta")], "word_id int, word string")
    want = sorted(map(tuple, B.bag_of_words(docs, vocab).collect()))
    monkeypatch.setattr(V, "BROADCAST_WORDS", 0)
    assert sorted(map(tuple, B.bag_of_words(docs, vocab).collect())) == want


@pytest.mark.parametrize("ids", [[], [5], [3, 3, 3, 9, 1], list(range(500, 0, -7)), [None, 2, 1]])
def test_row_numbers(spark, ids):
    got = [(r["k"], r["n"]) for r in row_numbers(spark.createDataFrame([(i,) for i in ids], "k long"), "k", "n").orderBy("n").collect()]
    order = sorted(ids, key=lambda x: (x is not None, x or 0))
    assert got == [(k, i + 1) for i, k in enumerate(order)]


def test_word_ids(spark):
    rows = [("b", 2), ("a", 2), ("ccc", 9), ("ab", 2)]
    got = word_ids(spark.createDataFrame(rows, "word string, word_count long")).orderBy("word_id").collect()
    assert [r["word"] for r in got] == ["ccc", "a", "ab", "b"]


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines\n")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / ".hidden").write_text("no")
    got = [(r["doc_id"], r["text"], r["batch_id"]) for r in files.read_corpus(spark, str(tmp_path), 1).orderBy("doc_id").collect()]
    assert got == [(0, "one", 0), (1, "two lines", 1)]
    assert files.read_lines(spark, str(tmp_path)).count() == 3
    stop = tmp_path / "stop.txt"
    stop.write_bytes("-LRB-\r\nThe\r\n\r\n".encode())
    assert files.read_word_list(spark, str(stop)) == ["-lrb-", "the"]
    (tmp_path / "v.txt").write_text("x\ny\nx\n")
    assert files.read_vocabulary(spark, str(tmp_path / "v.txt")) == ["x", "y"]
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "l.txt").write_bytes("café\nnoir".encode("latin-1"))
    assert files.read_texts(spark, str(tmp_path / "latin"), "ISO-8859-1").first()["text"] == "café noir"
