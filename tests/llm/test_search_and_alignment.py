"""Token alignment, lexical search and SimHash near-dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tests_llm_helpers import WORD
from topicloom.llm import lexical_search, simhash_dedup, token_alignment
from topicloom.llm.bpe import byte_alphabet
from topicloom.llm.near_dedup import components

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# ---- op11


def brute_alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), by the libraries and loops over tokens."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    back = byte_alphabet()
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs = []
    for i, t in rows:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        spell_a = [bytes(back[c] for c in tok.id_to_token(x)) for x in a]
        spell_b = [bytes_b(x) for x in b]
        if not t or not b"".join(spell_a) == b"".join(spell_b) == (" " + t).encode():
            docs.append((i, [], [], [], []))
            continue
        spans = []
        for ids, spelled in ((a, spell_a), (b, spell_b)):
            at, own = 0, []
            for x, s in zip(ids, spelled, strict=True):
                own.append((at, at + len(s), x))
                at += len(s)
            spans.append(own)
        links, j = [], 0
        for lo, hi, x in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((x, spans[1][k][2]))
                k += 1
        both = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, mine = [], ([], [])
        for end in sorted({e for s in spans for _, e, _ in s}):
            for side in (0, 1):
                mine[side].extend(x for _, e, x in spans[side] if e == end)
            if end in both:
                groups.append("|".join(",".join(map(str, m)) for m in mine))
                mine = ([], [])
        docs.append((i, a, b, links, groups))
    n = Counter(p for _, _, _, links, _ in docs for p in set(links))
    best = defaultdict(int)
    for (x, _), c in n.items():
        best[x] = max(best[x], c)
    return [(i, len(a), len(b), len(g), len(k), sum(n[p] == best[p[0]] for p in k), sum(n[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if k else "") for i, a, b, k, g in docs]


def test_alignment_against_brute_force(spark, rows, docs, clashing, nothing):
    few = [(r[0], r[1]) for r in rows]
    got = token_alignment.align(docs, A, B)
    assert _sorted(map(tuple, got.collect())) == _sorted(brute_alignment(few))
    assert _sorted(map(tuple, token_alignment.align(clashing, A, B).collect())) == _sorted(map(tuple, got.collect()))
    none = token_alignment.align(nothing, A, B)
    assert none.count() == 0 and none.columns == got.columns


@pytest.mark.parametrize("t", ["a  b", " x", "x ", "  ", "\n", "a \n b", "a\tb  c\n\n d", "▁", "a▁b", "<s> </s> <unk> <0x0A>", "<|endoftext|>", "don't  stop", "a b  c", "\x00x \x00", "漢字かな ✓ ü", "x" * 3000, "ab " * 2000, "  a", "’s ’ s"])
def test_alignment_of_odd_texts(t):
    aligner = token_alignment.load(A, B)
    counts, digests, _, keys, times = token_alignment.align_texts(aligner, [t, "plain words", t])
    want = brute_alignment([(0, t), (1, "plain words"), (2, t)])
    for i in range(3):
        assert (*counts[i].tolist(), digests[i]) == (*want[i][1:5], want[i][7])


def test_long_text_is_aligned_in_stretches(monkeypatch):
    rng = random.Random(4)
    t = " ".join(rng.choice(["the", "Größe,", "x\ny", "12345", "  ", "naïve"]) for _ in range(3000))
    aligner = token_alignment.load(A, B)
    whole = token_alignment.align_texts(aligner, [t, "a b"])
    monkeypatch.setattr(token_alignment, "STRETCH", 500)
    monkeypatch.setattr(token_alignment, "BATCH_BYTES", 2000)
    parts = token_alignment.align_texts(aligner, [t, "a b"])
    assert len(aligner.stretches(" " + t)) > 10
    assert np.array_equal(whole[0], parts[0]) and whole[1] == parts[1]
    assert dict(zip(whole[3].tolist(), whole[4].tolist(), strict=True)).keys() == dict(zip(parts[3].tolist(), parts[4].tolist(), strict=True)).keys()
    assert sorted(zip(*(x.tolist() for x in whole[2:]), strict=True)) == sorted(zip(*(x.tolist() for x in parts[2:]), strict=True))
    lost = token_alignment.align_texts(aligner, [t + " ▁", "a b"])  # one stretch is not spelled: the whole text has no tokens
    assert lost[0][0].tolist() == [0] * 4 and lost[1][0] == "" and lost[0][1].tolist() == whole[0][1].tolist()


def test_many_reports_and_tasks_of_a_stripe(spark, docs, monkeypatch):
    want = _sorted(map(tuple, token_alignment.align(docs, A, B).collect()))
    monkeypatch.setattr(token_alignment, "REPORTS", 2)
    monkeypatch.setattr(token_alignment, "LINK_BYTES", 200)
    assert _sorted(map(tuple, token_alignment.align(docs.repartition(7), A, B, stripes=3).collect())) == want


# ---- op12


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def _corpus(rng, n, vocabulary=60):
    words = [f"w{i}" for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(vocabulary)], k=rng.randint(1, 60)))) for i in range(n)]


def test_search_against_brute_force(spark, rows, docs, clashing, nothing):
    items = [(1, "One two THREE changed"), (2, rows[0][1]), (3, None), (4, "..."), (5, "nowhere"), (6, "漢字 ünïcödé x1"), (1, "One two THREE changed"), (None, "edit edit lone")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(docs, queries)
    assert _sorted(map(tuple, got.collect())) == _sorted(brute_search([(r[0], r[1]) for r in rows], items))
    assert _sorted(map(tuple, lexical_search.search(clashing, queries.withColumn("query", F.lit(1))).collect())) == _sorted(map(tuple, got.collect()))
    assert lexical_search.search(nothing, queries).count() == 0
    assert lexical_search.search(docs, queries.limit(0)).columns == got.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_search_of_random_corpora_in_small_blocks(spark, monkeypatch, seed):
    rng = random.Random(seed)
    docs = _corpus(rng, 400)
    docs += [(1000 + i, t) for i, t in docs[:40]]  # ties
    items = [(i, " ".join(rng.sample([f"w{j}" for j in range(60)], rng.randint(1, 12)))) for i in range(30)]
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 200)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert _sorted(map(tuple, got.collect())) == _sorted(brute_search(docs, items, 5))


def test_search_stops_early_and_completes_scores():
    """A rare term decides; the many postings of a common one are not read."""
    n = 4000
    ids, words = np.arange(n), np.full(n, 20)
    doc = np.concatenate([np.arange(n), np.arange(30)])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(30, np.int64)])
    order = np.lexsort((term, doc))
    tf = np.concatenate([np.ones(n, np.int64), np.arange(1, 31)])
    index = lexical_search.Index(ids, words, doc[order], term[order], tf[order], np.array([3, 9000]), n, int(words.sum()))
    read, postings = [], index.doc

    class Spy:
        def __getitem__(self, part):
            read.append(part)
            return postings[part]

    index.doc = Spy()
    some, score = index.search(np.array([0, 1]), 10, 0)
    best = lexical_search._first(ids[some], score, 10)
    m = 10 + 90 * 20 * n // (20 * n)
    full = [9000 * (10**9 * t // (1000 * t + 8 * m)) + 3 * (10**9 // (1000 + 8 * m)) for t in range(30, 20, -1)]
    assert score[best].tolist() == full and ids[some][best].tolist() == list(range(29, 19, -1))
    assert len(some) < 40 and all(part.start >= n for part in read)  # of the common term only the candidates' postings were looked up


# ---- op13


def brute_fingerprint(t):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_link_components(prints, radius=3):
    """The smallest vertex that each of the distinct prints reaches."""
    root = {p: p for p in prints}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    own = sorted(prints)
    for i, a in enumerate(own):
        for b in own[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def test_simhash_against_brute_force(spark, rows, docs, clashing, nothing):
    more = [(200 + i, rows[0][1] + f" w{i}", None, None, None) for i in range(30)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = simhash_dedup.near_components(table)
    prints = [(r[0], brute_fingerprint(r[1])) for r in [*rows, *more]]
    comp = brute_link_components({p for _, p in prints})
    top = {}
    for i, p in prints:
        top[comp[p]] = min(top.get(comp[p], simhash_dedup.NULL_ID), simhash_dedup.NULL_ID if i is None else i)
    want = [(i, f"{p:016x}", None if top[comp[p]] == simhash_dedup.NULL_ID else top[comp[p]]) for i, p in prints]
    assert _sorted(map(tuple, got.collect())) == _sorted(want)
    assert _sorted(map(tuple, simhash_dedup.near_components(clashing).collect())) == _sorted(map(tuple, simhash_dedup.near_components(docs).collect()))
    assert simhash_dedup.near_components(nothing).count() == 0


def test_fingerprint_in_stretches(monkeypatch):
    t = (" ".join(f"W{i % 97}x{i % 5}" for i in range(5000)) + "\n" + "y" * 400 + " end").encode()
    whole = simhash_dedup.fingerprint(t)
    monkeypatch.setattr(simhash_dedup, "STRETCH", 64)
    assert simhash_dedup.fingerprint(t) == whole == brute_fingerprint(t.decode())
    assert simhash_dedup.fingerprint(b"A b") == brute_fingerprint("a b") and simhash_dedup.fingerprint(b" \n") == 0


@pytest.mark.parametrize("limit", [16, 64, 4096])
def test_links_of_crowded_fingerprints(spark, limit):
    """A dense ball, a chain and strangers; small limits cut the buckets again and again."""
    rng = random.Random(limit)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(20, 34), rng.randint(1, 6))))
    chain = rng.getrandbits(64)
    for step in range(40):
        chain ^= 0b111 << step % 61
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(100)} | {0, 1 << 63, 2**64 - 1}
    rows = spark.createDataFrame([(simhash_dedup._signed(p),) for p in prints], "fp long")
    found = simhash_dedup.links(rows, 3, limit)
    told = [(a % 2**64, b % 2**64) for a, b in found.collect()]
    assert all(a != b and bin(a ^ b).count("1") <= 3 for a, b in told)
    groups = defaultdict(set)
    for v, top in components(found).collect():
        groups[top].add(v % 2**64)
    want = defaultdict(set)
    for p, top in brute_link_components(prints).items():
        want[top].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_forest_of_a_bucket_is_small():
    prints = np.array([x for x in range(2048)], np.uint64)
    a, b = simhash_dedup.forest(prints, 3)
    assert len(a) == 2047 and (np.bitwise_count(a ^ b) <= 3).all()


def test_limit_must_allow_an_end(spark):
    with pytest.raises(ValueError):
        simhash_dedup.links(spark.createDataFrame([(1,)], "fp long"), 3, 8)
