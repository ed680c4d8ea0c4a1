from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from topicloom.llm import html_text, warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/", "<p>same"), (2, "http://b/", "<p>same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "x" * 100_000 + "\r\n\r\n"), (None, "http://e/", "<p>same"), (7, "http://f/", "é✓"), (2, "http://b/", "<p>same")]


def want_records(rows, least=0):
    out = Counter()
    for page, _, h in rows:
        payload = (h or "").encode()
        twins = [p for p, _, x in rows if (x or "").encode() == payload and p is not None]
        last = max(twins, default=None)
        revisit = len(payload) >= least and last is not None and (page is None or page < last)
        out[(page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)] += 1
    return out


@pytest.mark.parametrize(("least", "broadcast"), [(0, 10), (0, 0), (5, 10)])
def test_warc_round_trip(spark, monkeypatch, tmp_path, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    pages = spark.createDataFrame([(*r, "more", "k") for r in ROWS], f"{SCHEMA}, digest string, _sha string").repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "warc"), least)
    got = warc.read_records(index).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want_records(ROWS, least)
    payload = {(p, u): (h or "").encode() for p, u, h in ROWS}
    assert all(bytes(r["payload"]) == payload[(r["page_id"], r["url"])] for r in got if r["record_type"] == "response")
    # selected records only; and the archive is plain concatenated gzip members
    some = warc.read_records(index.filter("page_id = 5")).collect()
    assert [r["page_id"] for r in some] == [5]
    files = list((tmp_path / "warc").iterdir())
    data, n = files[0].read_bytes(), 0
    while data:
        d = zlib.decompressobj(31)
        assert d.decompress(data).startswith(b"WARC/1.1\r\n")
        data, n = d.unused_data, n + 1
    assert n == index.filter(index.file.endswith(files[0].name)).count()


def test_coalesced_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "READ", 600)
    rows = [(i, f"http://x/{i}", f"page {i} " * 20) for i in range(60)]
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    assert Counter(tuple(r) for r in warc.read_records(index.filter("page_id % 3 = 0")).select("page_id", "payload_digest").collect()) == Counter((i, warc.payload_digest(h.encode())) for i, _, h in rows if i % 3 == 0)


def test_a_wrong_payload_is_found(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(ROWS[:1], SCHEMA), str(tmp_path / "w"))
    bad = index.withColumn("digest", index.url)
    with pytest.raises(Exception, match="payload of its digest"):
        warc.read_records(bad).collect()


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty).count() == 0 and html_text.extract(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this now</div>
<div id="cookie-notice"><p>We use cookies on this site, as all do.</p></div>{article}<aside class="sidebar"><p>Other stories that you may like to read.</p></aside>
<form><label>Mail</label><input name="q"><button>Go</button></form><section class="comments"><p>Great article, thank you so much for writing all of it!</p></section><footer>&copy; site</footer></body></html>"""
ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b>\n  and <a href=x>link</a>&nbsp;text.<p>Second&#33;<br>line<ul><li>one<li>two</ul><p>The last and longest paragraph of it, with words enough to count.</p>"
TEXT = "Title & more\nFirst bold and link text.\nSecond! line\none\ntwo\nThe last and longest paragraph of it, with words enough to count."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div><div id="content">{}</div></div>'])
def test_main_text(wrap):
    assert html_text.main_text(PAGE.replace("{article}", wrap.format(ARTICLE))) == TEXT


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt;", "plain <text>"), ("<div><div>", ""), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<!-- open", ""), ("</p></div>x", "x"), ("a < b and <c", "a < b and <c"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep")])
def test_defined_results(page, text):
    assert html_text.main_text(page) == text


def test_extract_table(spark):
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame([(*r, "x") for r in ROWS], f"{SCHEMA}, text string")).collect()}
    assert got[7]["text"] == "é✓" and got[7]["n_chars"] == 2 and got[3]["text"] == "" and got[5]["n_chars"] == 100_000


def test_noisy_names_need_noisy_text():
    """Wrappers and states that only mention a noisy part keep the article; parts that are noise go."""
    text = "<p>" + "The story of the day has many plain words in it and goes on. " * 8 + "</p>"
    want = " ".join(("The story of the day has many plain words in it and goes on. " * 8).split())
    nav = '<div class="sidebar"><a href="/a">one link</a> <a href="/b">two links</a></div>'
    notes = '<div id="comments"><article class="comment"><p>First!</p></article><div class="comment-body"><p>Second!</p></div></div>'
    for wrapper in ('<div class="page has-sidebar">', '<div class="no-sidebar">', '<div class="with-banner">', '<div class="sidebar-layout">', '<article class="post comments-closed">', '<div id="promo"><article>'):
        for body in ("<body>", '<body class="single comments-open">'):
            page = f"<html>{body}{wrapper}{text * 2}{'</article>' * ('<article' in wrapper)}{nav}{notes}</div></body></html>"
            assert html_text.main_text(page) == f"{want}\n{want}", (body, wrapper)
    assert html_text.main_text(f'<body><article><div class="entry-header"><h1>A title</h1></div>{text}</article>{notes}</body>') == f"A title\n{want}"
    assert html_text.main_text('<body><div class="ad">Buy two of these and get one more for nothing.</div><article><h1>A short title</h1></article></body>') == "A short title"


def _density_by_hand(node, body, link=False):
    """Characters, tags, the same of links, density and density sum of a node, by recursion over its own subtree."""
    own = sum(len("".join(x.split(" ")).replace("\n", "")) for x in node.items if isinstance(x, str))
    inner = [_density_by_hand(x, body, link or x.tag == "a") for x in node.items if not isinstance(x, str) and not x.drop]
    c, t = own + sum(i[0] for i in inner), len(inner) + sum(i[1] for i in inner)
    lc = (own if link else 0) + sum(i[2] for i in inner)
    lt = sum(i[3] + (link or x.tag == "a") for i, x in zip(inner, [x for x in node.items if not isinstance(x, str) and not x.drop], strict=True))

    def formula(c, t, lc, lt):
        if not c:
            return 0.0
        t, nlc, lt, one = t or 1, c - lc or 1, lt or 1, lc or 1
        return c / t * math.log(max(1.0, (c / one) * (t / lt)), math.log((c / nlc) * one + body * c + math.e))

    d = formula(c, t, lc, lt)
    return c, t, lc, lt, d, sum(i[4] for i in inner) + formula(own, 0, own if link else 0, 0)


def test_densities_against_the_formula():
    rng = random.Random(6)

    def tree(depth):
        tag = rng.choice(["div", "p", "a", "span", "section"])
        inner = "".join(rng.choice(["some words ", "x", ""]) + (tree(depth - 1) if depth and rng.random() < 0.7 else "") for _ in range(3))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        root = html_text.parse(tree(4))
        nodes = html_text._measure(root)
        body = root.link_chars / max(root.chars, 1)
        for n in nodes:
            inside_link = any(x.tag == "a" for x in html_text._path(n)[0:])
            want = _density_by_hand(n, body, inside_link)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == want[:4]
            assert n.density == pytest.approx(want[4]) and n.density_sum == pytest.approx(want[5])


def _paragraphs(n, seed=1):
    rng = random.Random(seed)
    return ["The story of day " + " ".join(rng.choice(["river", "stone", "walk", "evening", "bread"]) for _ in range(40)) + f" {seed} {i}." for i in range(n)]


def _p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


MENU = "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(12))


def test_density_decides_without_any_name():
    """Plain divs only: menus and link lists go because of their density, and the body as a whole would be wrong."""
    a = _paragraphs(6)
    page = f"<body><div><ul>{MENU}</ul></div><div>{_p(a)}</div><div><ul>{MENU}</ul></div></body>"
    assert html_text.main_text(page) == "\n".join(a)
    assert "\n".join(html_text.block_texts(html_text.parse(page))) != "\n".join(a)


def test_several_containers_are_one_article():
    a, b, c = _paragraphs(3, 1), _paragraphs(4, 2), _paragraphs(3, 3)
    assert html_text.main_text(f"<body><div><ul>{MENU}</ul></div><div>{_p(a)}</div><div>{_p(b)}</div></body>") == "\n".join(a + b)
    assert html_text.main_text(f"<body><div><ul>{MENU}</ul></div><section>{_p(a)}</section><section>{_p(b)}</section><section>{_p(c)}</section></body>") == "\n".join(a + b + c)
    assert html_text.main_text(f"<body><h1>Title of it</h1><div><ul>{MENU}</ul></div></body>").startswith("Title of it")
    assert html_text.main_text(f"<body><div><ul>{MENU}</ul></div><div><h1>Title of it</h1><div>{_p(a)}</div></div></body>") == "\n".join(["Title of it", *a])


def test_wrappers_with_names_keep_the_article():
    a = _paragraphs(5)
    for page in (
        f'<body><div class="wrapper no-sidebar"><article>{_p(a)}</article></div></body>', f'<body><div class="sidebar">{_p(a)}</div></body>', f"<body><form><div><ul>{MENU}</ul></div><div>{_p(a)}</div></form></body>", f"<body><form><article>{_p(a)}</article><footer>end</footer></form></body>",
        f'<body><div data-id="ad">{_p(a)}</div><div data-class="menu">{_p([])}</div></body>', f'<body><div class="promo">{_p(a)}</div><footer>&copy; here</footer></body>', f"<body><aside>{_p(a)}</aside><nav><ul>{MENU}</ul></nav></body>",
        f'<body><div id="content">{_p(a)}</div><div class="comments">{_p(_paragraphs(9, 5))}</div></body>', f'<body><article>{_p(a)}</article><aside>{_p(_paragraphs(20, 5))}</aside></body>',
    ):
        assert html_text.main_text(page) == "\n".join(a), page[:80]


def test_tags_of_articles_are_only_a_hint(spark):
    """The same texts where article and main are plain divs, on the tables' own pages."""
    pages = [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    same = sum(html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, plain, strict=True))
    assert same >= 0.99 * len(pages)


def test_names_that_only_mention_a_part_take_nothing_away():
    """The last word that is more than a shape says what a part is; inside an article density must agree, whatever the size."""
    a, b = _paragraphs(5), _paragraphs(4, 2)
    price = "The share price fell by two in the evening."
    page = f'<body><article>{_p(a)}<div class="share-price"><p>{price}</p></div><section id="comment-on-the-budget">{_p(b)}</section></article><div class="google-ads"><p>Buy two.</p></div></body>'
    assert html_text.main_text(page) == "\n".join([*a, price, *b])
    # a part with a noisy name: poor in text it goes, dense as the article it stays, however small or large
    box = '<div class="promo-box"><ul>' + "".join(f'<li><a href="/{i}">More of it {i}</a></li>' for i in range(3)) + "</ul></div>"
    assert html_text.main_text(f"<body><article>{_p(a)}{box}{_p(b)}</article></body>") == "\n".join(a + b)
    dense = f'<div class="promo-box">{_p([" ".join(b)])}</div>'
    assert html_text.main_text(f"<body><article>{_p(a)}{dense}</article></body>") == "\n".join([*a, " ".join(b)])
    assert html_text.main_text(f'<body><article>{_p(a)}<div class="post-comments">{_p(b)}</div></article></body>') == "\n".join(a)


def test_a_constant_density_changes_the_result(monkeypatch):
    """What is kept hangs on the formula: with the same density everywhere a poor part of the article is not told from its text."""
    a = _paragraphs(5)
    box = '<div class="promo-box"><ul>' + "".join(f'<li><a href="/{i}">More of it {i}</a></li>' for i in range(3)) + "</ul></div>"
    pages = [f"<body><article>{_p(a)}{box}</article></body>", f"<body><div><ul>{MENU}</ul></div><div>{_p(a)}</div><div><ul>{MENU}</ul></div></body>"]
    assert [html_text.main_text(p) for p in pages] == ["\n".join(a)] * 2
    monkeypatch.setattr(html_text, "density", lambda *_: 1.0)
    assert all(html_text.main_text(p) != "\n".join(a) for p in pages)


def test_repeated_and_clashing_rows(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
