import pytest
import time
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="page-with-sidebar">
<header><h1>Site</h1></header><nav class="x"><ul><li>Menu</li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p><b>First <i>para</i>graph<br>goes&nbsp;on<p>Second   one
here</p><aside>Related</aside><form><input><button>Send</button></form><ul><li>One<li>Two</ul><blockquote>Quote</blockquote>
<section class="comments"><p>First!</p><article class="comment"><p>Reader</p></article></section></article><div class="sidebar">S</div><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html_text.blocks_of(PAGE) == ["Title & more", "First paragraph goes on", "Second one here", "One", "Two", "Quote"]


def test_odd_pages():
    one = lambda p: html_text.blocks_of(p)
    assert one(None) == one("") == one("<p> </p>") == []
    assert one("plain &lt;b&gt; text") == ["plain <b> text"]
    assert one("<body><nav><li>never closed<article><p>Kept</p></article>") == ["Kept"]
    assert one("<main><p>In</p></main><p>Out</p>") == ["In"]
    assert one("<P CLASS='AD'>no<P>yes") == ["yes"]
    assert one('<div role="navigation">n</div><div hidden>h</div><div style="display: none">d</div><p>x</p>') == ["x"]
    assert one("<p>a < b and c > d</p>") == ["a < b and c > d"]
    assert one('<p title="a > b">q</p><p>cut off <b') == ["q", "cut off"]
    assert one("<p>&#233;&#x41;&eacute;&unknown;</p>") == ["éAé&unknown;"]
    assert one("<textarea><p>no</p></textarea><p>deep" + "<div>" * 5000 + "x") == ["deep", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<nav>", "</nav>", "<article>", "</article>", "<div class='ad'>", "</div>", "text ", "&amp;", "<", ">", '"', "<script>", "</script>", "<!--", "-->", "<br/>", "\n", "<a href='"]), max_size=40))
def test_any_markup(parts):
    for block in html_text.blocks_of("".join(parts)):
        assert block == " ".join(block.split()) and block


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_order(tokens):
    order, rank = html_text.suffix_order(np.array(tokens, np.uint64), 8)
    heads = [tuple(tokens[i : i + 8]) for i in range(len(tokens))]
    assert [heads[i] for i in order] == sorted(heads)
    assert all((rank[i] == rank[j]) == (heads[i] == heads[j]) for i in range(len(tokens)) for j in range(len(tokens)))


NOTICE = "subscribe to our weekly letter for more stories like this one"


def split(page):
    """The tokens of a page, by a plain regex."""
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"<?[^\x20\x09-\x0D<>]*>|<?[^\x20\x09-\x0D<>]+|<", page)]


def brute_heads(pages, share):
    distinct = {tuple(t for *_, t in split(p)) for p in pages} - {()}
    count = Counter(h for d in distinct for h in {d[i : i + 4] for i in range(len(d) - 3)})
    return len(distinct), {h: n for h, n in count.items() if n >= max(1, share * len(distinct))}


PIECES = ["<p>", "</p>", "a", "b ", " c", "\n", "é", "日本 ", "x>y", "<", ">", "<b x='1'>", " \u00a0", "&amp; "]
ANY_PAGES = st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=8)


def laid(pages):
    return html_text.flat(pa.array(pages, pa.string()))


@settings(max_examples=200, deadline=None)
@given(ANY_PAGES, st.sampled_from([0.3, 0.5, 1.0]))
def test_heads_and_removal_match_brute_force(pages, share):
    data, offs = laid(pages)
    starts, ends, row, _ = html_text.tokens_of(data, offs)
    raw = bytes(data)
    assert [(int(r), raw[a:b].decode()) for a, b, r in zip(starts, ends, row, strict=True)] == [(k, t) for k, p in enumerate(pages) for *_, t in split(p)]
    n, got = html_text.common_heads(pa.array(pages, pa.string()), share)
    want_n, want = brute_heads(pages, share)
    assert n == want_n and sorted(got.values()) == sorted(want.values())
    left = html_text.without(pages, data, offs, [np.array(list(got), np.int64).view(np.uint64)] * len(pages))
    for page, text in zip(pages, left, strict=True):
        own, chars = split(page), list(page)
        for i in range(len(own) - 3):
            if tuple(t for *_, t in own[i : i + 4]) in want:
                for a, b, _ in own[i : i + 4]:
                    chars[a:b] = " " * (b - a)
        assert (page if text is None else text) == "".join(chars)


def test_markup_stays_where_its_text_goes():
    assert html_text.blocks_of("<p>one two</p><nav>x</nav><p>three</p>", " " * 38) == []
    page = "<div class='ad'>old words</div><p>new words</p>"
    assert html_text.blocks_of(page, page.replace("<div class='ad'>", " " * 16)) == ["new words"]


def test_operator(spark):
    quote = "a passage that three of all these articles quote in full"
    page = lambda i: f"<article><h1>T{i}</h1><p>x{i} y{i} z{i}</p>" + (f"<p>{quote}</p>" if i % 20 == 1 else "") + f"<p>{NOTICE}</p></article>"
    rows = [(i, f"http://H{i % 2}.example/{i}", page(i), "host", "t") for i in range(120)]
    rows += [(120, None, "<p>q</p>", "h", "t"), (121, "http://h0.example/", None, "h", "t"), (None, "nonsense", "", None, None), (5, rows[5][1], rows[5][2], "h", "t")]
    rows += [(200 + i, "http://h1.example/copy", page(1), "h", "t") for i in range(200)]  # copies of an article don't remove it
    rows += [(500 + i, "http://few.example/", page(i), "h", "t") for i in range(9)]  # too few to tell
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, text string").withColumn("heads", F.lit(1)).withColumn("salt", F.lit(2))
    for settings_ in ({}, {"block": 16}, {"block_bytes": 2000}):
        got = html_text.extract(df, **settings_).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r for r in got}
        assert by[7].text == "T7\n\nx7 y7 z7" and by[7].n_chars == 12 and by[120].text == "q" and by[121].text == "" and by[None].n_chars == 0
        assert by[1].text == by[399].text == f"T1\n\nx1 y1 z1\n\n{quote}" and by[21].text.endswith(quote)
        assert by[503].text.endswith(NOTICE)
    assert html_text.extract(df.filter("false")).count() == 0


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for host in range(4):
        notice, menu = some(9), some(6)
        for i in range(9 if host == 3 else 24):
            own = f"<html><body><nav><ul><li>{menu}</li></ul></nav><article><h1>{some(4)}</h1><p>{some(20)} &amp; é</p>" + (f"<p>{notice}</p>" if i % 3 or host == 1 else "") + f"<p>{some(5)}\n {some(5)}</p></article><footer>{menu}</footer></body></html>"
            rows.append((100 * host + i, f"https://h{host}.example/{i}?x#y", own))
    rows += [(990, "https://h0.example/copy", rows[1][2]), (991, "https://h0.example/none", None), (992, None, rows[2][2])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want, removed = {}, 0
    for host in {(u or "").split("/")[2] if u else "" for _, u, _ in rows}:
        here = [(k, u, p) for k, u, p in rows if ((u or "").split("/")[2] if u else "") == host]
        n, heads = brute_heads([p for *_, p in here if p], 0)
        common = {h for h, c in heads.items() if c >= max(10, 0.5 * n)}
        for k, u, page in here:
            own, chars = split(page or ""), list(page or "")
            for i in range(len(own) - 3):
                if tuple(t for *_, t in own[i : i + 4]) in common:
                    for a, b, _ in own[i : i + 4]:
                        chars[a:b] = " " * (b - a)
            text = "\n\n".join(html_text.blocks_of(page, "".join(chars)))
            removed += text != "\n\n".join(html_text.blocks_of(page))
            want[k] = (u, text, len(text))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op2_html_extraction(spark, str(tmp_path)).collect()}
    assert got == want and removed > 40  # the notices that are in no element of their own go


@pytest.mark.parametrize("unit", ['<a "', '<a b="c" ', "< <a", "<a ", "</script ", "<script>x</script ", "<!-- ", """<a ">" '""", '</a x="', '<div class="'])
def test_malformed_pages_take_time_in_proportion(unit):
    """Work is counted by searches that look at the page, not by the clock."""
    seen = []
    for n in (2000, 8000):
        tags, looked, at = html_text.Tags(unit * n), 0, 0
        plain = tags.find

        def find(what, begin):
            nonlocal looked
            known = tags.known.get(what)
            end = plain(what, begin)
            if tags.known[what] != known:
                looked += (end if end >= 0 else len(tags.page)) - begin
            return end

        tags.find = find
        while (tag := tags.next(at)) is not None and tag[1] < len(tags.page):
            at = tag[1]
        seen.append(looked)
    assert seen[1] <= 5 * seen[0] + 1000


def test_long_attributes_take_time_in_proportion():
    began = time.monotonic()
    assert html_text.blocks_of("<p " + "a" * 3_000_000 + ">said</p>") == ["said"]
    assert time.monotonic() - began < 20


def test_elements_that_are_not_the_article():
    blocks = html_text.blocks_of
    text = "The main text, which is a good deal longer than what the teaser says."
    assert blocks(f"<aside><article>teaser</article></aside><p>{text}</p>") == [text]
    assert blocks(f"<article>teaser</article><p>{text} {text}</p>") == ["teaser", f"{text} {text}"]
    assert blocks(f"<aside>menu <article><p>{text}</p></article>") == [text]  # the aside was never closed
    for name in ("related-work", "share-price", "hidden-print", "commentary"):
        assert blocks(f'<div class="{name}"><p>{text}</p></div>') == [text], name
    for name in ("site-footer", "comment-list", "nav-bar", "cookie_banner", "box share-buttons", "ad"):
        assert blocks(f'<div class="{name}"><p>said</p></div><p>{text}</p>') == [text], name


def test_results_do_not_hang_on_blocks(spark):
    """Copies that differ in white space count once; a notice on half of the pages goes whatever the blocks are."""
    rng = random.Random(3)
    own = lambda i, n=30: " ".join(f"w{i}x{rng.randint(0, 9999)}" for _ in range(n))
    article = own("copy")
    notice = "please note that this offer of ours ends today and not later"
    rows = [(i, "http://copies/", "<p>" + article.replace(" ", " " * (1 + i % 7), 1 + i % 5) + "</p>") for i in range(150)] + [(i, "http://copies/", f"<p>{own(i)}</p>") for i in range(150, 160)]
    rows += [(i, "http://notices/", f"<p>{notice}</p><p>{own(i)}</p>" if i % 100 < 51 else f"<p>{own(i)}</p>") for i in range(200, 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {b: {r.page_id: r.text for r in html_text.extract(pages, block=b).collect()} for b in (8, 128, 1 << 30)}
    assert found[8] == found[128] == found[1 << 30]
    assert all(found[8][i].split() == article.split() for i in range(150))
    assert not [i for i in range(200, 300) if "offer" in found[8][i]] and all(found[8][i] for i in range(200, 300))


def test_heads_of_a_slice_are_hashed_once(monkeypatch):
    menu = "<ul> <li>Hémé</li> <li>About</li> <li>Contact us</li> </ul>"
    pages = [f"{menu if k % 3 else ''} <p>Page {k} says {'ä' if k % 2 else 'a'} word\u2003of its own</p> {menu.replace('é', 'e') if k % 4 else ''}" for k in range(24)] + [None, "", "<p>"]
    column = pa.array(pages, pa.string())
    _, counts = html_text.common_heads(column, 0.5)
    heads = np.array(list(counts), np.int64)
    alone = [html_text.without([p], *html_text.flat(pa.array([p], pa.string())), [heads])[0] for p in pages]
    real, calls = html_text.head_hashes, []
    monkeypatch.setattr(html_text, "head_hashes", lambda tokens: calls.append(len(tokens)) or real(tokens))
    assert html_text.without(pages, *html_text.flat(column), [heads] * len(pages)) == alone and len(calls) == 1
    assert all("Contact" not in x and f" {k} says" in x and len(x) == len(pages[k]) for k, x in enumerate(alone[:24]) if x is not None) and sum(x is not None for x in alone) > 12
