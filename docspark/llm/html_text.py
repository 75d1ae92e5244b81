"""Main text of web pages: a host suffix array against repeated boilerplate, then page structure.

The token streams of a host's whole pages, markup and text alike, are laid end to end and their suffixes sorted by
their first LONG tokens (prefix doubling). A run of suffixes with equal heads is a substring repeated across pages. It
is boilerplate when at least `share` of the host's distinct pages have it, and at least `least` pages; a longer repeat
is covered by its heads. Words that boilerplate covers go, before anything is known of the page's structure; the unique
runs stay. Pages with the same stream count as one, so copies of an article don't remove each other, and a passage
that only some articles quote stays.

What is left is parsed: what the markup says is not the article goes (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments), references are decoded, and text is cut into blocks. An article or
main element is the page where it holds a quarter of the text at least; one within a dropped element stays dropped.

A host is dealt into blocks of about `block` pages and block_bytes by a hash of its pages' token streams, so equal streams
share a block and count once; each block has a suffix array of its own, so no task holds a host. A head that a share of a
host's pages has is one that a share of some block's pages has, so blocks name the candidates, and those of hosts with
several blocks are then counted over all of the host's distinct pages: no result hangs on the size of a block. Pages are
only shuffled for the arrays, and only those of hosts with `least` pages; removal and parsing go page by page, beside
their host's boilerplate. Tags are found in one pass, in time that follows the page's length whatever is left unclosed.

Defined cases: null or empty html, and pages without text, give the empty text; urls without a host are those of one
host; rows that repeat a page are pages of their own with the same text; hosts below `least` distinct pages keep all;
pages of any length are handled whole; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import IS_SPACE, flat, give_back, mix, sent_whole, slices, span_hashes, stash, with_workers

LONG = 4
#: So many hosts, or heads of all hosts, are broadcast at most; beyond it pages are shuffled to their host's.
MOST_SENT = 2_000_000

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A whole tag as most are; it holds no other < or >, so a match never looks beyond the next tag.
PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\s++[a-zA-Z_:-]++="[^"<>]*+")*+\s*+/?)>""")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z0-9]+")

#: Elements whose content is never text, up to their own end tag whatever stands between.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are not the article.
DROP = frozenset("head nav footer aside form button select template svg canvas object dialog menu datalist audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class and id values, and values of role, that say the same.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar footer notice notices cookie cookies consent gdpr alert disclaimer comment comments commentlist discussion disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager masthead copyright widget widgets skip hidden".split()
)
#: Words that may stand beside a hint in a class of several words, joined by hyphens or underscores.
BESIDE = frozenset(
    "site main page post entry top bottom left right primary secondary global header footer box list item items bar slot unit wrap wrapper container block section area inner outer content link links button buttons form letter policy text title panel module group set row col column head body foot id 1 2 3 4 5".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
PAGE = frozenset("html body article main".split())
COMMENTS = frozenset("comment comments commentlist replies".split())


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROP or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            for one in value.split():
                words = set(WORD.findall(one))
                if words & COMMENTS or tag not in PAGE and (words & HINTS and words <= HINTS | BESIDE or "header" in words and not in_article):
                    return True
        elif tag not in PAGE and (name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return tag not in PAGE and re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) is not None


class Tags:
    """The tags of a page from front to back, in time that follows its length whatever is left unclosed: where a search
    has found nothing up to a place, the next one from before that place doesn't look again."""

    def __init__(self, page: str):
        self.page, self.known, self.failed = page, {}, set()

    def find(self, what: str | re.Pattern, at: int) -> int:
        """Where `what` is next, from `at` on; -1 if nowhere."""
        begin, end = self.known.get(what, (1, 0))
        if begin <= at and (at <= end or end < 0):
            return end
        if isinstance(what, str):
            end = self.page.find(what, at)
        else:
            m = what.search(self.page, at)
            end = m.start() if m else -1
        self.known[what] = at, end
        return end

    def _end(self, at: int) -> int:
        """Where the tag's own > is, outside quotes; -1 if it has none."""
        passed = []
        while at not in self.failed:
            passed.append(at)
            at = self.find(SPECIAL, at)
            if at < 0 or self.page[at] == ">":
                break
            at = self.find(self.page[at], at + 1) + 1
            if not at:
                break
        else:
            at = 0
        if at <= 0:
            self.failed.update(passed)
            return -1
        return at

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, closing, name, attributes) of the next tag; the name is empty for comments and declarations."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            m = PLAIN.match(page, at)
            if m:
                return at, m.end(), m[1], m[2], m[3]
            if self.find(">", at) < 0:  # nothing ends any more: a comment goes on to the end, or the page ends within a tag
                comment, last = page.find("<!--", at), page.rfind("<", at)
                at = comment if comment >= 0 else last
                return (at, len(page), "", "", "") if comment >= 0 or NAME.match(page, at) or page[at + 1 : at + 2] in ("!", "?", "/") else None
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", "", ""
            m = NAME.match(page, at)
            if m:
                end = self._end(m.end())
                if end < 0:
                    end = self.find(">", m.end())
                if end >= 0:
                    return at, end + 1, m[1], m[2], page[m.end() : end]
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                end = self.find(">", at + 1)
                if end >= 0:
                    return at, end + 1, "", "", ""
            if page[at + 1 : at + 2] and (m or page[at + 1] in "!?/") and self.find("<", at + 1) < 0:
                return at, len(page), "", "", ""  # the page ends within a tag
            at += 1
        return None

    def after_raw(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; the page's end without one."""
        begin = self.find(_closing(tag), at)
        end = self.find(">", begin) if begin >= 0 else -1
        return end + 1 if end >= 0 else len(self.page)

    def closes(self, tag: str, at: int) -> bool:
        return self.find(_closing(tag), at) >= 0


@lru_cache(256)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s>])", re.I)


def blocks_of(page: str | None, text: str | None = None) -> list[str]:
    """The text blocks of a page's main part, in order; text: the page with what shall not be read blanked out."""
    if not page:
        return []
    text = page if text is None else text
    found: dict[str, list[str]] = {"article": [], "main": [], "body": []}
    inside = {"article": 0, "main": 0}
    parts: list[str] = []
    skip, depth, at, tags = "", 0, 0, Tags(page)

    def flush() -> None:
        block = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if block:
            for k in ("article", "main"):
                if inside[k]:
                    found[k].append(block)
            found["body"].append(block)

    while True:
        found_tag = tags.next(at)
        if not skip:
            parts.append(text[at : found_tag[0] if found_tag else len(page)])
        if not found_tag:
            break
        _, at, closing, tag, attributes = found_tag
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                at = tags.after_raw(tag, at)
            continue
        if skip:
            if closing:
                depth -= tag == skip
            elif tag in ("article", "main") and skip not in ("article", "main") and not (skip in DROP and tags.closes(skip, at)) or tag == "body" or skip == "p" and tag in BLOCK:
                depth = 0  # the dropped element was never closed
            elif tag == skip and tag not in VOID and not attributes.endswith("/"):
                depth += 1
            if depth > 0:
                continue
            skip = ""
            if closing:
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if tag in inside:
                inside[tag] = max(0, inside[tag] - 1)
        elif tag not in VOID and not attributes.endswith("/"):
            if _dropped(tag, attributes, inside["article"] > 0):
                flush() if tag in BLOCK else parts.append(" ")
                skip, depth = tag, 1
            elif tag in inside:
                inside[tag] += 1
    flush()
    for k in ("article", "main"):  # a short one among much else is a teaser
        if 4 * sum(map(len, found[k])) >= sum(map(len, found["body"])):
            return found[k] or found["body"]
    return found["body"]


# ------------------------------------------------------------ the host's suffix array


def suffix_order(tokens: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `long` tokens (a power of two), and the rank of each; equal heads have equal ranks."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, have = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable") if long == 1 else rank
    while have < long:
        second = np.append(rank[have:], np.full(min(have, len(rank)), -1)) + 1
        key = rank * (int(rank.max(initial=0)) + 2) + second
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]))
        have *= 2
    return order, rank


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each token of html: runs without white space, cut before < and after >."""
    inside = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    cut[:-1] |= data == 60
    cut[1:] |= data == 62
    starts = np.flatnonzero(inside & (cut[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (cut[1:] | np.append(~inside[1:], True))) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, span_hashes(data, starts, ends)


def head_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the LONG tokens from each place on; the last places have none."""
    out = np.zeros(max(0, len(tokens) - LONG + 1), np.uint64)
    for j in range(LONG):
        out = mix((out ^ tokens[j : len(out) + j]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def stream_of(page: bytes) -> bytes:
    """A digest of a page's tokens, without cutting them: one space stands for white space between two, none where < or >
    cuts anyway; empty for a page without any."""
    plain = b" ".join(page.split()).replace(b" <", b"<").replace(b"> ", b">")
    return hashlib.blake2b(plain, digest_size=8).digest() if plain else b""


def common_heads(pages: pa.Array, share: float) -> tuple[int, dict[int, int]]:
    """How many distinct pages there are, and of each head that at least `share` of them have, how many have it."""
    data, offs = flat(pages)
    _, _, page, tokens = tokens_of(data, offs)
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(stream_of(data[a:b].tobytes()), len(seen)) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64)
    n = len(seen) - (b"" in seen)
    # A mark of its own ends each page, so that no head goes over it.
    ends_at = np.flatnonzero(np.append(page[1:] != page[:-1], True))[: len(page)]
    stream = np.insert(tokens, ends_at + 1, np.arange(len(ends_at), dtype=np.uint64))
    owner = np.insert(kind[page], ends_at + 1, -1)
    order, rank = suffix_order(stream, LONG)
    within = np.zeros(len(stream), bool)
    within[_without_marks(owner)] = True
    whole = order[within[order]]
    # A rank and a page as one number: neither is as large as the stream, or the pages, are long.
    pairs = np.sort(rank[whole] * max(1, len(seen)) + owner[whole])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    ranks, pages_with = np.unique(pairs // max(1, len(seen)), return_counts=True)
    often = pages_with >= max(1.0, share * n)
    place = np.zeros(len(stream), np.int64)
    place[rank[whole]] = whole
    heads = head_hashes(stream)[place[ranks[often]]] if often.any() else np.zeros(0, np.uint64)
    return n, dict(zip(heads.view(np.int64).tolist(), pages_with[often].tolist(), strict=True))


def _without_marks(owner: np.ndarray) -> np.ndarray:
    """Where LONG tokens of one page begin."""
    marks = np.cumsum(np.append(0, owner < 0))
    at = np.arange(max(0, len(owner) - LONG + 1))
    return at[marks[at + LONG] == marks[at]]


def without(pages: list[str | None], data: np.ndarray, offs: np.ndarray, heads: list[np.ndarray | None]) -> list[str | None]:
    """Each page with the tokens that heads cover blanked out, of the same length; None where there are none."""
    starts, ends, row, hashes = tokens_of(data, offs)
    found = head_hashes(hashes).view(np.int64)
    first = np.searchsorted(row, np.arange(len(pages) + 1))
    out: list[str | None] = [None] * len(pages)
    for k, known in enumerate(heads):
        a, b = first[k], first[k + 1]
        if known is None or not len(known) or b - a < LONG:
            continue
        known, own = np.sort(known.view(np.int64)), found[a : b - LONG + 1]
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
        if not len(hit):
            continue
        covered = np.zeros(b - a + 1, np.int64)
        covered[hit] += 1
        covered[hit + LONG] -= 1
        gone = np.flatnonzero(np.cumsum(covered[:-1]) > 0) + a
        raw, base = data[offs[k] : offs[k + 1]], offs[k]
        blank = np.zeros(len(raw) + 1, np.int8)
        blank[starts[gone] - base] += 1  # no two tokens begin, or end, at one place
        blank[ends[gone] - base] -= 1
        blanked = np.cumsum(blank[:-1], dtype=np.int8) > 0
        if len(pages[k]) == len(raw):  # each character is a byte
            chars = raw.copy()
            chars[blanked] = 32
            out[k] = chars.tobytes().decode("ascii")
            continue
        lead = (raw & 0xC0) != 0x80  # a character's first byte
        chars = np.frombuffer(pages[k].encode("utf-32-le"), np.uint32).copy()
        chars[blanked[lead]] = 32
        out[k] = chars.tobytes().decode("utf-32-le")
    return out


def _once(host: pa.Array, html: pa.Array, seen: set) -> tuple[pa.Array, np.ndarray]:
    """(rows, streams) of the pages whose host and stream are not in seen, which gets them."""
    data, offs = flat(html)
    rows, streams = [], []
    for k, (name, a, b) in enumerate(zip(host.to_pylist(), offs[:-1], offs[1:], strict=True)):
        stream = stream_of(data[a:b].tobytes())
        if stream and (name, stream) not in seen:
            seen.add((name, stream))
            rows.append(k)
            streams.append(int.from_bytes(stream, "little", signed=True))
    return pa.array(rows, pa.int64()), np.array(streams, np.int64)


def hosts_of(own: DataFrame, share: float, least: int, block: int, block_bytes: int) -> DataFrame:
    """(host, heads): the boilerplate of each host that has any."""

    def deal(batches):
        seen: set = set()  # of a task's pages, 8 bytes each; copies of a page leave it once
        for batch in batches:
            rows, streams = _once(batch.column(0), batch.column(1), seen)
            own = batch.take(rows)
            yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(streams % own.column(2).to_numpy())], names=["host", "html", "salt"])
        give_back()

    def report(table: pa.Table) -> pa.Table:
        n, counts = common_heads(table.column("html").combine_chunks(), share)
        rows = [(None, n), *counts.items()]
        host = table.column("host")[0].as_py()
        return pa.table({"host": pa.array([host] * len(rows), pa.string()), "head": pa.array([h for h, _ in rows], pa.int64()), "pages": pa.array([c for _, c in rows], pa.int64())})

    def counted(batches):
        seen: set = set()
        for batch in batches:
            rows, streams = _once(batch.column(0), batch.column(1), seen)
            own, found = batch.take(rows), []
            begin, values = own.column(2).offsets.to_numpy(), own.column(2).values.to_numpy()
            for at, data, offs in slices(own.column(1)):
                _, _, page, tokens = tokens_of(data, offs)
                all_heads = head_hashes(tokens).view(np.int64)
                first = np.searchsorted(page, np.arange(len(offs)))
                for k in range(len(offs) - 1):
                    wanted = values[begin[at + k] : begin[at + k + 1]]
                    heads = all_heads[first[k] : max(first[k], first[k + 1] - LONG + 1)]
                    near = np.minimum(np.searchsorted(wanted, heads), len(wanted) - 1)
                    found.append(wanted[np.unique(near[wanted[near] == heads])])
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(streams), pa.array(found, pa.list_(pa.int64()))], names=["host", "stream", "heads"])
        give_back()

    sizes = own.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")).filter(F.col("pages") >= least)
    blocks = F.greatest(F.ceil(F.col("pages") / block), F.ceil(F.col("bytes") / block_bytes), F.lit(1)).cast("bigint")
    sizes = stash(sizes.select("host", blocks.alias("blocks")), "hosts")
    many = own.join(sent_whole(sizes, MOST_SENT), "host")
    dealt = many.select("host", "html", "blocks").mapInArrow(deal, "host string, html string, salt bigint").repartition("host", "salt")  # by both, so that no host is one task
    sums = stash(dealt.groupBy("host", "salt").applyInArrow(report, "host string, head bigint, pages bigint").groupBy("host", "head").agg(F.sum("pages").alias("pages")), "heads")
    whole = sums.filter("head is null").select("host", F.col("pages").alias("n")).filter(F.col("n") >= least)
    # What a share of a host's pages has, a share of some block's pages has: no other head can be common. In a host of
    # one block that count is the host's; for others the heads that remain are counted over all pages.
    several = sizes.filter("blocks > 1").select("host")
    named = sums.filter("head is not null")
    open_ = stash(named.join(several, "host", "left_semi").groupBy("host").agg(F.sort_array(F.collect_set("head")).alias("heads")), "candidates")
    asked = own.join(sent_whole(open_, MOST_SENT, "sum(size(heads) + 8)"), "host").select("host", "html", "heads")
    each = asked.mapInArrow(counted, "host string, stream bigint, heads array<bigint>").groupBy("host", "stream").agg(F.first("heads").alias("heads"))
    over = each.select("host", F.explode("heads").alias("head")).groupBy("host", "head").agg(F.count("*").alias("pages"))
    counts = named.join(several, "host", "left_anti").select("host", "head", "pages").unionByName(over)
    common = counts.join(whole, "host").filter((F.col("pages") >= least) & (F.col("pages") >= share * F.col("n")))
    return stash(common.groupBy("host").agg(F.sort_array(F.collect_set("head")).alias("heads")), "boilerplate")


#: Characters that only one of Python's and this module's notions of white space takes.
ODD = {c: " " for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85)}


def extract(pages: DataFrame, share: float = 0.5, least: int = 10, block: int = 128, block_bytes: int = 4 << 20) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of pages (page_id, url, html)."""

    def parse(batches):
        for batch in batches:
            begin, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            heads = [values[a:b] if b > a else None for a, b in zip(begin[:-1], begin[1:], strict=True)]
            column, texts = batch.column(3), []
            for at, data, offs in slices(column):
                own = column.slice(at, len(offs) - 1).to_pylist()
                known = heads[at : at + len(own)]
                left = without(own, data, offs, known) if any(x is not None for x in known) else [None] * len(own)
                texts += ["\n\n".join(blocks_of(page, text)).translate(ODD) for page, text in zip(own, left, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])
        give_back()

    with_workers(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    known = own.join(sent_whole(hosts_of(own, share, least, block, block_bytes), MOST_SENT, "sum(size(heads) + 8)"), "host", "left")
    out = known.select("page_id", "url", "heads", "html").mapInArrow(parse, "page_id bigint, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
