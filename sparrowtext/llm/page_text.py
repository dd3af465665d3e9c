"""Main text of web pages: each page is differenced against its nearest pages by URL.

A page's html is cut into lines of text: paragraphs, headings, list items, cells, and the texts of
menus and footers alike (scripts, styles and other text that no reader sees are none). Pages of a
host with equal lines are one class. Classes stand in the order of their paths within the host; each
is paired with the four nearest in this order, and each pair's lines are aligned by longest common
subsequence. A line that at least two of these pages share with the class (or the only one, where a
host has but two classes) is template and deleted: a quotation is shared with one.

In a marked article (<article>, <main>) shared lines may be content, so there every one of at least three
pages must share a line. A page whose article shares more than half its characters is a near copy and is not counted
among them, and deletion goes from the article's first and last line inwards, to the first line that is
kept (templates put their lines around an article's text, quotations stand within it).

What differencing can't see, as it changes from page to page or is alone in its host, goes by
structure: menus, headers, footers, sidebars, notices, adverts, forms and reader comments, by
element, role, or words of a class or id (within an article only if all words of one class name say so). If
the page marks its article, only lines there can be main text.

Line hashes of one page a class are ranked by (host, path) over all hosts and dealt in blocks of ranks, each with the four classes
before and after it, so a host that holds a third of all pages spreads over many tasks, pairs are
the same for any partitioning, and nothing but partition sizes reaches the driver.

Edge cases: null html gives an empty text; a URL without host (null among them) is paired with
none; pages with equal lines share one verdict; a class alone in its host loses nothing by
differencing; rows with equal id, URL or html are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, ship

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|math)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BOILER = frozenset("nav header footer aside form button select menu dialog head".split())
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose nesting decides; others may stay open, as <p> and <b> often do.
NESTED = BOILER | ARTICLE | frozenset("div section ul ol dl table figure blockquote fieldset body html details".split())
#: Names of what changes from page to page, so that differencing can't see it.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer "
    "cookie cookies consent notice notices gdpr popup modal overlay comment comments reply replies disqus share sharing social subscribe newsletter signup related recommended widget".split()
)
#: What may stand beside one of WORDS in a class name within an article.
PLAIN = frozenset("area articles bar block box buttons container content form group inner items links list outer panel posts reader section site slot stories top user wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Classes that a class is paired with, of which those of an article must be so many, and classes in a block.
NEAR, ALL, BLOCK = 4, 3, 256


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILER and not (tag == "header" and in_article):
        return True
    for m in ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return True
        elif tag in ARTICLE or tag in ("body", "html"):
            continue
        elif not in_article:
            if any(w in WORDS or w == "header" for w in re.split(r"[^a-z]+", value)):
                return True
        elif tag not in INLINE:
            for name in value.split():
                words = set(filter(None, re.split(r"[^a-z]+", name)))
                if words & WORDS and words <= WORDS | PLAIN:
                    return True
    return False


def blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, unwanted by structure, within a marked article) of a page's lines, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open nesting elements; is it unwanted?
    opened: dict[str, int] = {}
    unwanted = article = 0
    buf: list[str] = []
    at, html = 0, html or ""

    def flush() -> None:
        text = " ".join(unescape("".join(buf)).split()) if buf else ""
        if text:
            out.append((text, unwanted > 0, article > 0))
        buf.clear()

    for m in TOKEN.finditer(html):
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            buf.append(" ")
        elif tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if m[2]:
            if tag in NESTED and opened.get(tag):
                while True:
                    t, bad = stack.pop()
                    opened[t] -= 1
                    unwanted -= bad
                    article -= t in ARTICLE
                    if t == tag:
                        break
        elif tag in NESTED:
            bad = _unwanted(tag, m[4] or "", article > 0)
            stack.append((tag, bad))
            opened[tag] = opened.get(tag, 0) + 1
            unwanted += bad
            article += tag in ARTICLE
    buf.append(html[at:])
    flush()
    return out


def candidates(lines: list[tuple[str, bool, bool]]) -> list[int]:
    """Places of the lines that may be main text."""
    marked = any(a and not bad for _, bad, a in lines)
    return [i for i, (_, bad, a) in enumerate(lines) if not bad and (a or not marked)]


def common_lines(a: list[int], b: list[int], most: int = 4_000_000) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence (Hunt and Szymanski; where more than `most`
    pairs of places are equal, a is halved as Hirschberg does, and b where the sum of both lengths is largest)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    mid: list[tuple[int, int]] = []
    if sum(len(where.get(x, ())) for x in a[head : len(a) - tail]) <= most or len(a) - tail - head < 2:
        ends: list[int] = []
        chains: list[tuple | None] = []
        for i in range(head, len(a) - tail):
            for j in where.get(a[i], ()):
                k = bisect_left(ends, j)
                node = (i, j, chains[k - 1] if k else None)
                if k == len(ends):
                    ends.append(j)
                    chains.append(node)
                else:
                    ends[k], chains[k] = j, node
        node = chains[-1] if chains else None
        while node:
            mid.append(node[:2])
            node = node[2]
        mid.reverse()
    else:
        inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
        half = len(inner_a) // 2
        both = [x + y for x, y in zip(_lengths(inner_a[:half], inner_b), reversed(_lengths(inner_a[:half - 1 : -1], inner_b[::-1])))]
        k = both.index(max(both))
        mid = [(i + head, j + head) for i, j in common_lines(inner_a[:half], inner_b[:k], most)]
        mid += [(i + head + half, j + head + k) for i, j in common_lines(inner_a[half:], inner_b[k:], most)]
    return [*((i, i) for i in range(head)), *mid, *((len(a) - k, len(b) - k) for k in range(tail, 0, -1))]


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of a and each prefix of b, by whole rows as bits of one number."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    out = [0]
    for c in reversed(f"{row:0{len(b)}b}") if b else ():
        out.append(out[-1] + (c == "0"))
    return out


def template_lines(page: tuple, near: list[tuple]) -> list[int]:
    """Places of a page's lines that its nearest pages make template. A page: (hashes, characters, codes) of its
    lines; codes: 1 a line that may be main text, 3 one within a marked article, else 0."""
    lines, size, codes = page
    votes, inner, counted = [0] * len(lines), [0] * len(lines), 0
    whole = sum(n for n, c in zip(size, codes) if c == 3)
    for other in near:
        same = [i for i, _ in common_lines(lines, other[0])]
        theirs = sum(n for n, c in zip(other[1], other[2]) if c == 3)
        copy = 2 * sum(size[i] for i in same if codes[i] == 3) > min(whole, theirs) if whole and theirs else False
        counted += not copy
        for i in same:
            votes[i] += 1
            inner[i] += not copy
    need = min(2, len(near))
    if not need:
        return []
    gone = {i for i in range(len(lines)) if votes[i] >= need and codes[i] != 3}
    article = [i for i, c in enumerate(codes) if c == 3]
    for order in (article, article[::-1]) if counted >= ALL else ():
        for i in order:
            if inner[i] < counted:
                break
            gone.add(i)
    return sorted(gone)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, path, texts (that may be main text), lines (hashes of all), size, codes, digest (of the three)."""
    form = pa.struct([("texts", pa.list_(pa.string())), ("lines", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("codes", pa.list_(pa.int8()))])

    @F.arrow_udf("struct<texts:array<string>,lines:array<long>,size:array<int>,codes:array<tinyint>>")
    def of_pages(html: pa.Array) -> pa.Array:
        import xxhash

        out = []
        for h in html:
            got = blocks(h.as_py())
            own = candidates(got)
            codes = [0] * len(got)
            for i in own:
                codes[i] = 3 if got[i][2] else 1
            out.append({"texts": [got[i][0] for i in own], "lines": [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _, _ in got], "size": [len(t) for t, _, _ in got], "codes": codes})
        return pa.array(out, form)

    ship(pages.sparkSession)
    where = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(url, where, 1)).alias("host"), F.regexp_extract(url, where, 2).alias("path"), of_pages(F.col(html_col)).alias("x"))
    return src.select("page_id", "url", "host", "path", "x.*").withColumn("digest", F.xxhash64("lines", "size", "codes"))


def deletions(pages: DataFrame) -> DataFrame:
    """host, digest, gone (places of template lines), of classes that have any, from parsed()."""
    classes = pages.where("host <> ''").groupBy("host", "digest").agg(F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("lines", "size", "codes")))
    rows = ranked(classes, ["host", "path", "digest"], "at")
    block, place = F.floor(F.col("at") / BLOCK), F.col("at") % BLOCK
    sent = F.array(block, F.when(place < NEAR, block - 1), F.when(place >= BLOCK - NEAR, block + 1))
    dealt = rows.select("*", F.explode(F.filter(sent, lambda b: b >= 0)).alias("block"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").to_pydict()
        at, block, host = rows["at"], rows["block"][0], rows["host"]
        each = list(zip(rows["lines"], rows["size"], rows["codes"]))
        out: dict[str, list] = {"host": [], "digest": [], "gone": []}
        for k in range(len(at)):
            if at[k] // BLOCK != block:
                continue
            near = sorted((j for j in range(max(0, k - NEAR), min(len(at), k + NEAR + 1)) if j != k and host[j] == host[k]), key=lambda j: (abs(j - k), j))
            gone = template_lines(each[k], [each[j] for j in near[:NEAR]])
            if gone:
                for name, v in zip(out, (host[k], rows["digest"][k], gone)):
                    out[name].append(v)
        return pa.table({"host": pa.array(out["host"], pa.string()), "digest": pa.array(out["digest"], pa.int64()), "gone": pa.array(out["gone"], pa.list_(pa.int32()))})

    return dealt.groupBy("block").applyInArrow(run, "host string, digest long, gone array<int>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_deleted (lines that differencing took from the main text), n_template (from the whole page): one row per page."""
    whole = cut(parsed(pages, id_col, url_col, html_col), "blocks")
    gone = cut(deletions(whole), "deletions").withColumnsRenamed({"host": "of_host", "digest": "of_digest"})
    rows = whole.join(gone, F.expr("host = of_host AND digest = of_digest"), "left")
    # places of the candidates among all lines, beside their texts
    own = F.expr("filter(transform(codes, (c, i) -> IF(c > 0, i, -1)), i -> i >= 0)")
    kept = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda x, k: ~F.array_contains("gone", F.get(F.col("own"), k))))
    out = rows.withColumn("own", F.when(F.col("gone").isNotNull(), own)).select("page_id", "url", F.size("texts").alias("n"), kept.alias("kept"), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_template"))
    out = out.select("page_id", "url", F.array_join("kept", "\n").alias("text"), (F.col("n") - F.size("kept")).cast("long").alias("n_deleted"), "n_template")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted", "n_template")
