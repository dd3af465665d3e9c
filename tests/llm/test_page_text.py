"""Main text of literal pages, differencing of neighbours, and the longest common subsequence."""

from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL

from sparrowtext.llm import page_text as pt

SCHEMA = "page_id long, url string, html string"


def text_of(html):
    got = pt.blocks(html)
    return "\n".join(got[i][0] for i in pt.candidates(got))


PAGES = {
    "": "",
    "plain words": "plain words",
    "<p>One<p>Two <b>bold\n words</b></p>": "One\nTwo bold words",
    "<article><h1>T</h1><p>a &amp; b&nbsp;c &#233;&lt;i&gt;</p></article><footer>f</footer>": "T\na & b c é<i>",
    "<body><nav>menu</nav><header>site</header><main><p>text</p><aside>side</aside></main><p>outside</p></body>": "text",
    "<div class='cookie-notice'>We use <div>cookies</div></div><p>kept</p>": "kept",
    "<div id=sidebar><p>x</div><section class=\"user-comments\"><p>nice!</p></section><p>kept</p>": "kept",
    "<div role='search'><input></div><form><p>mail</p></form><p>kept</p>": "kept",
    "<div class='ad'>buy</div><div class='adventure'>story</div>": "story",
    "<script>var t='</p><p>no';</script><style>p{}</style><noscript>no</noscript><p>a<!-- <p>b --></p>": "a",
    "<p>a<br>b<br/>c</p>": "a b c",
    "<table><tr><td>1</td><td>2</td></tr></table>": "1\n2",
    "<ul><li>x<li>y</ul>": "x\ny",
    "<article><header><h1>Title</h1></header><p>t</p><div class='share'>s</div><div class='comments'><p>c</p></div></article>": "Title\nt",
    "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2",
    "<p title='a > b'>q</p>": "q",
    "<article><p>unclosed <b>bold<br><p>next": "unclosed bold\nnext",
    "</div></p>stray<p>ok": "stray\nok",
    "<ARTICLE><P>Upper</P></ARTICLE>": "Upper",
    "<script>never closed": "",
    "<article><p>a</p><div class='related-work'><p>Our related work section.</p></div><div id='comment-policy-essay'>b</div><div class='x related-posts'>no</div></article>": "a\nOur related work section.\nb",
    "<p>tab\tand\nline and  more</p>": "tab and line and more",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_blocks(html):
    assert text_of(html) == PAGES[html]


def test_long_and_hostile_pages_end():
    for bad in ("<" * 200_000, "<div>" * 50_000 + "x", "<!--" * 50_000, "<p a='" * 20_000, "<a " + "b " * 100_000, "&" * 200_000, "<p>" + "w " * 500_000 + "</p>"):
        assert isinstance(text_of(bad), str)


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_longest_common_subsequence(a, b):
    for most in (10**6, 3):  # also by halves
        got = pt.common_lines(a, b, most)
        assert len(got) == lcs_length(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_pages_of_one_repeated_line_end():
    a = [1, 2] * 4000
    assert len(pt.common_lines(a, [2, 1] * 4000)) == 7999


def page(own, template=("Site name", "All our topics", "Contact us today")):
    return f"<body><p>{template[0]}</p><p>{template[1]}</p>{''.join(f'<p>{x}</p>' for x in own)}<p>{template[2]}</p></body>"


def test_neighbours_lose_shared_lines(spark):
    rows = [(i, f"http://h.org/a/{i}", page([f"own {i}", "shared by chance" if i < 2 else f"more {i}"])) for i in range(6)]
    rows += [(50, "http://other.org/x", page(["alone"])), (51, None, "<p>no url</p>"), (52, "http://q.org/1", None), (None, "http://q.org/2", "<p>null id</p>")]
    rows += [(60, "http://copies.org/1", page(["same"])), (61, "http://copies.org/1", page(["same"]))]
    rows += [(53, None, page(["null"])), (54, None, page(["too"])), (80, "http://two.org/1", page(["first"])), (81, "http://two.org/2", page(["second"]))]
    docs = spark.createDataFrame([(*r, 1, "z", "z") for r in rows], SCHEMA + ", digest int, host string, gone string")
    got = pt.extract(docs).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for i in range(2, 6):
        assert by[i] == f"own {i}\nmore {i}"
    assert by[0] == "own 0\nshared by chance" and by[80] == "first"  # one page shares it; two pages in all
    assert by[50] == "Site name\nAll our topics\nalone\nContact us today" and by[51] == "no url" and by[52] == "" and by[None] == "null id"
    assert by[60] == by[61] == "Site name\nAll our topics\nsame\nContact us today" and by[53].startswith("Site name")
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.n_deleted for r in got}[3] == 3


def test_articles_keep_quotations_and_near_copies(spark):
    story = lambda i, *more: f"<nav><p>Home</p></nav><article><p>Follow us on our channel.</p><p>The story {i} and what came of it, told at such length that most of the article is its own.</p>{''.join(f'<p>{x}</p>' for x in more)}<p>It ended {i}.</p></article>"
    rows = [(i, f"http://a.org/{i}", story(i, "A passage that all of them quote.")) for i in range(5)]
    long = [f"Paragraph {k} of a text that was copied." for k in range(9)]
    rows += [(10 + i, f"http://b.org/{i}", f"<article>{''.join(f'<p>{x}</p>' for x in long)}<p>edited by {i}</p></article>") for i in range(5)]
    by = {r.page_id: r for r in pt.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(5):
        assert by[i].text == f"The story {i} and what came of it, told at such length that most of the article is its own.\nA passage that all of them quote.\nIt ended {i}."
        assert by[10 + i].text == "\n".join([*long, f"edited by {i}"])
        assert by[i].n_template == 2 and by[i].n_deleted == 1


@pytest.fixture
def ranges(spark):
    """Sets the number of partitions; afterwards it is as before."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", was)


def by_hand(rows):
    """page_id -> text, all on one machine: every pair of every host, and votes counted by a plain table of lengths."""

    def shared(a, b):  # places of a in a longest common subsequence
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    hosts = {}
    for i, url, html in rows:
        lines = pt.blocks(html)
        own = pt.candidates(lines)
        codes = tuple((3 if lines[k][2] else 1) if k in own else 0 for k in range(len(lines)))
        parts = url.split("?")[0].split("#")[0].split("/", 3)
        kind = hosts.setdefault(parts[2].lower(), {}).setdefault((tuple(t for t, _, _ in lines), codes), [[], []])
        kind[0].append("/" + parts[3] if len(parts) > 3 else "")
        kind[1].append(i)
    out = {}
    for kinds in hosts.values():
        order = sorted(kinds, key=lambda k: min(kinds[k][0]))
        for at, (lines, codes) in enumerate(order):
            near = [order[j] for j in (at - 1, at + 1, at - 2, at + 2, at - 3, at + 3, at - 4, at + 4) if 0 <= j < len(order)][:4]
            votes, inner, need, counted = [0] * len(lines), [0] * len(lines), min(2, len(near)), 0
            for other, theirs in near:
                same = shared(lines, other)
                sizes = [sum(len(t) for t, c in zip(x, y) if c == 3) for x, y in ((lines, codes), (other, theirs))]
                copy = min(sizes) > 0 and 2 * sum(len(lines[k]) for k in same if codes[k] == 3) > min(sizes)
                counted += not copy
                for k in same:
                    votes[k] += 1
                    inner[k] += not copy
            gone = {k for k in range(len(lines)) if need and votes[k] >= need and codes[k] == 1}
            article = [k for k, c in enumerate(codes) if c == 3]
            for seq in (article, article[::-1]):
                for k in seq:
                    if counted < 3 or inner[k] < counted:
                        break
                    gone.add(k)
            text = "\n".join(t for k, t in enumerate(lines) if codes[k] and k not in gone)
            out |= dict.fromkeys(kinds[lines, codes][1], text)
    return out


@pytest.mark.parametrize("n", ["1", "8", "211"])
def test_pairs_do_not_hang_on_partitions(spark, ranges, n, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 16)  # classes of a host in many blocks
    rows = [(i, f"http://h{i // 40}.org/{i % 40 // 6}/{i:03d}", page(["same"] if 20 <= i < 35 else [f"own {i}", f"of section {i // 6}"])) for i in range(100)]
    ranges(n)
    got = pt.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    want = by_hand(rows)
    assert {r.page_id: r.text for r in got} == want and all("Site name" not in x for x in want.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_hosts_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = pt.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == by_hand([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert sum(r.n_template for r in got) > 0


def test_a_host_with_most_pages_spreads(spark):
    rows = [(i, f"http://big.org/s{i % 7}/p{i:05d}", page([f"own {i}", f"more {i}"])) for i in range(3000)]
    got = pt.extract(spark.createDataFrame(rows, SCHEMA).repartition(12)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own {i}\nmore {i}" for i in range(3000)}


def test_empty_table(spark):
    assert pt.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_table_against_its_articles(spark):
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in pt.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", body)
        want = [" ".join(unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in want if x)
