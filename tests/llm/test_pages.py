import re
from html import unescape

import pytest

from eventledger.llm import pages, queries
from eventledger.llm.common import read_table


def plain(page):
    """The article of a page of the sample tables, by plain string work."""
    inside = page.split("<article>", 1)[1].split("</article>")[0]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query_on_all_sample_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op3_html_extraction(spark, sf).collect()}
    for r in read_table(spark, sf, "pages").collect():
        assert got[r.page_id].text == plain(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].url == r.url


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;&#x33;<p>four<b>five</b></article>", "A & B\none two 3\nfourfive"),
        ("<body><nav>menu</nav><div>text<br>more</div><footer>end</footer>", "text more"),
        ("<main><article><p>x</p><section id=comments><p>hi</p></section></article></main>", "x"),
        ("<article>a<script>var t='</article>';</script>b<style>p{}</style></article>c", "ab"),
        ("<article><p>a<div class='cookie-notice'>b</div>c<form><input>d</form></article>", "a\nc"),
        ("<article><p>1 < 2 &lt; 3</p><!-- <p>no</p> --><ul><li>x<li>y</ul>", "1 < 2 < 3\nx\ny"),
        ("<article><p>cut off<div class=\"a", "cut off"),
        ("<div role='main'><p>m</p></div><p>outside", "m"),
        ("<article><p class=ad>buy</p><p>read</p><aside>side</aside></article>", "read"),
        ("<title>t</title>", ""),
        ("<article><p title='a hidden gem'>x</p><p data-x=' class=ad id=nav '>y</p><p hidden>z</p></article>", "x\ny"),
        ("<div class='content no-sidebar'><article><p>a</p></article></div>", "a"),
        ("<article class='post has-comments'><p>a</p></article>", "a"),
        ("<div class='content no-sidebar'><p>a</p></div>", "a"),
        ("<article><p>a</p><section id='related-work'><p>b</p></section><div id=notice-period>c</div></article>", "a\nb\nc"),
        ("<article><p>at <span class='share-price'>12</span></p><h1 class='header'>h</h1></article>", "at 12\nh"),
        ("<article><p>a</p><div class='relatedPosts'>b</div><div class='site-header top'>c</div><ul id=comment_list>d</ul></article>", "a"),
        ("<article><p>a <span class='ad'>Buy <span>now</span> cheap stuff</span> b</p></article>", "a b"),
        ("<p>a <b then c, and a<5 or x<y too", "a <b then c, and a<5 or x<y too"),
        ("<p>i<j and <b>bold</b> k < l</p>", "i<j and bold k < l"),
        ("<article>part one</article><p>between</p><article>part two</article>", "part one\npart two"),
        ("<main><p>" + "long text " * 9 + "</p><article>teaser</article></main>", ("long text " * 9).strip() + "\nteaser"),
        ("<main><article><p>" + "long text " * 9 + "</p></article><p>more</p></main>", ("long text " * 9).strip()),
        ("<body><div class=widget><p>" + "all the text " * 9 + "</p></div><p>x</p></body>", ("all the text " * 9).strip() + "\nx"),
        ("<body><div class=widget>" + "<a href=x>a link</a> " * 9 + "</div><p>the text</p></body>", "the text"),
        ("", ""),
    ],
)
def test_structure(page, text):
    assert pages.main_text(page) == text


def test_templates_of_a_host_go_and_copies_do_not(spark):
    box = "<div class='x17'>Ten years of us</div>"
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>text {i}</p>{box}<div>own {i}</div></article>") for i in range(8)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><article><p>same</p>{box}</article>") for i in range(8)]
    rows += [(40, None, f"<article>{box}</article>"), (None, "http://a.org", None), (41, "", ""), (41, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", pages.F.lit(1))
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert pages.extract(df).count() == len(rows)
    assert all(got[i] == f"text {i}\nown {i}" for i in range(8))
    assert all(got[20 + i] == "same\nTen years of us" for i in range(8))
    assert got[40] == "Ten years of us" and got[None] == "" and got[41] == ""
    assert pages.extract(df.limit(0)).collect() == []


def test_pages_without_containers_count(spark):
    """A sentence in a div on 5 of 1,000 pages, the others without any div, is no template."""
    rows = [(i, f"http://a.org/{i}", f"<body><p>text {i}</p>" + ("<div>twice told</div>" if i < 5 else "") + "</body>") for i in range(1000)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" + ("\ntwice told" if i < 5 else "") for i in range(1000)}


def test_pages_are_told_apart_by_their_text(spark):
    """Text right in the body; the notice that all hold is template, on copies it is not."""
    note = "<div>Our shop is closed</div>"
    rows = [(i, f"http://a.org/{i}", f"<body>text {i}{note}</body>") for i in range(100)]
    rows += [(200 + i, f"http://b.org/{i}", f"<body>one page{note}</body>") for i in range(100)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}" and got[200 + i] == "one page\nOur shop is closed" for i in range(100))


def test_templates_equal_a_plain_count(spark):
    """Hosts whose pages mix layouts, against subtrees counted in plain Python."""
    boxes = [f"<div>box {b}</div>" for b in range(12)]
    rows = []
    for host, size in (("a", 40), ("b", 120), ("c", 7), ("d", 400)):
        for i in range(size):
            own = "".join(box for b, box in enumerate(boxes) if (i * 7 + b * b) % (b + 1) == 0)
            rows.append((len(rows), f"https://{host}.org/{i}", f"<body><p>{host} {i // 2}</p>{own}</body>"))
    pages_of, seen = {}, {}
    for _, url, page in rows:
        host = url.split("/")[2]
        pages_of.setdefault(host, set()).add(page)
        for box in boxes:
            if box in page:
                seen.setdefault((host, box), set()).add(page)
    gone = {k for k, v in seen.items() if len(v) >= 5 and (len(v) >= 0.05 * len(pages_of[k[0]]) or len(v) >= pages.MANY_PAGES)}
    assert 0 < len(gone) < len(seen)
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for key, url, page in rows:
        left = [b[5:-6] for b in boxes if b in page and (url.split("/")[2], b) not in gone]
        assert got[key] == "\n".join([page.split("<p>")[1].split("</p>")[0], *left])


def test_deep_and_long_pages():
    assert pages.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert len(pages.main_text("<article>" + "<p>word word</p>" * 50_000)) == 50_000 * 10 - 1
