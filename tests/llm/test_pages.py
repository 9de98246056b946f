"""Operators on pages, and the pipeline."""

import hashlib
import zlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from fieldflux.llm import bpe, exact_dedup, html_text, jaccard_join, language_id, substring_dedup, warc
from fieldflux.llm.common import documents
from fieldflux.scratch import scratch_dir

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>x";</script></head>
<body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice"><p>We use cookies</p></div>
<article><header><h1>Title &amp; more</h1></header><p><b>First.<br><p>Second
  line &lt;b&gt; caf&eacute; a<i>b</i>c</p><aside>Also</aside><p>x</p><form><input value="a>b"><p>Mail</p></form><ul><li>One</li><li><a href=u>Two</a></li></ul>
<section class="comments"><p>I agree</p></section><p>Last</article><div class="comment-list"><article class="comment">me</article></div>
<footer>&copy; us</footer></body></html>"""


def test_article():
    assert html_text.main_text(ARTICLE) == "Title & more\nFirst.\nSecond line <b> café abc\nx\nOne\nTwo\nLast"


def test_page_without_article():
    body = "".join(f"<p>Paragraph {i} has some text to read.</p>" for i in range(5))
    page = f"<div><a href=1>Home</a> | <a href=2>News</a></div><div class=sidebar>Side</div><div>{body}<p>Ok.</p></div><ul><li><a href=3>x</a></li><li><a href=4>y</a></li><li><a href=5>z</a></li></ul><p>tiny</p>"
    assert html_text.main_text(page).split("\n") == [*[f"Paragraph {i} has some text to read." for i in range(5)], "Ok."]


LONG = "".join(f"<p>Paragraph {i} of the main text says what the page is about.</p>" for i in range(8))


def test_teasers_in_articles_do_not_replace_the_text():
    """Whether the text is in an article or not, the lengths choose it."""
    teasers = "".join(f"<article class=card><h3>Teaser {i}</h3><p>More on it</p></article>" for i in range(4))
    for tag in ("main", "div", "article"):
        got = html_text.main_text(f"<body><{tag}>{LONG}</{tag}>{teasers}</body>").split("\n")
        assert len(got) == 8 and got[0].startswith("Paragraph 0") and got[-1].startswith("Paragraph 7")


def test_text_at_edges_and_under_names_that_sound_like_menus():
    gap = "<div class=ad>Buy</div>" * 4
    end = "<p>That is all for today.</p>"
    assert html_text.main_text(f"<div>{LONG}</div>{gap}{end}").endswith("\nThat is all for today.")
    for name in ("layout has-sidebar", "no-sidebar", "sidebar"):
        assert html_text.main_text(f"<div class='{name}'>{LONG}</div>").count("\n") == 7
    inner = "<h2 id=related-work>Related work</h2><section id=search-methods><p>We search.</p></section><div class=share-price>It rose.</div>"
    assert html_text.main_text(f"<article>{LONG}{inner}</article>").endswith("\nRelated work\nWe search.\nIt rose.")
    linked = "<p><a href=1>The whole report of the agency is to be had here</a></p>"
    assert html_text.main_text(f"<div>{LONG}{linked}</div>").endswith("to be had here")
    assert html_text.main_text(f"<div class=sidebar>Side</div><div>{LONG}</div><div class='comment-list'>{LONG * 3}</div>").count("\n") == 7


SAID = "<p>I agree with every word that was written here by the author.</p>" * 3
MADE = {
    "notice": f'<div id="onetrust-banner-sdk"><p>We use cookies and similar technologies to improve the site.</p></div><{{0}}>{LONG}</{{0}}>',
    "comments inside": f'<{{0}}>{LONG}<div class="reader-responses">{SAID}</div></{{0}}>',
    "reviews": f'<{{0}}>{LONG}</{{0}}><section id="user-reviews">{SAID}</section>',
    "comment list": f'<{{0}}>{LONG}</{{0}}><ol class="commentlist"><li>{SAID}</li></ol>',
    "advert": f'<{{0}}>{LONG}<div class="adslot-x"><p>Buy one and get the other for free</p></div></{{0}}>',
    "contents": f'<{{0}}><ul><li><a href="#a">Part one</a></li><li><a href=#b>Part two</a></li></ul>{LONG}</{{0}}>',
    "form around all": f'<body><form id="aspnetForm"><{{0}}>{LONG}</{{0}}></form></body>',
    "open menu": f"<body><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><{{0}}>{LONG}</{{0}}></body>",
    "form beside": f"<form>{'<label>Name</label><input>' * 9}</form><{{0}}>{LONG}</{{0}}>",
}


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("kind", MADE)
def test_made_pages(kind, tag):
    want = "\n".join(f"Paragraph {i} of the main text says what the page is about." for i in range(8))
    assert html_text.main_text(MADE[kind].format(tag)) == want


def test_what_stays_beside_such():
    heading = "<h2><a href='#s'>Section</a></h2><p class='address book-reviews'>See <a href='#n'>note</a></p>"
    for tag in ("article", "div"):
        assert html_text.main_text(f"<{tag}>{LONG}{heading}{LONG}</{tag}>").split("\n")[8:10] == ["Section", "See note"]
    assert html_text.main_text(f"<form>{'<label>Name</label><input>' * 9}</form><p>Hello</p>") == "Hello"
    assert html_text.main_text(f"<div hidden>{LONG}</div><p>Hello</p>") == "Hello"
    assert html_text.main_text("<nav><a href=1>Home</a><a href=2>News") == ""


def test_the_window_decides_how_far_short_lines_reach():
    menu = "".join(f"<div>M{i}</div>" for i in range(6))
    inner = "".join(f"<p>{c}</p>" for c in "abcdef")
    for window in (1, 2, 3, 5):
        got = html_text.main_text(f"<body>{menu}<div>{LONG}{inner}{LONG}</div>{menu}</body>", window).split("\n")
        assert got == [
            *[f"M{i}" for i in range(7 - window, 6)], *html_text.main_text(f"<article>{LONG}{inner}{LONG}</article>").split("\n"),
            *[f"M{i}" for i in range(window - 1)],
        ]
    assert html_text.main_text(f"<article>{menu}{LONG}</article>").startswith("M0\n")


def test_stretches_at_random():
    """Without a threshold no line with a length is lost; a stretch begins and ends with such lines."""
    rnd = np.random.default_rng(3)
    for _ in range(300):
        lengths, window = [int(x) for x in rnd.choice([0, 0, 2, 5, 40], rnd.integers(0, 30))], int(rnd.integers(1, 5))
        kept = {i for a, b in html_text.stretches(lengths, window, 0.0) for i in range(a, b) if lengths[i]}
        assert kept == {i for i, n in enumerate(lengths) if n}
        for a, b in html_text.stretches(lengths, window, 12.0):
            assert lengths[a] and lengths[b - 1] and sum(lengths[a : a + window]) > 12


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<!-- open", "<script>x", "<nav>a", "</p></div>", "<a <b <c", "&", "<article></article>"])
def test_odd_pages(page):
    assert html_text.main_text(page) in ("", "<", "&", "<p", "<a <b <c")


def test_many_stretches():
    assert html_text.stretches([0, 5, 0, 0, 3, 0, 0, 0, 2]) == [(1, 5), (8, 9)] and html_text.stretches([]) == []


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key long, digest string").repartition(3)


def test_extract(spark, equal):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>word " * 50_000 + "</article>")]
    got = html_text.extract(pages_frame(spark, rows)).collect()
    want = [(i, u, html_text.main_text(h or ""), len(html_text.main_text(h or ""))) for i, u, h in rows]
    equal(got, want)
    assert html_text.extract(pages_frame(spark, rows).limit(0)).count() == 0


def test_warc(spark, equal):
    big, other = "é<p>" * 300, "z" * 1000
    rows = [(i, f"http://x/{i}\r\nInjected: 1", big) for i in range(6)] + [(9, None, other), (7, "u", other), (7, "u", other), (11, "u", "s" * 999), (12, "u", "s" * 999)]
    rows += [(20, "u", None), (21, "u", ""), (9, "again", other), (None, "n", big), (None, "n", "q" * 2000), (None, "n", "q" * 2000), (30, "u", "y" * 400_000)]
    got = warc.archive(pages_frame(spark, rows), file_bytes=600).collect()
    size = lambda h: len((h or "").encode())
    keep = {}
    for i, _, h in rows:
        keep.setdefault(h, []).append(i)
    want, first = [], set()
    for i, _, h in rows:
        top = max((x for x in keep[h] if x is not None), default=None)
        revisit = size(h) >= 1000 and len(keep[h]) > 1 and (i != top or h in first)
        if i == top and size(h) >= 1000:
            first.add(h)
        want.append((i, size(h), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    equal([r[:5] for r in got], want)
    assert warc.archive(pages_frame(spark, rows).limit(0)).count() == 0


def test_archives_are_the_same_each_time_and_checked(spark):
    rows = [(i, "u", f"{i} " * 900) for i in range(40)]
    folders = [f"{scratch_dir(spark)}/warc-test-{n}-{np.random.default_rng().integers(1 << 60)}" for n in range(2)]
    manifests = [sorted(map(tuple, warc.write_archives(pages_frame(spark, rows), f, file_bytes=500).collect())) for f in folders]
    assert manifests[0] == manifests[1] and sum(r[1] for r in manifests[0]) == 40 and len(manifests[0]) > 5
    read = warc.read_archives(spark.read.parquet(f"{folders[0]}/manifest"), folders[0], with_html=True).collect()
    assert sorted((r.page_id, r.html) for r in read) == [(i, h) for i, _, h in rows]
    raw = warc.record("1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse(raw)[0]["X-Page-ID"] == "1"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_pipeline(spark):
    """Every stage on what the one before it kept, against plain versions; then the packed ids."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    docs = documents(spark, sf)
    model = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if model[r.doc_id].lang_pred != "und" and model[r.doc_id].score >= 0.5}
    rows = {i: t for (i, t), c in zip(rows.items(), brute.copies(list(rows.items())), strict=True) if c[3]}
    rows = {i: rows[i] for i, _, c in brute.near_components(list(rows.items())) if i == c}
    rows = {i: kept if gone else rows[i] for i, n, gone, kept in brute.repeated_spans(list(rows.items())) if not n or gone < n}
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(got) == set(rows)
    for i, text in rows.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for start, length, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_stages_keep_columns(spark, messy):
    for stage in (language_id.keep_identified, exact_dedup.drop_copies, jaccard_join.keep_first, substring_dedup.remove_spans):
        assert stage(messy.limit(0)).columns == messy.columns
