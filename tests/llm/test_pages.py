"""URL filter, HTML extraction and WARC archives."""

from __future__ import annotations

import hashlib
import io
import time

import pytest

from tests.llm.awkward import clash
from trailmesh.llm import html, urls, warc
from trailmesh.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "x" * 200_000 + "</p>"
    rows = [(3, "http://a.net/x", long), (1, "http://b.org/fr/1?q=2", "<p>short"), (2, None, None), (4, "no mark", ""),
            (5, "http://C.Example.Net/en/a", long), (None, "http://d.com/", long), (3, "http://a.net/x", long),
            (7, "HTTP://x.com\u0001 y/", "ünïcode" * 30), (8, "", "ünïcode" * 30), (9, "http://x", "<p>short")]
    return clash(spark.createDataFrame(rows, PAGES))


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("example.net/en/", "", "", None, "allow"),
    ("http://Example.NET/en/x?y#z", "example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.b.example.net/de/x", "a.b.example.net", "/de/x", "net/", "block"),
    ("http://net", "net", "", None, "allow"), ("http://net/", "net", "/", "net/", "block"),
    ("http://planet/x", "planet", "/x", None, "allow"), ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"), ("http://a.com?u=://b.net/", "a.com", "", None, "allow"),
    ("http://casino.com/", "casino.com", "/", None, "block"), ("http://mycasino.com/", "mycasino.com", "/", None, "allow"),
    ("http://cheap-pills.com/", "cheap-pills.com", "/", None, "block"), ("http://cheap.com/cheap/cheap", "cheap.com", "/cheap/cheap", None, "allow"),
    ("x://a.com/FREE_bets", "a.com", "/FREE_bets", None, "block"), ("http://ÄB.com/é", "Äb.com", "/é", None, "allow"),
])
def test_url(spark, url, host, path, rule, verdict):
    row = urls.judge_urls(clash(spark.createDataFrame([(1, url)], "page_id long, url string")), URL_RULES).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_urls_of_nothing(spark, pages):
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).collect() == []
    assert urls.judge_urls(pages).count() == pages.count()


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<script>var x='</p>';</script>b", "ab"),
    ("<html><body><nav><a href=x>Home page of the site</a></nav><article><h1>Head</h1><p>First, long enough to be a "
     "paragraph, really.<br>Next\n\t line&nbsp;here<p>Second <b>bold, too</b> paragraph of the article.</article>"
     "<footer>Copyright</footer>",
     "Head\n\nFirst, long enough to be a paragraph, really. Next line here\n\nSecond bold, too paragraph of the article."),
    ("<div id=main><p>One paragraph with commas, words, and more words in it.</p><div class='comments'><p>A reader says, "
     "well, that this is nice indeed.</p></div><form><p>Your name, please, and mail address</p></form></div>"
     "<div class=sidebar><p>Other, unrelated, but long paragraph in the sidebar.</p></div>",
     "One paragraph with commas, words, and more words in it."),
    ("<main><section><p>First section has a text, with commas, and words.</p></section><section><p>Second section has "
     "a text, with commas, and words.</p></section></main><aside><p>Aside</p></aside>",
     "First section has a text, with commas, and words.\n\nSecond section has a text, with commas, and words."),
    ("<article><p>Cut off in the middle of a tag, as some pages are</p><p>and then <a hre", "Cut off in the middle of a tag, "
     "as some pages are\n\nand then"),
    ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<p>x &lt;b&gt; &#233; &unknown; &am", "x <b> é &unknown; &am"),
    ("<div style='display:none'>no</div><p>yes, this one</p><p hidden>no</p>", "yes, this one"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"), ("</p></div>stray <b>ends", "stray ends"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


ARTICLE = "<p>It's a long first paragraph, with commas, and words.</p><p>Another one's here, too, and it is long enough.</p>"
PLAIN = "It's a long first paragraph, with commas, and words.\n\nAnother one's here, too, and it is long enough."


@pytest.mark.parametrize("page", [
    f"<article><div title=it's>{ARTICLE}</div></article>",
    f"<div class='site-content no-sidebar'>{ARTICLE}</div>", f'<div class="post has-comments">{ARTICLE}</div>',
    f"<div id=widget class=sidebar>{ARTICLE}</div>",  # nothing else is there
    f"<div class='has-header'>{ARTICLE}</div>", f"<div class=content>{ARTICLE}<div class='comment-list'><p>A reader, again, says so.</p></div></div>",
    f"<div class=wide><div class='content'>{ARTICLE}</div><div class='side-bar left'><p>Other things, and more, and more yet.</p></div></div>",
    f"<div a=\"<p>x'\" b='\"' c = d/e>{ARTICLE}</div>", f'<div class="a" "b" =c>{ARTICLE}</div  x="y>">',
    f"<main>{ARTICLE}<aside class=x>More, of the same, and so on.</aside></main>",
])
def test_articles_survive_names_and_quotes(page):
    assert html.main_text(page) == PLAIN


@pytest.mark.parametrize("page", [
    "<a " * 300_000 + '"', "<a b='" * 150_000, "<div>" * 50_000 + "</x>" * 150_000, "<b>" * 60_000 + "<hr>" * 100_000,
    "<b>" * 60_000 + "<td>" * 100_000, "<" * 1_000_000, "<!--" * 250_000, "<p>, words, and more of these words, " * 25_000,
    "<div>" * 20_000 + "<p>some words, and more, and yet more words" * 2_000,
])
def test_time_grows_with_the_page_only(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 10


def test_deep_page_is_survived():
    assert html.main_text("<div>" * 3000 + "<p>deep down, here" + "</div>" * 10) == "deep down, here"


def test_extraction_keeps_rows(spark, pages):
    rows = html.extract_text(pages).collect()
    assert len(rows) == pages.count()
    assert all(r.n_chars == len(r.text) for r in rows) and max(r.n_chars for r in rows) == 200_000
    assert html.extract_text(spark.createDataFrame([], PAGES)).collect() == []


def test_archive_round_trip(pages):
    rows = warc.archive_round_trip(pages, roll_bytes=400).collect()
    source = {(r.page_id, (r.html or "").encode()) for r in pages.collect()}
    assert len(rows) == pages.count() and all(r.digests_ok for r in rows)
    by_id = {r.page_id: r for r in rows}
    for page_id, payload in source:
        row = by_id[page_id]
        assert row.payload_bytes == len(payload) and row.payload_digest == hashlib.sha256(payload).hexdigest()
        assert row.payload == (payload if row.record_type == "response" else None)
    assert [by_id[i].refers_to for i in (1, 2, 3, 4, 5, None, 7, 8, 9)] == [None, None, None, None, 3, 3, None, 7, None]
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in rows)
    assert len({r.path for r in rows}) > 1


def test_archives_of_nothing(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def archive(*records):
    return b"".join(warc.gzip_member(warc.record(*r, "2020-01-01T00:00:00Z")) for r in records)


def test_reader_crosses_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    payloads = [b"a" * 1000, b"", bytes(range(256)) * 20]
    data = archive(*((k, "u", p, None) for k, p in enumerate(payloads)))
    found = list(warc.read_records(io.BytesIO(data)))
    assert [warc.parsed(f, b)["payload"] for _, f, b in found] == payloads
    for position, fields, block in found:  # every position opens the same record
        assert next(warc.read_records(io.BytesIO(data[position:])))[1:] == (fields, block)


def test_reader_refuses_damage():
    data = archive((1, "u", b"hello", None))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    raw = warc.record(1, "u", b"hello", None, "d").replace(b"hello", b"jello")
    (_, fields, block), = warc.read_records(io.BytesIO(warc.gzip_member(raw)))
    assert not warc.parsed(fields, block)["digests_ok"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.gzip_member(raw[:-4]))))


def test_archives_with_wrong_digests_are_refused(spark, tmp_path):
    sound = warc.record(1, "http://a.net/", b"hello", None, "d")
    for name, raw in (("sound", sound), ("damaged", sound.replace(b"hello", b"jello"))):
        (tmp_path / name).write_bytes(warc.gzip_member(raw))
    read = {n: warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{n}", 1, 1)], warc.MANIFEST)).select("page_id")
            for n in ("sound", "damaged")}
    assert [r.page_id for r in read["sound"].collect()] == [1]
    with pytest.raises(Exception, match="a digest of the record at 0"):
        read["damaged"].collect()
