"""Secrets, page text, counts and pieces against brute force, round trips and the public library."""

import hashlib
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from conftest_rows import ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from taken import Taken

from tidemart.llm import html_text, pieces, secrets
from tidemart.llm.tables import read
from tidemart.llm.text_stats import base_counts

TEXT = st.text(alphabet="ab c\n\t#|=:'\"0129fAKI▁é日.-", max_size=120)


def runs(text, allowed, start=0):
    """The run of allowed characters from a place on."""
    end = start
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def plain_spans(text):
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    spans, at = [], 0
    fold = "".join(c.lower() if c < "\x80" else c for c in text)
    while at < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if fold.startswith(k, at)), None)
        if key:
            for quote_1 in (1, 0):  # an optional quote may also be left
                i = at + len(key)
                if quote_1 and text[i:i + 1] not in ('"', "'") or quote_1 and not text[i:i + 1]:
                    continue
                i = runs(text, " ", i + quote_1)
                if text[i:i + 1] and text[i] in ":=":
                    i = runs(text, " ", i + 1)
                    i += bool(text[i:i + 1]) and text[i] in "\"'"
                    end = runs(text, word, i)
                    if end > i:
                        if end - i >= 12:
                            spans.append((at, end, "assign"))
                        at = end - 1
                        break
        at += 1
    for kind, head, allowed, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("hex", "", "0123456789abcdef", 16)):
        at = 0
        while at < len(text):
            end = runs(text, allowed, at + len(head))
            if text.startswith(head, at) and end > at + len(head):
                if end - at >= least:
                    spans.append((at, end, kind))
                at = end
            else:
                at += 1
    return sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "token", "API_KEY", "AKIA", "=", ":", " ", '"', "'", "\n", "abcdef0123456789",
                                 "ABCDEFGHIJKLMN", "x.y-z", "é"]), max_size=14).map("".join))
def test_base_spans(text):
    base, spans = secrets.all_spans(text)
    assert base == plain_spans(text)
    assert set(base) <= set(spans)


@pytest.mark.parametrize("text, found", [
    ('K = "Zx81kdjA0s9"\nclient_secret = K\n', ["Zx81kdjA0s9"]),
    ("smtp:\n  user_pwd: 'Tr0ub4dor&3x'\n", ["Tr0ub4dor&3x"]),
    ('authToken := "abC9" + "Def12345"', ["abC9", "Def12345"]),
    ('{"private_key" : "mZ91-kd8L0q2"}', ["mZ91-kd8L0q2"]),
    ("password = changeme\nsecret_key = os.environ\n", []),
    ("title: A plain sentence with nothing to hide\nkey = value\n", []),
    ("PATH=/usr/bin && color: red", []),
])
def test_lexed(text, found):
    _, spans = secrets.all_spans(text)
    assert [text[a:b] for a, b, k in spans if k == "lexed"] == found


def test_secrets_query(messy, empty):
    rows = secrets.digest_spans(secrets.find_secrets(messy)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    one = next(r for r in rows if r.doc_id == 11)
    text = next(r[1] for r in ROWS if r[0] == 11)
    joined = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(text))
    assert one.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (one.n_assign, one.n_access) == (1, 1)
    assert secrets.find_secrets(empty).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            text.count("\n") + 1]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_base_counts(text):
    assert base_counts(text) == plain_counts(text)


def test_base_counts_of_tables(spark, sf):
    for r in read(spark, sf, "documents").collect():
        assert base_counts(r.text or "") == plain_counts(r.text or "")


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as file:
        return pieces.PieceModel(file.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=60), st.text(alphabet=" abx\n-=", max_size=200)))
def test_pieces_equal_the_library(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text)
    if pieces.SPACE not in text:
        assert model.decode(ids) == text


def test_pieces_of_tables(spark, sf, messy, empty, library):
    for r in pieces.encode_texts(read(spark, sf, "documents")).collect():
        assert list(r.ids) == library.encode(r.text) and r.round_trip and r.n_tokens == len(r.ids)
    rows = pieces.encode_texts(messy)
    assert rows.columns == [*messy.columns, "ids", "n_tokens", "round_trip"]
    assert all(r.round_trip is (None if r.text is None else True) for r in rows.collect())
    back = pieces.decode_ids(rows.withColumnRenamed("text", "before")).collect()
    assert all(r.text == (r.before or "") for r in back)
    assert pieces.encode_texts(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href="/">Site name of some length which is a header</a></header><nav><ul><li>Menu one<li>Menu two</ul></nav>
<div class="cookie-notice">We use cookies for many reasons, please accept all of them now</div>
<div id="sidebar">Popular posts and other things that are long enough to surge here</div>
<article><h1>The   heading &amp; more</h1><p>First <b>bold</b>
paragraph &#233; &lt;tag&gt;.<br>After break<p>Second, left open
<div class="ad">Buy this now</div><script>var t = "</p>";</script><p>Third</p>
<section id="comments"><p>A reader says something long about the article text</p></section></article>
<form>Send us your name <input name="a"><button>Go</button></form><footer>&copy; all rights</footer></body></html>"""


def test_a_task_leaves_no_chunks_behind(model, monkeypatch):
    """A Python worker goes on to other steps: what a task of the encoder remembered must not stay in its memory."""
    frame = Taken(pa.schema({"doc_id": pa.int64(), "text": pa.string()}))
    run = pieces.encode_texts(frame).function
    with open(pieces.MODEL, "rb") as file:
        data = file.read()
    monkeypatch.setattr(pieces, "_models", {})
    texts = [f"word{i} and, number {i * 7919}\n" for i in range(600)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], schema=frame.arrow)
    for _ in range(2):
        out = pa.Table.from_batches(run(iter([batch, batch]))).to_pylist()
        assert [r["ids"] for r in out] == 2 * [model.encode(t or "") for t in texts]
        worker = pieces.model_of(data)
        assert not worker._seen and not worker._before
    tasks = run(iter([batch]))
    next(tasks)
    assert worker._seen
    tasks.close()  # a task that is not read to its end
    assert not worker._seen


def test_neighbours_are_remembered_up_to_a_bound(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 50)
    own = pieces.PieceModel(open(pieces.MODEL, "rb").read())
    for i in range(300):
        text = f"zq{i * 7919}x{i}b streng{i}"
        assert own.encode(text) == model.encode(text)
        assert len(own._apart) <= 50 and len(own._seen) <= 50


def test_main_text():
    assert html_text.extract(PAGE).split("\n\n") == [
        "The heading & more", "First bold paragraph é <tag>. After break", "Second, left open", "Third"]


def test_main_text_without_article():
    page = ("<div class=menu>Home About Contact and many more links to follow here</div><div class=post><h2>Short</h2>"
            + "<p>Some text long enough to be the main text of a page.</p>" * 3 + "</div><div class=comments>Nice post of yours</div>")
    assert html_text.extract(page).split("\n\n") == ["Short"] + ["Some text long enough to be the main text of a page."] * 3
    assert html_text.extract("<p>a < b and 3 > 2, said in a text long enough to surge") == "a < b and 3 > 2, said in a text long enough to surge"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>only a menu</nav>") == ""


def test_odd_markup():
    assert html_text.extract('<article><p class="lead>Open quote text</p><p>Next</p></article>') == "Open quote text\n\nNext"
    assert html_text.extract("<article><div class='article header'><h1>Head</h1></div><svg><p>Text</article>") == "Head\n\nText"
    assert html_text.extract("<b>" * 20_000 + "</i>" * 20_000 + "<article>text</article>") == "text"
    assert html_text.extract("<article>text <!-- never closed <p>more") == "text"
    assert html_text.extract("<article>cut off in a <a href") == "cut off in a"


def test_unlabelled_clutter_in_main():
    text = "A paragraph that is long enough to be taken as main text of the page."
    links = "<ul class=zz>" + "<li><a href=/x>Some other story of this site</a></li>" * 5 + "</ul>"
    short = "<div class=zz>Three left this month</div>"
    page = f"<main><h1>Title</h1>{links}<p>{text}</p><p><a href=/y>one link on its own</a></p><p>{text}</p>{links}{short}{links}</main>"
    assert html_text.extract(page).split("\n\n") == ["Title", text, "one link on its own", text]
    bare = f"<div>{links}</div><div><p>{text}</p><p>{text}</p></div><div>{links}</div>"
    assert html_text.extract(bare).split("\n\n") == [text, text]


def test_page_wide_wrappers():
    text = "A paragraph that is long enough to be taken as main text of the page."
    nav, foot = "<nav>Home and away</nav>", "<div class=site-footer>Imprint, and all else that stands in a footer</div>"
    for inner in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
        for wrapper in ("form action=/", 'div class="page has-sidebar"', "div class=with-banner", "div class=side-nav-layout"):
            page = f"<body><{wrapper}>{nav}{inner}{foot}</{wrapper.split()[0]}></body>"
            assert html_text.extract(page) == text, (wrapper, inner)
    assert html_text.extract(f"<div class=sidebar><main><p>{text}</p></main></div>") == text
    assert html_text.extract(f"<article><p>{text}</p></article><form><p>{text * 5}</p></form>") == text


def test_pages(spark, sf):
    import html
    rows = {r.page_id: r for r in html_text.extract_pages(read(spark, sf, "pages")).collect()}
    for page in read(spark, sf, "pages").collect():
        article = re.sub("<br>", " ", page.html.partition("<article>")[2].partition("</article>")[0])
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert rows[page.page_id].text == "\n\n".join(filter(None, blocks))
        assert rows[page.page_id].n_chars == len(rows[page.page_id].text)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>" + "word " * 100_000)],
                                "page_id BIGINT, url STRING, html STRING")
    assert sorted(r.n_chars for r in html_text.extract_pages(odd).collect()) == [0, 0, 499_999]


ARTICLE = "A paragraph of the article that is long enough to be the main text of a page."


def test_names_that_only_sound_like_clutter():
    for kind in ("class='share-price'", "class='navy'", "class='related-work'", "class='promotion-rules'", "id='side-effects'"):
        page = f"<article><p>{ARTICLE}</p><div {kind}><p>One more paragraph of it.</p></div></article>"
        assert html_text.extract(page) == f"{ARTICLE}\n\nOne more paragraph of it.", kind
    for kind in ("share-buttons", "site-nav", "mainNav", "cookie_banner", "related-posts", "comment-list", "ad-slot-2", "newsletterSignup"):
        page = f"<article><p>{ARTICLE}</p><div class='{kind}'><p>Something else that is long enough to be a text of its own.</p></div></article>"
        assert html_text.extract(page) == ARTICLE, kind


def test_short_lines_around_an_unmarked_text():
    page = (f"<div>Site title</div><div>Today is Monday</div><div>Log in or register</div><p>{ARTICLE}</p><h2>Why</h2><p>It is so.</p>"
            f"<p>{ARTICLE}</p><div class=c2><p>Top ten</p><p>Latest</p></div><div>Copyright 2020</div><div>All rights reserved</div>"
            "<div>Powered by X</div>")
    assert html_text.extract(page).split("\n\n") == [ARTICLE, "Why", "It is so.", ARTICLE]
    assert html_text.extract("<div>Menu</div><h1>Title</h1><p>" + ARTICLE).split("\n\n") == ["Title", ARTICLE]
    assert html_text.extract("<p>Hello world</p>") == "Hello world"
    assert html_text.extract("<p>Hello") == "Hello"


def test_teasers_beside_the_article():
    page = f"<article class=teaser><p>{ARTICLE} More.</p></article><article><p>{ARTICLE}</p></article>"
    assert html_text.extract(page) == ARTICLE
    assert html_text.extract(f"<article class=teaser><p>{ARTICLE}</p></article>") == ARTICLE


@pytest.mark.parametrize("part", ["<div class=nav><p>text of it", "<svg><p>text of it", "<p class=\"x>text", "<b><div class=menu>", "</i><a href='",
                                  "<ul><li>item", "<article><p>text", "<!-"])
def test_a_large_page_takes_time_in_proportion(part):
    began = time.process_time()
    html_text.extract(part * ((1 << 20) // len(part)) + ">")
    assert time.process_time() - began < 25  # a few seconds on a fast machine; hours if every tag looked at all the others


def test_pages_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, "u", f"<p>{ARTICLE}", 5, "t")] * 2 + [(None, None, None, 1, None)],
                                "page_id BIGINT, url STRING, html STRING, n_chars INT, text STRING")
    got = sorted(((r.page_id, r.text) for r in html_text.extract_pages(odd).collect()), key=str)
    assert got == [(1, ARTICLE), (1, ARTICLE), (None, "")]
    assert html_text.extract_pages(odd.limit(0)).count() == 0
