"""Block labeller: hand-labelled pages, held-out accuracy, mark-up, and defined results for odd pages."""

from html.parser import HTMLParser

import numpy as np
import pytest
from pages_by_hand import MARK, PAGES

from minutary.llm import common, html_main, train_labeller


def marked(html):
    """(text without its mark, whether it is main) of each block, by the labeller's own reading."""
    return [(t.removeprefix(MARK).strip(), t.startswith(MARK)) for _, t, _ in html_main.blocks(html, {})]


def labelled(html):
    known, w = {}, html_main.load_weights()
    found = html_main.blocks(html.replace(MARK, ""), known)
    (marks,) = html_main.label([html_main.gates(found, known, w)], w)
    return [(t, bool(m)) for (_, t, _), m in zip(found, marks)]


def test_held_out_accuracy():
    assert train_labeller.accuracy(html_main.load_weights(), 200, seed=12345) > 0.99


def test_pages_written_by_hand():
    hit = wrong = missed = 0
    faults = []
    for name, html in PAGES.items():
        want, got = marked(html), labelled(html)
        assert [t for t, _ in want] == [t for t, _ in got], name
        for (t, a), (_, b) in zip(want, got):
            hit, wrong, missed = hit + (a and b), wrong + (b and not a), missed + (a and not b)
            if a != b:
                faults.append((name, t[:60], "kept" if b else "lost"))
    assert 2 * hit / (2 * hit + wrong + missed) >= 0.95 and len(PAGES) >= 30, faults


class Plain(HTMLParser):
    """A plain reading of well-formed mark-up into blocks."""

    def __init__(self):
        super().__init__()
        self.out, self.piece, self.off = [], "", 0

    def cut(self):
        text = " ".join(self.piece.split())
        if text:
            self.out.append(text)
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        if tag == "br":
            self.piece += " "
        elif tag in html_main.BLOCK or tag == "hr":
            self.cut()

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        if tag in html_main.BLOCK:
            self.cut()

    def handle_data(self, data):
        self.piece += "" if self.off else data


def test_blocks_equal_a_plain_reader():
    import random

    r = random.Random(8)
    for html in [train_labeller.page(r) for _ in range(150)] + list(PAGES.values()):
        if "it's" in html:  # not well-formed
            continue
        plain = Plain()
        plain.feed(html)
        plain.close()
        plain.cut()
        assert [t for _, t, _ in html_main.blocks(html, {})] == plain.out


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p class=it's>Don't lose this text.</p>", ["Don't lose this text."]),
        ('<p title="abc>Hello there</p>', ["Hello there"]),
        ('<p title="abc>Hello</p><p class="x">World</p>', ["Hello", "World"]),
        ("<p>if a<b too</p><p>next</p>", ["if a<b too", "next"]),
        ("<p>one</p><3 hearts", ["one", "<3 hearts"]),
        ("<p>one</p>tail < end", ["one", "tail < end"]),
        ("<p>one</p><a href=\"http://x", ["one"]),
        ("<p>one<!-- no > no --> two<!-- three", ["one two"]),
        ("<p>a <img src=x> b<wbr>c <svg><text>label</text></svg></p>", ["a bc label"]),
        ("<div>a<p>b<ul><li>c<li>d</ul>e</div>", ["a", "b", "c", "d", "e"]),
        ("<noscript><p>shown</p></noscript><object>fallback</object><iframe>frame</iframe>", ["shown", "fallbackframe"]),
        ("<SCRIPT>var a='<p>'</SCRIPT ><style>p{}</style><p>x", ["x"]),
        ("<p data-x='a > b' class=\"y\">kept &amp; &#233;&nbsp;z</p>", ["kept & é z"]),
        ("<![CDATA[x]]><?php echo ?><p>y</p></ p><p>z", ["y", "z"]),
    ],
)
def test_marks_up(html, want):
    assert [t for _, t, _ in html_main.blocks(html, {})] == want


def test_reading_stays_linear():
    import time

    for piece in ("<p title=\"a", "<a b='", "<!--", "<p ", "<", "</", "<script", "<a b=\"c\" d=\"e\"f=\"", "&", "<p><div>", "x=\"'"):
        began = time.perf_counter()
        html_main.blocks(piece * 40_000, {})
        assert time.perf_counter() - began < 20, piece
    deep = "<x-a>" * 40_000
    for page in ("<div>x" * 40_000, "<a " + "a= " * 40_000, "<a " + "a= " * 40_000 + "<b", deep + "</y>x" * 40_000, "<option>x<select>" + deep + "<option>x</option>" * 40_000, "<div>x" * 20_000 + "</div>y" * 20_000):
        began = time.perf_counter()
        known = {}
        found = html_main.blocks(page, known)
        html_main.gates(found, known, html_main.load_weights())
        assert time.perf_counter() - began < 15, page[:60]


def test_labels_are_those_of_a_plain_lstm():
    """The network computed again, one block, gate and direction at a time."""
    w, known = html_main.load_weights(), {}
    found = html_main.blocks("<nav><a href=/>Home</a></nav><article><h1>Head</h1>" + "".join(f"<p>Sentence {k} of the story, which goes on.</p>" for k in range(9)) + "</article><div class=ad>Buy</div><footer>(c)</footer>", known)
    x, n = html_main.features(found, known), html_main.HIDDEN
    total = np.full(len(x), float(np.ravel(w["o"])[0]))
    for side, order in (("f", range(len(x))), ("r", range(len(x) - 1, -1, -1))):
        h, c = np.zeros(n), np.zeros(n)
        for t in order:
            z = x[t] @ w[f"x{side}"] + w[f"b{side}"] + h @ w[f"h{side}"]
            i, f, o = (1 / (1 + np.exp(-z[k * n : (k + 1) * n])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * n :])
            h = o * np.tanh(c)
            total[t] += float(np.ravel(h @ w[f"o{side}"])[0])
    (got,) = html_main.label([html_main.gates(found, known, w)], w)
    assert list(got) == list(total > 0) and 0 < got.sum() < len(got)


def test_extraction(spark):
    page = "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy now</div><article><h1>Head &amp; tail</h1><p><b>First\n  line.<br><p>Second <i>one</i>.</p></article><div class='comments'><p>I agree</p></div><footer>&copy; x</footer>"
    clash = ("text", "n_chars", "html_", "path", "words", "blocks")
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<<< & <a <p"), (None, None, page), (1, "u", page)]
    table = spark.createDataFrame([(*r, *clash) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in clash))
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_main.extract(table).collect() if r.page_id != 4)
    text = "Head & tail\nFirst line.\nSecond one."
    assert got == [(0, None, text, len(text)), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, "v", "", 0), (3, None, "", 0)]
    assert html_main.extract(table.limit(0)).count() == 0


def test_query_equals_one_page_at_a_time(spark):
    """Brute force: every page read and labelled alone, in plain Python."""
    from minutary.llm import queries

    folder, known, w = "/root/testdata/sf0.01", {}, html_main.load_weights()
    want = []
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        found = html_main.blocks(r.html or "", known)
        (marks,) = html_main.label([html_main.gates(found, known, w)], w)
        text = "\n".join(t for (_, t, _), m in zip(found, marks) if m)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(tuple(x) for x in queries.op10_block_labeller(spark, folder).collect()) == sorted(want)


def test_whole_text_of_long_pages():
    body = "".join(f"<p>Sentence number {k} of the story.</p>" for k in range(9000))
    got = labelled(f"<body><nav>Menu</nav><article>{body}</article></body>")
    assert [m for _, m in got] == [False] + [True] * 9000


def test_batches_keep_rows_and_bounds():
    import pyarrow as pa

    whole = pa.record_batch({"x": ["a" * 100] * 1000})
    parts = list(common.batches([whole, whole.slice(0, 0)], 64, 10_000))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) <= 100
