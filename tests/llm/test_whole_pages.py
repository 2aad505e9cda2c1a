"""Odd pages lose nothing."""

import pytest

from ledgerlens.llm import html


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>a</p><svg class="i"/><p>article text</p><p>more</p>', ["a", "article text", "more"]),
        ('<p>a <svg title="1 > 0" /> b</p><svg><text>no</text></svg><p>c', ["a b", "c"]),
        ('<p>a</p><video-player src="x"></video-player><p>article</p>', ["a", "article"]),
        ("<p>a</p><object data=x><p>article</p>", ["a", "article"]),
        ("<p>a</p><video>no</video><p>b</p><video>c", ["a", "b", "c"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let x=1 be"]),
        ("<p>a</p><script>never </p> closed", ["a"]),
        ("<p>a</p><noscript><p>b</p></noscript><p>c <object data=x>d</object> e</p>", ["a", "b", "c d e"]),
        ("<article><object><p>a</p></object><noscript>b</noscript></article>", ["a", "b"]),
    ],
)
def test_raw_elements_take_no_more_than_their_content(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_many_unclosed_elements():
    assert len(html.blocks("<video><p>a</p>" * 20_000)) == 20_000


def test_paragraphs_of_an_article_stay_whatever_holds_them():
    extractor = html.Extractor(html.trained())
    text = "Some words of the article, which are as long as others are. They go on for a second sentence."
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{text}</p><noscript><p>{text} One.</p></noscript><object><p>{text} Two.</p></object><p>Euler wrote <math>e=1</math> once. {text}</p></article><footer>Imprint</footer></body>"
    assert extractor.text(page).split("\n") == ["Title of it", text, f"{text} One.", f"{text} Two.", f"Euler wrote e=1 once. {text}"]
