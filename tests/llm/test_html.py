import numpy as np
import pytest

from spectrail.llm import html

PAGES = {
    1: (
        "<html><head><title>T</title><style>x{}</style></head><body><header class=masthead><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>"
        "<article><h1>A &amp; B</h1><p>First  para\n graph &lt;here&gt; with <b>bold</b> words.<p>Second &eacute;t&#233; one, unclosed.<ul><li>item one of a list.</li><li>item two.</ul>"
        "<div class=ad>Buy now</div></article><aside class=sidebar><h3>Related</h3><p>More text to read there.</p></aside>"
        "<div id=comments><div class=comment><p>I like what this says, great post.</p></div></div><script>var t='</p>';</script><footer>&copy; 2024 x &middot; All rights</footer></body></html>",
        "A & B\nFirst para graph <here> with bold words.\nSecond été one, unclosed.\nitem one of a list.\nitem two.",
    ),
    2: (None, ""),
    3: ("", ""),
    4: ("<nav><a href=x>Menu</a></nav>", ""),
}


@pytest.fixture(scope="module")
def net():
    return html.train()


def test_pages(spark, net):
    rows = [(i, "u", h, 0) for i, (h, _) in PAGES.items()] + [(1, None, PAGES[1][0], 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract(df, net).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html.extract(df.limit(0), net).count() == 0


def test_formulas_are_text():
    page = "<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=tex>E=m</annotation></math> is tall.<p>After <svg><text>no</text></svg>it.</article>"
    assert [b.text for b in html.blocks(page)] == ["Energy E=m is tall.", "After it."]


def test_made_pages_that_were_not_learnt(net):
    wrong = total = 0
    for k in range(70_000, 70_080):
        page = html.blocks(html.made_page(k))
        truth = np.array([html.MAIN in b.text for b in page])
        for b in page:
            b.text = b.text.replace(html.MAIN, "").replace(html.OTHER, "").strip() or "-"
        wrong += int(((net.scores([html.vectors(page)])[0] >= 0.5) != truth).sum())
        total += len(page)
    assert wrong / total < 0.02


def test_batches_do_not_change_scores(net):
    pages = [html.vectors(html.blocks(html.made_page(k))) for k in range(80_000, 80_006)]
    for one, many in zip(pages, net.scores(pages), strict=True):
        assert np.allclose(net.scores([one])[0], many, atol=1e-4)


def test_markup():
    text = lambda page: [b.text for b in html.blocks(page)]
    assert text("a<!-- b --><script>c</script>d<br>e") == ["ad", "e"]
    assert text("<p>1 < 2 &amp;&nbsp;3<p title='a>b'>x</p>y") == ["1 < 2 & 3", "x", "y"]
    assert text("<script>never closed") == [] and text("<p") == [] and text("x<!-- y") == ["x"]
    assert text("<p>a" * 3000)[-1] == "a"


def test_long_pages_take_time_in_proportion():
    import time

    began = time.process_time()
    deep = html.blocks("<div class=x>word " * 50_000)
    assert len(deep) == 50_000 and deep[-1].path.depth == 49_999
    x, _, _ = html.Labeller().inputs([html.vectors(deep)])
    mixed = html.blocks("".join(f"<div class='{'a b ' * 20}'><b>x<td><table><li>" for _ in range(10_000)))
    assert len(mixed) == 10_000 and x.shape[0] == 50_000
    assert time.process_time() - began < 10


def test_every_name_of_an_attribute_is_read():
    names = " ".join("abcdefghijklmnopqrstuvwxyz"[k] * 4 for k in range(20))
    (block,) = html.blocks(f"<div class='{names}'>x</div>")
    assert len(block.path.names) == 21


def test_directions_together_are_each_alone(net):
    x, mask, _ = net.inputs([html.vectors(html.blocks(html.made_page(k))) for k in range(5)])
    both = net.both(x, mask)
    for d, cut in (("f", slice(0, html._H)), ("b", slice(html._H, None))):
        assert np.allclose(np.where(mask[:, :, None], both[:, :, cut] - net.states(x, mask, d)[0], 0), 0, atol=1e-5)
