"""HTML extraction: the parser on odd mark-up, held-out accuracy, and the random field against enumeration."""

import itertools

import numpy as np
import pytest
from siftwell.llm import html


@pytest.fixture(scope="module")
def model():
    return html.default_model()


def test_blocks():
    page = "<p>&lt;c&gt; d<script>x</p></script><table><tr><td>l<td>m</table>&eacute;&#233;<div>n</div><select><option>no</select><!-- no --><textarea>no</textarea>p"
    assert [b[0] for b in html.leaf_blocks(page)] == ["<c> d", "l", "m", "éé", "n", "p"]
    assert [b[0] for b in html.leaf_blocks("<p>a&amp;b\n <p>e<br>f <b>g</b>h<ul><li>i<li>j</ul>k")] == ["a&b", "e f gh", "i", "j", "k"]
    assert [b[0] for b in html.leaf_blocks("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> says</p>")] == ["as x=2 says"]
    assert html.leaf_blocks(None) == [] == html.leaf_blocks("") == html.leaf_blocks("<script>x")


def test_training_and_viterbi_against_enumeration():
    r = np.random.RandomState(0)
    scores, trans, first = r.randn(1, 5, 2), r.randn(2, 2), r.randn(2)
    gamma, pairs, z = html._forward_backward(scores, np.ones((1, 5), bool), trans, first)
    value = lambda y: first[y[0]] + sum(scores[0, i, y[i]] for i in range(5)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
    ways = {y: np.exp(value(y)) for y in itertools.product(range(2), repeat=5)}
    total = sum(ways.values())
    assert np.isclose(z[0], np.log(total))
    assert np.allclose(gamma[0, :, 1], [sum(p for y, p in ways.items() if y[i]) / total for i in range(5)])
    assert np.isclose(pairs[0, 1], sum(p * sum((a, b) == (0, 1) for a, b in zip(y, y[1:])) for y, p in ways.items()) / total)


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_against_enumeration(seed):
    r = np.random.RandomState(seed)
    word = lambda: "".join(r.choice(list("abc.,|"), r.randint(1, 7)))
    blocks = [(" ".join(word() for _ in range(r.randint(1, 30))), float(r.rand()), (("div", (word(),)),)) for _ in range(r.randint(1, 9))]
    w, trans, first = r.randn(html.FEATURES, 2), 2 * r.randn(2, 2), r.randn(2)
    scores = [w[html.features(b)].sum(0) for b in blocks]
    value = lambda y: first[y[0]] + sum(s[k] for s, k in zip(scores, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
    best = max(itertools.product(range(2), repeat=len(blocks)), key=value)
    assert html.decode(blocks, (w, trans, first)) == [bool(k) for k in best]


def test_extract_is_enumeration_over_blocks(spark, model):
    pages = [(i, "u", p) for i, (p, _) in enumerate(html.sample_pages(60, seed=5)) if 0 < len(html.leaf_blocks(p)) <= 13]
    assert len(pages) > 5
    w, trans, first = model
    for r in html.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string"), model).collect():
        blocks = html.leaf_blocks(dict((i, p) for i, _, p in pages)[r.page_id])
        scores = [w[html.features(b)].sum(0) for b in blocks]
        value = lambda y: first[y[0]] + sum(s[k] for s, k in zip(scores, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(2), repeat=len(blocks)), key=value)
        assert r.text == "\n\n".join(b[0] for b, k in zip(blocks, best, strict=True) if k)


def test_held_out_pages(model):
    right = blocks = 0
    for page, main in html.sample_pages(150, seed=99):
        read = html.leaf_blocks(page)
        right += sum(keep == (b[0] in main) for b, keep in zip(read, html.decode(read, model), strict=True))
        blocks += len(read)
    assert right >= 0.97 * blocks


def test_article_alone_stays(spark, model):
    page = (
        "<!DOCTYPE html><html><head><title>t</title></head><body><header>Site</header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<div class=ad>Buy this now, it is very good.</div><article><h1>Head &amp; line</h1><p>First  paragraph, with <a href=x>a link</a> in it.</p><p><b>Second.<br><p>Third paragraph is here.</article>"
        "<aside class=sidebar><p>Popular posts of the week.</p></aside><form><p>Subscribe here</p></form><section id=comments><div class=comment><p>Nice article, thank you.</p></div></section><footer>&copy; Site</footer></body></html>"
    )
    rows = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (None, "", "", 1), (3, "x", "<article><p>" + "long text. " * 200_000 + "</article>", 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"), model).collect()
    text = "Head & line\n\nFirst paragraph, with a link in it.\n\nSecond.\n\nThird paragraph is here."
    assert sorted((r.page_id or 0, r.text if r.page_id != 3 else "", r.n_chars) for r in got) == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 2_199_999)]
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string"), model).count() == 0
