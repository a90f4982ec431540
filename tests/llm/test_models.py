import itertools
import random

import numpy as np
import pytest

from placelore.llm import htmltree, langid, toxicity
from placelore.llm.letters import Letters, subwords, trigrams

LANGUAGES = {"xa": "ba be bi bo bu da de di do du".split(), "xb": "krä krö strü schlö pfä kno bru".split(), "xc": "ñi llo ció que ez jar rro".split()}


def text(rng, lang, words=60):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def language_rows():
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang, 1) for i, lang in enumerate(rng.choices(list(LANGUAGES), k=240))]
    return rows + [(1000, None, "xa", 1), (1001, "", "xb", 1), (1002, "123 --- 456", None, 1), (1003, text(rng, "xa", 40) + " " + text(rng, "xc", 60), None, 1), (1004, "ba", None, 1), (None, text(rng, "xb"), None, 1)]


SCHEMA = "doc_id long, text string, lang string, score int"


def test_language_mixture(spark, language_rows):
    found = langid.identify(spark.createDataFrame(language_rows + language_rows[:3], SCHEMA)).collect()
    assert len(found) == len(language_rows) + 3
    by = {r.doc_id: r for r in found}
    truth = {d: lang for d, _, lang, _ in language_rows if d is not None and d < 1000}
    assert all(by[d].lang_pred == lang for d, lang in truth.items())
    assert [by[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    mixed = by[1003].languages
    assert by[1003].lang_pred == "xc" and set(mixed) == {"xa", "xc"} and abs(mixed["xa"] - 0.4) < 0.08 and abs(by[1003].score - 0.6) < 0.08
    assert by[None].lang_pred == "xb" and by[None].held_out
    assert all(0 <= r.score <= 1 for r in found) and {r.held_out for r in found} == {True, False}


def test_mixture_of_four_languages(spark):
    rng = random.Random(4)
    words = LANGUAGES | {"xd": "wyx zuv qop fyg hij".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 60), lang, 1) for i, lang in enumerate(rng.choices(list(words), k=240))]
    rows.append((1000, " ".join(make(lang, n) for lang, n in zip(words, (80, 60, 50, 40))), None, 1))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}[1000]
    assert set(got.languages) == set(words) and got.lang_pred == "xa" and abs(got.score - 80 / 230) < 0.05 and abs(got.languages["xd"] - 40 / 230) < 0.05


def test_language_without_anything_to_learn(spark):
    found = langid.identify(spark.createDataFrame([(1, "some text", None, 1)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_stay_where_nothing_could_be_learned(spark):
    rows = [(1, "some text", None, 1), (2, "12 --", None, 1), (3, None, None, 1), (4, "", None, 1), (None, "more text", None, 1), (1, "some text", None, 1)]
    kept = langid.drop_unknown(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in kept) == ["more text", "some text", "some text"]
    assert langid.drop_unknown(spark.createDataFrame([(None, "some text", "xa", 1)], SCHEMA)).count() == 1  # the only labelled row is held out


def test_mixture_proportions_maximise_the_likelihood():
    rng = np.random.default_rng(0)
    like = rng.random((50, 2))
    share, total = langid.mixture(like, np.array([0]), np.ones((1, 2)), rounds=500, close=1e-9)
    grid = [np.log(like @ [a, 1 - a]).sum() for a in np.linspace(0, 1, 2001)]
    assert total[0] >= max(grid) - 1e-4 and abs(share.sum() - 1) < 1e-9


def test_letters_against_plain_loops():
    texts = ["Ab, cÉ d", None, "", "\0x", "İz 9"]
    letters = Letters(texts)
    words = ["".join(chr(c) for c in letters.codes[a:b].tolist()) for a, b in zip(letters.begins, letters.ends)]
    assert words == ["ab", "cé", "d", "x", "i", "z"] and letters.doc.tolist() == [0, 0, 0, 3, 4, 4]
    assert len(trigrams(letters, 10)) == sum(map(len, words))
    h, at = subwords(letters, 3, 5, 18)
    assert np.diff(at).tolist() == [1 + sum(max(len(w) + 2 - n + 1, 0) for n in (3, 4, 5)) for w in words]
    one, where = subwords(Letters(["zz cé"]), 3, 5, 18)
    assert set(one[where[1]:where[2]].tolist()) == set(h[at[1]:at[2]].tolist())


def toxic_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = text(rng, "xa", rng.randint(5, 80)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = "zorgwick" + rng.choice(["", "s", "ing", "ed"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_finds_misspellings(spark):
    rows = toxic_rows(2)
    docs = spark.createDataFrame([(d, t, "xa", 5) for d, t, _ in rows] + [(900, None, "x", 1), (901, "", "x", 1), (902, "dudi zorgwikk bado zorgwich ba zorrgwicks", "x", 1), (3, rows[3][1], "x", 1), (None, "ba be", "x", 1)], SCHEMA)
    labels = spark.createDataFrame([(d, bad, bad) for d, _, bad in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, score int")
    found = toxicity.classify(docs, labels, max_rows=200).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + 5
    right = [by[d].predicted == bad for d, _, bad in rows if by[d].held_out]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == 0 and by[None].held_out
    assert all(0 <= r.score <= 1 for r in found)


def test_toxicity_with_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "x", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(docs, labels).collect()} == {0}
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.classify(docs.limit(0), labels).collect() == []


@pytest.fixture(scope="module")
def tree_model():
    return htmltree.train(htmltree.labelled())


def test_marginals_are_those_of_all_states(tree_model):
    forest = htmltree.Forest([htmltree.Page("<nav><ul><li>a</ul></nav><article><p>b<p>c</article>")])
    p, both = htmltree.marginals(tree_model, forest)
    n = len(forest.parent)
    own = np.bincount(forest.node, tree_model.unary[forest.feature], minlength=n)
    total, sums, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in itertools.product((0, 1), repeat=n):
        s = np.array(state)
        w = np.exp((own * s).sum() + sum(tree_model.pair[forest.kind[i], s[forest.parent[i]], s[i]] for i in range(n) if forest.parent[i] >= 0))
        total, sums = total + w, sums + w * s
        for i in range(n):
            if forest.parent[i] >= 0:
                pairs[i, s[forest.parent[i]], s[i]] += w
    assert np.allclose(p, sums / total) and np.allclose(both[forest.parent >= 0], (pairs / total)[forest.parent >= 0])


def test_held_out_pages(tree_model):
    forest = htmltree.Forest(htmltree.labelled(150, seed=5))
    p, _ = htmltree.marginals(tree_model, forest)
    y = np.array([x or 0 for x in forest.labels])
    assert ((p >= 0.5) == y)[forest.is_text].mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><div class='cookie-notice'>We use cookies
<button>OK</button></div><div class=wrapper><div class=sidebar><p>some longer text beside the article, about many things</p></div><div id=content><h1>Title &amp; more</h1>
<p>First&nbsp; para <b>bo</b>ld.<script>var x="<p>no</p>"</script><p>Second<br>line<!-- <p>no</p> --><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><label>Name</label><input></form><p>Short.</p></div>
<div class=comments><h3>Comments</h3><p>A reader writes a comment that has quite a number of words in it, more than most.</p></div></div><footer>&copy; x</footer></body></html>"""


def test_main_text(spark, tree_model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "u", "<article><h1>A&lt;b</h1><p>x y z words are here</article"), (4, "u", "<p" * 50), (5, "u", "<article>" + "<div>" * 4 + "deep text stands in here" + "</div>" * 4), (6, "u", "<div>" * 3000 + "far down" + "</div>" * 3000)]
    got = htmltree.main_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string"), tree_model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Title & more\nFirst para bold.\nSecond line\none\ntwo\na\nb\nShort."
    assert by[2] == by[3] == by[4] == "" and by[None] == "A<b\nx y z words are here" and by[5] == "deep text stands in here"
    assert all(r.n_chars == len(r.text) for r in got)


LONG = "some longer text that stands in here and tells about many things of the world, with more words to read. " * 2


def test_text_in_shapes_that_training_pages_do_not_name(tree_model):
    """Unknown names, many wrappers, no content element, no markup: the text stays; what is around it goes."""
    menu, foot = "<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav>", "<footer><p>About us</p></footer>"
    shapes = ["{}", "<p>{}</p>", "<div>" * 12 + "<p>{}</p>" + "</div>" * 12, "<article><div><div><div>{}</div></div></div></article>",
              menu + "<div class=qwe><div class=rty><p>{}</p></div></div>" + foot, menu + "<div id=zz9><section class=body-copy><p>{}</p></section></div><div class=sidebar><p>More</p></div>" + foot]
    found = htmltree.extract(tree_model, [s.format(LONG) for s in shapes])
    assert [x == LONG.strip() for x in found] == [True] * len(shapes)


@pytest.mark.xfail(reason="a lone paragraph under one unknown class is still taken for a side region (README)")
def test_lone_paragraph_under_an_unknown_class(tree_model):
    assert htmltree.extract(tree_model, [f"<html><body><div class=prose><p>{LONG}</p></div></body></html>"]) == [LONG.strip()]


def test_label_attribute_of_an_ordinary_page(spark, tree_model):
    page = "<html><body><nav><a href=x>Home</a></nav><article{}><h1>Prices</h1><p>{}</p><table><tr><td{}>12</td><td{}>13</td></tr></table></article></body></html>"
    text = "some longer text that stands in the article, about many things and their prices"
    plain = page.format("", text, "", "")
    marked = [page.format("", text, ' data-label="Amount"', " data-label"), page.format(" data-label=0", text, " data-label='1st'", ' data-label=""')]
    rows = [(i, "u", s) for i, s in enumerate([plain, *marked])]
    got = htmltree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), tree_model).collect()
    assert len(got) == 3 and {r.text for r in got} == {f"Prices\n{text}\n12\n13"}
    assert all(x is None for s in marked for x in htmltree.Page(s).label)


def test_parser_closes_what_html_leaves_open():
    page = htmltree.Page("<p>a<div>b</p>c</div><ul><li>d<ul><li>e</ul><li>f</ul><b>g<p>h</b>i")
    assert [t for t in page.text if t] == ["a", "b", "c", "d", "e", "f", "g", "hi"]


def test_empty_pages_table(spark, tree_model):
    assert htmltree.main_text(spark.createDataFrame([], "page_id long, url string, html string"), tree_model).collect() == []


def test_filters_judge_little_text_at_a_time(spark):
    from placelore.llm.common import JUDGED_BYTES, keep_rows

    # arrays of a judge are many times its text, and an executor holds several workers: 3,039 of 3,000 MB with slices of 1 MB
    docs = spark.createDataFrame([(i, "ab " * 10_000) for i in range(40)], "doc_id long, text string").coalesce(1)
    most = 2 * JUDGED_BYTES
    assert most <= 1 << 19
    kept = keep_rows(docs, lambda texts: np.full(len(texts), sum(map(len, texts)) <= most))
    assert kept.count() == 40
