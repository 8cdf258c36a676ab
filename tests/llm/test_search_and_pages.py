"""Nearest neighbours against all pairs, and main text of pages in several templates."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import html_text, nearest
from tidemark.llm.boosting import BoostedTrees

VECTOR = "vec_id bigint, embedding array<float>, label int"


def exact(rows, k=5, divisor=50):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append((i, np.asarray(v, dtype=np.float32).astype(np.float64)))
    out = {}
    for i, v in usable:
        if i % divisor == 0:
            scored = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in usable if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + 0.5 * rng.normal(size=16)).tolist() for _ in range(1500)]
    vectors[200:600] = [vectors[0]] * 400  # a hot group of copies
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR)
    graphs = nearest.index(frame, shard_rows=400)
    assert graphs.selectExpr("count(distinct shard) AS n").first()["n"] > 1
    found: dict[int, list] = {}
    for r in nearest.search(graphs, frame.where("vec_id % 50 = 0"), block=7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = exact(rows)
    assert found.keys() == want.keys() and all([x[2] for x in f] == [1, 2, 3, 4, 5] for f in found.values())
    hits = sum(len({x[0] for x in found[q]} & {x[0] for x in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert [x[0] for x in found[250]] == [0, 200, 201, 202, 203]  # copies: the smallest ids, not its own
    for q, f in found.items():
        for i, score, _ in f:
            a, b = (np.asarray(vectors[k], dtype=np.float32).astype(np.float64) for k in (q, i))
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (50, [0.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTOR)
    got: dict[int, list] = {}
    for r in nearest.search(nearest.index(frame), frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 7, 50], 50: [7, 0, 1]}
    empty = frame.limit(0)
    assert nearest.search(nearest.index(empty), frame.where("vec_id = 0")).count() == 0
    assert nearest.search(nearest.index(frame), empty).count() == 0


def test_pruning_keeps_diverse_edges():
    unit = nearest._unit(np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.11], [1.0, -0.2]]))
    kept = nearest.robust_prune(unit, np.array([0]), np.array([[1, 2, 3, 1, -1, 0]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Not text</title>{head}</head><body>{body}</body></html>"


def sample_pages(n=60):
    rng = np.random.default_rng(2)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    say = lambda k: " ".join(rng.choice(words, k))
    out = []
    for k in range(n):
        title, parts = say(5), [say(int(rng.integers(8, 60))) for _ in range(rng.integers(1, 6))]
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choice(words, 5))
        html = page(
            f'<nav><ul>{menu}</ul></nav><div class="ad">{say(9)}</div><article><h1>{title}</h1>'
            + "".join(f"<p>{p}</p>" for p in parts) + f"</article><footer>&copy; {say(6)}</footer>"
        )
        out.append((k, html, " ".join([title, *parts])))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, f"http://x/{k}", h) for k, h, _ in sample_pages()]
    return html_text.fit(spark.createDataFrame(rows, "page_id bigint, url string, html string"))


def test_main_text_in_known_and_new_templates(spark, model):
    rows = sample_pages()
    frame = spark.createDataFrame([(k, h, "x") for k, h, _ in rows], "page_id bigint, html string, text string")
    got = {r["page_id"]: r["main_text"] for r in html_text.main_text(frame, model).collect()}
    assert all(got[k] == text for k, _, text in rows)
    for k, html, text in rows[:20]:
        assert html_text.extract(model, [html_text.varied(html, 900 + k)]) == [text]
    other = page(
        '<div class="site-header">Site</div><div class="content"><h1>A title</h1><p>First paragraph with quite a few words &amp; more.</p>'
        '<div class="share-buttons">Share</div><p>Second <b>bold</b>er one,&nbsp;\n longer than the first paragraph by some words.</p></div>'
        '<div class="comments"><p>I agree with all of this and more!</p></div><form><p>Your mail</p></form>'
    )
    assert html_text.extract(model, [other]) == [
        "A title First paragraph with quite a few words & more. Second bolder one, longer than the first paragraph by some words."
    ]


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "<p>deep text of a page</p>" + "</div>" * 3000
    long = "<article>" + "<p>words of a long page</p>" * 20_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>a<p>b"), (5, deep), (6, long), (7, "<p>x</p><!-- open"), (7, "<p>x</p><!-- open"),
            (None, "<article><p>no id but some words</p></article>"), (8, "<p>cut <a href='"), (9, "<script>var t='</p>'</script><ul><li>"), (10, "a < b & c &unknown; &#x41;")]
    frame = spark.createDataFrame(rows, "page_id bigint, html string")
    got = [(r["page_id"], r["main_text"]) for r in html_text.main_text(frame, model).collect()]
    found = dict(got)
    assert len(got) == 12 and found[1] == "" and found[2] == "" and found[9] == ""
    assert found[6] == " ".join(["words of a long page"] * 20_000)
    assert found[10] in ("", "a < b & c &unknown; A")
    assert html_text.main_text(frame.limit(0), model).count() == 0
    assert html_text.extract(html_text.fit(frame.limit(0)), ["<p>x</p>"]) in ([""], ["x"])


def test_decoding_is_consistent_along_the_tree(model):
    for _, html, _ in sample_pages(10):
        tree = html_text.parse(html)
        rng = np.random.default_rng(3)
        kept = html_text.decode(tree, rng.normal(0, 3, len(tree.parent)))
        assert len(kept) == len(tree.parent)
    tree = html_text.parse("<div><p>a</p><p>b</p></div>")
    assert html_text.decode(tree, np.array([-9.0, 9.0, 9.0, -0.1]))[2:] == [True, True]  # the section decides
    assert html_text.decode(tree, np.array([-9.0, 0.1, 9.0, -9.0]))[2:] == [True, False]


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.logit(x[2000:]) > 0) == y[2000:]).mean() > 0.95
