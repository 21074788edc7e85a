"""Hard negatives, whitening and page text against brute force."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hangarlog.llm import hard_negatives, html_text, queries, whitening
from llm_helpers import prose

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, score string, n string, key string"


# ---- hard negatives --------------------------------------------------------

def vector_rows(n, seed=1, dim=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dim)] if i % 5 else [0.5, -0.25] + [0.125] * (dim - 2)  # many equal vectors
        rows.append([i, v, rng.choice([0, 0, 0, 1, 2])])
    nan, inf = float("nan"), float("inf")
    odd = [[n + 1, None, 1], [n + 2, [nan] * dim, 1], [n + 3, [inf] + [0.0] * (dim - 1), 1], [n + 4, [None] + [0.0] * (dim - 1), 1], [n + 5, [1.0] * (dim + 1), 1],
           [n + 6, [0.1] * dim, None], [None, [0.1] * dim, 1], [n + 7, [], 1], [n + 8, [3e30] * dim, 1], [n + 9, [0.0] * dim, 0], [6, [9.0] * dim, 0]]
    return [tuple(r) + ("a", "b", "c", "d") for r in rows + odd + [rows[2], rows[10]]]


def integers_of(rows, dim=7):
    kept = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or len(v) != dim or any(e is None or not np.isfinite(e) or abs(e) > 1e6 for e in v):
            continue
        kept.append((i, label, tuple(int(np.floor(256 * float(np.float32(e)))) for e in v)))
    return kept


@pytest.mark.parametrize("block", [64, 8192])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "SEEDS", 4)
    rows = vector_rows(400)
    got = hard_negatives.mine_negatives(spark.createDataFrame(rows, VECTORS), F.col("label"), F.col("vec_id") % 6 == 0)
    want, kept = [], sorted(set(integers_of(rows)), key=str)
    for i, label, q in kept:
        if i % 6:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, x)), j, m) for j, m, x in kept if j != i)
        for minus, j, _ in [r for r in near if r[2] == label][:5]:
            fits = [(j2, -s2) for s2, j2, m in near if m != label and 50 * -minus <= 100 * -s2 <= 95 * -minus][:3]
            want += [(i, j, k + 1, j2, -minus, s2) for k, (j2, s2) in enumerate(fits)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert hard_negatives.mine_negatives(spark.createDataFrame([], VECTORS), F.col("label"), F.col("vec_id") % 6 == 0).collect() == []


def test_intervals_hold_the_true_score_and_prune():
    draw = np.random.default_rng(3)
    x = np.floor(256 * draw.normal(size=(3000, 64)) / 8).astype(np.int64)
    x[5] = 0
    block = hard_negatives.Block(hard_negatives.Rotation(64), np.arange(3000), np.zeros(3000), x)
    at, left = np.arange(3000), []
    for q in (x[0], x[5], 3 * x[7], np.ones(64, dtype=np.int64)):
        estimate, reach = block.intervals(q.astype(np.float64), at)
        assert (np.abs(estimate - x @ q) <= reach).all()
        left.append((estimate + reach >= np.sort(x @ q)[-5]).mean())
    assert left[0] < 0.6 and left[3] < 0.6
    huge = hard_negatives.Block(hard_negatives.Rotation(64), np.arange(3000), np.zeros(3000), x << 20)  # beyond what doubles hold exactly
    assert (huge.scores(x[0] << 20, at) == (x << 20) @ (x[0] << 20)).all() and huge.exact is None


# ---- whitening -------------------------------------------------------------

@pytest.mark.parametrize("weight", ["one", "count"])
def test_whitening_against_numpy(spark, weight):
    rows = vector_rows(300)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), 4, weight).collect()
    kept = [(i, tuple(int(np.floor(256 * float(np.float32(e)))) for e in v)) for i, v, *_ in rows
            if v and len(v) == 7 and all(e is not None and np.isfinite(e) and abs(e) < 1e6 for e in v)]
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in kept)
    distinct = sorted({x for _, x in kept})
    w = np.array([sum(x == y for _, y in kept) if weight == "count" else 1 for x in distinct])
    x, n = np.array(distinct), int(w.sum())
    sums = (x * w[:, None]).sum(axis=0)
    c = x - sums / n
    values, basis = np.linalg.eigh((c * w[:, None]).T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    by_vector = dict(zip(distinct, c @ basis[:, :4] / np.sqrt(values[:4])))
    of = {}
    for i, v in kept:
        of.setdefault(i, set()).add(v)
    signs = None
    for r in got:
        options = of[r.vec_id]
        v = next(v for v in options if len(options) == 1 or sum((n * a - int(s)) ** 2 for a, s in zip(v, sums)) == r.deviation)
        assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
        want = by_vector[v]
        signs = np.sign(want * r.whitened) if signs is None else signs
        assert np.allclose(r.whitened, signs * want, atol=1e-9)
        assert np.allclose(r.explained, values[:4] / values.sum()) and r.identity_error < 1e-10


def test_whitening_without_variance(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, "", "", "", "") for r in rows], VECTORS)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None), (2, [])])).collect() == []
    same = whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, [], [], None)] * 3
    line = whitening.whiten(make([(1, [0.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0])])).collect()
    assert all(len(r.whitened) == 1 and r.identity_error < 1e-9 for r in line)
    far = whitening.whiten(make([(1, [0.0, 0.0]), (2, [2.0 ** 31, 0.0])])).collect()  # a deviation beyond a long
    assert {r.deviation for r in far} == {None}
    with pytest.raises(ValueError, match="weight"):
        whitening.whiten(make([]), weight="some")


def test_whitening_query_has_the_columns_asked_for(spark):
    out = queries.op12_whitening(spark, FOLDER)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet").num_rows
    assert out.count() == 4 * rows and out.groupBy("component").count().count() == 4


# ---- page text -------------------------------------------------------------

PAGES = "page_id long, url string, html string, text string, host string, main string, id string, texts string"


def texts_of(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], PAGES)
    return {r.page_id: r.text for r in html_text.main_text(frame).collect()}


def plain(source):
    return html_text.dissect(source)[1]


@pytest.mark.parametrize("source, want", [
    ("", []), ("just text &amp; more", ["just text & more"]), ("<p>a  b\n c</p><p></p><p>d&nbsp;e", ["a b c", "d e"]),
    ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", ["T", "one", "two"]),
    ("<nav>n</nav><header>h<h1>site</h1></header><main><p>m</p><form>f<input></form></main><aside>a</aside>", ["m"]),
    ("<script>var t='</p><p>x</p>'</script><style>p{}</style><p>y</p><!-- c --><!--><p>z<!-- open", ["y", "z"]),
    ("<p>1 < 2 and 3 > 2, &lt;p&gt; &#233; &copy 5</p>", ["1 < 2 and 3 > 2, <p> é © 5"]),
    ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><div class='has-sidebar'><article>x</article></div><div class='comments'><article>r</article></div>", ["x"]),
    ("<article><header><h1>T</h1><p>by</p></header>b<div class='share'>s</div><div class=ad>q</div><ul><li>i<li>j</ul><footer>f</footer></article>", ["T", "b", "i", "j"]),
    ("<table><tr><td>a<td>b<tr><th>c</th><td>d</table>", ["a b", "c d"]),
    ("<form><article><p>asp</p></article></form>", ["asp"]),
    ("<div class='widget'><article><p>odd wrapper</p></article></div>", ["odd wrapper"]),
    ("<title>t</title><article>a</article>", ["a"]), ("<head><title>t</title><article>a", ["a"]),
    ("<p title='a>b' x=\"c>d\">e</p><p title=it's>f</p><p \"", ["e", "f"]),
    ("<article>one<span>two</span> <i>th</i>ree<span class=ad>q</span></article>", ["onetwo three"]),
    ("<ARTICLE>A<BR>B</ARTICLE>", ["A B"]), ("<p>x</p></div></article>", ["x"]), ("<>", ["<>"]), ("a<", ["a<"]), ("a<b", ["a"]),
    ("<article><p>a</p><section class=comments><article>c</article></section></article>", ["a"]),
    ("<textarea><p>x</p></textarea><noscript>on</noscript><p>y<select><option>1<option>2</select>z</p>", ["yz"]),
])
def test_main_text_of_one_page(source, want):
    assert plain(source) == want


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>x" * 20_000
    assert plain(deep) == ["x"] * 20_000
    assert len(plain("<p>" + "word " * 200_000)[0]) == 5 * 200_000 - 1
    assert plain("<a " * 20_000 + "<p \"" * 20_000) == []
    assert plain("<" * 50_000) == ["<" * 50_000]


def test_templates_of_a_site_go_and_prose_stays(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        body = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(3))
        site = "<div>Our shop opens at nine</div>"
        rows.append((i, f"https://A.example/{i}", f"<body>{site}<div>{body}</div><p>Call us</p></body>"))
        rows.append((100 + i, f"https://b.example/{i}", f"<body>{site}<article>{body}<p>the same line everywhere</p><div>Read our letter</div></article></body>"))
    rows += [(200 + i, None, "<div>Our shop opens at nine</div>") for i in range(9)]
    rows += [(300 + i, "http://c.example", "<article><div><p>copied article</p></div></article><p>tail</p>") for i in range(30)]
    rows += [(400, "http://c.example", None), (401, None, ""), (None, "x", "<p>no name</p>"), (402, "http://d.example", "<p>only page</p>")]
    got = texts_of(spark, rows)
    assert len(got) == len(rows)
    for i in range(40):
        want = [html.unescape(p) for p in re.findall("<p>(.*?)</p>", rows[2 * i][2])]
        assert got[i] == "\n".join(want[:3])
        assert got[100 + i] == "\n".join([*want[:3], "the same line everywhere"])
    assert all(got[200 + i] == "Our shop opens at nine" for i in range(9))  # no host, no site
    assert all(got[300 + i] == "copied article" for i in range(30))
    assert got[400] == "" and got[401] == "" and got[None] == "no name" and got[402] == "only page"
    assert html_text.main_text(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_page_query_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", most)
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r.page_id: r for r in queries.op13_html_text(spark, "/root/testdata/sf0.01").collect()}
    for page in pages:
        article = re.search(r"(?s)<article>(.*)</article>", page["html"])[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", article)]
        r = got.pop(page["page_id"])
        assert r.text == "\n".join(b for b in blocks if b) and r.url == page["url"] and r.n_chars == len(r.text)
    assert not got
