"""Clustering, page text and fill-in-middle against plain versions on small rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from panelworks.llm.centroid_clustering import centroid_clustering, choose_pivots, nearest, pivot_distances
from panelworks.llm.fill_in_middle import fill_in_middle, restore_middle
from panelworks.llm.html_extraction import extract_text, main_text

# ---- clustering


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centroids = [v for _, v in sorted(kept, key=mark)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), x in zip(kept, of, strict=True) if x == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    d = [square(v, centroids[c]) for (_, v), c in zip(kept, of, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, x, sum(y for y, b in zip(d, of, strict=True) if b == c), sum(d), sha[c]) for (i, _), c, x in zip(kept, of, d, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")


def test_clustering_equals_plain(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(150)]
    rows += [(200, None), (201, [1.0] * 7), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, []), (205, [float("inf")] * 8)]
    rows += [(i, rows[0][1]) for i in range(300, 380)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, [0.0] * 8), (401, [-0.001] * 8)]
    got = centroid_clustering(vectors(spark, rows), k=9, rounds=3, dims=8, pivots=4)
    assert sorted((str(r.vec_id), *r[1:]) for r in got.rows.collect()) == plain_clusters(rows, 9, 3, 8)
    assert got.rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert 0 < got.exact < got.full


def test_clustering_small_and_large_values(spark):
    assert centroid_clustering(vectors(spark, [])).rows.count() == 0
    few = [(i, [float(i)] * 8) for i in range(3)]
    assert sorted((str(r.vec_id), *r[1:]) for r in centroid_clustering(vectors(spark, few), dims=8).rows.collect()) == plain_clusters(few, 40, 5, 8)
    same = [(i, [0.5] * 8) for i in range(30)]  # all first centroids are equal: the first takes everything
    assert {r.cluster for r in centroid_clustering(vectors(spark, same), k=5, dims=8).rows.collect()} == {0}
    huge = [(1, [1e300] * 8), (2, [-1e300] * 8), (3, [1.0] * 8)]
    assert all(r.distance >= 0 for r in centroid_clustering(vectors(spark, huge), k=2, dims=8).rows.collect())


@pytest.mark.parametrize("seed", range(5))
def test_bounds_never_lose_the_nearest(seed):
    rng = np.random.default_rng(seed)
    v, c = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (20, 16))
    c[7] = c[3]  # ties go to the smaller number
    v[:20] = c
    pivots = choose_pivots(c, 6)
    cluster, distance, made = nearest(v, pivot_distances(v, pivots), c, pivot_distances(c, pivots))
    full = ((v[:, None, :] - c[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all() and made <= full.size


# ---- fill-in-middle


def plain_middle(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain(spark):
    rng = random.Random(3)
    letters = "ab <>PSM\n\x00é語😀"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (3, "again"), (3, "again"), (1002, "語" * 1_500_000), (1003, "<"), (1004, "<S<S"), (1005, "x<M>y"), (1006, "<P"), (1007, "S>")]
    d = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    made = fill_in_middle(d)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(((str(r[0]), *r[1:]) for r in restore_middle(made).collect()), key=str)
    assert got == sorted(((str(i), *plain_middle(i, t), t or "") for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(d.limit(0)).count() == 0 and restore_middle(made.limit(0)).count() == 0


def test_restoring_odd_rows(spark):
    rows = [("psm", "<P>a<S>b<M>c"), ("psm", "<S>b<P>a<M>c"), ("spm", "<S>b<P>a<M>c"), ("psm", "<P>a<S>b"), ("psm", "<P><P>a<S>b<M>c"), ("psm", "x<P>a<S>b<M>c"), ("other", "a"), ("plain", "a<P>"), (None, "a"), ("plain", None), ("psm", "")]
    got = [r.restored for r in restore_middle(spark.createDataFrame(rows, "form string, output string").coalesce(1)).collect()]
    assert got == ["acb", None, "acb", None, None, None, None, "a<P>", None, None, None]


# ---- page text

ONE = "The first part of the story is about a river that runs to the sea and the people who live by it."
TWO = "In the second part the author says that it was not the first time that this had been tried."
PAGES = {
    f"<div id=top>My Site</div><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul><div><h2>Title</h2><p>{ONE}<p>Short one.</p><p>{TWO}</div><div><a href=x>Next story</a> | <a href=y>Previous</a></div><div>Copyright &copy; 2020</div>": f"Title {ONE} Short one. {TWO}",
    f"<main><h1>T</h1><p>{ONE}</p></main><section id='comments'><h3>2 comments</h3><article><p>{TWO}</p></article></section>": f"T {ONE}",
    f"<article><h1>T</h1><p>{ONE}</p><article class=c><p>{TWO}</p></article></article>": f"T {ONE}",
    f"<form><nav>a b</nav><article><p>{ONE}</p></article><label>Name</label><input></form>": ONE,
    f"<div class='cookie-banner'><p>{TWO}</p><button>OK</button></div><article><header><h1>Head</h1></header><p>a&nbsp;b &lt;c&gt; &#233;&eacute;</p></article><aside>{TWO}</aside>": "Head a b <c> éé",
    "<nav><a href=x>Home</a></nav><article><p>Be.</p></article><footer>x</footer>": "Be.",
    "<div class=header>Site</div><div class='post-content'><p>Hi there.</p></div><div class=sidebar>More</div>": "Hi there.",
    "Just text &amp; more < 5": "Just text & more < 5",
    "a<!-- b": "a",
    "<p>one<p>two<a hre": "one two",
    '<p>one</p><a href="x>two</a><p>three</p>': "one three",
    "<p>foo<b>bar</b>baz<br>q<span> w</span></p>": "foobarbaz q w",
    f"<p>{ONE} <span class='ad'>Buy <b>now</b></span> end.</p>": f"{ONE} end.",
    f"<body class='has-sidebar'><div class='page with-comments'><p>{ONE}</p></div>": ONE,
    f"<table><tr><td>{ONE}<td>{TWO}</table>": f"{ONE} {TWO}",
    f"<div hidden>{ONE}</div><p>{TWO}": TWO,
    f"<div class='wrapper sidebar'><main><p>{ONE}</p></main></div>": ONE,
    f"<article><p>{ONE}</p><p><a href=x>Read the other story</a></p><div class='notice'>{TWO}</div></article>": ONE,
    f"<script>if (a < b) '</p>'</script><style>p {{}}</style><p>{ONE}</p><script>never closed <p>{TWO}": ONE,
    "<nav>Home</nav><footer>Imprint</footer>": "",
    "<<<>>> </ > <": "<<<>>> <",
}


def test_pages():
    for page, text in PAGES.items():
        assert main_text(page) == text, page


def test_undecided_blocks_inherit():
    """Short blocks have no label of their own: they are text beside text and boilerplate beside boilerplate."""
    low = "zq wx vb nm kj hg fd sa po iu yt re wq az sx dc fv gb hn jm"
    page = f"<div><p>{low}</p><p>Near low.</p></div><div><p>Near text.</p><p>{ONE}</p><p>{TWO}</p><p>The end.</p></div>"
    assert main_text(page) == f"Near text. {ONE} {TWO} The end."


def test_extract_text_rows(spark):
    long = "<article>" + f"<p>{ONE}</p>" * 20_000 + "<a " * 20_000 + "</article>"
    rows = [(1, "u", f"<p>{ONE}</p>"), (1, "u", f"<p>{ONE}</p>"), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 50_000 + ONE), (4, "x", long), (5, "y", "<a '" * 30_000)]
    d = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(extract_text(d).collect(), key=str)
    assert extract_text(d).columns == ["page_id", "url", "text", "n_chars"]
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 7 and texts[1] == ONE and texts[2] == "" and texts[None] == "" and texts[3] == ONE and texts[4] == " ".join([ONE] * 20_000) and texts[5] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(d.limit(0)).count() == 0
