import time

import pytest

from folio.llm import htmltext as H


@pytest.fixture(scope="module")
def trees():
    return H.trained()


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>'
    '<div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>First paragraph, with some words in it.<br><p>Second  one\n here. It has two sentences.</p>'
    "<ul><li>item one</li><li>item two</li></ul></article><footer>&copy; x &middot; y</footer>"
)


def test_article_text(trees):
    want = "Title & more\nFirst paragraph, with some words in it.\nSecond one here. It has two sentences.\nitem one\nitem two"
    assert H.extract([PAGE, None, "", "plain  text"], trees) == [want, "", "", "plain text"]
    assert H.extract([PAGE + "</body></html>"], trees) == [want]


def test_held_out_pages(trees):
    nodes = H.Nodes()
    g = H.Generator(1234)
    for k in range(150):
        H.parse(g.page(), k, nodes)
    marks = [H.CONTENT_MARK in run for _, run in nodes.runs]
    clean = [(i, run.replace(H.CONTENT_MARK, "").replace(H.OTHER_MARK, "")) for i, run in nodes.runs]
    nodes.runs = clean
    keep = H.decode(nodes, trees.predict(H.features(nodes)))
    right = sum(keep[i] == m for (i, _), m in zip(clean, marks, strict=True))
    assert right / len(marks) > 0.985


def test_no_contradictions(trees):
    """A subtree that was cut as a whole has one answer for all its nodes."""
    nodes = H.Nodes()
    H.parse(PAGE, 0, nodes)
    keep = H.decode(nodes, trees.predict(H.features(nodes)))
    nav = next(i for i, t in enumerate(nodes.tag) if t == H.CODE["nav"])
    assert not any(keep[nav : nodes.end[nav]])


@pytest.mark.parametrize("page", ["<p>" * 3000 + "x", "<div><span>" * 500, "<!-- open <p>a</p>", "<script>var a='<p>x</p>'", "<<<>>>", "<a href='x>y", "<p>a</b></i></p></p>x</div>", "&lt;p&gt; 5 < 6", "<table><td>a<td>b<tr><td>c", "<li>a<li>b<dl><dt>c<dd>d", "\x00<p>퟿"])
def test_broken_pages(trees, page):
    assert isinstance(H.extract([page], trees)[0], str)


def runs(page):
    nodes = H.Nodes()
    H.parse(page, 0, nodes)
    return [t for _, t in nodes.runs]


@pytest.mark.parametrize("end", ["", "</head>", "</head><body>", "<body class=x>"])
def test_heads_without_end_tag(trees, end):
    page = PAGE.replace("</head><body>", "<meta name=a><script>'<body>'</script><noscript><link></noscript><!-- <p> -->" + end)
    assert runs(page) == runs(PAGE) and H.extract([page], trees) == H.extract([PAGE], trees)
    assert runs("<html><head><title>t</title>plain words") == ["plain words"]


@pytest.mark.parametrize("name", ["button", "select", "noscript", "object", "video", "audio", "canvas", "svg", "template"])
def test_skipped_elements_without_end_tag(trees, name):
    want = H.extract([PAGE], trees)
    for later in ("", f"<div><{name}>no</{name}></div>"):
        page = PAGE.replace("<nav>", f"<div class='notice'><{name}>OK</div><nav>") + later
        assert "OK" not in runs(page) and runs(page) == runs(PAGE), name
        assert H.extract([page], trees) == want
    assert runs(f"<body><{name}>no<article>text</article>") == ["text"]
    assert runs(f"<table><tr><td><{name}>no<td>text</table><p>more") == ["text", "more"]
    assert runs(f"<div>a<{name}><i>no</i><div>no</div></{name}>b</div>c") == ["a b", "c"]
    assert runs(f"<div>a<{name}><script></{name}></div></script>no</{name}>b</div>c") == ["a b", "c"]


def test_many_unclosed_elements_take_linear_time():
    start = time.time()
    for part in ("<button>x", "<video><div></div>", "<div><svg>x</div>", "<object>", "<select><p>x"):
        runs(part * 20_000)
        runs(part * 20_000 + "</video></svg></object></button></select>")
    assert time.time() - start < 60


def test_scripts_and_forms_never_count(trees):
    got = H.extract(["<article><p>Some text is here, and more of it.</p><script>no()</script><style>no{}</style><select><option>no</option></select><textarea>no</textarea><noscript>no</noscript></article>"], trees)[0]
    assert got == "Some text is here, and more of it."


def test_operator(spark, trees):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, "clash"), (None, "v", "", "clash"), (1, "u", PAGE, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1][0] == [r.text for r in got if r.page_id == 1][1] and {r.text for r in got if r.page_id != 1} == {""}
    assert H.main_text(df.limit(0)).count() == 0


def test_references_end_with_their_piece_of_text(trees):
    assert H.extract(["<article><p>AT&am<b>p;T</b> and A&amp;B &lt<i>;</i> stay as they are in this paragraph.</p></article>"], trees) == ["AT&amp;T and A&B <; stay as they are in this paragraph."]


@pytest.mark.parametrize("page", [lambda n: "<span>" * n + "<li>x" * n, lambda n: "<b><div>" * n + "</b>" * n, lambda n: "<table><tr><td>" * n, lambda n: "<p><b>" * n, lambda n: "<ul><li>" * n + "<li>" * n])
def test_open_elements_take_linear_time(page):
    import time

    took = []
    for n in (15_000, 60_000):
        text, began = page(n), time.process_time()
        H.parse(text, 0, H.Nodes())
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_boosting_equals_a_plain_learner_of_one_split():
    """One tree of depth 1 on all rows: the split with the best gain among all by hand, and its Newton steps."""
    import numpy as np

    r = np.random.default_rng(2)
    x = r.integers(0, 8, (300, 4)).astype(np.float32)
    y = np.clip((x[:, 2] > 4) * 0.9 + r.random(300) * 0.1, 0, 1)
    got = H.boost(x, y, np.ones(300), rounds=1, depth=1, rate=1.0, share=1.1)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gain, j, cut = max((score(x[:, j] <= c) + score(x[:, j] > c), -j, -c) for j in range(4) for c in range(7))
    assert got.feature[0][0] == -j == 2 and -cut <= got.threshold[0][0] < -cut + 1
    low = x[:, 2] <= -cut
    assert got.leaf[0] == pytest.approx([g[m].sum() / (h[m].sum() + 1) for m in (low, ~low)])


def test_decoding_equals_brute_force():
    """The likeliest of all ways to cut a small tree."""
    import itertools

    import numpy as np

    r = np.random.default_rng(6)
    for _ in range(60):
        n = H.Nodes()
        text = "".join(r.choice(["<div>a b c", "<p>dd", "</div>", "<ul><li>e", "</ul>", "fff gg "], 7))
        H.parse(text, 0, n)
        size = len(n.parent)
        if size > 7 or size == 1 or not n.runs:
            continue
        p = np.clip(r.random(size), 1e-4, 1 - 1e-4)
        own = np.zeros(size)
        for node, run in n.runs:
            own[node] += np.log1p(len(run))
        inside = [range(i, n.end[i]) for i in range(size)]
        log = lambda i, side: np.log(p[i] if side else 1 - p[i])

        def total(cuts, sides):
            out = 0.0
            for i in range(size):
                top = next((c for c in range(size) if c in cuts and i in inside[c]), None)
                out += own[i] * (log(i, sides[i]) if top is None else (log(i, sides[top]) + log(top, sides[top])) / 2)
            return out

        best = max(total(c, s) for k in range(size) for c in itertools.combinations(range(1, size), k) for s in itertools.product((False, True), repeat=size))
        keep = H.decode(n, p)
        options = [c for k in range(size) for c in itertools.combinations(range(1, size), k) if all(len({keep[i] for i in inside[x]}) == 1 for x in c)]
        assert max(total(c, keep) for c in options) == pytest.approx(best)
