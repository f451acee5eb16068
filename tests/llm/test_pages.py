import random
from collections import Counter, defaultdict

from passages.llm.pages import blocks, main_text

SCHEMA = "page_id long, url string, html string, text string"


def test_blocks():
    page = '<div class=x>Hi <a href="/x">the<b>re</b></a> &amp; you<br>z</div><aside>no</aside><p>a<p>b<ul><li>1<li>2</ul><div id="comments"><p>bad</p></div>tail <i>x'
    assert [t for z, t in blocks(page) if z == 1] == ["Hi there & you", "z", "a", "b", "1", "2", "tail x"]
    assert blocks("5 < 6 & <3") == [(1, "5 < 6 & <3")] and blocks("") == [] and blocks("<p></p><!-- x") == []


def test_article_pages(spark):
    rows = [
        (1, "http://h/a", '<nav>m</nav><header>h</header><article><header><h1>T&eacute;</h1></header><p>one\n two<p>x&nbsp;y<form>f</form><script>s("</p>")</script><div class="ad">ad</div></article><footer>f</footer>', "clash"),
        (2, None, None, None), (3, "x", "", None), (3, "x", "", None), (4, "http://h/b", "<main><p>only main</p></main><p>out</p>", None), (5, "http://h/c", "<article>" + "w " * 300_000, None),
    ]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "Té one two x y" and by[1].n_chars == 14
    assert by[2].text == "" and by[2].n_chars == 0 and by[4].text == "only main" and by[5].n_chars == 599_999
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_host_array_removes_repeated_runs(spark):
    rng = random.Random(2)
    rows, body = [], {}
    for i in range(12):
        body[i] = " ".join(f"w{rng.randrange(500)}" for _ in range(40))
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<div>Home About Contact Products News Blog Careers Help Login site {i % 2}</div><div><p>{body[i]}</p></div><div>All of this is said at the end of each page here</div>", None))
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == body


def test_a_page_listed_again_is_one_page(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "http://h/a", f"<div><p>{text}</p></div>", None) for i in range(3)] + [(9, None, f"<p>{text}</p>", None)] * 4
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert [r.text for r in got] == [text] * 7


def boilerplate(rows):
    """Text of each row without an article, from the definitions: windows of 8 tokens and whole shorter blocks that enough pages of the host share."""
    streams, on, distinct = [], defaultdict(set), defaultdict(set)
    for _, url, html, _ in rows:
        host = url.split("/")[2].lower() if url else ""
        tokens, opened, runs = [], [], []
        for zone, text in blocks(html or ""):
            ws = text.split(" ")
            runs += [(len(tokens), len(ws))] if len(ws) < 8 else []
            tokens += ws
            opened += [zone == 1] * len(ws)
        runs += [(i, 8) for i in range(len(tokens) - 7)]
        spans = [(host, n == 8, tuple(w.lower() for w in tokens[a : a + n]), a, n) for a, n in runs]
        streams.append((host, tokens, opened, spans))
        if html is not None:
            distinct[host].add((url, html))
            for key in {x[:3] for x in spans}:
                on[key].add((url, html))
    out = []
    for host, tokens, opened, spans in streams:
        pages = len(distinct[host])
        least = max(min(3, pages), -(-pages // 5))
        gone = {i for *key, a, n in spans if len(on[tuple(key)]) >= max(2, least) for i in range(a, a + n)}
        out.append(" ".join(t for i, (t, o) in enumerate(zip(tokens, opened)) if o and i not in gone))
    return out


def test_array_equals_brute_force(spark):
    rng = random.Random(12)
    chrome = [" ".join(f"{'Menu' if k % 2 else 'menu'}{k}_{i}" for i in range(rng.randint(1, 14))) for k in range(6)]
    prose = [" ".join(f"t{rng.randrange(400)}" for _ in range(30)) for _ in range(8)]
    rows = []
    for host, pages in (("a.example", 40), ("B.example", 2), ("c.example", 1), ("d.example", 12), ("e.example", 3)):
        for i in range(pages):
            parts = [f"<div>{c}</div>" for c in rng.sample(chrome, rng.randint(0, 5))]
            parts.append(f"<p>{' '.join(f't{rng.randrange(400)}' for _ in range(rng.randint(0, 40)))}</p>")
            if rng.random() < 0.3:
                parts.append(f"<p>own words then {rng.choice(prose)[: rng.randint(20, 90)]}</p>")
            if rng.random() < 0.2:
                parts.append("<footer>the foot of this page has some words too</footer>")
            rng.shuffle(parts)
            rows.append((len(rows), f"http://{host}/{i}", "".join(parts), "clash"))
    rows += [rows[0], rows[0], rows[41], (900, None, "<p>no url here</p>", None), (901, "http://a.example/x", None, None), (902, "http://a.example/y", "w " * 200_000, None), (903, "http://c.example/z", "one", None)]
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((r[0], t) for r, t in zip(rows, boilerplate(rows)))


def test_class_names():
    page = '<article><p>a</p><section class="form-factor">b</section><div class="related-work">c</div><div class="ad-slot x">d</div><div class="post-comments">e</div><div class="cookie_notice">f</div><div id=newsletter2>g</div><div class="header">h</div><div role="search">i</div></article>'
    assert [t for z, t in blocks(page) if z == 3] == ["a", "b", "c", "h"]


def test_array_reaches_into_articles(spark):
    rng = random.Random(5)
    notice, license_ = "read all of our stories first by asking for the weekly letter", "all of this may be copied freely under the usual public terms"
    rows, want = [], {}
    for i in range(12):
        head, body = (" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(2))
        # The notice stands in the articles and outside them, the license only in articles, the headline in one article and on all pages.
        rows.append((i, f"http://h.example/{i}", f"<article><h2>{{}}</h2><p>{head}</p><h3>Home</h3><p>{notice.title()}</p><p>{body} {license_}</p></article><p>{notice}</p><p>Home</p>", None))
        want[i] = f"{head} Home {body} {license_}"
    title = "a headline of nine words that all menus show"
    rows = [(i, u, h.format(title if i == 4 else "x") + f"<nav>{title}</nav>", c) for i, u, h, c in rows]
    want = {i: f"{title if i == 4 else 'x'} {t}" for i, t in want.items()}
    # Copies of one article are one article, wherever its text stands besides.
    for i in range(20, 26):
        rows.append((i, f"http://copies.example/{i}", f"<article><p>{notice}</p></article><p>{notice}</p>", None))
        want[i] = notice
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == want


def whole_pages(rows):
    """Text of every row from the definitions, articles included."""
    pages, distinct, outside, inside = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for _, url, html, _ in rows:
        host = url.split("/")[2].lower()
        parts = blocks(html)
        best = max([z for z, _ in parts if z >= 2], default=None)
        stream, opened, short = [], [], []
        for zone, text in parts:
            if zone < (best or 2):
                ws = text.split(" ")
                short += [(len(stream), len(ws))] if len(ws) < 8 else []
                stream += ws
                opened += [zone == 1] * len(ws)
        article = [w for z, t in parts if z == best for w in t.split(" ")]
        spans = [[(host, tuple(w.lower() for w in ws[a : a + n]), n == 8, a) for a, n in runs] for ws, runs in ((stream, short + [(i, 8) for i in range(len(stream) - 7)]), (article, [(i, 8) for i in range(len(article) - 7)]))]
        pages.append((host, best, article if best else stream, [True] * len(article) if best else opened, spans))
        distinct[host].add((url, html))
        for x in spans[0]:
            outside[x[:3]].add((url, html))
        text = " ".join(article)
        for x in spans[1]:
            inside[x[:3]].add(text)
    out = []
    for host, best, tokens, kept, spans in pages:
        n = len(distinct[host])
        least = max(2, min(3, n), -(-n // 5))
        gone = set()
        for x in spans[1 if best else 0]:
            if len(outside[x[:3]]) >= least and (not best or len(inside[x[:3]]) >= least):
                gone |= set(range(x[3], x[3] + (8 if x[2] else len(x[1]))))
        out.append(" ".join(t for i, (t, o) in enumerate(zip(tokens, kept)) if o and i not in gone))
    return out


def test_all_pages_equal_brute_force(spark):
    rng = random.Random(31)
    runs = [" ".join(f"{'Run' if k % 2 else 'run'}{k}_{i}" for i in range(rng.randint(2, 16))) for k in range(7)]
    rows = []
    for host, pages in (("a.example", 40), ("B.example", 2), ("c.example", 1), ("d.example", 15), ("e.example", 4)):
        for i in range(pages):
            zones = []
            for _ in range(2):
                parts = [f"<p>{r}</p>" for r in rng.sample(runs, rng.randint(0, 5))] + [f"<p>{' '.join(f't{rng.randrange(300)}' for _ in range(rng.randint(0, 30)))} {rng.choice(runs)}</p>"]
                rng.shuffle(parts)
                zones.append("".join(parts))
            tag = rng.choice(["article", "article", "main", "div"])
            rows.append((len(rows), f"http://{host}/{i}", f"<footer>{zones[0]}</footer><{tag}>{zones[1]}</{tag}>" if rng.random() < 0.7 else f"<{tag}>{zones[1]}</{tag}><div>{zones[0]}</div>", "clash"))
    rows += [rows[0], rows[0], rows[41], (900, "http://a.example/x", f"<article>{'w ' * 150_000}{runs[3]}</article>{runs[3]}", None), (901, "http://d.example/y", "<article></article>", None)]
    want = whole_pages(rows)
    assert sum("<article>" in r[2] and t != " ".join(x for z, x in blocks(r[2]) if z == 3) for r, t in zip(rows, want)) > 10
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((r[0], t) for r, t in zip(rows, want))
