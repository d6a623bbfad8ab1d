"""Wrapper induction: alignment against brute force, what the template decides, odd pages."""

import random

import pytest

from kosha.llm import html

PAGES = "page_id long, url string, html string"


def told(spark, pages):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, PAGES)).collect()}


def test_one_page_by_its_own_tree():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div>"
        "<article><h1>Head &amp; tail</h1><p><b>One\n two<br>three<p>Four &eacute;</p><aside>Side</aside><div class='comments'><p>Reader</p></div><form>F</form></article><footer>Foot</footer>"
    )
    assert html.main_text(page) == "Head & tail\nOne two three\nFour é"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<p>plain<p>text") == "plain\ntext"
    kept = "<article><div class='related-work'>Work</div><p class='side'>Note</p><p>Text <a href=x>a long link of this paragraph</a></p></article>"
    assert html.main_text(kept) == "Work\nNote\nText a long link of this paragraph"
    assert html.main_text("<main><p>Around</p><article><p>The article itself</p></article></main>") == "The article itself"


def test_deep_trees_keep_their_ends():
    deep = 3000
    page = "<body><article><p>in</p>" + "<div>" * deep + "deep" + "</div>" * deep + "<p>last</p></article><footer>out</footer></body>"
    assert html.main_text(page) == "in\ndeep\nlast"


def brute_matching(a, b):
    """Simple tree matching as defined, over (kind, children)."""
    if a[0] != b[0]:
        return 0
    m, n = len(a[1]), len(b[1])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matching(a[1][i], b[1][j]))
    return best[m][n] + 1


def random_tree(rng, depth):
    return rng.choice(["div", "section", "ul"]), [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []


def written(tree):
    return f"<{tree[0]}>" + "".join(map(written, tree[1])) + f"</{tree[0]}>"


def test_alignment_equals_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        a, b = (("#root", [random_tree(rng, 3) for _ in range(3)]) for _ in range(2))
        first, second = (html.Tree("".join(map(written, t[1]))) for t in (a, b))
        matcher = html.Matcher()
        x, y = matcher.shapes(first), matcher.shapes(second)
        pairs = matcher.align(first, second, x, y)
        assert len(pairs) == matcher.score(x[0], y[0]) == brute_matching(a, b)
        for right, left in pairs.items():
            assert first.nodes[left].tag == second.nodes[right].tag
            assert left == right == 0 or pairs[second.parent[right]] == first.parent[left]
        order = sorted(pairs)
        assert [pairs[i] for i in order] == sorted(pairs.values())


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def plain_pages(n, host="h.example"):
    """Pages without an article element: menus and notes vary, some lines in and out of the text do not."""
    rng = random.Random(n)
    pages, want = [], {}
    for i in range(n):
        title, story = words(rng, 4), [words(rng, 30) for _ in range(rng.randint(1, 6))]
        links = "".join(f"<li><a href=/{k}>{words(rng, 2)}</a></li>" for k in range(4))
        body = "".join(f"<p>{p}</p>" for p in story)
        page = (
            f"<body><div class=top><ul>{links}</ul><p>Welcome to the site</p></div><div class=page><h1>{title}</h1><div class='text t{i}'>{body}<p>Share this story</p>"
            f"<ul>{links}</ul></div></div><div class=low><p>{words(rng, 5)}</p></div></body>"
        )
        pages.append((i, f"https://{host}/{i}", page))
        want[i] = "\n".join([title, *story])
    return pages, want


def test_slots_decide_without_an_article(spark):
    pages, want = plain_pages(8)
    got = told(spark, pages)
    assert got == want
    # a page alone has no template: its own tree keeps what its host would have told to be constant
    for i, _, page in pages:
        assert "Share this story" in html.main_text(page) and "Share this story" not in got[i]
    far = told(spark, [(i, f"https://h{i}.example/", page) for i, _, page in pages] + [(100, None, pages[0][2])])
    assert all("Share this story" in far[i] for i in want) and far[100] == far[0]


def test_lines_inside_an_article(spark):
    rng = random.Random(4)
    page = lambda i, more="": f"<body><nav>Menu {i}</nav><article><h1>T{i}</h1><p>{words(rng, 20)}</p>{more}<p>Read our newsletter</p></article></body>"
    pages = [(i, f"https://h.example/{i}", page(i, "<p>Said by three</p>" if i < 3 else "")) for i in range(10)]
    got = told(spark, pages)
    assert all("newsletter" not in t and t.startswith(f"T{i}\n") for i, t in got.items())
    assert all("Said by three" in got[i] for i in range(3))  # what a minority of pages holds is content


def test_copies_are_no_template(spark):
    rng = random.Random(6)
    story = "".join(f"<p>{words(rng, 30)}</p>" for _ in range(4))
    same = [(i, f"https://h.example/{i}", f"<body><nav>a</nav><article>{story}</article></body>") for i in range(30)]
    near = [(100 + i, f"https://n.example/{i}", f"<body><article>{story}<p>Edition {i}</p></article></body>") for i in range(30)]
    got = told(spark, same + near)
    assert all(t.count("\n") == 3 for i, t in got.items() if i < 100) and all(got[100 + i].endswith(f"\nEdition {i}") and got[100 + i].count("\n") == 4 for i in range(30))


def test_two_layouts_of_a_host(spark):
    rng = random.Random(9)
    pages = [(i, f"https://h.example/{i}", f"<body><header>Top {i}</header><main><p>{words(rng, 20)}</p></main></body>") for i in range(6)]
    pages += [(10 + i, f"https://h.example/{10 + i}", f"<body><div><p>Out {i}</p></div><section><p>{words(rng, 20)}</p></section></body>") for i in range(6)]
    got = told(spark, pages)
    for i, _, page in pages:
        inner = page.split("<main>")[-1].split("<section>")[-1].split("<p>")[-1 if i >= 10 else 1].split("</p>")[0]
        assert got[i] == inner


def test_odd_pages(spark):
    pages = [(1, None, "<p>x</p>"), (2, "https://h.example/z", None), (3, "https://h.example/y", ""), (None, "no url", "<p>nameless</p>"), (None, "no url", "<p>nameless</p>"), (5, "https://h.example/<>", "<<<>>> &#0; text")]
    pages += [(6, "https://long.example/", "<article>" + "<p>many words here</p>" * 20_000 + "</article>"), (6, "https://long.example/", "<article>" + "<p>many words here</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 as page_group", "2 as mark", "3 as blocks", "4 as reference", "5 as text", "6 as n_chars", "7 as inside")
    rows = html.extract(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert by[1][0].text == "x" and by[2][0].text == by[3][0].text == "" and [r.text for r in by[None]] == ["nameless"] * 2
    assert [len(r.text) for r in by[6]] == [16 * 20_000 - 1] * 2
    assert html.extract(df.limit(0)).collect() == []
    named = html.extract(df.withColumnsRenamed({"page_id": "k", "url": "u", "html": "h"}), "k", "u", "h")
    assert sorted(r.text for r in named.collect()) == sorted(r.text for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_pages(spark, n):
    pages, _ = plain_pages(n)
    assert all("w" in t and "Welcome" not in t for t in told(spark, pages).values())


def paragraph(i, k):
    return f"Paragraph {k} of page {i} tells of thing{i * 7 + k} and thing{i * 13 + k} in its own words, at some length."


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(df).collect()}


@pytest.mark.parametrize("n", [3, 20])
def test_headings_and_by_lines_within_the_article_stay(spark, n):
    """The same on every page, but between lines that vary: also the same result with three pages and with twenty."""
    page = lambda i: f"<nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>By Jane Doe</p><h2>Ingredients</h2><p>{paragraph(i, 1)}</p><h2>Method</h2><p>{paragraph(i, 2)}</p></article><footer>Foot</footer>"
    got = extracted(spark, [page(i) for i in range(n)])
    assert got == {i: "\n".join([f"Title {i}", "By Jane Doe", "Ingredients", paragraph(i, 1), "Method", paragraph(i, 2)]) for i in range(n)}


def test_lists_of_sources_stay(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>{paragraph(i, 1)}</p><p>{paragraph(i, 2)}</p><ul><li><a href=/a{i}>Source {i} alpha</a></li><li><a href=/b{i}>Source {i} beta</a></li></ul></article>"
    got = extracted(spark, [page(i) for i in range(6)])
    assert got[4] == "\n".join(["Title 4", paragraph(4, 1), paragraph(4, 2), "Source 4 alpha", "Source 4 beta"])


def test_generated_sites_give_their_content(spark):
    """Sites without any telling tag: a template around the content, headings that all pages share within it."""
    rng = random.Random(6)
    pages, want = [], {}
    for site in range(4):
        top = [f"Site {site} top line {k} of the template" for k in range(rng.randrange(1, 4))]
        foot = [f"Site {site} foot line {k} of the template" for k in range(rng.randrange(1, 4))]
        heads = [f"Shared heading {k}" for k in range(rng.randrange(1, 3))]
        for i in range(12):
            lines = [f"Title of {site} {i}"]
            for k, head in enumerate(heads):
                lines += [head, *[paragraph(100 * site + i, 10 * k + m) for m in range(rng.randrange(1, 4))]]
            cut = lambda rows: "".join(f"<p>{x}</p>" for x in rows)
            pages.append((len(pages), f"http://site{site}.example/{i}", f"<html><body><div>{cut(top)}</div><div><div>{cut(lines)}</div></div><div>{cut(foot)}</div></body></html>"))
            want[len(pages) - 1] = lines
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html.extract(df).collect()}
    right = sum(len(set(got[i]) & set(w)) for i, w in want.items())
    assert right == sum(map(len, want.values())) and sum(map(len, got.values())) == right
