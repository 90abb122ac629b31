"""Main-text extraction against pages whose text is known."""

import html
import random
import re

from tessera.llm import htmltext

WORDS = [f"word{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def page_article(rng, i):
    parts = [prose(rng, rng.randint(3, 60)) for _ in range(rng.randint(1, 6))]
    body = "".join(f"<p>{p.replace('word1 ', 'word1 &amp; <b>x</b>y ')}\n" for p in parts)
    text = [p.replace("word1 ", "word1 & xy ") for p in parts]
    page = f"<html><head><title>T{i}</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>{prose(rng, 2)}</a></ul></nav><div class='cookie-notice'>We use cookies {prose(rng, 9)}</div><article><h1>Head {i}</h1>{body}<section class='comments'><p>{prose(rng, 40)}</p></section><form>{prose(rng, 5)}<input></form></article><aside>{prose(rng, 60)}</aside><footer>&copy; {i}</footer>"
    return page, " ".join([f"Head {i}", *text])


def page_divs(rng, i):
    parts = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    body = "".join(f"<p>{p}</p>" for p in parts)
    page = f"<html><body><div id=top><a href=/>Home</a> <a href=/x>{prose(rng, 2)}</a></div><div id='wrap'><div class='main-col'><p>Read more on this site every day</p>{body}<div class=ad>{prose(rng, 20)}</div></div><div class='sidebar'>{prose(rng, 150)}</div></div><div class='footer'>bye</div></body></html>"
    return page, " ".join(parts)


def make():
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(30):
        make_page = page_article if i % 2 else page_divs
        page, text = make_page(rng, i)
        rows.append((i, f"https://{'a' if i % 2 else 'B'}.example.org:80/{i}?q=//c.d", page))
        want[i] = text
    rows += [(100, "https://x.org/", None), (101, None, ""), (102, "no url", "just text\n here"), (None, "https://a.example.org/", rows[1][2])]
    want |= {100: "", 101: "", 102: "just text here", None: want[1]}
    rows.append((103, "https://y.org/", "<p>" + "long " * 100_000))
    want[103] = ("long " * 100_000).strip()
    rows.append((104, "https://z.org/", "<div>" * 3_000 + "deep" + "</div>" * 2_000))
    want[104] = "deep"
    rows.append((105, "https://w.org/", "<div>" * 1_200 + "deep"))
    want[105] = "deep"
    return rows, want


def test_extract(spark):
    rows, want = make()
    pages = spark.createDataFrame([(i, u, h, "host", "t") for i, u, h in rows], "page_id long, url string, html string, host string, text string")
    got = htmltext.extract_pages(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    assert htmltext.extract_pages(pages.limit(0)).collect() == []


def test_template_is_found():
    rng = random.Random(1)
    (wrapper,) = htmltext.induce([page_divs(rng, i)[0] for i in range(5)]).values()
    assert wrapper["path"] == [["div|wrap.", 0], ["div|.main-col", 0]]
    assert wrapper["template"] == ["Read more on this site every day"]


def test_a_wrapper_matters_on_article_pages():
    """Standing text inside the article goes; only the alignment can tell."""
    rng = random.Random(5)
    made = [page_article(rng, i) for i in range(6)]
    pages = [p.replace("<article>", "<article><p>You are reading the example gazette</p>") for p, _ in made]
    wrappers = htmltext.induce(pages)
    for page, (_, text) in zip(pages, made):
        assert htmltext.extract(page, wrappers) == text
        assert htmltext.extract(page, None) == "You are reading the example gazette " + text


def test_near_copies_keep_their_text():
    rng = random.Random(6)
    page, text = page_article(rng, 1)
    pages = [page.replace("Head 1", f"Head {n}") for n in range(6)]
    assert htmltext.extract(pages[0], htmltext.induce(pages)) == text.replace("Head 1", "Head 0")


def test_layouts_have_wrappers_of_their_own():
    rng = random.Random(7)
    one = [page_divs(rng, i) for i in range(4)]
    two = [(p.replace("main-col", "body-col").replace("Read more on this site every day", "Another standing line of words"), t) for p, t in (page_divs(rng, i) for i in range(4))]
    wrappers = htmltext.induce([p for p, _ in one + two])
    assert len(wrappers) == 2
    for page, text in one + two:
        assert htmltext.extract(page, wrappers) == text


def test_all_articles_and_their_inner_elements():
    page = """<body><nav>menu</nav><article><h2>A first story</h2><div class="related-work">Prior work</div></article>
      <article><p>A second <span class="notice">small</span> story</p><section id="social-policy">On policy</section><div class="notice">We use cookies</div></article></body>"""
    assert htmltext.extract(page, None) == "A first story Prior work A second small story On policy"


def test_comments_and_teasers_as_articles():
    main = "<article><h1>Head</h1><p>main</p></article>"
    assert htmltext.extract(f'<body>{main}<section id="responses"><article class="comment">reader says</article></section></body>', None) == "Head main"
    assert htmltext.extract(f'<body>{main}<div id="talk"><article>reader one says much more than all the text of the page</article><article>two</article></div></body>', None) == "Head main"
    assert htmltext.extract(f'<body>{main}<div class="more-stories"><article>Teaser one</article></div></body>', None) == "Head main"
    assert htmltext.extract('<body><main><article class="post">main story</article><article class="comment">me too, at length</article></main></body>', None) == "main story"
    assert htmltext.extract('<body><article><p>main</p><article class="comment"><p>inner reader</p></article></article></body>', None) == "main"
    assert htmltext.extract('<body><div class="c"><article>one</article></div><div class="c"><article>two</article></div></body>', None) == "one two"


def test_a_layout_agrees_on_its_place():
    """Without a main heading a page with much talk and little text is only told by the other pages of its layout."""
    rng = random.Random(8)
    page = lambda n, m: f"<body><div id=w><article><p>{n}</p></article></div><div id=talk><article>{m}</article></div></body>"
    made = [(prose(rng, 60), prose(rng, 5)) for _ in range(6)] + [("short", prose(rng, 50))]
    wrappers = htmltext.induce([page(*m) for m in made])
    assert [htmltext.extract(page(*m), wrappers) for m in made] == [m[0] for m in made]
    assert htmltext.extract(page(*made[-1]), None) == made[-1][1]


def test_class_words_inside_articles():
    page = '<body><article><p>One</p><section id="cookie-recipes">Bake them</section><div class="lunch-menu">Soup</div><div class="cookie-notice">We use</div><div class="ad-container">Buy</div><div class="adBox">Buy</div></article></body>'
    assert htmltext.extract(page, None) == "One Bake them Soup"


def test_an_unseen_layout_decides_for_itself():
    rng = random.Random(3)
    wrappers = htmltext.induce([page_divs(rng, i)[0] for i in range(4)])
    page, text = page_article(rng, 1)
    assert htmltext.extract(page, wrappers) == text


def test_large_and_deep_pages_train():
    def page(n):
        return "<body><div id=w><div class=m><p>Standing words of the site</p>" + "".join(f"<p>{n} text {k}</p>" for k in range(3_000)) + "<div>" * 2_000 + f"deep {n}" + "</div>" * 2_000 + "</div></div></body>"

    (wrapper,) = htmltext.induce([page(n) for n in range(3)]).values()
    assert wrapper["path"][:2] == [["div|w.", 0], ["div|.m", 0]] and wrapper["template"] == ["Standing words of the site"]


def test_known_texts(spark):
    """The supplied pages hold a heading and a document; without and with wrappers, all of them come out."""
    folder = "/root/testdata/sf0.01"
    known = {" ".join((r.text or "").split()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    heads = {r.page_id: " ".join(html.unescape(re.search("<h1>(.*?)</h1>", r.html, re.S)[1]).split()) for r in pages.collect()}
    found = htmltext.extract_pages(pages).collect()
    right = sum(r.text.startswith(heads[r.page_id]) and r.text[len(heads[r.page_id]) :].strip() in known for r in found)
    assert len(found) == len(heads) and right == len(found)


def test_copies_keep_their_text():
    """Equal pages say nothing about what is template."""
    rng = random.Random(2)
    page, text = page_article(rng, 1)
    assert htmltext.extract(page, htmltext.induce([page] * 6)) == text


def test_simple_tree_matching():
    a = htmltext.parse("<ul><li>1<li>2<li>3</ul>")
    b = htmltext.parse("<ul><li>1<b>x</b><li>3</ul>")
    assert htmltext.matched(a, b, {}) == 1 + 1 + 2 * 2
    assert sum(1 for _ in htmltext.pairs(a, b)) == 6


def test_wrappers_are_of_all_pages(spark, monkeypatch):
    """A layout that few of a host's many pages have, a text that many agree on but not nearly all, bodies of different classes, copies."""
    rng = random.Random(12)
    rows, want = [], {}
    for n in range(80):  # one page in ten has the rare layout
        page, text = page_divs(rng, n)
        if n % 10:
            page = page.replace("<p>Read more", "<h4>Seen by some</h4><p>Read more") if n % 4 else page
            text = f"Seen by some {text}" if n % 4 else text
        else:
            page = page.replace("main-col", "rare-col").replace("Read more on this site every day", "A rare layout's standing line")
        rows.append((n, "http://h.org/", page.replace("<body>", f"<body class='post-{n}'>")))
        want[n] = text
    rows += [(100 + k, "http://h.org/", rows[1][2]) for k in range(300)]
    want |= {100 + k: want[1] for k in range(300)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for most in (htmltext.BROADCAST_CHARS, 0):
        monkeypatch.setattr(htmltext, "BROADCAST_CHARS", most)
        assert {r.page_id: r.text for r in htmltext.extract_pages(pages).collect()} == want


def plain_pairs(a, b):
    """All pairs of the matching by the full table of each two nodes."""
    memo = {}

    def best(x, y):
        if isinstance(x, str) or isinstance(y, str):
            return int(isinstance(x, str) and isinstance(y, str)), []
        if (id(x), id(y)) not in memo:
            left, right = htmltext.parts(x), htmltext.parts(y)
            t = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
            for i, u in enumerate(left):
                for j, v in enumerate(right):
                    same = isinstance(u, str) or isinstance(v, str) or u.label == v.label
                    t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + (best(u, v)[0] if same else 0))
            chosen, i, j = [], len(left), len(right)
            while i and j:
                if t[i][j] == t[i - 1][j]:
                    i -= 1
                elif t[i][j] == t[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    chosen.append((left[i], right[j]))
            memo[id(x), id(y)] = 1 + t[-1][-1], chosen
        return memo[id(x), id(y)]

    found, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        found.append((id(x), id(y)))
        todo += best(x, y)[1]
    return found


def test_alignment_equals_full_tables(monkeypatch):
    """Whatever is held of tables and alignments, and whichever way a table is made."""
    rng = random.Random(21)

    def tree(depth):
        kids = "".join(rng.choice(["t<br>", "<p>x</p>", "<p>x<b>y</b></p>", "<i>z</i>", tree(depth - 1) if depth else "<u>w</u>"]) for _ in range(rng.choice([1, 4, 12])))
        return f"<div>{kids}</div>"

    for wide, cells, held in ((10**9, 1, 10**9), (0, 10**9, 10**9), (0, 1, 10**9), (3, 30, 5), (3, 1, 1)):
        for name, value in (("WIDE", wide), ("HELD_CELLS", cells), ("HELD_PAIRS", held)):
            monkeypatch.setattr(htmltext, name, value)
        for _ in range(25):
            a, b = htmltext.parse(tree(3)), htmltext.parse(tree(3))
            assert [(id(x), id(y)) for x, y in htmltext.pairs(a, b)] == plain_pairs(a, b)


def test_large_pages_are_aligned_as_small_ones():
    """What comes before a standing text moves it; only the matching of all children finds it on pages of thousands of them."""
    page = lambda n, more: f"<body><div id=w><div class=m>{'<p>before</p>' * more}<p><b>Standing</b> <i>words</i></p>" + "".join(f"<p>{n} text {k}</p>" for k in range(1_500)) + "</div></div></body>"
    (wrapper,) = htmltext.induce([page(n, n % 3) for n in range(9)]).values()
    assert wrapper["template"] == ["Standing", "words"]

