import os
import random

from gridloom.llm import html


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(3000):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        kept = [x for x, k in zip(a, html.common_lines(a, b), strict=True) if k]
        rest = iter(b)
        assert all(x in rest for x in kept) and len(kept) == lcs(a, b)


def test_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header>Site</header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p>one\n  <b>two</b>thr<i>ee</i></p><!-- no --><p>x<br>y
    <div class="share-box">share</div><form><p>mail</p></form><p>caf&eacute; &#x41;&copy</p><section class="comments"><p>first!</p></section></article><aside>side</aside><footer>&copy; me</footer></body></html>"""
    lines, marked = html.content(page)
    assert marked and lines == ["A & B", "one twothree", "x y", "café A©"]


def test_broken_markup():
    assert html.content("<nav>a<article><p>b<p>c &am")[0] == ["b", "c &am"]
    assert html.content("<p>a < b > c</p><p") == (["a < b > c"], False)
    assert html.content("<script>never closed <p>x")[0] == [] and html.content("")[0] == []
    assert html.content('<article><p title="a>b">t</p></article><p>out</p>')[0] == ["t"]


def page(i, body, host="h.com", where="a"):
    return (i, f"http://{host}/{where}/{i}", f"<html><body><div>Home</div><div>About us</div>{body}<div>Copyright line</div></body></html>")


SCHEMA = "page_id long, url string, html string"


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_differencing(spark, monkeypatch):
    rows = [page(1, "<p>one</p><p>two</p>"), page(2, "<p>three &amp; more</p>"), page(3, "<p>four</p>"), page(9, "<p>alone</p>", "other.com"), (4, None, None), (5, "http://h.com/a/5", ""), page(1, "<p>one</p><p>two</p>")]
    want = {1: "one\ntwo", 2: "three & more", 3: "four", 9: "Home\nAbout us\nalone\nCopyright line", 4: "", 5: ""}
    df = spark.createDataFrame(rows, SCHEMA)
    assert texts(html.extract(df)) == want and html.extract(df).count() == 7
    monkeypatch.setattr(html, "BROADCAST_PAGES", 0)
    assert texts(html.extract(df)) == want
    assert html.extract(df.limit(0)).count() == 0


def test_partition_borders_dont_matter(spark, monkeypatch):
    r = random.Random(3)
    rows = [page(i, f"<p>text {i}</p>" + f"<p>topic {i // 7}</p>" * r.randint(0, 1), r.choice(("h.com", "big.com", "big.com"))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = texts(html.extract(df))
    monkeypatch.setattr(html, "PARTITION_ROWS", 30)
    assert texts(html.extract(df)) == one and all("Home" not in t for t in one.values())


def test_copies_are_no_partners_and_articles_stay(spark):
    same = "<p>long shared story</p><p>more of it</p><p>and the end</p><p>really</p><p>yes</p><p>ok</p><p>seven</p><p>eight</p><p>nine</p><p>ten</p>"
    rows = [page(i, same) for i in (1, 2, 3)] + [page(4, "<p>other</p>")]
    got = texts(html.extract(spark.createDataFrame(rows, SCHEMA)))
    assert got[1].startswith("long shared story") and "Home" not in got[1]
    marked = [page(i, f"<article>{same}</article>") for i in (1, 2)]
    assert set(texts(html.extract(spark.createDataFrame(marked, SCHEMA))).values()) == {"\n".join(html.content(same)[0])}


def test_template_lines_go_from_articles_and_stories_stay(spark):
    story = "<p>a story told twice</p><p>to its end</p>"
    rows = [page(i, f"<article><p>Subscribe to our letter</p>{story if i < 3 else f'<p>text {i}</p>'}<p>By line {i}</p></article>") for i in range(8)]
    got = texts(html.extract(spark.createDataFrame(rows, SCHEMA)))
    assert got == {i: ("a story told twice\nto its end" if i < 3 else f"text {i}") + f"\nBy line {i}" for i in range(8)}


def test_runs_of_copies_and_pages_of_mostly_template(spark, monkeypatch):
    story = "".join(f"<p>story {k}</p>" for k in range(20))
    copies = [page(f"{i:03}", story)[1:] for i in range(40)] + [page("900", "<p>other</p>")[1:]]
    near = [page(f"{i:03}", f"{story}<p>version {i}</p>", "near.com")[1:] for i in range(40)] + [page(f"9{i:02}", f"<p>text {i}</p>", "near.com")[1:] for i in range(60)]
    menu = "".join(f"<div>menu {k}</div>" for k in range(5))
    most = [page(f"{i:03}", f"{menu}<p>own {i}</p><p>more {i}</p>", "most.com")[1:] for i in range(6)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(copies + near + most)], SCHEMA)
    one = texts(html.extract(df))
    assert not any("Home" in t or "menu" in t or "Copyright" in t for t in one.values())
    assert all(t.startswith("story 0\nstory 1\n") for i, t in one.items() if i < 40 or 41 <= i < 81) and one[len(df.collect()) - 1] == "own 5\nmore 5"
    monkeypatch.setattr(html, "PARTITION_ROWS", 30)
    monkeypatch.setattr(html, "BROADCAST_PAGES", 0)
    assert texts(html.extract(df)) == one


def test_other_articles_and_named_boxes():
    one = lambda page: html.content(page)[0]
    assert one('<article><p>Story</p></article><div id="comments"><article class="comment"><p>Reader says</p></article></div>') == ["Story"]
    assert one('<article><p>Story</p><div id="comments"><article><p>Reader says</p></article></div><p>end</p></article>') == ["Story", "end"]
    assert one('<article><p>Story</p><article class="comment">one<article class="comment">two</article></article><p>end</p></article>') == ["Story", "end"]
    assert one('<aside class="related"><article>Teaser</article></aside><div><p>Real content</p></div>') == ["Real content"]
    assert "The story, which is longer" in one("<div><p>The story, which is longer</p><p>than what the one article of the page says, a teaser</p></div><article>Teaser</article>")
    body = "a sentence of the body " * 6
    assert one(f'<article><p>Body</p><div class="widget"><p>{body}</p></div><div class="notice">Short</div><p>end <span class="share">Share</span>of it</p></article>') == ["Body", body.strip(), "end of it"]
    assert one('<article class="post comments-open"><p>Story</p><p>a <button>Click</button>b</p></article>') == ["Story", "a b"]


def test_quotes_that_never_close():
    assert html.content('<p class="x>hello</p>')[0] == ["hello"]
    assert html.content('<p class="x>hello</p><p id="y">z</p>')[0] == ["hello", "z"]
    assert html.content("<p title=it's>don't</p>the dogs' x")[0] == ["don't", "the dogs' x"]


def flags_by_table(a, b):
    """Entries of ``a`` on a longest common subsequence with ``b``, by the full table."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    out, i, j = set(), len(a), len(b)
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(a[i])
    return out


def brute(rows):
    """Texts of pages (id, host, path, marked, lines) whose lines are all different."""
    votes, out, final = {}, {}, {}
    for i, host, path, marked, lines in rows:
        own = list({(m, tuple(x)): (p, m, tuple(x)) for _, h, p, m, x in sorted(rows, key=lambda r: r[2], reverse=True) if h == host}.values())
        places = lambda m, ls: {(e, n, x) for k, x in enumerate(ls) for e, n in (("start", k), ("end", len(ls) - k))} if m else set(ls)
        stands = lambda x: sum(x in places(m, ls) for _, m, ls in own)  # noqa: E731, B023
        template = {x for x in places(marked, lines) if len(own) >= 4 and stands(x) >= 3 and 2 * stands(x) >= len(own)}
        half = set() if marked else template
        own.sort(key=lambda r: r[0])
        at = [k for k, r in enumerate(own) if r[1:] == (marked, tuple(lines))][0]
        path = own[at][0]
        near = [k for k in range(len(own)) if k != at and abs(k - at) <= 8]
        near.sort(key=lambda k: (-len(os.path.commonprefix([path, own[k][0]])), abs(k - at), k))
        shared = set()
        for k in near:
            shared = flags_by_table(lines, own[k][2])
            if len(shared - half) < 0.8 * len(set(lines) - half) or not set(lines) - half:
                break
            shared = set()
        final[i] = half | shared
        if marked:
            final[i] = template
            for x in template:
                votes.setdefault((host, x), {})[tuple(lines)] = x[2] in shared
    for i, host, _, marked, lines in rows:
        gone = final[i]
        if marked:
            n = len({(m, tuple(x)) for _, h, _, m, x in rows if h == host})
            gone = {x[2] for x in gone if sum(votes[host, x].values()) >= max(3, n / 2)}
        out[i] = "\n".join(x for x in lines if x not in gone)
    return out


def test_equals_brute_force(spark, monkeypatch):
    r, rows = random.Random(8), []
    for i in range(240):
        host, marked = r.choice(("big.com", "big.com", "small.com", f"h{i % 30}.com")), r.random() < 0.5
        if rows and r.random() < 0.15:
            _, host, _, marked, lines = r.choice(rows)
            lines = [x for x in lines if r.random() < 0.97] or lines
        else:
            notes = [f"note {k} of {host}" for k in range(4) if r.random() < 0.2 * (k + 1)]
            marked = marked and host != "small.com" or host == "big.com"
            lines = [f"menu {k}" for k in range(3) if r.random() < 0.9] + [f"own {i} {k}" for k in range(r.randint(1, 5))] + [f"told {i // 9}"] * (r.random() < 0.4) + notes
        rows.append((i, host, f"/{r.choice('abc')}/{r.randint(10, 99)}/{i}", marked, lines))
    page = lambda marked, lines: ("<article>" if marked else "<div>") + "".join(f"<p>{x}</p>" for x in lines) + ("</article>" if marked else "</div>")
    df = spark.createDataFrame([(i, f"https://{h}{p}", page(m, x)) for i, h, p, m, x in rows], SCHEMA)
    want = brute(rows)
    assert texts(html.extract(df)) == want
    changed = [m for i, _, _, m, x in rows if want[i] != "\n".join(x)]
    assert changed.count(True) > 20 and changed.count(False) > 30
    monkeypatch.setattr(html, "PARTITION_ROWS", 25)
    monkeypatch.setattr(html, "BROADCAST_PAGES", 0)
    assert texts(html.extract(df)) == want


def test_near_copies_of_a_story_are_most_of_a_host(spark):
    story = "".join(f"<p>story {k}</p>" for k in range(12))
    rows = [page(i, f"<article>{story}<p>version {i}</p></article>") for i in range(12)] + [page(f"9{i}", f"<article><p>text {i}</p></article>") for i in range(8)]
    got = texts(html.extract(spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(rows)], SCHEMA)))
    assert all(t.startswith("story 0\nstory 1\n") for i, t in got.items() if i < 12)


def test_names_are_whole_words():
    one = lambda page: html.content(page)[0]
    text = "<p>" + "body text " * 20 + "</p>"
    kept = ['<h2 id="related-work">H</h2>', '<section id="related-work"><p>S</p></section>', '<p class="sponsored-research">R</p>', '<section class="recommended-dosage">D</section>', '<h2 id="comment-on-policy">C</h2>', '<ul class="menu"><li>Soup</li></ul>', '<p class="no-sidebar ad-supported">N</p>', '<h3 id="comments">Q</h3>', '<div class="banner">B</div>']
    assert "".join(one(f"<article>{text}{''.join(kept)}</article>")[1:]) == "HSRDCSoupNQB"
    gone = ['<div class="replies">x</div>', '<div class="comment-list">x</div>', '<div id="disqus_thread">x</div>', '<ul class="thread">x</ul>', '<div class="discussion">x</div>', '<div class="ad-box-2">x</div>', '<ul class="menu"><li><a>x</a></li></ul>', '<form><input>x</form>', '<div role="navigation">x</div>', '<div class="post share-buttons">x</div>']
    assert len(one(f"<article>{text}{''.join(gone)}</article>")) == 1


def test_forms_and_boxes_around_the_text():
    one = lambda page: html.content(page)[0]
    assert one('<body><form id="aspnetForm"><p>All of the page is in a form</p></form></body>') == ["All of the page is in a form"]
    assert one('<body><form><article><p>Story of the page</p></article></form><form>Your mail</form></body>') == ["Story of the page"]
    assert one('<body><div class="widget"><p>All of the page is in a widget</p></div><div class="widget">small</div></body>') == ["All of the page is in a widget"]
    assert one('<article><p>Short story</p></article><div class="comments">' + "<p>many readers say</p>" * 3 + "</div>") == ["Short story"]


def test_headings_and_lines_elsewhere_stay(spark):
    """Lines of an article only go at one place of half of the host's pages, and then wherever they stand there."""
    body = lambda i: "<h1>Weekly news</h1><p>By our staff</p>" + f"<p>text {i}</p>" * (1 + i % 3) + ("<p>Told twice</p>" if i % 4 == 0 else "") + f"<p>end {i}</p><p>Subscribe</p>"
    rows = [page(i, f"<article>{body(i)}</article>") for i in range(12)]
    got = texts(html.extract(spark.createDataFrame(rows, SCHEMA)))
    assert got == {i: "\n".join(["Weekly news", *[f"text {i}"] * (1 + i % 3), *["Told twice"] * (i % 4 == 0), f"end {i}"]) for i in range(12)}


def test_no_text_of_an_article_is_lost(spark):
    import re

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        return
    df = spark.read.parquet(path)
    got = texts(html.extract(df))
    for r in df.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)
        plain = " ".join(html.entities.unescape(re.sub(r"<[^>]*>", " ", article[1])).split())
        assert got[r.page_id].replace(" ", "").replace("\n", "") == plain.replace(" ", "")


def test_awkward_pages(spark):
    long = "<article>" + "".join(f"<p>line {k} of a very long page</p>" for k in range(60_000)) + "</article>"
    rows = [(1, "http://h.com/1", long, "a", 1, True), (None, None, None, None, None, None), (None, None, None, None, None, None), (2, "", "", "x", 2, False), (3, "not a url", "<p>t</p>", "y", 3, True), (1, "http://h.com/1", long, "b", 1, True)]
    df = spark.createDataFrame(rows, SCHEMA + ", text string, uid long, marked boolean")
    got = sorted(((r.page_id or 0), r.n_chars, r.text[:6]) for r in html.extract(df).collect())
    size = len("\n".join(f"line {k} of a very long page" for k in range(60_000)))
    assert got == [(0, 0, ""), (0, 0, ""), (1, size, "line 0"), (1, size, "line 0"), (2, 0, ""), (3, 1, "t")]
