"""Main text of planted pages."""

import random

from tidewheel.llm import html_extract

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><header class="site-header"><h2>My site</h2></header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div><aside>Side {n}</aside>
{open}<h1>Title {n}</h1><p><b>First {n} &copy; one<br><p>Second
 has   <i>inner</i> white&nbsp;space</p><ul><li>item a<li>item b {n}</ul><form><input value="x">Subscribe</form>{close}
<section class="comments"><article class="comment"><p>Nice post {n}</p></article></section><footer>&copy; host &middot; {n}</footer></body></html>"""


def expected(n):
    return f"Title {n}\nFirst {n} © one\nSecond has inner white space\nitem a\nitem b {n}"


def test_articles_and_plain_containers(spark):
    rows = []
    for n in range(6):
        rows.append((n, f"https://a.example/{n}", PAGE.format(n=n, open="<article>", close="</article>")))
        rows.append((10 + n, f"https://B.example/{n}", PAGE.format(n=10 + n, open='<div class="body-text">', close="</div>")))
    rows += [(30, "https://lone.example/", PAGE.format(n=30, open="<main>", close="</main>")), (31, None, None), (32, "u", ""), (33, "u", "plain &lt;text&gt;\n here"), (34, "https://a.example/x", "<p>no article")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    want = {k: expected(k) for k, _, h in rows if h and "Title" in h} | {31: "", 32: "", 33: "plain <text> here", 34: "no article"}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def vectors(pages):
    """Occurrence vectors of elements and words, counted page by page."""
    elements, words = {}, {}
    for k, page in enumerate(pages):
        blocks, paths = html_extract.read_page(page)
        for path, n in paths.items():
            elements.setdefault(path, [0] * len(pages))[k] = n
        for b in blocks:
            own = b.text.split(" ")
            for before, word in zip(["", *own], own):
                words.setdefault((b.path, before, word), [0] * len(pages))[k] += 1
    return elements, words


def test_vectors_form_classes(spark):
    rows = [(n, "https://a.example/", "<body><div><p>x</p></div>" + "<section><h2>a</h2><p>b</p></section>" * (n % 3)) for n in range(6)]
    own = html_extract.hosted(spark.createDataFrame(rows, "page_id long, url string, html string"), ("page_id",))
    none = spark.createDataFrame([], "__host string, tokens array<bigint>")
    got = {r.path: (r.pages, r.occurrences, r.low, r.high) for r in html_extract.occurrence_vectors(own, none).collect()}
    assert got["/body"] == got["/body/div"] == got["/body/div/p"] == got[""]
    assert got["/body/section"] == got["/body/section/h2"] != got[""]


def test_classes_against_counting(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    pages = []
    for n in range(12):
        body = "".join(f"<p>{' '.join(rng.choices(words, k=rng.randrange(1, 9)))}</p>" for _ in range(rng.randrange(1, 5)))
        pages.append(f"<body><div class='x{n}'><p>Shared words of all the pages here</p><p>w0</p></div>{'<ul><li>a<li>b</ul>' * (n % 3)}<section>{body}<p>twice twice twice</p></section>")
    own = html_extract.hosted(spark.createDataFrame([(n, "https://a.example/", p) for n, p in enumerate(pages)], "page_id long, url string, html string").repartition(3), ())
    elements, counted = vectors(pages)
    candidates = html_extract.candidate_words(own).groupBy("__host").agg({"token": "collect_list"}).withColumnRenamed("collect_list(token)", "tokens")
    found = html_extract.occurrence_vectors(own, candidates).collect()
    mine = {r.path: r for r in found if r.path}
    assert {p: (r.pages, r.occurrences, r.squares) for p, r in mine.items()} == {p: (sum(map(bool, v)), sum(v), sum(x * x for x in v)) for p, v in elements.items()}
    classes = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in {tuple(x) if isinstance(x, list) else x for x in d.values()} if any(d[k] == v for k in d))
    assert classes({p: (r.pages, r.low, r.high) for p, r in mine.items()}) == classes({p: tuple(v) for p, v in elements.items()})
    by_token = {}
    for (path, before, word), v in counted.items():
        block = [html_extract.Block(path, f"{before} {word}".strip(), 0)]
        by_token[int(html_extract.word_tokens(block)[0][-1].astype("int64"))] = v
    assert {r.token: (r.pages, r.occurrences, r.squares) for r in found if r.token is not None} == {t: (sum(map(bool, v)), sum(v), sum(x * x for x in v)) for t, v in by_token.items()}
    fixed = set(html_extract.templates(own).first().fixed)
    assert fixed == {t for t, v in by_token.items() if min(v) == max(v) > 0} and len(fixed) >= 10


def test_a_host_without_articles_loses_shared_sentences_and_keeps_odd_names(spark):
    shared = "Welcome to our friendly community of readers number one"
    page = "<html><body><div class='top'><p>{shared}</p></div><div class='wrap'><p>{a}</p><p class='social-history'>{b}</p><p class='search-algorithms'>{c}</p><p>{shared}</p></div><div><p>{ad}</p></div></body></html>"
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(n))
    rows, want = [], {}
    for n in range(8):
        a, b, c, ad = text(60), text(30), text(30), text(4)
        rows.append((n, "https://plain.example/", page.format(shared=shared, a=a, b=b, c=c, ad=ad)))
        want[n] = "\n".join((a, b, c))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    assert all(html_extract.main_text(html) != want[n] for n, _, html in rows)  # the page alone does not tell


def test_edges(spark):
    shape = "page_id long, url string, html string, text string, template string, `fixed` long, path string"
    assert html_extract.extract(spark.createDataFrame([], shape)).count() == 0
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(None, None, "<p>a"), (None, None, "<p>a"), (1, "https://h/", f"<body><nav>menu</nav><article><p>{long}</article>"), (1, "https://h/", " "), (2, "https://tie/", "<body><div>one two</div><section>six ten</section>")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], shape)).collect()]
    assert sorted(got, key=str) == sorted([(None, "a", 1), (None, "a", 1), (1, long, len(long)), (1, "", 0), (2, "one two\nsix ten", 15)], key=str)


def test_broken_markup():
    blocks, _ = html_extract.read_page("<div><p>a<p>b</div>c<script>if (a<b) '</p>'</script>d<!-- x")
    assert [b.text for b in blocks] == ["a", "b", "cd"]
    assert html_extract.read_page('<p title="a>b">t</p><p class=\'q>x')[0][0].text == "t"
    assert html_extract.read_page("<" * 1000 + "p" * 1000)[0] != []


def test_fixed_text_inside_articles_goes(spark):
    page = "<body><article><p>Story {n}</p><div class='x'>Read our app</div><p>{shared}</p></article></body>"
    rows = [(n, "https://a.example/", page.format(n=n, shared="twice" if n < 2 else f"own {n}")) for n in range(12)]
    rows += [(100 + n, "https://few.example/", page.format(n=n, shared="own")) for n in range(3)]
    rows += [(200 + n, "https://copies.example/", "<article><p>One and the same</p></article>") for n in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Story 0\ntwice" and got[5] == "Story 5\nown 5"
    assert got[100] == "Story 0\nRead our app\nown"  # three pages do not tell content from template
    assert got[200] == "One and the same"


def test_names_of_articles_and_wrappers_do_not_hide_the_page():
    article = "<article{}><p>The story itself, long enough to be most of it.</p></article>"
    story = "The story itself, long enough to be most of it."
    for name in ("post category-social", "post tag-search", "category-promotions"):
        assert html_extract.main_text("<body>" + article.format(f' class="{name}"')) == story
    for opened, closed in (('<div id="page" class="right-sidebar">', "</div>"), ("<form action='/x'>", "</form>")):
        assert html_extract.main_text(f"<body><p>Skip</p>{opened}<div class='cookie-notice'>We use cookies</div>{article.format('')}{closed}") == story
    # what is boilerplate within or beside a text stays so
    assert html_extract.main_text(f"<body>{article.format('')}<div class='comments'><article class='comment'><p>Nice</p></article></div><form>Subscribe</form>") == story
    assert html_extract.main_text("<body><nav>Menu</nav><footer>Foot</footer>") == ""
    assert html_extract.main_text("<body><div class='promo'><p>All there is</p></div><nav>Menu</nav>") == "All there is"


def by_hand(rows):
    """Texts with vectors and classes counted page by page in every host."""
    hosts, out = {}, {}
    for page, url, html in rows:
        hosts.setdefault(url, []).append((page, html))
    for pages in hosts.values():
        pages.sort(key=lambda p: len(p[1].encode()))
        read = [html_extract.read_page(html) for _, html in pages]
        elements, words = vectors([html for _, html in pages])
        shortest = {w for w, v in words.items() if any(v[: html_extract.SHORTEST])}
        fixed = {w: tuple(v) for w, v in words.items() if w in shortest and sum(map(bool, v)) >= max(2, 0.75 * len(pages)) and len(set(v) - {0}) == 1}
        frame = []
        for path, v in [("", [1] * len(pages)), *elements.items()]:
            if max(v) == 1 and 2 * sum(v) >= len(pages):
                below = [b for blocks, _ in read for b in blocks if html_extract._inside(b.path, [path]) or not path]
                inner = sum((len(w.encode()) + 1) * sum(v) for (p, _, w), v in fixed.items() if html_extract._inside(p, [path]) or not path)
                frame.append({"path": path, "size": sum(len(b.text) for b in below), "linked": sum(b.linked for b in below), "fixed": inner})
        template = html_extract.choose_slots(frame)
        for (page, _), (blocks, paths) in zip(pages, read):
            chosen = [blocks[k] for k in html_extract.cut(blocks, template)]
            chosen = chosen or [blocks[k] for k in html_extract.cut(blocks, html_extract.own_template(blocks, paths))]
            stays = []
            for b in chosen:
                own = b.text.split(" ")
                of = [fixed.get((b.path, before, word)) for before, word in zip(["", *own], own)]
                best = max(({v for v in of if v}), key=of.count, default=None)
                if best is None or of.count(best) < 0.75 * len(own) or of.count(best) * (sum(map(bool, best)) - 1) < 30:
                    stays.append(b)
            if len(pages) * sum(len(b.text) for b in stays) < sum(len(b.text) for b in chosen):
                stays = chosen
            out[page] = "\n".join(b.text for b in stays)
    return out


def test_texts_against_classes_counted_by_hand(spark):
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    rows = []
    for host, n_pages in enumerate([1, 2, 3, 5, 9, 14]):
        lines = [text(k) for k in (1, 3, 8, 16, 30)]
        for n in range(n_pages):
            own = [text(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5))]
            own += [line for line in lines if rng.random() < 0.9] + [f"{lines[2]} {n} {lines[3]}"]
            rng.shuffle(own)
            body = "".join(f"<p>{x}</p>" for x in own)
            wrap = ("<article>{}</article>", "<div class='body'>{}</div>")[host % 2].format(body)
            rows.append((100 * host + n, f"https://h{host}.example/", f"<body><nav>{text(2)}</nav><div class='box'><p>{lines[4]}</p></div>{wrap}<footer>{text(3)}</footer></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == by_hand([(p, u, h) for p, u, h in rows])
    assert sum(got[p] != html_extract.main_text(h) for p, _, h in rows) > 15  # the host decides


def test_near_constant_blocks_and_blocks_with_one_varying_word_go(spark):
    notice = "Join the readers of our letter today and never miss a story"
    page = "<body><article><h1>Title {n} of it</h1><p>{own}</p><p>{notice}</p><p>This story has been read by so many readers {n}</p></article></body>"
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    for total in (5, 7, 8, 10):  # no size of host switches the rule
        rows = [(n, "https://a.example/", page.format(n=n, own=text(40), notice=notice if n != 4 or total < 8 else text(9))) for n in range(total)]
        got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert not any(notice in t or "so many readers" in t for t in got.values()) and all(t.startswith(f"Title {n} of it\n") for n, t in got.items())


def test_two_versions_of_a_page_keep_what_they_share(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    shared, ends = text(200), [text(10), text(12)]
    rows = [(n, "https://a.example/", f"<body><article><p>{shared}</p><p>{ends[n]}</p></article></body>") for n in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"{shared}\n{ends[n]}" for n in range(2)}


def test_titles_in_headers_of_articles_and_notes_stay():
    for name in ("header", "page-header", "masthead"):
        assert html_extract.main_text(f"<body><div class='header'>Site</div><article><div class='{name}'><h1>The Title</h1></div><p>The story, long enough.</p></article>") == "The Title\nThe story, long enough."
    assert html_extract.main_text("<body><article><p>The story, long enough.</p><div role='note'><p>A note on it.</p></div></article>") == "The story, long enough.\nA note on it."


def test_kept_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(1, "https://a/", "<article><p>a story</p></article>", "h", 5, "own")], "page_id long, url string, html string, __host string, __key long, `__html` string")
    row = html_extract.extract(df, keep=("page_id", "__html", "__host", "__key")).first()
    assert tuple(row) == (1, "own", "h", 5, "a story", 7)


def test_fixed_text_that_the_shortest_pages_lack_is_found(spark):
    note = "every reader of this host is kindly asked to support our work with a small gift"
    pages = []
    for k in range(40):
        own = " ".join(f"w{k}x{j}" for j in range(20 + k))
        pages.append((k, f"http://h/{k}", f"<html><body><article><p>{own}</p>{'' if k < 4 else f'<p>{note}</p>'}</article></body></html>"))
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    assert len(got) == 40 and not any(note in text for text in got.values())
    assert all(f"w{k}x0" in got[k] for k in got)
