import re
from html import unescape

from patternloom.llm.pages import UNSEEN, best_region, extract_text, main_text, train_weights

SF = "/root/testdata/sf0.01"


def test_region_of_largest_sum():
    import random

    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randrange(9))]
        a, b = best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *sums])


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = train_weights(pages)
    assert all(w > 0 if n.startswith("word") else w < 0 for n, w in weights.items())
    for r in extract_text(pages, weights).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_parts_that_are_no_article(spark):
    weights = train_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    text = "word " * 40
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href='/'>Home</a></nav>"
        f"<article><h1>Head &amp; &lt;b&gt;</h1><p>{text}<b>bold</b> &#233;\n x</p><div class='ad banner'>Buy now</div><script>a('<p>no</p>')</script>"
        f"<p>{text}</p><form><label>Mail</label></form><!-- <p>gone</p> --></article><aside>Side</aside>"
        "<section id='comments'><p>first comment of a reader</p></section><footer>&copy; me</footer></body></html>"
    )
    words = text.strip()
    assert main_text(page, weights) == f"Head & <b>\n\n{words} bold é x\n\n{words}"
    assert main_text(None, weights) == main_text("", weights) == main_text("<p></p>", weights) == ""
    assert main_text("just words & more", {}) == "just words & more"
    assert set(UNSEEN) == {"word", "tag"}


def test_names_in_the_article_drop_nothing(spark):
    weights = train_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    text = ("word " * 40).strip()
    body = f"<h1>Head</h1><p>{text}</p>"
    want = f"Head\n\n{text}"
    nav = "<nav><a href='/'>Home</a></nav>"
    for page in (
        f"<body class='single has-sidebar'>{nav}<article>{body}</article></body>",
        f"<body class='comments-open'>{nav}<article>{body}</article></body>",
        f"<html class=search><body id='search'>{nav}<main role=search class='widget'><article class='related'>{body}</article></main></body></html>",
        f"<div class='content with-sidebar'>{body}</div>",
        f"<div class='search'>{nav}<article>{body}</article></div>",
        f"<div class='search'>{nav}{body}</div>",
        f"<form id='search'>{nav}<article>{body}</article></form>",
        f"<article><h1>Head</h1><p data-id='search' data-role=nav title=\" class='ad' \">{text}</p></article>",
        f"<article>{body}</article><div class='related'><article><p>other teaser</p></article></div>",
        f"<main>{body}<div id='comments'><article><p>a comment</p></article></div></main>",
    ):
        assert main_text(page, weights) == want, page
    page = f"<article>{body}<section id='related-work'><h2 id='binary-search'>Works</h2><p>{text}</p></section><h2 id='search'>More</h2><p>{text}</p></article>"
    assert main_text(page, weights) == f"{want}\n\nWorks\n\n{text}\n\nMore\n\n{text}"
    page = f"<article>{body}<div CLASS = 'x AD'>Buy</div><div id=comments>me too</div><div role='navigation'>On</div><p>{text}</p></article>"
    assert main_text(page, weights) == f"{want}\n\n{text}"


def test_raw_elements_end_at_their_parent(spark):
    weights = train_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    text = ("word " * 40).strip()
    rest = f"<p>{text}</p><svg><title>t</title></svg></article></body></html>"
    for raw in ("button", "svg", "select", "option", "textarea", "iframe", "noscript", "template"):
        page = f"<html><body><article><h1>Head</h1><p>{text} <{raw}>gone</p>{rest}"
        assert main_text(page, weights) == f"Head\n\n{text}\n\n{text}", raw
        page = f"<html><body><article><h1>Head</h1><p>{text} <{raw}><i>gone</i></{raw}>kept</p>{rest}"
        assert main_text(page, weights) == f"Head\n\n{text} kept\n\n{text}", raw
    for start in ("<head><title>T</head><body>", "<head><title>T<body>", "<body><button>Go", "<body><svg><path d=''>"):
        assert main_text(f"<html>{start}<article><h1>Head</h1>{rest}", weights) == f"Head\n\n{text}"
    page = f"<article><h1>Head</h1><p>{text} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is <object data=o>shown</object> here</p>{rest}"
    assert main_text(page, weights) == f"Head\n\n{text} x=1 is shown here\n\n{text}"
    page = f"<article><h1>Head</h1><p>{text} <math><mi>x <object>shown</p>{rest}"
    assert main_text(page, weights) == f"Head\n\n{text} x shown\n\n{text}"
    assert main_text(f"<article><p>{text}</p><script>var a = '<p>no</p>'", weights) == text
    assert main_text("<textarea>" * 50_000 + f"<div>{text}</div>", weights) == ""


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "old", 1), (None, "u", "", None, None), (2, "u", "<p>a b</p>" * 3000, "x", 2), (2, "u", "<p>a b</p>" * 3000, "x", 2)]
    pages = spark.createDataFrame(rows, schema)
    got = extract_text(pages, train_weights(pages))
    assert set(got.columns) == set(pages.columns)
    assert sorted((str(r.page_id), len(r.text)) for r in got.collect()) == [("1", 0), ("2", 14998), ("2", 14998), ("None", 0)]
    assert extract_text(pages.limit(0), {}).count() == 0


def test_blocks_at_every_place_of_an_article(spark):
    weights = train_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    text = ("word " * 40).strip()
    paragraphs = [f"<p>{text}</p>"] * 3
    parts = {
        "<ul>" + "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(20)) + "</ul>": [f"item {k}" for k in range(20)],
        "<ol><li>one<li>two<li>three</ol>": ["one", "two", "three"],
        "<table><caption>Cap</caption><tr><th>a<th>b<tr><td>1</td><td>2</td></tr></table>": ["Cap", "a", "b", "1", "2"],
        "<pre><code>x = 1</code></pre>": ["x = 1"],
        "<dl><dt>term</dt><dd>meaning</dd></dl>": ["term", "meaning"],
        "<figure><img src='x.png'><figcaption>A caption</figcaption></figure>": ["A caption"],
        "<blockquote>said</blockquote>": ["said"],
    }
    outside = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy</div>"
    for part, lines in parts.items():
        for at in range(4):
            body = "<h1>Head</h1>" + "".join([*paragraphs[:at], part, *paragraphs[at:]])
            want = "\n\n".join(["Head", *[text] * at, *lines, *[text] * (3 - at)])
            for page in (f"<body>{outside}<article>{body}</article><footer>f</footer></body>", f"<body>{outside}<div>{body}</div><div><a href='/'>x</a></div><footer>f</footer></body>", f"<body>{outside}{body}<div><a href='/x'>x</a></div></body>"):
                assert main_text(page, weights) == want, page


def test_broken_pages_take_linear_time(spark):
    import time

    text = ("word " * 40).strip()
    n = 5 << 20
    start = time.perf_counter()
    for page in ("<a " * (n // 3), "<a \"x>\" " * (n // 9), "<b>" * (n // 30) + "x</i>" * (n // 30), "<div>" * (n // 40) + "x" * 9, "<" * n, "<!--" * (n // 4), "</p " * (n // 4), "<b>x" * (n // 30)):
        assert text in main_text(f"<article><p>{text}</p>" + page, {})
    assert time.perf_counter() - start < 120
    assert main_text(f"<p title=\"a>{text}</p><p>{text}</p>", {}).endswith(text)


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a b</p>", 1, 2, "x")], "page_id long, url string, html string, _html int, `a.b` int, Text string")
    got = extract_text(rows, {})
    assert got.columns == ["page_id", "url", "html", "_html", "a.b", "text"] and tuple(got.head()) == (1, "u", "<p>a b</p>", 1, 2, "a b")
