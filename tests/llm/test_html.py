from llm_rows import SF

from tabulith.llm import html, queries


def test_rules():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
    <body><header class=top>Site name</header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
    <main><article><header><h1>The &amp; title</h1></header><p>First <b>para</b>graph&nbsp;of   the text.<p>Second.<br>Line
    <aside>Also read the other one</aside><form><input><p>Sign up</p></form><div class="ad">Buy</div></article>
    <section id=comments><article class=comment><p>I liked the article a lot and will read it again.</p></article></section></main>
    <div class="sidebar"><p>Popular posts of the week and of the month</p></div><footer>&copy; us</footer></body></html>"""
    assert html.main_text(page) == "The & title First paragraph of the text. Second. Line"


def test_without_an_article():
    long = "It was the first day of the year and the people of the town were in the street to see what it was that had come to them. "
    page = f"<body><div>{'<a href=x>Link text here</a> ' * 9}</div><h2>A short head</h2><p>{long * 3}</p><p>Short too.</p><p>{long * 2}</p><div>{'<a href=y>Other link</a> ' * 9}</div></body>"
    assert html.main_text(page) == " ".join(["A short head", (long * 3).strip(), "Short too.", (long * 2).strip()])


def test_class_words_are_whole():
    text = "It was the first day of the year and the people of the town were in the street to see what it was."
    for attributes in ('class="overflow-hidden"', 'aria-hidden="false"', 'id="related-work"', 'class="search-results"', 'data-hidden="1"'):
        assert html.main_text(f"<article><div {attributes}><p>{text}</p></div></article>") == text, attributes
    for attributes in ("hidden", 'aria-hidden="true"', 'style="display: none"', 'class="site-footer"', 'class="x cookie-notice"', 'class="navMenu"', 'id="comments-list"'):
        assert html.main_text(f"<article><p>{text}</p><div {attributes}><p>{text} Not this.</p></div></article>") == text, attributes


def test_stop_words_decide(spark):
    """First labels depend on stop words, on real pages and for lists of names."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    changed = 0
    for p in pages:
        found = html.blocks(p or "")
        changed += sum(html._first_label(b, True, True) != html._first_label(html.Block("x" * len(b.text), b.linked, b.furniture, b.inside), True, True) for b in found)
    assert changed > len(pages)
    names = "Berlin Paris Madrid Lisbon Vienna Prague Warsaw Dublin Athens Oslo Riga Tallinn Vilnius Sofia " * 3
    prose = "It was the first day of the year and the people of the town were in the street to see what it was that had come to them. " * 2
    assert html.main_text(f"<body><p>{names}</p><p>{prose}</p></body>") == prose.strip()


def test_broken_pages():
    for page in ("", "   ", "<", "<p", "<!-- open", "<script>x", "plain words", "<p>a<p>b", "&am", "</div></div>x"):
        html.main_text(page)
    assert html.main_text("<article><p>The text is cut &am") == "The text is cut &am"
    assert html.main_text("<article><p>A</p><footer>f</article>") == "A"


def test_query(spark):
    got = queries.op7_html_extraction(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "<" not in r.text.replace("<|", "") for r in got)
    odd = spark.createDataFrame([(1, "u", None, 0), (None, None, "", 1), (2, "v", "<article>x", 2), (2, "v", "<article>x", 2)], "page_id long, url string, html string, id int")
    assert sorted(str(r.text) for r in html.extract(odd).collect()) == ["", "", "x", "x"]
    assert html.extract(odd.limit(0)).count() == 0
