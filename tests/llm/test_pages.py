"""HTML extraction on small pages."""

import random
import time

from targetlake.llm import html_extraction as h

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>No</title><style>p{}</style><script>var t="</p><p>x";</script></head><body><nav><ul><li><a href="/">menu</a></ul></nav>'
    '<!-- note --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>First  text\nhere.<br>more<p>Second &lt;b&gt;&nbsp;text</p><form>mail</form>'
    '<div class="comments"><p>reader</p></div><aside>side</aside></article><footer>&copy; x</footer></body></html>'
)


def test_blocks_of_a_page():
    assert h.extracted(h.blocks(PAGE), ["html>body>article"]) == "Head & line\n\nFirst text here. more\n\nSecond <b> text"
    assert h.extracted(h.blocks("<p>unclosed <"), None) == "unclosed <"
    assert h.extracted(h.blocks(""), None) == "" and h.blocks("<!-- open") == [] and h.blocks("<p class='x") == []


def test_consensus_beats_a_page_of_its_own(spark):
    body = lambda main, noise: f"<html><body><div class='post-{len(main)}'><p>{main}</p></div><div class='extra'><p>{noise}</p></div></body></html>"
    rows = [(i, "http://h.example/x", body("main text " * 30, "noise"), "clash") for i in range(5)] + [(9, "http://h.example/y", body("short text of the page", "noise " * 30), "clash")]
    rows += [(10, None, None, None), (11, "http://other.example/", "<p>alone</p>", None), (9, "http://h.example/y", body("short text of the page", "noise " * 30), "clash")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[9] == "short text of the page" and by[10] == "" and by[11] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_article_is_kept(spark):
    lead, body = "lead " * 20, "body " * 80
    pages = [
        ("a", f"<html><body><nav>menu</nav><article><div class=lead><p>{lead}</div><div class=body><p>{body}</div></article><div class=x>out</div></body></html>"),
        ("b", f"<html><body><article><h1>Title</h1><p>{lead}</p><section><p>{body}</section><section><p>{body}</section></article></body></html>"),
        ("c", f"<html><body><main><p>{lead}</p><ul><li>{body}<li>{body}</ul></main></body></html>"),
        ("d", f"<html><body><div class=page><div class=lead><p>{lead}</div><div class=body><p>{body}</div><div class=links><a href=x>{lead}</a></div></div><div class=x>out</div></body></html>"),
        ("e", "<article>one <svg/> two <svg width='5' /> three <math><mi>x</mi><mo>=</mo><mspace/><mn>5</mn><annotation>tex</annotation></math> four</article>"),
    ]
    rows = [(i, f"http://{name}.example/{i}", html) for name, html in pages for i in range(2)]
    got = {r["url"][7]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    lead, body = lead.strip(), body.strip()
    assert got["a"] == f"{lead}\n\n{body}" and got["b"] == f"Title\n\n{lead}\n\n{body}\n\n{body}" and got["c"] == f"{lead}\n\n{body}\n\n{body}"
    assert got["d"].startswith(f"{lead}\n\n{body}") and "out" not in got["d"] and got["e"] == "one two three x=5 four"


def random_page(rng, template, words):
    """A page of a host's template and the text that it should give."""
    said = []

    def prose():
        text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))
        said.append(text)
        first, rest = text.split(" ", 1)
        return rng.choice([f"<p title=it's>{text}", f"<P CLASS='body txt' data-class=ad>{text}</P>", f"<p>{first} <b><i>{rest}</b></i></p>", f"<p>{first}&nbsp;\n {rest}</p>", f"<p>{text}"])

    def noise():
        return rng.choice(["<nav><ul><li><a href=/>menu</a></ul></nav>", "<aside>side <div>deep</div></aside>", "<div class='ad box'>buy</div>", "<script>if (a < b) '<p>no</p>'</script>", "<form>mail <input></form>", "<!-- <p>no</p> -->", "<style>p {}</style>", "<div id=comments><p>reader</div>", "<div role=navigation>x</div>", "<div class=cookie-notice>ok</div>"])

    def body(depth):
        out = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.25:
                out.append(noise())
            if kind < 0.5 and depth < 4:
                name, extra = rng.choice([("div", " class=part7"), ("section", ""), ("div", ""), ("section", ' class="s x"')])
                out.append(f"<{name}{extra}>{body(depth + 1)}</{name}>")
            else:
                out.append(prose())
        return "".join(out)

    inner = body(0) + "<div class=text>" + "".join(prose() for _ in range(4)) + "</div>"
    title = "Title of " + rng.choice(words)
    said.insert(0, title)
    start, end = template
    header = "<div class=entry-header><h1>" if "<article" in start else "<h1>"
    page = f"<html><head><title>no</title></head><body><header><h2>Site</h2></header>{noise()}{start}{header}{title}</h1>{'</div>' if 'div' in header else ''}{inner}{end}{noise()}<footer>&copy;</footer>"
    return page + rng.choice(["", "</body></html>", "</body>", "<div><div>" + "<div class='sidebar'>"]), "\n\n".join(said)


def test_generated_pages(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    templates = [("<article>", "</article>"), ("<main><div class=c><article class='post-1'>", "</article></div></main>"), ("<main>", "</main>"), ("<div class='page p12'>", "</div>"), ("<div id=x><div class=story>", "</div></div>")]
    rows, want = [], {}
    for i in range(300):
        page, text = random_page(rng, templates[i % 5], words)
        rows.append((i, f"https://host{i % 5}.example:80/{i}", page, "clash"))
        want[i] = text
    table = spark.createDataFrame(rows + [(300, None, None, None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in h.extract(table).collect()}
    assert got.pop(300) == "" and [i for i in want if got[i] != want[i]] == []


def test_pages_with_very_many_open_tags():
    n = 100_000
    for page, text in (("<div>" * n + "x", 1), ("<div>x" * n, n), ("<b>" * n + "<div>x</div>" * n, n), ("<li><div>" + "<i>" * n + "<li>x</li>" * n, n), ("x</i>" * n, n), ("<i>" * n + "x</b>" * n, n)):
        found = h.blocks(page)
        assert sum(len(b.text) for b in found) == text and len({b.path for b in found}) <= h.DEPTH + 1
        assert len("".join(h.extracted(found, None).split())) <= text
    long = "word " * 2_000_000
    assert h.extracted(h.blocks(f"<article><p>{long}</article>"), None) == long.strip()


def test_quotes_and_unended_elements():
    read = lambda page: h.extracted(h.blocks(page), None)
    assert read("<article><p title=it's>first</p><p data-x=\"a>b\">second</p><p x='>'>third</article>") == "first\n\nsecond\n\nthird"
    assert read("<article>one <svg> two <noscript> three</article>") == "one two three"
    assert read("<body><div class=header>site</div><article><div class=entry-header><h1>Title</h1></div><p>text<script>end</article>") == "Title\n\ntext"
    assert read("<article><p title='class=ad'>kept</p><p id=ad>no</p></article>") == "kept"


def texts(spark, pages):
    """Extracted texts by page, each (host, html)."""
    rows = [(i, f"http://{host}.example/{i}", page) for i, (host, page) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_no_main_text_is_lost(spark):
    """Parts beside each other in the body, names that only look like notices, headings before the article, odd comments."""
    intro = [(f"i{k % 2}", f"<html><body><div class=intro><p>{prose(k, 20)}</div><div class=content><p>{prose(100 + k)}</div><div class=foot><p>x</div></body></html>") for k in range(8)]
    names = ["<section id=related-work>", "<div class=share-price>", "<p class=notice-of-death>", "<section class=menu-week>", "<section class=commentary>"]
    named = [("n", f"<html><body><article><h1>T{k}</h1><p>{prose(200 + k)}</p>{name}{prose(300 + k, 20)}</article></body></html>") for k, name in enumerate(names)]
    teaser = [("t", f"<body><div class=post><p>{prose(400 + k)}</div></body>") for k in range(6)] + [("t", f"<body><div class=post><p>teaser</div><div class=story><p>{prose(450)}</div></body>")]
    heading = [("h", f"<body><header><h1>Site</h1></header><h1>Title {k}</h1><article><p>{prose(500 + k)}</article></body>") for k in range(2)]
    odd = [("o", f"<body><article><p>{prose(600)}<!--> <p>{prose(601)}<!-- x --!><p>{prose(602)}<!---><p>{prose(603)}</article></body>")]
    got = texts(spark, [*intro, *named, *teaser, *heading, *odd])
    want = [f"{prose(k, 20)}\n\n{prose(100 + k)}" for k in range(8)] + [f"T{k}\n\n{prose(200 + k)}\n\n{prose(300 + k, 20)}" for k in range(5)]
    want += [prose(400 + k) for k in range(6)] + [prose(450)] + [f"Title {k}\n\n{prose(500 + k)}" for k in range(2)] + ["\n\n".join(map(prose, range(600, 604)))]
    assert got == dict(enumerate(want))


def test_named_containers_go_by_evidence(spark):
    """Short, mostly links or repeated on the host: gone; long and its own: kept. Copies of a page are one page."""
    notice, links = prose(1, 90), " ".join(f"<a href=/{k}>{prose(k, 3)}</a>" for k in range(40))
    page = lambda k, extra: f"<html><body><article><p>{prose(700 + k)}</p>{extra}</article></body></html>"
    pages = [("r", page(k, f"<div class=cookie-notice>{notice}</div><div class=ad>buy {k}</div><div class=related>{links}</div>")) for k in range(5)]
    own = page(9, f"<div class=promo-text>{prose(9, 90)}</div><div class=comments><p>{prose(2, 200)}</div>")
    got = texts(spark, [*pages, ("c", own), ("c", own)])
    assert got == {**{k: prose(700 + k) for k in range(5)}, 5: f"{prose(709)}\n\n{prose(9, 90)}", 6: f"{prose(709)}\n\n{prose(9, 90)}"}


def test_unended_tags_take_time_in_proportion():
    """Pages of 5 MB of tags that never end."""
    for tag in ("<noscript>", "<svg>", "<object data=x>", "<iframe>", "<!-- x --!>", "<select><canvas>"):
        page = "<article><p>first</p>" + tag * (5_000_000 // len(tag)) + "<p>last</article>"
        began = time.process_time()
        text = h.extracted(h.blocks(page), None)
        assert text == "first\n\nlast" and time.process_time() - began < 20


def test_tied_votes_and_missing_winners(spark):
    page = lambda name, k: f"<html><body><div class=page><div class={name}><p>{prose(k)}</div></div></body></html>"
    got = texts(spark, [("v", page("b", 800)), ("v", page("a", 801)), ("w", "<body><main><p>one</main></body>"), ("w", "<body><main><p>two</main></body>"), ("w", f"<div><p>{prose(802)}</div>"), ("w", "")])
    assert got == {0: prose(800), 1: prose(801), 2: "one", 3: "two", 4: prose(802), 5: ""}
