import html
import json
import random
import re
from collections import Counter

import pytest

from braidgraph.llm import wrappers as w


def expected(page):
    inside = page.split("<article>", 1)[1].split("</article>")[0]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1|article)>", inside)]
    return "\n".join(p for p in parts if p)


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    source = {r["page_id"]: r for r in pages.collect()}
    rows = w.main_text(pages.selectExpr("*", "'z' AS w_main", "'z' AS host")).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r["text"] == expected(source[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == source[r["page_id"]]["url"]


def page(draw, style):
    body = [f"Paragraph {draw.random()} &amp; <i>more</i>\n  text &eacute;" for _ in range(draw.randint(1, 6))]
    parts = "".join(f"<p>{b}</p>" for b in body)
    want = "\n".join(["Title", *(" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in body)])
    comments = "".join(f"<li>comment {i} {draw.random()}</li>" for i in range(draw.randint(0, 9)))
    if style:
        return f"<html><head><title>t</title></head><body><div class='topbar menu'>Menu</div><div id=content><h1>Title</h1>{parts}<div class='ad-box ad'>Buy</div><form>Name <input></form></div><div class='sidebar'>Side {draw.random()}</div><ul class=comments>{comments}</ul><div class=cookie-notice>We use</div></body></html>", want
    return f"<body><header>Head</header><main><h1>Title</h1>{parts}<aside>Also</aside><script>if (a<b) x('</p>')</script></main><section class='comments'>{comments}</section><footer>Foot</footer></body>", want


@pytest.mark.parametrize("style", [0, 1])
def test_other_layouts(spark, style):
    draw = random.Random(style)
    made = [page(draw, style) for _ in range(30)]
    rows = w.main_text(spark.createDataFrame([(i, "http://h.com/", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [t for _, t in made]


def matches(items, stream, at=0):
    """The ends that an expression can reach in a list of tokens."""
    ends = {at}
    for x in items:
        if isinstance(x, str):
            ends = {e + 1 for e in ends if e < len(stream) and stream[e] == x}
        elif x[0] == "?":
            ends |= {f for e in ends for f in matches(x[1], stream, e)}
        else:
            reached, new = set(), ends
            while new:
                new = {f for e in new for f in matches(x[1], stream, e) if f > e} - reached
                reached |= new
            ends = reached
    return ends


def test_a_wrapper_matches_all_its_pages():
    draw = random.Random(5)
    pages = [page(draw, i % 2)[0] for i in range(25)] + ["<p>", "<p>a<p>b<p>c", "x"]
    al, streams = w.Alphabet(), []
    for p in pages:
        stream, _ = w.stream_of(p, al)
        flat = []
        for kind, name, rest in w.tokens(p):
            if kind != "text" or rest.strip():
                flat.append("#text" if kind == "text" else f"<{w.label(name, rest)}>" if kind == "open" else f"</{name}>")
        streams.append((stream, flat))
    wrapper = None
    for s, _ in streams:
        wrapper = s if wrapper is None else w.merge(wrapper, s, al)
    items = al.expanded(wrapper)
    assert all(len(flat) in matches(items, flat) for _, flat in streams)
    assert "(" in w.pattern(items)


def test_folding():
    al = w.Alphabet()
    one = "".join(map(al.letter, ["<li>", "#text", "</li>"]))
    assert w.pattern(al.expanded(w.fold(one * 4, al))) == "(<li> #text </li>)+"
    plain, many = w.fold(one, al), w.fold(al.letter("<ul>") + one * 3 + al.letter("</ul>"), al)
    assert w.pattern(al.expanded(w.merge(many, al.letter("<ul>") + plain + al.letter("</ul>"), al))) == "<ul> (<li> #text </li>)+ </ul>"
    assert w.pattern(al.expanded(w.merge(al.letter("a") + al.letter("b"), al.letter("a"), al))) == "a (b)?"


def test_hostile_pages():
    for bad in ("<a" * 50_000, '<a "' * 50_000, "<!--" * 20_000, "<script>" * 20_000, "<p>x" * 20_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, "</p>" * 10_000, "\x00<\xff>", "<p title='>'>a</p>"):
        w.stream_of(bad, w.Alphabet())
        w.extract(bad, "")
    assert w.extract("<p title='>'>a <b>b</b></p>c&#233;", "") == "a b\ncé"
    assert w.extract("a<!-- x > y", "") == "a"
    assert w.region(Counter()) == ""


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (2, "", ""), (3, "no scheme", "<p>x"), (None, "http://a/", "<article>y</article>")]
    got = w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("3", "x", 1), ("None", "y", 1)]
    assert w.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    rows = w.main_text(spark.createDataFrame([(i, "http://h.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))
    return [r["text"] for r in rows.orderBy("page_id").collect()]


def test_slots_that_hold_the_same_on_all_pages_go(spark):
    draw = random.Random(11)
    own = [[f"Words {draw.random()} of page {i} and more {draw.random()}" for _ in range(draw.randint(1, 4))] for i in range(12)]
    box = [i % 2 == 0 for i in range(12)]  # an optional group
    pages = [f"<body><article><h2>About</h2><div class=x>Read all about it here</div>{''.join(f'<p><b>Note</b> {t}</p>' for t in o)}{'<div class=y><p>Posted on this site</p></div>' if b else ''}<p>All rights kept</p></article></body>" for o, b in zip(own, box, strict=True)]
    assert texts_of(spark, pages) == ["\n".join(["About", *(f"Note {t}" for t in o)]) for o in own]
    # A few copies of a page, or nearly, are no evidence, and neither are two pages.
    copies = ["<article><p>The whole of the only text, that is copied</p><p>Another one that is copied too</p></article>".replace("too", t) for t in ("too", "too", "a", "b", "c")]
    assert all(t.startswith("The whole") for t in texts_of(spark, copies))
    assert [t.split("\n")[-1] for t in texts_of(spark, pages[:2])] == ["All rights kept"] * 2


def test_places_in_a_wrapper():
    m = w.Matcher(["a", ["?", ["b", ["+", ["#text"]]]], ["+", ["c", "#text"]], "#text"])
    one, many = m.places(["a", "c", "#text", "#text"]), m.places(["a", "b", "#text", "#text", "c", "#text", "c", "#text", "#text"])
    assert one[1:] == many[-3:] and many[2] == many[3] and many[4] == many[6] and many[5] == many[7] != many[8]
    assert m.places(["a"]) is None and m.places(["b"]) is None


def test_all_blocks_of_an_article_stay(spark):
    draw = random.Random(12)

    def words(n):
        return " ".join(str(draw.random()) for _ in range(n))

    parts = [(words(11), words(9)) for _ in range(8)]
    split = [f"<body><nav>Menu</nav><div id=content><section class=a>{a}</section><section class=b>{b}</section></div></body>" for a, b in parts]
    assert texts_of(spark, split) == [f"{a}\n{b}" for a, b in parts]
    beside = [f"<body><article class=one>{a}</article><article class=two>{b}</article><div>{a[:9]}</div></body>" for a, b in parts]
    assert texts_of(spark, beside) == [f"{a}\n{b}" for a, b in parts]
    # Long pages of another template don't decide for short ones.
    mixed = [f"<body><table><tr><td>{words(900)}</td></tr></table></body>" for _ in range(3)] + [f"<body><p>{a}</p><table><tr><td>{b[:20]}</td></tr></table></body>" for a, b in parts]
    assert texts_of(spark, mixed)[3:] == [f"{a}\n{b[:20]}" for a, b in parts]


def test_a_word_in_a_name_takes_no_main_text(spark):
    draw = random.Random(13)
    own = [" ".join(str(draw.random()) for _ in range(20)) for _ in range(5)]
    shapes = ["<body class='single has-sidebar'><p>{}</p>", "<body class=sidebar><p>{}</p>", "<body><article class='long-form comment'>{}</article>", "<main class='with-sidebar sidebar'>{}</main>", "<div id=content class='ad-free'>{}</div>", "<section id=discussion>{}</section>", "<div role=main class=widget>{}</div>"]
    for shape in shapes:
        pages = [shape.format(t) + f"<div class='ad-box'>Buy {t[:9]}</div><div class=cookie-notice>We use {t[:7]}</div>" for t in own]
        assert texts_of(spark, pages) == own, shape
    al = w.Alphabet()
    assert w.region(w.stream_of("<body><div class=comments>long enough</div><p>x<nav>a long list of links</nav>", al)[1]) == "body div.comments"


def sentences(draw, n):
    return " ".join(draw.choice("haus baum weg licht wort zeit kind jahr".split()) + str(draw.randrange(99)) for _ in range(n))


def unmarked(draw):
    """Pages without article or main, under names that no list holds, in another language; and their main texts."""
    for _ in range(9):
        body = [sentences(draw, 14) for _ in range(draw.randint(2, 5))]
        title = sentences(draw, 3)
        menu = "".join(f"<li><a href=x>{sentences(draw, 1)}</a></li>" for _ in range(draw.randint(3, 7)))
        remarks = "".join(f"<li><b>{sentences(draw, 1)}</b> {sentences(draw, 30)}</li>" for _ in range(draw.randint(1, 7)))
        text = "".join(f"<p>{b}</p>" for b in body)
        yield f"<body><header>Tagblatt</header><div id=c1><ul>{menu}</ul></div><div id=c2><h1>{title}</h1>{text}</div><div class=zz>Alle Rechte bei uns</div><ul class=meinungen>{remarks}</ul></body>", "\n".join([title, *body])


def test_pages_without_marks_in_another_language(spark):
    pages, want = zip(*unmarked(random.Random(21)), strict=True)
    assert texts_of(spark, pages) == list(want)


def whole_wrapper(pages):
    al, wrapper = w.Alphabet(), None
    for p in pages:
        stream, _ = w.stream_of(p, al)
        wrapper = stream if wrapper is None else w.merge(wrapper, stream, al)
    return al.expanded(wrapper)


def test_another_wrapper_gives_another_text():
    """The text comes from the slots and groups of the wrapper that a page is matched against."""
    pages, want = zip(*unmarked(random.Random(22)), strict=True)

    def texts(items):
        matcher, slots = w.Matcher(items), w.Slots()
        for p in pages:
            slots.see(w._blocks(p, "", matcher))
        return [w.extract(p, "", matcher, slots.template()) for p in pages]

    items = whole_wrapper(pages)
    assert texts(items) == list(want)
    assert all(t != x and len(t) > len(x) for t, x in zip(texts(["<garbage>"]), want, strict=True))


def test_names_and_headers():
    draw = random.Random(23)
    a, b = sentences(draw, 20), sentences(draw, 20)
    assert w.extract(f"<body><header>Site Name</header><p>{a}</p><p>{b}</p>", "") == f"{a}\n{b}"
    assert w.extract(f"<body><header><b>Site</b><h1>Title</h1></header><p>{a}</p>", "") == f"Title\n{a}"
    for name in ("elementor-widget text", "search-results-article"):
        assert w.extract(f"<body><div class='{name}'><article><h1>Title</h1><p>{a}</p></article></div>", "") == f"Title\n{a}"
    assert w.extract(f"<body><p>{a}</p><ul class=kommentare><li>{b}</li><li>{b} {a} {b}</li></ul>", "") == a


def test_tables_sections_and_lists_of_the_text_stay(spark):
    draw = random.Random(24)
    shapes = ["<body><p>{0}</p><ul><li>{1}</li><li>{2}</li></ul><p>{3}</p>", "<body><div class=intro><p>{0}</p></div><div class=part><h2>{1}</h2><p>{2}</p></div><div class=part><h2>{3}</h2><p>{0}</p></div>", "<body><p>{0}</p><table><tr><td>{1}</td></tr><tr><td>{2}</td></tr></table>", "<body><div id=text><div class=lead>{0}</div><div class=para>{1}</div><div class=para>{2}</div></div>", "<body><p>{0} <a href=x>{1}</a> {2}</p><p>{3}</p>"]
    for shape in shapes:
        parts = [[sentences(draw, 15) for _ in range(4)] for _ in range(6)]
        pages = [shape.format(*p) for p in parts]
        assert texts_of(spark, pages) == [expected_blocks(x) for x in pages], shape


def expected_blocks(page):
    return "\n".join(t for p in re.split("</?(?:p|li|ul|div|h2|td|tr|table|body)\\b[^>]*>", page) if (t := " ".join(re.sub("<[^>]*>", "", p).split())))


def test_long_runs_fold():
    al = w.Alphabet()
    body = "".join(al.letter(f"<x{i}>") for i in range(3 * w.SHORT_GROUP))
    items = al.expanded(w.fold(al.letter("<ul>") + body * 3 + al.letter("</ul>"), al))
    assert [x if isinstance(x, str) else (x[0], len(x[1])) for x in items] == ["<ul>", ("+", 3 * w.SHORT_GROUP), "</ul>"]
    # Equal windows inside of the run lie closer than it is long.
    inner = "".join(al.letter(f"<y{i}>") for i in range(w.SHORT_GROUP + 9))
    odd = inner + al.letter("<one>") + inner + al.letter("<two>")
    assert [len(x[1]) for x in al.expanded(w.fold(odd * 2, al))] == [len(odd)]
    assert w.fold(odd, al) == odd


def test_merging_as_a_tree_and_joining_by_shuffle(spark, monkeypatch):
    draw = random.Random(25)
    made = [page(draw, i % 2) for i in range(24)]
    frame = spark.createDataFrame([(i, f"http://h{i % 2}.com/", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    deep = {r["host"]: json.loads(r["expression"]) for r in w.infer(frame, fan_in=2).collect()}
    for i, (p, _) in enumerate(made):
        flat = [x[3] for x in w._flat(p) if x[3]]
        assert len(flat) in matches(deep[f"h{i % 2}.com"], flat) and w.Matcher(deep[f"h{i % 2}.com"]).places(flat)
    monkeypatch.setattr(w, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(w, "FAN_IN", 3)
    rows = w.main_text(frame).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [t for _, t in made]


def test_a_very_long_page(spark):
    draw = random.Random(26)
    parts = [sentences(draw, 12) for _ in range(20_000)]
    long = "<body><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article></body>"
    assert texts_of(spark, [long, "<body><article><p>short</p></article></body>", None]) == ["\n".join(parts), "short", ""]
