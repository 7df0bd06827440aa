import math
import random
from html.parser import HTMLParser

import pytest

from nearfield.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1><p>Welcome, reader, to it.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, as all do. Accept them, please.</p></div>
<div class="wrap"><div class="post"><h2>Title &amp; more</h2><p>A long paragraph, with   commas, and a <a href="x">link</a>. It goes on for a
 while, so that the ratio is high.<br><p>Short.</p><ul><li>One item, in a list.</li><li>Two</li></ul><blockquote>Quoted words, in a block.</blockquote></div>
<aside><p>Other stories, all of them long enough to be tempting, really. They go on and on.</p></aside>
<section id="comments"><h3>Comments</h3><p>First! I like this, a lot. It was great, thanks.</p></section>
<form><p>Subscribe, now, please, do it.</p><input></form></div><!-- <p>gone</p> --><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_a_page():
    assert html.extract(PAGE).split("\n\n") == ["Title & more", "A long paragraph, with commas, and a link. It goes on for a while, so that the ratio is high.", "Short.", "One item, in a list.", "Two", "Quoted words, in a block."]


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<script>x", "<!-- only", "<div><style>a{}"])
def test_no_text(page):
    assert html.extract(page) == ""


def test_text_and_references():
    assert html.extract("plain text, no tags.") == "plain text, no tags."
    assert html.extract("<article><p>a &lt;b&gt; &amp;amp; &#233;&eacute; 1 < 2</p></article>") == "a <b> &amp; éé 1 < 2"


def test_mark_on_everything_is_ignored():
    text = "A long enough article, with commas. It is all that the page has."
    assert html.extract(f"<body><div class='ad free'><p>{text}</p></div></body>") == text


def test_content_outside_the_largest_element_stays():
    lead = [f"Lead {i}, a sentence with commas, and a stop at its end." for i in range(3)]
    body = [f"Body {i}, a sentence with commas, and a stop at its end." for i in range(7)]
    made = ["".join(f"<p>{x}</p>" for x in part) for part in (lead, body)]
    for tag in ("div", "section", "blockquote"):
        page = f"<body><article><h1>Title</h1><div class=lead><h2>Lead</h2>{made[0]}</div><{tag} class=body>{made[1]}</{tag}></article></body>"
        assert html.extract(page).split("\n\n") == ["Title", "Lead", *lead, *body]
        assert html.extract(f"<article><h1>Title</h1><{tag}>{made[1]}</{tag}></article>").split("\n\n") == ["Title", *body]


def test_content_without_an_enclosing_element():
    text = [f"Paragraph {i}, with commas, and a stop at its end." for i in range(4)]
    page = f"<p>{text[0]}</p><p>{text[1]}</p><div><p>{text[2]}</p></div><p>{text[3]}</p>"
    assert html.extract(page).split("\n\n") == text


def test_comments_longer_than_the_article_stay_out():
    article = ["A short article, with a comma.", "It ends here, after two sentences."]
    posts = "".join(f"<div><p>Comment {i}, one of very many, and each of them is longer than the article is, by far. So it goes, on and on.</p></div>" for i in range(60))
    made = "".join(f"<p>{x}</p>" for x in article)
    for around in ("<div class=post>{}</div>", "<article>{}</article>", "<main>{}</main>", "{}"):
        page = "<body>" + around.format(made) + f"<div id=comments>{posts}</div><div class=advert><p>Buy this, now, and that.</p></div></body>"
        assert html.extract(page).split("\n\n") == article
    # each comment an article of its own
    assert html.extract(f"<body><div class=post>{made}</div><ol class=comments>{posts.replace('div', 'article')}</ol></body>").split("\n\n") == article
    assert html.extract(f"<body><section id=comments>{posts}</section></body>").count("Comment") == 60


def test_mark_around_the_article_is_ignored_alone():
    text = [f"Paragraph {i}, with commas, and a stop at its end." for i in range(9)]
    made = "".join(f"<p>{x}</p>" for x in text)
    advert = "<div class=advert><p>Buy this, now, and that. It is cheap, they say.</p></div>"
    foot = "<div><p>All rights, 2020.</p></div>"
    for tag in ("main", "article"):
        assert html.extract(f"<body><div class='page with-sidebar'><{tag}>{made}</{tag}>{advert}</div></body>").split("\n\n") == text
    assert html.extract(f"<body><div class='page with-sidebar'><div>{made}</div>{advert}</div>{foot}</body>").split("\n\n")[:9] == text
    assert "Buy" not in html.extract(f"<body><div class='page with-sidebar'><div>{made}</div>{advert}</div>{foot}</body>")


def test_broken_and_deep_pages():
    deep = "<div>" * 5000 + "<p>Deep text, with a comma, and a stop.</p>" + "</div>" * 100
    assert html.extract(deep) == "Deep text, with a comma, and a stop."
    assert html.extract('<p title="a > b">Quoted, attribute.</p><p title="open>Next, paragraph here.</p>').startswith("Quoted, attribute.")
    assert html.extract("</p></div><p>One, two.<p>Three, four.") == "One, two.\n\nThree, four."


def test_long_page():
    body = "".join(f"<p>Paragraph {i}, of many, in a long article.</p>" for i in range(5000))
    assert html.extract(f"<nav><a>x</a></nav><main>{body}</main>").count("\n\n") == 4999


def test_frame(spark):
    rows = [(1, "u", PAGE, "a"), (None, None, None, "b"), (2, "u", PAGE, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    assert got[None].text == "" and got[None].n_chars == 0
    assert got[1].text == got[2].text and got[1].n_chars == len(got[1].text)
    assert html.main_text(pages.limit(0)).collect() == []


P = "<p>Paragraph {}, with commas, and a stop at its end.</p>"


def test_marks_lower_but_do_not_delete():
    body = "".join(P.format(i) for i in range(5))
    page = f"<article><div class='article-header'><h1>The title of it</h1></div>{body}<p class='share-price'>The price rose, to nine, and fell again.</p><div class='share-buttons'><p>Share it, with your friends, now.</p></div></article>"
    got = html.extract(page).split("\n\n")
    assert got[0] == "The title of it" and got[-1] == "The price rose, to nine, and fell again." and len(got) == 7


def test_deeply_nested_menu_stays_out():
    page = f"<article>{P.format(1)}{P.format(2)}</article>" + "<div>" * 300 + "<nav><p>Menu item, another one, and one more, all of it.</p></nav>" + "</div>" * 300 + f"<article>{P.format(3)}</article>"
    assert "Menu" not in html.extract(page) and html.extract(page).count("Paragraph") == 3


def test_hidden_is_an_attribute_and_not_a_word_of_one():
    assert html.extract(f"<p title='a hidden gem'>One, two, three.</p><p hidden>Four, five, six.</p>{P.format(1)}").startswith("One, two, three.\n\nParagraph")


@pytest.mark.parametrize("piece", ["<a ", "<a x='", "<!", "</", "<div><p>x", "<td><div>", "<p class=ad>x, y.", "a" * 20 + "="])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    began = time.process_time()
    html.extract(piece * (300_000 // len(piece)))
    html.extract("<p " + piece.replace("<", "") * (300_000 // len(piece)) + ">Text, here.</p>")
    assert time.process_time() - began < 20


class _Tree(HTMLParser):
    """A page as nested lists: [tag, attributes, parent, children]."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ["", {}, None, []]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.at[3].append([tag, dict(attrs), self.at, []])
        self.at = self.at[3][-1]

    def handle_endtag(self, tag):
        self.at = self.at[2]

    def handle_data(self, data):
        self.at[3].append(data)


def slow(page):
    """The main text by a walk over a parsed tree, every value computed from its definition."""
    up = lambda e: [e, *up(e[2])] if e[2] is not None else []
    blocks = []

    def walk(e, linked, new):
        for child in e[3]:
            if isinstance(child, str):
                if new[0] or blocks[-1][0] is not new[1]:
                    blocks.append((new[1], []))
                    new[0] = False
                blocks[-1][1].append((child, linked))
            elif child[0] in html.INLINE:
                walk(child, linked or child[0] == "a", new)
            else:
                walk(child, False, [True, child])
                new[0] = True

    walk(_Tree(page).root, False, [True, None])
    rows = []
    for e, pieces in blocks:
        around = up(e) if e else []
        text, free = (" ".join("".join(t for t, linked in pieces if not (only and linked)).split()) for only in (False, True))
        inner = [x for x in around if x[0] in ("article", "main")]
        if text and not any(x[0] in html.NEVER or x[0] == "header" and not [y for y in inner if x in up(y[2])] and not any(y[0] in ("article", "main") for y in up(x[2])) for x in around):
            strong = any(set(x[1].get("class", "").split("-")) & html.MARKS for x in around)
            rows.append((around, text, len(free), sum(free.count(c) for c in ".,;:!?"), html.STRONG if strong else 1.0))
    if not rows:
        return ""
    path = [tuple((x[0], x[1].get("class")) for x in r[0]) for r in rows]
    n = range(len(rows))
    mean = lambda values, w=None: sum(v * k for v, k in zip(values, w or [1] * len(values))) / sum(w or [1] * len(values))
    near = {-1: math.exp(-0.5), 0: 1.0, 1: math.exp(-0.5)}

    def smooth(k):
        ratio = [mean([rows[j][k] for j in n if path[j] == path[i]]) for i in n]
        return [mean([ratio[i + d] for d in near if i + d in n], [near[d] * (rows[i + d][4] if d else 1) for d in near if i + d in n]) for i in n]

    a, b = smooth(2), smooth(3)
    value = [mean([math.sqrt(a[j] * (b[j] + 0.1)) for j in n if path[j] == path[i]]) * rows[i][4] * any(rows[j][2] for j in n if path[j] == path[i]) for i in n]
    w = [r[4] for r in rows]
    spread = math.sqrt(mean([(v - mean(value, w)) ** 2 for v in value], w))
    bar = min(0.35 * max(value), max(spread, 0.35 * mean(value, w)))
    yes = [v > 0 and v >= bar for v in value]
    if not any(yes):
        return ""
    shared = [x for x in rows[yes.index(True)][0] if all(any(x is z for z in rows[j][0]) for j in n if yes[j])]
    holder = next((x for x in shared if x[0] in ("article", "main")), next((x for x in shared if x[0] != "p" and x[0] not in html.HEADINGS), None))
    return "\n\n".join(r[1] for r, y in zip(rows, yes) if y or any(x is holder for x in r[0]) and r[4] == 1 and 2 * r[2] >= len(r[1]))


def test_against_the_slow_version():
    r = random.Random(8)

    def words(n):
        return " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 8))) + r.choice(["", "", "", ",", "."]) for _ in range(n))

    def body(depth):
        out = ""
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.55 or depth == 0:
                tag = r.choice(["p", "p", "p", "h2", "blockquote"])
                out += f"<{tag}>{words(r.randint(1, 40))} <a href=x>{words(r.randint(1, 3))}</a> <b>{words(1)}</b></{tag}>"
            else:
                tag = r.choice(["div", "div", "section", "nav", "aside", "footer", "header"])
                mark = r.choice(["", "", "", " class=lead", " class=advert", " class=share-box"])
                out += f"<{tag}{mark}>{words(r.randint(0, 3))}{body(depth - 1)}</{tag}>"
        return out

    for k in range(300):
        long = "".join(f"<p>{words(60)}</p>" for _ in range(4))  # so that marks aren't all of the page
        page = f"<body><div class=page>{body(3)}<article>{long}{body(2)}</article>{body(1)}</div></body>"
        assert html.extract(page) == slow(page), k
