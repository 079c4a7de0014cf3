import html
import os
import random
import re
import time

from pairforge.llm import extract
from pairforge.llm.queries import op13_extract

WORDS = "the river and stone under water light of a thing with from über élan".split()


def sentence(r, n):
    return (" ".join(r.choice(WORDS) for _ in range(n)) + r.choice([".", "!", ", so.", " & <b> \"q\" 5 > 3."])).capitalize()


def paragraph(r):
    return " ".join(sentence(r, r.randint(1, 14)) for _ in range(r.choice([1, 1, 3, 6])))


def esc(r, t):
    """Spaces become any white space, some characters references."""
    out = "".join(f"&#{ord(c)};" if r.random() < 0.02 and c != " " else f"&#x{ord(c):X};" if r.random() < 0.02 and c != " " else html.escape(c) for c in t)
    return re.sub(" ", lambda _: r.choice([" ", " ", " ", "\n\t ", "&nbsp;"]), out)


NOISE = ['<nav><ul><li><a href="/">Home.</a><li><a href=/x>More, more.</a></ul></nav>', '<header class=top><h2>The site, yours.</h2></header>',
         '<div class="ad">Buy this thing now. It is good, really good.</div>', '<aside><p>On the side, a longer text that says this and that.</p></aside>',
         '<div id="cookie-notice"><p>We use cookies. You know, the usual.</p><button>OK</button></div>',
         '<form action="/s"><label>Search:</label> <input name=q><select><option>One.<option>Two.</select></form>', '<!-- <p>Not here.</p> -->',
         '<script>var t="</p><article>no";</script>', '<style>p > a { color: "red" }</style>', '<noscript>Switch it on, please.</noscript>',
         '<div role="complementary">Also read: another story, of course.</div>', '<section class="relatedPosts"><p>Related things, all of them.</p></section>',
         '<iframe src=x>No frames, sorry.</iframe>', '<template><p>Hidden, quite.</p></template>', '<div hidden>You do not see me, do you?</div>']
LATE = ['<div class="comments"><article class="comment"><p>I think, as a reader, that this is a good text. Long live the text, all of it.</p></article></div>',
        '<footer>&copy; the site &middot; All rights, all of them.</footer>', '<ul class="share-links"><li><a href=#>Share this, now.</a></ul>']


def page(r, kind):
    blocks = [paragraph(r) for _ in range(r.choice([1, 2, 5, 12]))]
    title = sentence(r, 6)
    body = ""
    for i, b in enumerate(blocks):
        t = esc(r, b)
        if r.random() < 0.3:
            t = re.sub(r"(\w+)", r"<em>\1</em>", t, count=1) if not t.startswith("&") else f"<span class=x>{t}</span>"
        body += r.choice([f"<p>{t}</p>", f"<p class=x>{t}<!-- c --></p>\n", f"<p>{t}", f"<p><b>{t}<br>"])
        if kind != "plain" and r.random() < 0.2:
            body += r.choice(NOISE[2:])
    items = [sentence(r, 2) for _ in range(3)] if r.random() < 0.4 else []
    heading = f"<h1>{esc(r, title)}</h1>"
    if items:
        body += "<ul>" + "".join(f"<li>{esc(r, x)}" for x in items) + "</ul>"
    if kind == "div":
        main = f'<div class="wrap"><div id="content">{heading}<div class="entry-body">{body}</div></div></div>'
    elif kind == "header":
        main = f"<main><article class=post><header>{heading}<nav>Up, down.</nav></header><section>{body}</section></article></main>"
    elif kind == "form":
        main = f"<form id=f><div><article>{heading}{body}</article></div></form>"
    else:
        main = f"<article>{heading}{body}</article>"
    before = "".join(r.sample(NOISE, 5))
    whole = f"<!DOCTYPE html><html><head><title>No, no.</title></head><body class='has-sidebar'>{before}{main}{''.join(r.sample(LATE, 2))}</body></html>"
    return whole, "\n".join(" ".join(x.split()) for x in [title, *blocks, *items])


def test_articles_of_many_templates_come_out_whole():
    r = random.Random(4)
    for kind in ("plain", "article", "div", "header", "form"):
        for _ in range(80):
            text, want = page(r, kind)
            assert extract.main_text(text) == want, (kind, text)


def test_pages_cut_off_anywhere_are_read_as_far_as_they_go():
    r = random.Random(6)
    text, want = page(r, "plain")
    for i in range(0, len(text), 7):
        got = extract.main_text(text[:i])
        assert "<" not in got.replace("<b>", "") and (not got or want.startswith(got[:20]) or "Home" not in got)
    assert extract.main_text(text[:text.index("</article>")]) == want


def test_reading_is_linear():
    for unit in ("<div>", "<p>", "<b>", "<li>", "<ul><li>", "<div><p>", "</p>", "<a href='", "<!--", "<x a=\"1", "<", "&am", "<table><td>", "<i></b>", "<h1>", "<div class=a><p>t, t.</p>"):
        took = []
        for n in (20_000, 80_000):
            t = time.perf_counter()
            extract.main_text("<article>" + unit * n + "text")
            took.append(time.perf_counter() - t)
        assert took[1] < 8 * took[0] + 0.5, (unit, took)


def test_smoothing_equals_the_sum_over_all_pairs():
    r = random.Random(8)
    p = extract.Page(page(r, "article")[0])
    n = len(p.parent)

    def above(i):
        return [i] + (above(p.parent[i]) if i else [])

    def steps(i, j):
        a, b = above(i), above(j)
        common = len(set(a) & set(b))
        return len(a) + len(b) - 2 * common
    own, mass = [0.0] * n, [0] * n
    for i in range(n):
        mine = [(t, k) for path, t, k in p.blocks if path == i]
        if mine:
            mass[i] = sum(len(t) for t, _ in mine)
            marks = sum(len(extract.PUNCTUATION.findall(t)) for t, _ in mine)
            art = any(p.label[j].split(".")[0] in ("article", "main") for j in above(i))
            own[i] = max(mass[i] - sum(k for _, k in mine), 0) / len(mine) * (1 + marks / len(mine)) * (1 + (10 if art else 0))
    want = [sum(extract.DECAY ** steps(i, j) * mass[j] * own[j] for j in range(n)) / sum(extract.DECAY ** steps(i, j) * mass[j] for j in range(n))
            if mass[i] else 0 for i in range(n)]
    assert all(abs(a - b) < 1e-6 * (1 + b) for a, b in zip(extract.ratios(p), want)) and max(want) > 0


def test_rows(spark):
    r = random.Random(9)
    long_page = "<article>" + "<p>One, two. Three.</p>" * 60000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", page(r, "plain")[0]), (1, "u", "no tags, just text."), (5, "u", long_page), (6, "u", "<nav>x</nav>"), (6, "u", "<nav>x</nav>")]
    df = spark.createDataFrame([(*x, "t", 3) for x in rows], "page_id bigint, url string, html string, text string, id int")
    got = [(x.id, x.text, x.n_chars) for x in extract.extract(df).collect()]
    assert got == [(i, extract.main_text(h), len(extract.main_text(h))) for i, _, h in rows]
    assert got[3][1] == "no tags, just text." and got[4][2] == 60000 * 17 - 1 and got[5][1] == ""
    assert extract.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The given pages' articles, read by plain patterns."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    got = {x.page_id: x for x in op13_extract(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(pages) == len(got)
    for p in pages:
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?p>|</?h1>", inner)]
        want = "\n".join(x for x in blocks if x)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))
