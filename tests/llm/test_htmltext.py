import html
import random
import re

from pyspark.sql import functions as F

from weftlens.llm import htmltext
from weftlens.llm.htmltext import Page, extract

SCHEMA = "page_id long, url string, html string, text string"


def page(article, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var a="</p><p>no";</script></head><body class="no-sidebar">'
        f"<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>hidden --><div class='x9'>We sell <b>boats</b></div>"
        f"{article}{extra}<footer>&copy; 2020</footer></body></html>"
    )


def test_main_text_of_one_page():
    for article, want in [
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>fo<b>u</b>r<i> five</article>", "A & B one two three four five"),
        ("<article><p>a<aside>s</aside><p>b<form>f<input value=x></form><section><article>mine is a much longer text</article></section></article>", "a b"),
        ("<article><p>a</p><p class='related-work'>b</p><div class='discussion'>c</div><h2 id='menu'>d</h2></article>", "a b c d"),
        ("<article><p>a</p><div itemscope itemtype='https://schema.org/Comment'>x</div><div hidden>y</div><div role=navigation>z</div></article>", "a"),
        ("<main><div><p>m</p><ul><li>x<li>y</ul></div></main>", "m x y"),
        ("<div class='entry-content with-sidebar'><p>d</p></div>", "d"),
        ("<article><p>5 < 6 &#8364; &lt;b&gt; &nope; <a href='>'>k</a></p><table><tr><td>1<td>2<tr><td>3</table></article>", "5 < 6 € <b> &nope; k 1 2 3"),
        ("<article><div class=wrap-cookie><article><p>deep</p></article></div>", "deep"),
        ("<article><p>open <b>bold<p>next <a href=x>", "open bold next"),
    ]:
        assert Page(page(article)).text(set()) == want, article
    for empty in (None, "", "<", "<>", "<p", "<script>x", "<!-- x", "</div>", "<div " + 'a="' * 50):
        assert Page(empty).text(set()) in ("", "<", "<>", "<p", '<div ' + 'a="' * 50)
    assert Page("<div>" * 5000 + "deep").text(set()) == "deep"


def test_articles_against_the_main_element():
    long = "long text " * 50
    for body, want in [
        (f"<main><p>{long}</p><article class='card'>More</article></main>", f"{long}More"),
        (f"<div><p>{long}</p></div><div><p>short</p></div>", f"We sell boats {long}short"),
        (f"<main><p>{long}</p></main><article>More</article>", long.strip()),
        (f"<main><p>Intro</p><article><p>{long}</p></article></main>", long.strip()),
        ("<main><article><p>part one</p></article><article><p>part two, longer</p></article></main>", "part one part two, longer"),
        ("<article><p>first</p></article><div><article><p>and the second</p></article></div>", "first and the second"),
    ]:
        assert Page(page(body)).text(set()) == want, body


def test_templates_go_and_articles_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(40):
        host = "https://a.example/" if i % 2 else f"http://b{i}.example:80/"
        text = " ".join(word() for _ in range(30))
        quote = "a line that many pages quote"
        body = f"<div><p>{text}</p><p>{quote}</p><section>Call us today</section></div>"
        rows.append((i, f"{host}p{i}", page(body), "clash"))
        want[i] = f"{text}{'' if i % 2 else ' ' + quote} {'' if i % 2 else 'Call us today'}".strip()
    article = page(f"<article><p>{'same words here ' * 9}</p><div>copied block of the same article</div></article>")
    rows += [(100 + i, f"https://a.example/c{i}", article.replace("boats", f"boats{i}"), None) for i in range(9)]
    rows += [(200, None, None, None), (201, "https://a.example/e", "", None), (202, "rel/x", "<p>r</p>", None), (None, "https://a.example/n", "<article>n</article>", None)]
    rows += [rows[1], rows[1]]
    out = extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out}
    for i in range(40):
        assert " ".join(got[i].split()) == " ".join(want[i].split()), i
    for i in range(9):
        assert got[100 + i].startswith("same words here same")
    assert (got[200], got[201], got[202], got[None]) == ("", "", "r", "n")


def test_random_class_names(spark):
    """A host whose menus, notices, adverts, side columns and boxes inside the article have meaningless names, beside brute force."""
    rng = random.Random(5)
    word = lambda n=1: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menus, adverts, boxes, feet = ([word(5) for _ in range(4)] for _ in range(4))
    rows, want = [], {}
    for i in range(60):
        prose = [word(20) for _ in range(3)]
        if i >= 50:
            prose = want[3]  # copies of an article are one witness
        div = lambda text: f'<div class="{word()}" id="{word()}">{text}</div>'
        column = div("".join(f"<p>{p}</p>" for p in prose[:2]) + div(rng.choice(boxes)) + f"<p>{prose[2]}</p>")
        html = div(f"<ul><li>{rng.choice(menus)}</li></ul>") + div(rng.choice(adverts)) + div(column) + div(f"<span>{rng.choice(feet)}</span>")
        rows.append((i, f"http://one.example/{i}", f"<html><body>{html}</body></html>", ""))
        want[i] = prose
    out = extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.page_id: r.text for r in out} == {i: " ".join(p) for i, p in want.items()}


def test_cards_of_the_site_go(spark):
    card = "<article><h3>Read our magazine</h3></article>"
    rows = [(i, "http://x.example/", f"<main><article><p>{'story ' * (i + 3)}</p></article>{card}</main>", "") for i in range(8)]
    out = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.page_id: r.text for r in out} == {i: ("story " * (i + 3)).strip() for i in range(8)}


def test_the_template_stage_finds_templates_on_pages(spark):
    from weftlens.llm.queries import table

    pages = table(spark, "/root/testdata/sf0.1", "pages").withColumn("host", F.split("url", "/")[2])
    largest = pages.groupBy("host").count().orderBy("count", ascending=False).first().host
    pages = pages.where(F.col("host") == largest).collect()
    seen = {}
    for r in pages:
        page = Page(r.html)
        for n in page.candidates:
            seen.setdefault(page.hash[id(n)], set()).add(page.story())
    assert sum(len(s) >= htmltext.MIN_PAGES for s in seen.values()) > 0


def test_no_rows(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_gives_the_articles(spark):
    from weftlens.llm.queries import op8_site_templates, table

    sf = "/root/testdata/sf0.001"
    raw = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    out = op8_site_templates(spark, sf).collect()
    assert len(out) == len(raw)
    for r in out:
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
    assert htmltext.MIN_PAGES > 1
