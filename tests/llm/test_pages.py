from cairn.llm.op8_html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var x="</p><article>no</article>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">one {i}</a></li><li><a href="/b">two</a></li></ul></nav><!-- <article>not this</article> -->
<div class="ad">Buy {i}</div><article class="post"><header><h1>Head &amp; line {i}</h1></header><p>First   part {i}<br>goes
on<p>Second <b>bold</b> &lt;tag&gt; caf&eacute;&nbsp;x</p><div class="share">Share this</div><form><p>Mail</p></form>
<section class="comments"><p>A reader says {i}</p></section></article><aside>Side {i}</aside><footer>&copy; {i}</footer>"""
WANT = "Head & line {i}\nFirst part {i} goes on\nSecond bold <tag> café x"
PLAIN = """<html><body><div id="top"><a href=x>a</a> <a href=y>b</a></div><div class="box1"><p>The text of page {i} is long enough to be the main part of it.</p><p>More of it {i}.</p></div>
<div class="sidebar"><p>See also a long list of other things {i} {i} {i}</p></div></body></html>"""


def test_templates_of_hosts(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(i=i), "x") for i in range(12)] + [(100 + i, f"http://b.example:80/{i}", PLAIN.format(i=i), "x") for i in range(9)]
    rows += [(200, None, PAGE.format(i=200), "x"), (201, "not a url", "", "x"), (202, "https://a.example/z", None, "x"), (203, "https://a.example/q", "just words & <b>more", "x"),
             (204, "https://c.example/", "<p>" * 3000 + "deep", "x"), (205, "https://a.example/5", PAGE.format(i=5), "x"), (None, "https://a.example/n", PAGE.format(i=7), "x"),
             (206, "https://d.example/", "<article><p>" + "long text " * 100_000 + "</article>", "x"), (207, "https://a.example/t", '<p class="a\'><x> 5 < 6', "x")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "html", "text"}
    for i in [*range(12), 200]:
        assert got[i].text == WANT.format(i=i)
    assert got[205].text == WANT.format(i=5) and got[None].text == WANT.format(i=7)
    for i in range(9):
        assert got[100 + i].text == f"The text of page {i} is long enough to be the main part of it.\nMore of it {i}."
    assert got[201].text == got[202].text == "" and got[204].text == "deep" and len(got[206].text) == 999_999


def test_no_pages(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_page_alone():
    assert extract(PAGE.format(i=1), None) == WANT.format(i=1).split("\n")
    assert extract("<main><p>a<p>b</main>c", {}) == ["a", "b"]
    assert extract("", None) == [] and extract("<<>><!-", None) in ([], ["<<>"], ["<<>>"], ["<", ">"])
