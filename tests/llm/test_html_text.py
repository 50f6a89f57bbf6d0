import pytest

from driftloom.llm.html_text import blocks, classify, extracted, main_text

LONG = "the man and the dog are in the house of this town and they were there for all of the day with us. " * 4
TEA = "she was in the garden with all of her friends and they had tea for an hour or more that day. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text &nbsp; here", "just text here"), ("<p>a</p>" * 3, "a\na\na"),
        ("<title>t</title><script>var x='</p>';</script><style>p{}</style><article><h1>Head</h1><p>One<b>two</b> 3<br>four</p></article>", "Head\nOnetwo 3 four"),
        ("<article><p><b>one.<br><p>two", "one.\ntwo"), ("<article><p>a &lt;b&gt; &amp;amp; &#233;&#x41;</p></article>", "a <b> &amp; éA"),
        ("<article><p>a <!-- <p>no</p> --> b</p><!-- open <p>never", "a b"), ("<article><p>x</p><script>never closed <p>y</p>", "x"),
        ("<article><p>one<br><br>two</p></article>", "one\ntwo"), ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"),
        ("<article><p>kept</p><div class='comments'><p>not kept</p></div><p>more</p></article>", "kept\nmore"),
        ("<article><p>kept</p><section id=comments><article class=comment><p>no</p></article></section></article>", "kept"),
        ("<header>h</header><nav><a href=/>n</a></nav><main><p>m</p><form>f<input></form><aside>a</aside></main><footer>f</footer>", "m"),
        ("<article><p>5 < 6 and 7 > 3</p></article>", "5 < 6 and 7 > 3"), ("<article><p>a\n\t b\xa0\xa0c</p>", "a b c"),
        ("<ARTICLE><P>Upper</P></ARTICLE><DIV CLASS=\"Cookie-Notice\">we use</DIV>", "Upper"), ("<article><p title='a > b'>q</p></article>", "q"),
        ("<article></p></b></article></nav>", ""), ("<article><p>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_density_rules_without_marks():
    page = f"<div><a href=/a>one</a> <a href=/b>two</a></div><p>{LONG}</p><p>short one</p><p>{TEA}</p><p><a href=/c>more like this</a></p><p>\xa9 2020 all rights of the owner</p>"
    assert main_text(page) == f"{LONG.strip()}\nshort one\n{TEA.strip()}"


LINKS = "<p><a href=/x>more of the news of the day that we have for you</a> and <a href=/y>what they had to say about all of this</a></p>"


def test_both_passes_run_inside_a_marked_article():
    page = f"<article><p>{LONG}</p>{LINKS}<p>an offer</p>{LINKS}{LINKS}<p>{TEA}</p><p>\xa9 2020 the owner</p></article>"
    assert main_text(page) == f"{LONG.strip()}\n{TEA.strip()}"


def test_main_text_outside_teaser_cards():
    cards = "<article><h2><a href=/a>one of the stories</a></h2><p>a few words</p></article>" * 3
    assert main_text(f"<div>{cards}</div><div><p>{LONG}</p><p>{TEA}</p></div>").endswith(f"{LONG.strip()}\n{TEA.strip()}")
    told = f"<article><p>{LONG}</p></article>"
    assert main_text(f"<p>a line above</p>{told}<div><p>{TEA}</p><p>its last line</p></div>") == f"{LONG.strip()}\n{TEA.strip()}\nits last line"
    assert main_text(f"<p>a line above</p>{told}<p>a line below</p>") == LONG.strip()


def test_short_blocks_take_the_nearest_label():
    page = f"<p>{LONG}</p><p>near the good one</p>" + "<p><a href=/x>link text that is all of it and long enough to be decided as bad here, surely</a></p><p>near the links</p>" * 2
    labels = {b.text: b.label for b in classify(blocks(page))}
    assert labels["near the good one"] == "good" and labels["near the links"] == "bad"


def test_whole_long_pages(spark):
    body = "".join(f"<p>the paragraph number {i} is one of many in the page</p>" for i in range(5000))
    pages = spark.createDataFrame(
        [(1, "u", f"<nav>x</nav><article>{body}</article>", "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    rows = extracted(pages).collect()
    assert sorted(len(r.text) for r in rows)[:3] == [0, 0, 0]
    assert max(len(r.text.split("\n")) for r in rows) == 5000
    assert extracted(pages.limit(0)).count() == 0
