"""Main text of pages: layouts with every kind of part that is no article, and broken markup."""

import pytest

from panelgrove.llm import pages

P = [
    "The harbour was quiet that morning, and the boats, tied in rows, moved only with the tide.",
    "A clerk from the customs house walked down the pier, counted the crates, and wrote the number in a book.",
    "Nobody asked him why.",
    "Later, when the fog had lifted, the first ferry came in with forty passengers, a dog, and two bicycles.",
]
WHOLE = " ".join(P)
PARAS = "".join(f"<p>{p}</p>" for p in P)
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport, weather</a></li></ul></nav>'
COMMENTS = "".join(
    f'<div class="comment"><p>I was there, in fact, on that very morning, and I can tell you, dear readers, that the fog, the ferry and the dog are all made up, number {i}.</p></div>' for i in range(9)
)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><body>{NAV}<article>{PARAS}</article><footer>Imprint, contact, and a long line of legal words, all of them tedious.</footer></body></html>", WHOLE),
        (f"<body><div id=header>Daily Paper</div><div class='menu'><a href=x>One</a> <a href=y>Two</a></div><div id=content>{PARAS}</div><div id=sidebar><p>Read this, that, and the other thing, which we recommend, really.</p></div></body>", WHOLE),
        (f"<body><div class=page><div class=post-body>{PARAS}</div><section id=comments><h2>9 comments</h2>{COMMENTS}</section></div></body>", WHOLE),
        (f"<body><main>{PARAS}<div class='cookie-notice'><p>We use cookies, and partners, and so on, to improve, well, everything.</p></div></main></body>", WHOLE),
        (f"<body><article>{P[0]}<aside><p>Elsewhere, in other news, a cat, a hat, and a bat.</p></aside><p>{P[1]}</p><div class='ad-slot'>Buy now, pay later, save big.</div><p>{P[2]}</p><p>{P[3]}</p></article>", WHOLE),
        (f"<body><form><p>Sign up, please, with name, street, town, and so on, and so forth, and more.</p><input name=a></form><div>{PARAS}</div><script>if (a < b) {{ document.write('<p>x, y, z</p>') }}</script></body>", WHOLE),
        ("<body><div><div><p>" + "</p></div><div><p>".join(P) + "</p></div></div></body>", WHOLE),
        ("<BODY><TABLE><TR><TD><A HREF=a>a</A><TD>" + "".join(f"<P>{p}" for p in P) + "</TABLE></BODY>", WHOLE),
        ("<body><div>" + "<br><br>".join(P) + f"</div>{NAV}", WHOLE),
        ("<p><b>" + P[0] + "<br><p>" + P[1] + "<p>" + P[2] + "<i><p>" + P[3], WHOLE),
        (f"<article><h1>Harbour news</h1><header><p>By a clerk.</p></header>{PARAS}<ul><li><a href=a>More</a></li><li><a href=b>Even more</a></li></ul></article>", "Harbour news By a clerk. " + WHOLE),
        (f"<title>Harbour news - Daily Paper</title><body><div class=wrap><h1>Harbour news</h1><div class=story>{PARAS}</div><h3>Most read</h3></div>", "Harbour news " + WHOLE),
        (f"<body><div class='content sidebar-left two-columns'>{PARAS}</div><div class='sidebarbox'><p>Elsewhere, in other news, a cat, a hat, and a bat, all of them asleep.</p></div><div id=usercomments>{COMMENTS}</div></body>", WHOLE),
        (f"<body><div class='commentary story'>{PARAS}</div><ins class=adsbygoogle>Buy, now, or, never, ever, again.</ins>", WHOLE),
        (f"<body class='has-sidebar menu-open'><article class='post comments-open'>{PARAS}</article>", WHOLE),
        (f"<body><div class=notice>{PARAS}</div></body>", WHOLE),
        (f"<body><div class=content><section><h2>One</h2><p>{P[0]}</p><p>{P[1]}</p></section><section><h2>Two</h2><p>{P[2]}</p><p>{P[3]}</p></section></div></body>", f"One {P[0]} {P[1]} Two {P[2]} {P[3]}"),
        (f"<div class=content><p>{P[0]}</p><ul><li>First, a list.</li><li>Then <a href=x>one link</a> in it.</li></ul><p>{P[1]}</p></div>", f"{P[0]} First, a list. Then one link in it. {P[1]}"),
        ("<p>A &lt;b&gt; &amp;amp; &#233;&#x41;&nbsp;&copy;&hellip; R&amp;D &ampx &unknown; a<b>b</b>c</p>", "A <b> &amp; éA ©… R&D &x &unknown; abc"),
        ("<p>a\n  <span>b</span>\t c<!-- x > <p>y</p> --> d</p><p title='>'>e<![CDATA[ <f> ]]></p>", "a b c d e <f>"),
        ("<p title=\"5\"\">a</p><p title=it's>b</p><p title = 'x>y'>c</p>", "a b c"),
        ("<div><p>Only this.</p><!-- never closed <p>x</p>", "Only this."),
        ("<p>Only this.</p><script>var a = '<p>x</p>';", "Only this."),
        ("no markup at all, only words", "no markup at all, only words"),
        ("<nav><a href=x>Only a menu</a></nav>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_articles(page, want):
    assert pages.main_text(page) == want


def test_long_and_deep():
    assert pages.main_text("<div>" * 50_000 + WHOLE + "</div>" * 50_000) == WHOLE
    assert pages.main_text("<p>" + "word, " * 200_000 + "</p>").count("word") == 200_000
    assert pages.main_text("<b>" * 50_000 + "<p>x" * 1000).count("x") == 1000
    assert pages.main_text("<a href='" + "x" * 1_000_000) == ""
    assert pages.main_text("< <<<<" * 10_000 + " a").endswith(" a")


def test_rows(spark):
    rows = [(1, "u", f"<article>{PARAS}</article>", "kept"), (1, "u", f"<article>{PARAS}</article>", "kept"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    out = pages.extract(df.withColumnRenamed("main_text", "b")).collect()
    assert [r["main_text"] for r in out] == [WHOLE, WHOLE, ""] and [r["b"] for r in out] == ["kept", "kept", None]
    assert [r["main_text"] for r in pages.extract(df).collect()] == [WHOLE, WHOLE, ""]
    assert pages.extract(df.limit(0)).count() == 0
