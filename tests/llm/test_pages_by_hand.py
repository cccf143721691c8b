"""Pages of layouts that the training pages' writer doesn't know, labelled by hand: a block that begins
with + is main text, one with - is not."""

import re

from tidemark.llm import htmltext

LONG = (
    "The committee met twice in spring and agreed on a plan for the bridge. Work begins in May, once the river falls. Two lanes stay open.",
    "Most of the samples came from wells along the northern ridge, where the water table is high. Each was kept at four degrees and measured within a day.",
    "She had written to her brother every week since the harbour closed. He answered seldom, and when he did, his letters were short and full of weather.",
    "Das Verfahren wurde im Herbst erprobt und danach in drei Betrieben eingeführt. Die Ergebnisse lagen über den Erwartungen, doch die Kosten auch.",
    "Le musée rouvre ses portes samedi après deux ans de travaux. Les visiteurs découvriront une aile entière consacrée à la photographie.",
)
SHORT = ("It works.", "See the table below.", "Prices rose by a tenth.", "Nobody was hurt.", "Mix well and wait.")
PAGES = [
    # a wiki
    """<html><body><div id="mw-page-base"></div><div id="content" role="main"><h1 id="firstHeading">+Heading</h1><div id="mw-content-text"><p>+{L}</p><p>+{L}</p><h2>+History</h2><p>+{L}</p><ul><li>+{S}</li><li>+{S}</li></ul></div></div><div id="mw-navigation"><ul><li><a href=a>-Main page</a></li><li><a href=b>-Random page</a></li></ul></div><div id="footer"><ul><li>-This page was last edited in May.</li></ul></div></body></html>""",
    # a blog with a theme
    """<body class="home single"><div class="site"><header class="site-header"><a href="/">-My blog</a></header><div id="primary" class="content-area"><article class="post hentry"><h1 class="entry-title">+On rivers</h1><div class="entry-content"><p>+{L}</p><blockquote><p>+{L}</p></blockquote><p>+{S}</p></div></article><div id="comments" class="comments-area"><h2>-Two thoughts</h2><ol class="comment-list"><li class="comment"><p>-{L}</p></li><li class="comment"><p>-{S}</p></li></ol></div></div><aside id="secondary" class="widget-area"><section class="widget"><h2>-Recent</h2><ul><li><a href=x>-Older post</a></li></ul></section></aside></div></body>""",
    # tables of the nineties
    """<html><body bgcolor=white><table width=100%><tr><td width=120><a href=1>-Home</a><br><a href=2>-Products</a><br><a href=3>-Contact</a></td><td><h2>+Welcome</h2><p>+{L}</p><p>+{L}</p></td></tr></table><hr><center>-© 1998 Example Works</center></body></html>""",
    # no names at all
    """<html><body><h1>+A short note</h1><p>+{L}</p><p>+{L}</p><p>+{S}</p></body></html>""",
    # hashed names
    """<body><div class="css-1q2w3e"><div class="css-a9f"><a class="css-77" href="/">-News</a><a class="css-77" href="/s">-Sport</a><a class="css-77" href="/w">-Weather</a></div><div class="css-zz1"><h1 class="css-h">+Bridge closed</h1><p class="css-p1">+{L}</p><p class="css-p1">+{L}</p><p class="css-p1">+{L}</p></div></div></body>""",
    # documentation
    """<body><nav class="bd-sidebar"><ul><li><a href=i>-Install</a></li><li><a href=u>-Usage</a></li></ul></nav><main class="bd-content"><section id="usage"><h1>+Usage</h1><p>+{L}</p><pre><code>+run --fast</code></pre><p>+{S}</p><h2>+Options</h2><dl><dt>+--fast</dt><dd>+{S}</dd></dl></section></main><footer class="bd-footer"><p>-© 2024 The team</p></footer></body>""",
    # a news page
    """<body><div class="masthead"><ul><li><a href=1>-World</a></li><li><a href=2>-Business</a></li></ul></div><div class="story"><h1>+Museum opens</h1><p class="byline">-By A. Writer</p><p>+{L}</p><div class="advert">-Buy a car today.</div><p>+{L}</p><p>+{L}</p></div><div class="related"><h3>-More stories</h3><a href=x>-Harbour shut</a></div><div class="footer">-All rights reserved.</div></body>""",
    # a recipe
    """<body><nav><a href=a>-Soups</a> <a href=b>-Cakes</a></nav><article><h1>+Lentil soup</h1><p>+{L}</p><h2>+You need</h2><ul class="ingredients"><li>+200 g lentils</li><li>+1 onion</li><li>+water</li></ul><ol class="steps"><li>+{S}</li><li>+{S}</li></ol></article><section class="reviews"><p>-Best soup ever. We loved it.</p></section></body>""",
    # prose with inline controls
    """<body><main><h1>+Reset</h1><p>+Press <kbd>the red key</kbd> or <button>OK</button> now. Then choose <label>the second line</label> and wait.</p><p>+{L}</p></main></body>""",
    # a cookie bar and a form
    """<body><div id="cookie-banner"><p>-We use cookies. You may refuse them.</p><button>-Accept</button></div><div id="content"><h1>+Opening hours</h1><p>+{L}</p><p>+{S}</p></div><form action="/s"><label>-Search the site</label><input><button>-Go</button></form></body>""",
    # a press release
    """<html><body><div class="wrapper"><div class="inner"><h3>+Example Works doubles output</h3><p>+{L}</p><p>+{L}</p><p>+{S}</p></div></div><div id="bottom"><a href=1>-Imprint</a> | <a href=2>-Privacy</a></div></body></html>""",
    # questions and answers
    """<body><div class="faq"><h1>+Questions</h1><dl><dt>+How long does it take?</dt><dd>+{L}</dd><dt>+What does it cost?</dt><dd>+{S}</dd></dl></div><ul class="breadcrumbs"><li><a href=/>-Start</a></li><li><a href=/h>-Help</a></li></ul></body>""",
    # a letter archive
    """<html><body><h2>+Re: release</h2><pre>+{L}

{L}</pre><hr><a href=p>-previous</a> <a href=n>-next</a> <a href=i>-index</a></body></html>""",
    # two columns without names
    """<html><body><div><div><a href=1>-One</a><br><a href=2>-Two</a><br><a href=3>-Three</a><br><a href=4>-Four</a></div><div><p>+{L}</p><p>+{L}</p><p>+{L}</p></div></div></body></html>""",
    # sections
    """<body><header><nav><a href=1>-About</a><a href=2>-Team</a></nav></header><section><h2>+Our method</h2><p>+{L}</p></section><section><h2>+Our results</h2><p>+{L}</p><table><tr><th>+Year</th><th>+Yield</th></tr><tr><td>+2020</td><td>+14</td></tr></table></section><footer>-© 2020 Example</footer></body>""",
    # share and tags
    """<body><article class="single-post"><h1>+Fog</h1><p>+{L}</p><p>+{L}</p><div class="share-buttons"><a href=f>-Share this</a> <a href=m>-Mail it</a></div><div class="tags"><a href=t>-weather</a> <a href=u>-sea</a></div></article></body>""",
    # a product
    """<body><div class="navbar"><a href=1>-Shop</a><a href=2>-Basket</a></div><div class="product-description"><h1>+Garden chair</h1><p>+{L}</p><ul><li>+Weight 4 kg</li><li>+Oak</li></ul></div><div class="sponsored-items"><p>-You may also like this table.</p></div><div class="newsletter-box"><p>-Get our letter every week.</p><form><input><button>-Join</button></form></div></body>""",
    # line breaks for paragraphs
    """<html><body><font size=5>+The mill</font><br><br>+{L}<br><br>+{L}<br><br>+{L}</body></html>""",
    # a government page
    """<body><a href="#m" class="skip-link">-Skip to main text</a><div class="govuk-header" role="banner"><a href="/">-Office of Roads</a></div><main id="main-content"><h1>+Report a hole in the road</h1><p>+{L}</p><ul><li>+{S}</li><li>+{S}</li></ul></main><div class="feedback"><p>-Is this page useful?</p></div></body>""",
    # long list of items as the text
    """<body><h1>+Glossary</h1><ul><li>+Weir: a low wall across a river. It holds water back.</li><li>+Lock: a chamber with gates. Boats rise in it.</li><li>+Mole: a wall in the sea. It breaks the waves.</li></ul></body>""",
    # a modal and a popup
    """<body><div class="modal-dialog" aria-hidden="true"><p>-Subscribe for more. It is free.</p></div><div class="post-body"><p>+{L}</p><p>+{L}</p></div><div class="popup">-Wait! Do not go yet.</div></body>""",
    # a paper
    """<body><div id="header"><a href=/>-Archive</a></div><div id="abs"><h1 class="title">+On waves</h1><blockquote class="abstract">+{L}</blockquote></div><div class="extra-services"><ul><li><a href=p>-PDF</a></li><li><a href=o>-Other formats</a></li></ul></div></body>""",
    # nested wrappers
    """<body><div id="page"><div id="main"><div class="row"><div class="col-8"><div class="box"><h2>+Tides</h2><p>+{L}</p><p>+{L}</p></div></div><div class="col-4 sidebar"><h4>-Popular</h4><ul><li><a href=1>-Moon</a></li><li><a href=2>-Sun</a></li></ul></div></div></div></div></body>""",
    # a forum thread with an opening post
    """<body><div class="post-content"><h1>+Which oil?</h1><p>+{L}</p></div><div class="replies"><div class="reply"><p>-{L}</p></div><div class="reply"><p>-{S}</p></div></div></body>""",
    # a hidden menu
    """<body><ul style="display:none"><li>-Hidden one</li><li>-Hidden two</li></ul><article><p>+{L}</p><figure><img src=x><figcaption>+The bridge in May.</figcaption></figure><p>+{L}</p></article></body>""",
    # a fragment
    """<p>+{L}</p><p>+{S}</p><p>+{L}</p>""",
    # a fragment of divs
    """<div>+{L}</div><div>+{L}</div>""",
    # a page with pagination
    """<body><div class="chapter"><h2>+Chapter three</h2><p>+{L}</p><p>+{L}</p><p>+{L}</p><p>+{L}</p></div><div class="pager"><a href=2>-Back</a> <a href=4>-On</a></div></body>""",
    # comments by a service
    """<body><div itemprop="articleBody"><p>+{L}</p><p>+{L}</p></div><div id="disqus_thread"><p>-First! What a text.</p></div></body>""",
    # a page with scripts and templates
    """<body><script>var a = "<p>-not text</p>";</script><template><p>-not shown</p></template><main><p>+{L}</p><noscript>-Switch scripts on.</noscript><p>+{L}</p></main><svg><text>-icon</text></svg></body>""",
    # legal footer without a tag of its own
    """<body><div class="text"><h1>+Notes</h1><p>+{L}</p><p>+{L}</p></div><div class="legal"><p>-Terms apply. Not for sale.</p></div></body>""",
    # an event
    """<body><div class="topbar"><span>-Call us</span></div><div class="event"><h1>+Summer fair</h1><p>+Saturday, 3 June</p><p>+{L}</p></div><div class="social"><a href=t>-Follow us</a></div></body>""",
    # a poem
    """<body><div class="poem"><h3>+Low water</h3><p>+The boats lie down<br>along the wall<br>and nothing moves</p><p>+until the moon<br>lets go the sea<br>again</p></div></body>""",
]


def blocks():
    """(page, kind, text) of every marked block, with the pages' texts filled in."""
    n = 0
    for page in PAGES:
        while "{L}" in page or "{S}" in page:
            at = min(i for i in (page.find("{L}"), page.find("{S}")) if i >= 0)
            page = page[:at] + (LONG[n % 5] if page[at + 1] == "L" else SHORT[n % 5]) + page[at + 3 :]
            n += 1
        shown = re.sub(r"<(script|template|noscript|svg)>.*?</\1>", "", page)
        marks = re.findall(r"(?<=>)([+-])([^<]*)", shown)
        yield page, marks


def test_share_of_right_blocks():
    right = seen = 0
    for page, marks in blocks():
        text = htmltext.extract(page)
        for kind, block in marks:
            there = " ".join((kind + block).split()) in text
            seen, right = seen + 1, right + (there == (kind == "+"))
    assert len(PAGES) >= 30 and right >= 0.92 * seen


def test_main_text_of_unnamed_layouts():
    p = "One two three four. Five six seven. Eight nine ten eleven."
    assert htmltext.extract(f"<p>{p}</p><p>{p}</p>") == f"{p}\n{p}"
    links = "".join(f"<a href={k}>Page {k}</a><br>" for k in range(4))
    assert htmltext.extract(f"<html><body><div>{links}</div><div>{p} {p}</div><div>{p}</div></body></html>") == f"{p} {p}\n{p}"
    items = '<ul class="list"><li>First item text here.</li><li>Second item.</li></ul>'
    assert htmltext.extract(f"<article><h1>T</h1><p>{p}</p>{items}</article>").endswith("First item text here.\nSecond item.")
    assert htmltext.extract("<article><p>Press <label>the red key</label> or <button>OK</button> now.</p></article>") == "Press the red key or OK now."


A, B = LONG[:2]
ENTRIES = (("Ann", "I liked this very much."), ("Bob", "Not true at all. Read it again."), ("Cid", "Thanks for the text."))


def unnamed(before="", after=""):
    return htmltext.extract(f'<html><body>{before}<div class="k"><h1>Bridge</h1><p>{A}</p><p>{B}</p></div>{after}</body></html>')


def test_parts_without_names_go_by_their_structure():
    """Comments, notices, forms and menus whose names say nothing, of three layouts each."""
    main = f"Bridge\n{A}\n{B}"
    divs = "".join(f'<div class="c"><b>{n}</b><p>{t}</p></div>' for n, t in ENTRIES)
    items = "".join(f"<li><strong>{n}</strong> <time>{k} May</time><p>{t}</p></li>" for k, (n, t) in enumerate(ENTRIES))
    for after in (f'<div id="kommentare"><h3>3 replies</h3>{divs}</div>', f"<section><h2>4 comments</h2><ul>{items}</ul></section>", f"<div><h3>3 answers</h3><div>{divs}</div></div>"):
        assert unnamed(after=after) == main
    cookies = "We use cookies to improve this site."
    for asked in (f'<div class="x1">{cookies} <button>Accept</button></div>', f"<div><p>{cookies}</p> <button>Yes</button> <a href=/p>More</a></div>", '<div class="x2">Subscribe to our weekly letter. <input name="e"><button>Send</button></div>'):
        assert unnamed(before=asked) == unnamed(after=asked) == main
    assert unnamed(before='<div class="css-9x"><a href="/">Home</a><a href="/n">News</a></div>') == main
    cell = '<td><a href="a">A</a><br><a href="b">B</a><br><a href="c">C</a></td>'
    assert htmltext.extract(f"<html><body><table><tr>{cell}<td><h1>Bridge</h1><p>{A}</p><p>{B}</p></td></tr></table></body></html>") == main
    toc = '<div id="t1"><ul><li><a href="#h">1 History</a></li><li><a href="#u">2 Use</a></li><li><a href="#s">3 See also</a></li></ul></div>'
    assert htmltext.extract(f'<html><body><div id="content"><h1>Bridge</h1><p>{A}</p>{toc}<h2>History</h2><p>{B}</p></div></body></html>') == f"Bridge\n{A}\nHistory\n{B}"


def test_main_text_that_looks_alike_stays():
    """Questions with answers, glossaries and buttons within the article."""
    asked = "".join(f"<div><b>{q}</b><p>{t}</p></div>" for q, t in (("How long?", "Two days at most."), ("How much?", "Ten euros for all."), ("Who?", "Everyone may come and see.")))
    for start, end in (("<article>", "</article>"), ("<div>", "</div>")):
        text = htmltext.extract(f"<html><body>{start}<h1>FAQ</h1><p>{A}</p>{asked}<p>{B}</p>{end}</body></html>")
        assert text == f"FAQ\n{A}\nHow long?\nTwo days at most.\nHow much?\nTen euros for all.\nWho?\nEveryone may come and see.\n{B}"
    terms = "".join(f"<li><b>{n}</b> the {k} <i>letter</i></li>" for n, k in (("Alpha", "first"), ("Beta", "second"), ("Gamma", "third")))
    assert "Beta the second letter" in htmltext.extract(f"<html><body><main><h1>Words</h1><p>{A}</p><ul>{terms}</ul><p>{B}</p></main></body></html>")
    assert "Press OK to go on. Then wait." in htmltext.extract(f"<html><body><div><h1>How</h1><p>Press <button>OK</button> to go on. Then wait.</p><p>{A}</p><p>{B}</p></div></body></html>")
