import pytest

from tipoff.llm.html_text import extract, main_text

LONG = "The article has a long paragraph with many of the usual words in it, and that is what the rules look for."

CASES = [
    (None, ""), ("", ""), ("plain words only", ""), ("<html><body></body></html>", ""),
    (f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>Short.</p></article><footer>&copy; me</footer>",
     f"Title & more\n{LONG}\nShort."),
    (f"<body><div class='ad'>{LONG}</div><main><p>{LONG}</p><div class=\"comments\"><p>{LONG}</p></div><p>End.</p></main>", f"{LONG}\nEnd."),
    (f"<article><p>A&nbsp;\n <b>bold</b>\tone<br>two &lt;x&gt;</p><script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p></article>",
     f"A bold one two <x>\n{LONG}"),
    (f"<div><h2>Head of it</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><p><a href=a>{LONG}</a></p><p>stray</p></div>",
     f"Head of it\n{LONG}\nShort one.\n{LONG}"),
    (f"<div id='sidebar'><p>{LONG}</p></div><div class=content><p>{LONG}</p></div><form><p>{LONG}</p></form><aside>{LONG}</aside>", LONG),
    (f"<article><header><h1>Own header</h1></header><p>{LONG}</p><p>{LONG}<br><br>Second</p></article><header>Site {LONG}</header>",
     f"Own header\n{LONG}\n{LONG}\nSecond"),
    (f"<p title='a > b' class=x>{LONG}<!-- open comment <p>{LONG}", LONG),
    (f"<p>{LONG}</p><p style='display:none'>{LONG}</p><p hidden>{LONG}</p><p>5 < 6 and {LONG}</p>", f"{LONG}\n5 < 6 and {LONG}"),
    (f"<article><ul><li>One<li>Two</ul><table><tr><td>{LONG}</td><td>cell</td></tr></table>", f"One\nTwo\n{LONG}\ncell"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_very_long_and_odd_pages():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert main_text(page).count("\n") == 19_999
    for odd in ("<" * 50_000, "<a " * 50_000, "</p>" * 50_000, "<p " + "'" * 50_001, "&" * 50_000, "<div>" * 20_000 + LONG):
        assert isinstance(main_text(odd), str)


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", CASES[4][0], "x"), (1, "u", CASES[4][0], "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, extract(pages).collect()), key=str)
    text = CASES[4][1]
    assert out == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("wrapper", [
    "div class='page has-sidebar'", "div class='container no-sidebar'", "div class='sticky-header'", "div class=withNavbar", "div id='search-results'",
    "form action='./page.aspx' id='aspnetForm'", "section class='sidebar-left layout'", "div class='wrap sticky-footer'", "div class='menu'"])
@pytest.mark.parametrize("mark", ["article", "main"])
def test_wrappers_of_an_article_are_no_regions(wrapper, mark):
    end = f"</{wrapper.split()[0]}>"
    beside = f"<div class='sidebar'><p>{LONG}</p></div><div id='comments'><article><p>{LONG}</p></article></div><nav>{LONG}</nav>"
    assert main_text(f"<body><{wrapper}><{mark}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></{mark}>{beside}{end}</body>") == f"Head\n{LONG}\n{LONG}"
    assert main_text(f"<main><{wrapper}><article><p>{LONG}</p><p>{LONG}</p></article>{end}</main>") == f"{LONG}\n{LONG}"
    # without marks only a name of which a region word is a part, or a form, can wrap a page
    kept = "" if "menu" in wrapper else f"{LONG}\n{LONG}"
    assert main_text(f"<body><{wrapper}><div><p>{LONG}</p><p>{LONG}</p></div>{end}</body>") == kept


@pytest.mark.parametrize("region", [
    "div class='comment-list'", "div id=comments", "section class='related-posts'", "div class='site-footer'", "div class='cookie-banner'", "aside", "div hidden",
    "div style='display:none'"])
def test_regions_beside_the_article_stay_apart(region):
    end = f"</{region.split()[0]}>"
    text = f"<p>{LONG}</p>"
    for inner in (text * 5, f"<article>{text * 5}</article>"):
        assert main_text(f"<div class=post>{text}</div><{region}>{inner}{end}") == LONG
        assert main_text(f"<article>{text}</article><{region}>{inner}{end}") == LONG
        assert main_text(f"<main>{text}<{region}>{inner}{end}</main>") == LONG
    assert main_text(f"<article>{text}<div class='share-links'>{text * 3}</div></article><form>{text}</form>") == LONG
    for odd in ("<div class=ad>" * 20_000 + LONG, "<div class='a-menu'>" * 20_000 + LONG, "<form>" * 20_000 + "<main>" + LONG):
        assert isinstance(main_text(odd), str)


FOREIGN = [
    "Il governo italiano approva oggi una nuova legge che cambia molte regole per imprese e lavoratori della regione, dopo mesi di discussioni.",
    "Правительство одобрило вчера новый закон, который меняет правила для предприятий и работников этой области, после долгих споров в парламенте.",
    "政府昨天批准了一项新的法律，这项法律改变了该地区企业和工人的许多规则，经过数月的讨论之后，议会以多数票通过了这一方案，新的规定将从明年一月起开始实施，并由各个地方的主管部门负责监督执行。",
]


@pytest.mark.parametrize("text", FOREIGN)
def test_other_languages_without_marks(text):
    head, short = text[:12].strip(), text[:20].strip()
    links = "".join(f"<li><a href=x>{text[:40]}</a>" for _ in range(5))
    page = f"<nav>{text}</nav><ul>{links}</ul><div><h2>{head}</h2><p>{text}</p><p>{short}</p><p>{text}</p></div><div><a href=x>{text}</a></div><footer>{text}</footer>"
    assert main_text(page) == f"{head}\n{text}\n{short}\n{text}"
    # beside text of a known language it stays a list of names
    assert main_text(f"<div><p>{LONG}</p></div><div>{text}</div>") == LONG
