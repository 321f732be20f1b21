"""Main text: the ratios decide, names and elements only weigh."""

import re

import pytest

from contactmill.llm import maintext

STORY = "".join(f"<p>This is paragraph {i} of the story, with some text; it goes on for a while. And then it ends, finally.</p>" for i in range(5))
LINES = [f"This is paragraph {i} of the story, with some text; it goes on for a while. And then it ends, finally." for i in range(5)]
LONG = "<p>A reader wrote a long remark, with commas. And so on; it goes on for a while, and on and on. Even longer than the paragraphs!</p>"

PAGES = {
    "names that only contain a listed word": (f'<body><nav><a href="x">Menu</a></nav><article class="post has-comments"><h1>Title</h1>{STORY}</article></body>', ["Title", *LINES]),
    "a container without a sidebar": (f'<body><div class="content no-sidebar">{STORY}</div><div class="sidebar"><p>Other things, to read. More of them, here.</p></div></body>', LINES),
    "one form around the page": (f'<body><form action="x"><div>{STORY}</div></form></body>', LINES),
    "a story beside a teaser": (f"<body><div>{STORY}</div><article><p>Teaser one.</p></article></body>", LINES),
    "ids of headings": (f'<body><article><h1>Title</h1>{STORY}<h2 id="related-work">Related work</h2><p>Text on it.</p><h3 id="search">Search</h3><p id="notice-of-appeal">A notice, of appeal.</p></article></body>',
                        ["Title", *LINES, "Related work", "Text on it.", "Search", "A notice, of appeal."]),
    "comments below, longer than the story's paragraphs": (f'<body><article><h1>Title</h1>{STORY}</article><div id="comments" class="comment-list"><div class="comment">{LONG}</div></div><form><p>Leave a reply, please.</p></form></body>', ["Title", *LINES]),
    "comments inside": (f'<body><article><h1>Title</h1>{STORY}<section class="commentList">{LONG}</section></article></body>', ["Title", *LINES]),
    "advert inside": (f'<body><main><h1>Title</h1>{STORY}<div class="ad-box">Buy this now, it is cheap.</div><ul><li>One point.</li></ul></main></body>', ["Title", *LINES, "One point."]),
    "nothing named at all": (f'<body><div><ul><li><a href="a">Home</a></li><li><a href="b">News</a></li></ul></div><div><h1>Title</h1>{STORY}</div><div>Short note</div></body>', ["Title", *LINES]),
    "a comment as an article of its own": (f'<body><main><article><h1>Title</h1>{STORY}<article class="comment">{LONG}</article></article></main></body>', ["Title", *LINES]),
    "all under a listed name": (f'<body><div class="comments">{STORY}</div></body>', LINES)}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    page, want = PAGES[name]
    assert maintext.main_text(page).split("\n") == want


def test_listed_names():
    for name in ("sidebar", "comment-list", "commentList", "site-footer", "sidebar_left", "ads", "newsletter-box"):
        assert maintext.listed(name), name
    for name in ("no-sidebar", "has-comments", "related-work", "notice-of-appeal", "content", "post", "header-image-credits", "", "-", "adsorption"):
        assert not maintext.listed(name), name


def test_ratios_alone_decide_on_pages_without_names(spark):
    html = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    bare = lambda x: re.sub(r"(</?)(article|nav|footer|aside|header|main)\b", r"\1div", re.sub(r' (class|id)="[^"]*"', "", x))
    same = lost = 0
    for x in html:
        full, part = maintext.main_text(x), maintext.main_text(bare(x))
        same += full == part
        lost += not set(full.split("\n")) <= set(part.split("\n"))
    assert same > 0.75 * len(html) and lost < 0.02 * len(html)


def test_long_and_odd_pages():
    assert maintext.main_text(f"<p>{'word, ' * 200_000}</p>").count("word") == 200_000
    assert maintext.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    for page in (None, "", " ", "<", "<p", "<form><p>only a form</p></form>", "<a href=x>only a link</a>", "<!-- x"):
        maintext.main_text(page)
    assert maintext.main_text("plain text, no markup") == "plain text, no markup"
