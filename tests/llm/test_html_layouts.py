"""Layouts marked by hand: what is the article, and what is not.  M stands for a paragraph of the article."""

import time

import pytest

from tallyspark.llm import html_text

P = "The quick brown fox, which had slept, jumped over the lazy dog, and then it ran away, as foxes do, into the dark green forest."
M = f"<p>{P}</p>"
NAV = '<nav><a href="/">Home</a> <a href="/b">News</a></nav>'
CASES = {
    "plain": (f"<body>{NAV}<article>{M}{M}</article><footer>All rights</footer></body>", f"{P} {P}"),
    "own header": (f"<body><header>Site</header><article><header><h1>Title</h1></header>{M}{M}</article></body>", f"Title {P} {P}"),
    "own header in a div": (f"<body><article><div><header><h1>Title</h1></header>{M}</div></article></body>", f"Title {P}"),
    "heading before": (f'<body>{NAV}<h1>My Title</h1><div class="content">{M}{M}</div></body>', f"My Title {P} {P}"),
    "two headings before": (f'<body><div class="menu">x</div><h1>A</h1> <h2>B</h2>\n<div class="content">{M}</div></body>', f"A B {P}"),
    "heading of something else": (f'<body><h2>Links</h2><div class="list">one two</div><div class="content">{M}{M}</div></body>', f"{P} {P}"),
    "linked heading": (f'<body><h2><a href="/">Site</a></h2><div class="content">{M}</div></body>', P),
    "parts": (f'<body><div class="part1">{M}{M}{M}</div><div class="part2"><h2>More</h2><p>Short.</p></div><div class="box">No.</div></body>', f"{P} {P} {P} More Short."),
    "unclosed quote": (f'<body><p title="x>{P}</p></body>', P),
    "greater in quotes": (f"<body><div title='a>b' data-x=\"c>d\">{M}</div></body>", P),
    "quote without value": (f'<body><p class"x">{P}</p></body>', P),
    "unquoted value": (f"<body><div class=content id=a/b>{M}</div></body>", P),
    "spaces round equals": (f"<body><div class = 'content'  id\n=\n'x'>{M}</div></body>", P),
    "upper case": (f"<BODY><DIV CLASS='sidebar'>{M}</DIV><DIV CLASS='content'>{M}{M}</DIV></BODY>", f"{P} {P}"),
    "closed at once": (f"<body><p>{P}<br/>end<img src='x'/></p></body>", f"{P} end"),
    "first attribute counts": (f'<body><div class="content" class="sidebar">{M}</div></body>', P),
    "comments of readers": (f'<body><div class="post">{M}{M}</div><div class="comments">{M}</div></body>', f"{P} {P}"),
    "references": (f"<body><article><p>{P} &eacute; &#8217; &amp;lt; &nbsp; x</p></article></body>", f"{P} é ’ &lt; x"),
    "script in between": (f"<body><article>{M}<script>if (a < b) '</p>'</script>{M}</article></body>", f"{P} {P}"),
    "less than in text": (f"<body><article><p>{P} 1 < 2 and 3 > 2</p></article></body>", f"{P} 1 < 2 and 3 > 2"),
    "tag that never ends": (f'<body><article>{M}</article><p class="x', P),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    page, want = CASES[name]
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<a " * 100_000 + '"', '<a x="' * 100_000, "<a x='>" * 100_000, "<p " + "x=" * 200_000, "<p" + " " * 300_000 + "x" + " " * 300_000, "<!--" * 100_000, "<script>" * 50_000, '="' * 200_000, "<p a='" + '"' * 200_000, "<header>" * 20_000, "<article>" + "<div>" * 30_000 + "<header></header>" * 30_000])
def test_odd_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3
