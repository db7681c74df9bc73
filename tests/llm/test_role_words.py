"""Role words and forms around an article do not take it away."""

import pytest

from noticework.llm.wrappers import main_text

NAV, FOOT = "<nav>Menu of the page</nav>", "<footer>foot</footer>"
ARTICLE = "<article><h1>Title</h1><p>Long text of the article stands here, and some more of it.</p></article>"
PLAIN = "<div><h1>Title</h1><p>Long text of the article stands here, and some more of it.</p></div>"
TEXT = "Title\nLong text of the article stands here, and some more of it."


@pytest.mark.parametrize("body", [ARTICLE, PLAIN])
@pytest.mark.parametrize("around", ['<body class="has-sidebar">{}', '<html id=menu-page><body>{}', '<div class="page with-header">{}</div>', '<form action="/p.aspx">{}</form>',
                                    '<form><div class="no-sidebar">{}</div></form>', '<main class="with-sidebar">{}</main>'])
def test_words_around_the_article(around, body):
    assert main_text(around.format(NAV + body + '<div class="comments">me too</div>' + FOOT) if "main" not in around else around.format(body), None, set()) == TEXT


def test_title_in_a_header_of_the_article():
    assert main_text('<article><div class="entry-header"><h2>Title</h2></div><p>Text</p><div class="share">Tell all</div></article>', None, set()) == "Title\nText"


def test_marks_that_stay():
    assert main_text(ARTICLE + '<div class="comments"><p>' + "me too " * 100 + "</p></div>", None, set()) == TEXT
    assert main_text(PLAIN + "<aside><article>Teaser</article></aside>", None, set()) == TEXT
    assert main_text(PLAIN + '<div class="related"><article>Teaser</article></div>', None, set()) == TEXT
    assert main_text(PLAIN + '<form>Your name<p>Send</p></form>', None, set()) == TEXT
