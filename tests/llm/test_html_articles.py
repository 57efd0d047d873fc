"""Comments, foreign articles and attributes as pages really write them."""

import pytest

from claimflow.llm.html import main_elements, main_text, parse


def text(page):
    return main_text(*main_elements(parse(page)))


@pytest.mark.parametrize("page,want", [
    ("<main><p>Body</p></main><article class=comment>first!</article>", "Body"),
    ("<article><p>Body</p><article class='comment reply'><p>first!</p></article></article>", "Body"),
    ("<article><p>Body</p></article><article class=advert><p>Buy</p></article>", "Body"),
    ("<main><article><p>One</p></article><article class=sponsored-content>Ad</article></main><article>Elsewhere</article>", "One"),
    ("<main class=content><p>Body</p></main>", "Body"),
    ("<main role=main><section class=comments><article>c</article></section><p>Body</p></main>", "Body"),
    ("<body><article id=post-7 class='post has-comments'><p>Body</p></article></body>", "Body"),
    ("<p title=it's>Hello don't go</p>", "Hello don't go"),
    ("<p title=it's>Hello", "Hello"),
    ("<p title='a > b' data-x=\"c > 'd'\">Hello</p>", "Hello"),
    ("<p title=>Hello</p><p =x>you</p>", "Hello\nyou"),
    ("<article><p class=it's>don't</p><div class='comments'>no</div></article>", "don't"),
])
def test_main_text(page, want):
    assert text(page) == want


def test_unclosed_and_long_attributes_do_not_backtrack():
    assert text("<p " + "a=" * 50_000 + ">Hello</p>") == "Hello"
    assert text("<p>Hello</p><p title=\"" + "x' = " * 50_000).startswith("Hello")
