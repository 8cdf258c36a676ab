"""Pages that leave out end tags."""

from __future__ import annotations

import pytest

from tidemark.llm import html_text


@pytest.mark.parametrize(
    "html, want",
    [
        ("<head><title>x</title><body><article><p>some words</p></article>", ["some words"]),
        ("<html><head><meta charset=u><link rel=x><div>some</div><p>words", ["some", "words"]),
        ("<head><title>x</title>bare words", ["bare words"]),
        ("<head><title>x</title></head><body><p>a</p><head><p>b</p>", ["a", "b"]),
        ("<div><select><option>one<option>two<p>after</p></div>", ["after"]),
        ("<div><option>one<p>after</p></div>", ["after"]),
        ("<div><button>go<p>after</p></div><p>more</p>", ["after", "more"]),
        ("<div><button><div>go</div></button><p>after</p></div>", ["after"]),
        ("<div><select><option>one</select> after</div>", ["after"]),
    ],
)
def test_text_after_open_tags_is_seen(html, want):
    assert [run for _, run in html_text.parse(html).runs] == want
