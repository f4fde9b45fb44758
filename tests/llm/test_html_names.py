"""Main text of pages whose names mislead, and of pages built from known parts."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

from docrows.llm.html_extract import furniture_name, main_text

PROSE = "The committee met in the spring, and it spoke of many things at length. " * 4


def page(inner):
    return f"<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{PROSE}</p>{inner}<p>{PROSE}</p></article><footer>us</footer></body></html>"


@pytest.mark.parametrize("tag", ['div class="notice-of-intent"', 'div class="related-work"', 'p id="comment-on-method"', 'section class="x ad-hoc-review"', 'div data-hidden="no"'])
def test_names_with_other_words_keep_an_articles_prose(tag):
    name = tag.split()[0]
    assert f"Kept: {PROSE.strip()}" in main_text(page(f"<{tag}>Kept: {PROSE}</{name}>"))


@pytest.mark.parametrize(
    "tag", ["section id=responses", 'div class="comments"', 'div class="comment-list"', 'div style="color:red; display : none"', "p hidden", 'div hidden=""', 'div class="cookie-notice"', "div style='visibility:hidden'", 'div class="related-links-x"']
)
def test_furniture_and_hidden_parts_go(tag):
    said = PROSE if "links-x" not in tag else "see <a href=y>more</a>"
    got = main_text(page(f"<{tag}>Gone: {said}</{tag.split()[0]}>"))
    assert "Gone" not in got and got == " ".join(f"Title {PROSE} {PROSE}".split())


def test_leads_of_the_main_element():
    body = f"<div class=main><p>{PROSE}</p><p>{PROSE}</p></div>"
    both = " ".join(f"{PROSE} {PROSE}".split())
    assert main_text(f"<body><p>Short intro here</p>{body}<p>(c) us</p></body>") == f"Short intro here {both}"
    assert main_text(f"<body><p>far</p><div>x</div>{body}</body>") == both
    assert main_text(f"<body><p hidden>Short intro here</p>{body}</body>") == both


def test_names():
    assert [furniture_name(x) for x in ("", "story", "ad", "ad-slot", "notice-of-intent", "story comments", "top_nav2", "shared")] == [0, 0, 2, 2, 1, 2, 2, 0]


class Plain(HTMLParser):
    """Text of elements with the attribute data-keep, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.on = [], False

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "a", "em", "br"):
            self.on = ("data-keep", None) in attrs
            self.blocks += [""] if self.on else []
        elif tag == "br" and self.on:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.on = self.on and tag in ("b", "i", "a", "em")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


@pytest.mark.parametrize("seed", range(5))
def test_built_pages(seed):
    """Pages of marked content among furniture, read by another parser for what is marked."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    inline = lambda t: rng.choice([t, f"<b>{t}</b>", f"<em>{t}</em> &amp; {word()}", f"{t} &lt;{word()}&gt;", f"{t}<br>{words(3)}"])
    sentence = lambda: inline(words(rng.randrange(6, 18))) + rng.choice([".", ", " + words(4) + ".", "!"])
    junk = [
        lambda: "<ul class=menu>" + "".join(f"<li><a href=/{word()}>{words(2)}</a></li>" for _ in range(6)) + "</ul>", lambda: f"<div class='ad-box'>{sentence()}</div>",
        lambda: f"<aside><p>{sentence()}</p></aside>", lambda: f"<script>if (a<b) x('</p>{word()}')</script>", lambda: f"<form><label>{words(3)}</label><input></form>", lambda: f"<div style='display:none'>{sentence()}</div>", lambda: f"<!-- {words(4)} -->",
    ]
    for _ in range(40):
        parts = [f"<h1 data-keep>{words(5)}</h1>"]
        for _ in range(rng.randrange(3, 12)):
            parts.append(f"<p data-keep>{' '.join(sentence() for _ in range(rng.randrange(2, 6)))}</p>")
            if rng.random() < 0.3:
                parts.append(rng.choice(junk)())
        around = [rng.choice(junk)() for _ in range(4)]
        text = f"<!doctype html><html><head><title>{words(3)}</title></head><body>{around[0]}{around[1]}<article>{''.join(parts)}</article>{around[2]}<section id=comments><p>{sentence()}</p></section>{around[3]}</body></html>"
        plain = Plain()
        plain.feed(text)
        assert main_text(text) == " ".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
