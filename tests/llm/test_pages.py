"""Pages by the rules of HTML and by composite text density: handmade pages, brute-force densities."""

import math
import random
import time

import pytest
from sparkprep.llm import html_text

LOREM = "The main text of the page goes on for some words. " * 6
MENU = "<nav><a href=1>One</a> <a href=2>Two</a></nav>"
THREAD = "".join(f"<p>A reader says a lot of words about all this, number {i}.</p>" for i in range(9))
SHORT = "<h1>Title</h1><p>First sentence here. Second sentence here. Third one to end it.</p>"


def text(body):
    return html_text.main_text(f"<html><body>{MENU}{body}</body></html>")


@pytest.mark.parametrize("thread", ['<div class="user-comments">%s</div>', '<section id="disqus_thread">%s</section>', '<div id="comments"><h3>Comments</h3>%s</div>',
                                    '<div class="post-comments">%s</div>', '<div itemprop="comment">%s</div>'])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<div class=post>%s</div>", "<main>%s</main>"])
def test_comments_of_any_length_are_left_out(thread, around):
    for page in (around % SHORT + thread % THREAD, around % (SHORT + thread % THREAD)):
        assert text(page) == "Title\nFirst sentence here. Second sentence here. Third one to end it."


@pytest.mark.parametrize("wrap", ['<form id="aspnetForm">%s</form>', "<fieldset>%s</fieldset>", "<dialog open>%s</dialog>", "<label>%s</label>", "<object>%s</object>"])
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<div class=content>%s</div>", "<main>%s</main>"])
def test_wrappers_of_the_content_stay(wrap, inner):
    body = f"<h1>Title</h1><p>{LOREM}</p><form action=x><input name=q><p>Your e-mail</p></form><p>{LOREM}</p>"
    assert text(wrap % (inner % body)) == f"Title\n{LOREM.strip()}\n{LOREM.strip()}"


@pytest.mark.parametrize("tag", ['<a title="5" tall">', "<img alt=Don't>", '<img alt=5" src=x>', "<span class=a'b \">", "<b title='a > b' x=\"c > d\">", "<i =\"x\">"])
def test_stray_quotes_swallow_nothing(tag):
    assert text(f"<article><p>{LOREM}</p><p>Before {tag}behind it.</p><p>{LOREM}</p></article>") == f"{LOREM.strip()}\nBefore behind it.\n{LOREM.strip()}"


@pytest.mark.parametrize("around", ["<main>%s</main>", "<div class=post>%s</div>", "<article>%s</article>"])
def test_headers_with_the_title_stay(around):
    page = around % f"<header><h1>The title</h1></header><p>{LOREM}</p><p>{LOREM}</p>"
    assert text("<header><h1>Site</h1><a href=0>Home</a></header>" + page) == f"The title\n{LOREM.strip()}\n{LOREM.strip()}"
    assert text(f"<main><header><h1>The title</h1></header><article><p>{LOREM}</p></article></main>") == f"The title\n{LOREM.strip()}"


def test_articles_side_by_side():
    one, two = (f"<article><h2>Part {i}</h2><p>{LOREM}</p><p>Number {i}. {LOREM}</p></article>" for i in (1, 2))
    want = "\n".join(f"Part {i}\n{LOREM.strip()}\nNumber {i}. {LOREM.strip()}" for i in (1, 2))
    assert text(one + two) == text(f"<main>{one}<div>{two}</div></main>") == text(f"<div>{one}</div><div>{two}</div>") == want


@pytest.mark.parametrize("junk", ["<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sports</a></div>",
                                  "<div><h3>Read more</h3><ul><li><a href=1>Another story of the day</a><li><a href=2>One more of these stories</a></ul></div>",
                                  '<div class="newsletter-signup"><p>Get our letter every week.</p></div>', '<div class="cookie-banner"><p>We use cookies on this site.</p></div>',
                                  '<div class="subscribe"><p>Subscribe now.</p></div>', "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"])
@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>"])
def test_link_lists_and_boxes_in_the_content_go(junk, around):
    got = text(around % f"<h1>Title</h1><p>{LOREM}</p>{junk}<p>{LOREM}</p>")
    assert got.replace("\nRead more", "") == f"Title\n{LOREM.strip()}\n{LOREM.strip()}"


def test_links_of_the_text_stay():
    body = f"<p>{LOREM}</p><p><a href=1>A paragraph that is a link</a></p><ul><li>An item with <a href=2>a link</a> and words<li>another</ul><p>{LOREM}</p>"
    assert text(f"<article>{body}</article>") == f"{LOREM.strip()}\nA paragraph that is a link\nAn item with a link and words\nanother\n{LOREM.strip()}"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</span>" * 20_000, "<div>" * 20_000 + "</div>" * 20_000, "<li><ul>" + "<b>" * 20_000 + "</li>" * 20_000,
                                  "<p><table>" + "<b>" * 20_000 + "<p>x" * 20_000, "<a x='" * 20_000, "<a =" * 20_000, '<a b="' * 20_001 + ">x"])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 4


class Node:
    def __init__(self, tag):
        self.tag, self.kids, self.text = tag, [], ""

    def nodes(self):
        return [self] + [n for k in self.kids for n in k.nodes()]

    def chars(self):
        return len(self.text) + sum(k.chars() for k in self.kids)

    def link_chars(self):
        return self.chars() if self.tag == "a" else sum(k.link_chars() for k in self.kids)

    def html(self):
        return f"<{self.tag}>{self.text}{''.join(k.html() for k in self.kids)}</{self.tag}>"


def random_tree(rnd, depth=0):
    node = Node("body" if depth == 0 else rnd.choice(["div", "div", "section", "span", "b", "a"]) if depth < 5 else "b")
    node.text = "x" * rnd.choice([0, 0, 3, 20, 200])
    if node.tag != "a":
        node.kids = [random_tree(rnd, depth + 1) for _ in range(rnd.randint(0, 4) if depth < 4 else 0)]
    return node


def test_densities_by_brute_force():
    """Characters per tag, and the logarithm that weighs links, straight from their definitions."""
    rnd = random.Random(7)
    for _ in range(50):
        root = random_tree(rnd)
        body = Node("#root")
        body.kids = [root]
        dom = html_text.parse(root.html())
        size = [0] * len(dom.tag)
        for k, t in dom.pieces:
            size[k] += len(t or "")
        density, sums = html_text._densities(dom, size)
        share = root.link_chars() / max(root.chars(), 1)
        every = body.nodes()
        assert dom.tag == [n.tag for n in every]
        want = []
        for n in every:
            c, lc = n.chars(), n.link_chars()
            t, lt = len(n.nodes()) - 1, sum(m.tag == "a" for m in n.nodes()[1:])
            if not c:
                want.append(0.0)
                continue
            ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            log = math.log(max(ratio, 1.0))
            want.append(c / max(t, 1) * (max(log / math.log(base), 0.0) if base > 1 else log / 1e-3))
        assert density == pytest.approx(want)
        for i, n in enumerate(every):
            assert sums[i] == pytest.approx(sum(want[every.index(k)] for k in n.kids))
