"""Main text of pages: ordinary HTML, and a slow version with a tree, held against the operator on all pages, on pages without marks and
on randomly damaged ones."""

import html
import random
import re

import pandas as pd
import pytest

from latticeql.llm import html_text as H

PAGES = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.tolist()


class Node:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.kids = tag, attributes, parent, []

    def up(self):
        node = self
        while node:
            yield node
            node = node.parent

    def blocks(self):
        return [n for n in self.up() if n.tag in H.BLOCK]


def tokens(page):
    """(kind, tag, rest): text, start, end; read character by character."""
    at, text = 0, ""
    while at < len(page):
        rest = page[at:]
        if rest.startswith("<!--"):
            end = rest.find("-->")
            at += end + 3 if end >= 0 else len(rest)
            continue
        tag = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", rest)
        if tag or rest[:2] in ("<!", "<?"):
            end, quote = (tag.end() if tag else 2), ""
            while end < len(rest) and (quote or rest[end] != ">"):
                if tag:
                    quote = "" if rest[end] == quote else quote or (rest[end] if rest[end] in "\"'" else "")
                end += 1
            if end < len(rest):
                if text:
                    yield "text", "", text
                text, name = "", tag[2].lower() if tag else ""
                at += end + 1
                if name in H.RAW.split("|") and not tag[1]:
                    close = re.search(rf"</{name}\s*>", page[at:], re.I)
                    at = at + close.end() if close else len(page)
                elif tag:
                    yield ("end" if tag[1] else "start"), name, rest[tag.end() : end]
                continue
        text += page[at]
        at += 1
    if text:
        yield "text", "", text


def tree(page):
    here = root = Node("#root", "", None)
    skips = lambda n: [x for x in n.up() if x.parent and H._boilerplate(x.tag, x.attributes)[0]]
    for kind, tag, rest in tokens(page):
        if kind == "text":
            here.kids.append(rest)
            continue
        block = tag in H.BLOCK
        if kind == "end":
            if not any(n.tag == tag for n in here.up()):
                here.kids += ["\0"] * block
                continue
            walls = set() if tag == "table" else {"table"} if tag in H.CELLS or (tag in H.SIBLINGS and tag not in H.WALLS) else H.CELLS | H.WALLS.get(tag, set())
            for n in here.blocks() if block else here.up():
                if n.tag == tag:
                    here = n.parent
                    break
                if n.tag in walls if block else n.tag in H.BLOCK:
                    here.kids += ["\0"] * block
                    break
            else:
                here.kids += ["\0"] * block
            continue
        if block:
            chain = here.blocks()
            if chain and chain[0].tag == "p" and tag not in "br button select option optgroup video audio object".split():
                here = chain[0].parent
            last = None
            for n in here.blocks() if tag in H.SIBLINGS else []:
                if n.tag in H.SIBLINGS[tag]:
                    last = n
                elif last or n.tag in H.WALLS.get(tag, {"table"}):
                    break
            here = last.parent if last else here
            here.kids.append("\0")
        if tag in H.MAIN:
            while (found := skips(here)) and not any(H._boilerplate(n.tag, n.attributes)[1] for n in found):
                here = here.parent
        if tag in H.VOID or re.search(r"(^|[\s\"'])/$", rest):
            continue
        node = Node(tag, rest, here)
        here.kids.append(node)
        here = node
    return root


def flat(node, marked=False, link=False, heading=False, inside=()):
    """Runs of text (text, marked, link, containers), breaks and gaps."""
    for kid in node.kids:
        if kid == "\0":
            yield "break"
        elif isinstance(kid, str):
            yield kid, marked, link and not heading, inside
        else:
            block = kid.tag in H.BLOCK
            skip = H._boilerplate(kid.tag, kid.attributes)[0]
            if skip:
                yield from ["break", 1] if block else []
                continue
            main = kid.tag in H.MAIN
            box = kid.tag in H.CONTAINER
            edge = [H.WINDOW if main and not marked else 1] if box else []
            yield from ["break"] * block + edge
            yield from flat(kid, marked or main, link or kid.tag == "a", heading or kid.tag in H.HEADING, (*inside, id(kid)) if box else inside)
            yield from ["break"] * block + edge


def slow(page):
    lines, here = [], []

    def flush():
        text = " ".join(html.unescape("".join(r[0] for r in here)).split())
        if text:
            plain = " ".join(html.unescape("".join("" if r[2] else r[0] for r in here)).split())
            lines.append((text, 1000 * len(text) if here[-1][1] else len(plain), here[-1][3]))
        here.clear()

    for x in flat(tree(page)):
        if isinstance(x, tuple):
            here.append(x)
        elif x == "break":
            flush()
        else:
            lines += [("", 0, ())] * x
    flush()
    sizes = [s for _, s, _ in lines]
    sizes = sizes if any(sizes) else [len(t) for t, _, _ in lines]
    runs, run = [], []
    for k, size in enumerate(sizes):
        if size and run and not all(any(sizes[j : j + 3]) for j in range(run[-1], k)):
            runs.append(run)
            run = []
        run += [k] * (size > 0)
    runs += [run] if run else []
    if not runs:
        return ""
    weight = lambda r: sum(sizes[k] for k in r)
    best = max(runs, key=weight)

    def parents(r):
        out = set()
        for k in range(r[0], r[-1] + 1):
            if lines[k][0]:
                chain = list(lines[k][2])
                while chain and sum(chain[-1] in other for _, _, other in lines) == 1:
                    chain.pop()
                out.add(chain[-1] if chain else None)
        return out

    return " ".join(lines[k][0] for r in runs if 5 * weight(r) >= weight(best) or parents(r) & parents(best) for k in range(r[0], r[-1] + 1) if lines[k][0])


WORD = "word " * 50
CASES = [
    ("<html><head><title>t</title><body><article><p>Hello world", "Hello world"),
    ("<article><p>a</p><svg class=i /><p>b</p><video src=x /><p>c</p></article>", "a b c"),
    ("<p class='ad'>buy now<p>Real one.<p>Real two.", "Real one. Real two."),
    ("<ul><li class='share'>tweet<li>Real item</ul>", "Real item"),
    ("<div class='content-with-sidebar'><p>Text here</p></div>", "Text here"),
    ("<p class='lead-share'>Lead</p>", "Lead"),
    ("<article><p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> ok</p></article>", "Sum x+1 ok"),
    ("<body><p>Short.</p></body>", "Short."),
    ("<div><a href=#c>Skip</a></div><div><ul><li><a>Home</a><li><a>About</a><li><a>Contact</a><li><a>More</a></ul></div><div><h1><a href=x>Title</a></h1><p>" + WORD + "</p><p>Read <a>this</a>.</p></div><div><div>(c) 2020</div></div>", "Title " + WORD + "Read this."),
    ("<div><p>" + WORD + "</p>" + "<div class=ad>x</div>" * 3 + "<p>End.</p></div>", WORD + "End."),
    ("<table><tr><td class=sidebar>side<td>main text<tr><td>more</table>", "main text more"),
    ("<form action=x><input><div><article><p>Wrapped page</p></article></div></form>", "Wrapped page"),
    ("<article>a<p>x<table><tr><td><p>y</div>z</table>w</article>", "a x y z w"),
    ("<article>foo<img src=x>bar <span class='shareButton'>tweet</span> baz</article>", "foobar baz"),
    ("<p><a href=x>only link</a></p>", "only link"),
    ("<dl><dt>a<dd>b<dt class=ad>c<dd>d</dl><select><option>e<option>f</select>", "a b d"),
    ("<nav>menu</nav><form>name</form>", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_ordinary_html(page, text):
    assert H.extract(page) == text == slow(page)


def test_all_pages_and_pages_without_marks_against_the_slow_version():
    for page in PAGES:
        text = H.extract(page)
        bare = re.sub("</?article>", "", page)
        assert text == slow(page) == H.extract(bare)
        # Without its article and its menu's tag a page is told by the sums alone.
        menu = re.sub("<(/?)nav>", r"<\1div>", bare)
        assert H.extract(menu) == text != " ".join(x.text for x in H.lines_of(menu) if x.text)


def test_damaged_pages_against_the_slow_version():
    rng = random.Random(8)
    tags = "div p li ul td tr table article main nav b a h1 br span dt dd form section option footer".split()
    extra = ["", " class=ad", " class='comment-list'", " id=x", " class='no-ads'", " /"]
    for page in PAGES[:120] + [c for c, _ in CASES] * 4:
        parts = re.split("(<[^>]*>)", page[:3000])
        for _ in range(rng.randint(1, 12)):
            k, tag = rng.randrange(len(parts)), rng.choice(tags)
            parts[k] = rng.choice(["", f"<{tag}{rng.choice(extra)}>", f"</{tag}>", parts[k] + f"<{tag}>", parts[k] * 2, "short text"])
        damaged = "".join(parts)
        damaged = damaged[: damaged.rfind(">") + 1]
        assert H.extract(damaged) == slow(damaged), damaged


def test_sums_find_surge_and_dive():
    assert H.stretches([0, 5, 0, 0, 5, 0, 0, 0, 7, 0], 3) == [(1, 5), (8, 9)]
    assert H.stretches([], 3) == [] == H.stretches([0, 0], 3)
