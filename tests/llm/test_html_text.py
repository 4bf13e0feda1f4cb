from __future__ import annotations

import html
import math
import random
import re

import pytest

from tallyframe.llm.common import table
from tallyframe.llm.html_text import extracted, in_order, main_text, op10_html, parsed, selected
from tests.conftest import SF01

P = "This paragraph is long enough to count as running text of an article, is it not?"


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<script>x", ""), ("<!-- c", ""), ("x &lt; y\n and <b>z", "x < y and z"), ("<p>a</p>", "a"),
    ("<p>a<br>b&nbsp;&eacute;&#x41;", "a b éA"), ("a < b", "a < b"), ("<p title='a>b'>x", "x"), ("<p title=\"a>x", "x"),
    ("<html><head><title>t</title><body><p>hi<li>a<li>b", "hi\n\na\n\nb"),
    (f"<nav>menu</nav><article><h1>T</h1><p><b>{P}<br><p>{P}</article><footer>f</footer>", f"T\n\n{P}\n\n{P}"),
    (f"<main><header><h1>T</h1></header><section><p>{P}</section><aside>s</aside><form><p>f</form></main><p>z", f"T\n\n{P}"),
    (f"<div class='side-menu'><a href=x>home</a></div><div id=c><h2>T</h2><p>{P}<p>{P}</div><div class=comments><p>{P}{P}</div>",
     f"T\n\n{P}\n\n{P}"),
    (f"<div class=cookie-notice><p>{P}</div><div><div><p>{P}<p>{P}</div><div><p>{P}</div></div><div role=navigation>{P}</div>",
     f"{P}\n\n{P}\n\n{P}"),
    (f"<article><style>p{{}}</style><script>var t='</p>';</script><p>{P}<div class=ad>{P}</div><ul><li>one<li>two</ul></article>",
     f"{P}\n\none\n\ntwo"),
    (f"<article><p>{P}</p><div class='reader-comments'>no</div><div hidden>no</div><p>{P}", f"{P}\n\n{P}"),
])
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<div class='content with-sidebar'><p>{P}<p>{P}</div>", f"{P}\n\n{P}"),
    (f"<div class=no-sidebar><p>{P}<p>{P}</div>", f"{P}\n\n{P}"),
    (f"<div class='sidebar layout'><p>{P}<p>{P}</div><div class=sidebar>{P}</div>", f"{P}\n\n{P}"),  # most of the text
    (f"<article><div class='entry-header'><h1>T</h1></div><p>{P}</article>", f"T\n\n{P}"),
    (f"<article><p>{P}<p>{P}<section id='related-work'><h2 id=cookies>R</h2><p>{P}</section></article>",
     f"{P}\n\n{P}\n\nR\n\n{P}"),
    (f"<article><p>{P}<div class=related><ul><li><a href=x>{P[:30]}</a></ul></div></article>", P),
    (f"<article><p>{P}<math><mi>x</mi><annotation>\\x</annotation></math> end</article>", f"{P}x end"),
])
def test_names_alone_remove_no_text(page, want):
    assert main_text(page) == want


LONG_COMMENTS = "".join(f"<article class=comment><p>{P} {P} {n}</p></article>" for n in range(6))


@pytest.mark.parametrize("page, want", [
    (f"<div style='overflow: hidden'><p>{P}<p>{P}</div>", f"{P}\n\n{P}"),
    (f"<article><p title='a hidden gem'>{P}<p data-x=hidden>{P}<p hidden=until-found>no</article>", f"{P}\n\n{P}"),
    (f"<article><p class = side-effects id='x'>{P}<p class='ad-hoc'>{P}<p class=login-guide>{P}<p class=notice>{P}</article>",
     "\n\n".join([P] * 4)),
    (f"<article><p>{P}<p class=advertisement>no<div class=notice>no</div><p class='ad-slot-2'>no</article>", P),
    (f"<form method=post><input type=hidden name=state><nav>no</nav><article><h1>T</h1><p>{P}</article><input type=submit></form>",
     f"T\n\n{P}"),
    (f"<form><div><p>{P}<p>{P}<p>{P}</div><input name=q><button>Go</button></form>", "\n\n".join([P] * 3)),
    (f"<div><p>{P}<p>{P}</div><form><p>Sign up</p><input name=mail><label for=x>Mail</label></form>", f"{P}\n\n{P}"),
    (f"<article><label>Note</label> <p>{P}<label>no <input></label></article>", f"Note\n\n{P}"),
    (f"<article><blockquote><p>{P}</p><footer>Someone</footer></blockquote><footer>no</footer></article>", f"{P}\n\nSomeone"),
    (f"<article><p>{P}</article>{LONG_COMMENTS}", P),  # more text than the article
    (f"<article><p>{P}</p><div class=comments>{LONG_COMMENTS}</div></article>", P),
    (f"<div id=comments><ol class=comment-list><li class='comment depth-1'><p>{P}{P}</ol></div><article><p>{P}</article>", P),
    (f"<div class=sidebar-right><div class=sidebar>no</div><main><p>{P}</main></div>", P),
    (f"<div class=notice><p>{P}</p></div>", P),  # nothing else is there
])
def test_attributes_forms_and_names(page, want):
    assert main_text(page) == want


def tree(rng, depth=0):
    """Random markup and what it stands for: (tag, children or texts)."""
    tag = rng.choice(["div", "section", "p", "a", "b"] if depth else ["div"])
    parts = []
    for _ in range(rng.randint(0, 4)):
        if depth > 4 or tag in ("p", "a", "b") or rng.random() < 0.3:
            parts.append(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 12))))
        else:
            parts.append(tree(rng, depth + 1))
    return tag, parts


def markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"


def sizes(node):
    """(characters, tags, characters in links, tags of links) of a node's subtree, itself left out as a tag."""
    tag, parts = node
    chars = tags = links = link_tags = 0
    for part in parts:
        if isinstance(part, str):
            chars += len(" ".join(part.split()))
        else:
            c, t, lc, lt = sizes(part)
            chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt + (part[0] == "a")
    return chars, tags, chars if tag == "a" else links, link_tags


def composite(node, body):
    c, t, lc, lt = sizes(node)
    if not c:
        return 0.0
    t, lc_, lt = max(1, t), max(1, lc), max(1, lt)
    share = body[2] / max(1, body[0])
    return c / t * math.log(max(1.0, c / lc_ * t / lt)) / math.log(math.log(lc_ / max(1, c - lc) * c + share * c + math.e))


def brute_force(root):
    """The chosen subtrees: by every node's density sum, the threshold of the path, and each dense node's best subtree."""
    body, paths = sizes(root), {}

    def visit(node, path):
        paths[id(node)] = (node, [*path, node])
        for child in node[1]:
            if not isinstance(child, str):
                visit(child, [*path, node])

    visit(root, [])
    density = {key: composite(node, body) for key, (node, _) in paths.items()}
    total = {key: sum(density[id(c)] for c in node[1] if not isinstance(c, str)) for key, (node, _) in paths.items()}
    order = [node for node, _ in paths.values()]
    lead = max(order, key=lambda n: total[id(n)])
    if not total[id(lead)]:
        return density, total, [root]
    threshold = min(density[id(n)] for n in paths[id(lead)][1])
    chosen = {id(lead)}
    for node in order[1:]:
        if density[id(node)] >= threshold:
            inside = [n for n in order if any(n is m or node is m for m in paths[id(n)][1]) and node in paths[id(n)][1]]
            chosen.add(id(max(inside, key=lambda n: total[id(n)])))
    return density, total, [n for n in order if id(n) in chosen and not any(id(m) in chosen for m in paths[id(n)][1][:-1])]


@pytest.mark.parametrize("seed", range(40))
def test_densities_and_selection_equal_brute_force(seed):
    rng = random.Random(seed)
    nodes = tree(rng)
    page = parsed(markup(nodes))
    root = ("body", [nodes])
    density, total, chosen = brute_force(root)
    got = selected(page)

    def pairs(element, node):
        yield element, node
        below = [c for c in element.content if not isinstance(c, str)]
        want = [c for c in node[1] if not isinstance(c, str)]
        assert [c.tag for c in below] == [c[0] for c in want]
        for one, other in zip(below, want):
            yield from pairs(one, other)

    matched = {id(e): n for e, n in pairs(page, root)}
    for element in in_order(page):
        assert element.density == pytest.approx(density[id(matched[id(element)])])
        assert element.total == pytest.approx(total[id(matched[id(element)])])
    assert [id(matched[id(e)]) for e in got] == [id(n) for n in chosen]


def test_all_articles_of_a_page_count():
    sizes = (2, 6, 3)  # the second leads
    articles = ["<article>" + "".join(f"<p>{P} {n}" for _ in range(n)) + "</article>" for n in sizes]
    want = "\n\n".join(f"{P} {n}" for n in sizes for _ in range(n))
    links = "<article>" + "".join(f"<p><a href=x>link {n}</a></p>" for n in range(20)) + "</article>"
    assert main_text("".join(articles) + links) == want
    assert main_text(f"<article><p>{P}{articles[1]}</article>{links}") == "\n\n".join([P] + [f"{P} 6"] * 6)


def test_links_lower_the_density():
    links = "".join(f"<a href={i}>a link with some words {i}</a> " for i in range(30))
    page = f"<div>{links}</div><div><p>{P}</p><p>{P}</p></div>"
    assert main_text(page) == f"{P}\n\n{P}"


def test_deep_and_hostile_markup():
    assert main_text("<div>" * 3000 + "x" + "</div>" * 10) == "x"
    assert main_text("<" * 3000 + "p>x").endswith("x")
    assert main_text("</p></div>" * 500 + "y") == "y"
    assert parsed("<p><b><i>x</p>").content


def plainly(page):
    """The article of the fixture's pages, taken apart by their fixed layout."""
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?p>|</?h1>|<footer>", article)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", part))).split()) for part in parts]
    return "\n\n".join(part for part in parts if part)


def test_fixture_pages(spark):
    pages = {r.page_id: r.html for r in table(spark, SF01, "pages").collect()}
    got = op10_html(spark, SF01).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plainly(pages[r.page_id]) and r.n_chars == len(r.text)


def test_odd_rows(odd, empty):
    got = extracted(odd, html_col="text", page_id="doc_id", url="source").collect()
    assert len(got) == 10 and {r.text for r in got if r.page_id in (1, 2, 5)} == {""}
    assert extracted(empty, html_col="text", page_id="doc_id").count() == 0
