"""The style tree against a plain one, a site that only the tree can clean, and names that must not empty a page."""

import math
import random
from collections import Counter, defaultdict

import pytest

from symtab.llm import html_text as H
from symtab.llm.common import table

WORDS = "stone river light north table green cloud seven paper under music early winter bridge market window".split()


def host_of(url):
    return url.split("//", 1)[1].split("/", 1)[0].split(":")[0].lower() if url and "//" in url else ""


def plain_tree(pages):
    """{host: (low, high)}: for each element path its pages, child sequences and texts in dictionaries."""
    hosts = defaultdict(lambda: defaultdict(lambda: (set(), Counter(), defaultdict(set), set())))
    for number, (url, html) in enumerate(pages):
        tree, styles = hosts[host_of(url)], set()
        for said, where in H.blocks_of(html):
            if said is None:
                if not where.drop:
                    tree[where.path][0].add(number)
                    styles.add((where.path, tuple(where.children)))
                    if where.main:
                        tree[where.path][3].add(True)
            elif not where[-1].drop:
                for n in where[1:]:
                    tree[n.path][2][said].add(number)
        for path, style in styles:
            tree[path][1][style] += 1
    out = {}
    for host, tree in hosts.items():
        low, high = set(), set()
        for path, (seen, styles, texts, main) in tree.items():
            m = len(seen)
            if m < H.MIN_PAGES:
                continue
            shares = [k / m for k in styles.values()]
            presentation = -sum(p * math.log(p, m) for p in shares)
            content = 1 - sum(math.log(len(k), m) for k in texts.values()) / len(texts) if texts else 0
            importance = (1 - H.GAMMA ** len(styles)) * presentation + H.GAMMA ** len(styles) * content
            if importance < H.LEAST:
                low.add(path)
            elif not main:
                high.add(path)
        out[host] = low, high
    return out


def plain_extract(pages):
    trees, out = plain_tree(pages), []
    for url, html in pages:
        low, high = trees[host_of(url)]

        def select(spared, low):
            blocks = H.blocks_of(html, spared)  # noqa: B023
            branches = [x for said, x in blocks if said is None and x.tag in ("article", "main") and not x.drop]
            texts = []
            for said, where in blocks:
                if said is None or where[-1].drop:
                    continue
                if any(n.path in low and not (n.main and n.tag in H.FLOW) for n in where):
                    continue
                main = where[-1].main
                texts.append((said, main, where[-1].path in high, where[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p") and not any(t[1] for t in texts) and not main))  # noqa: B023
            within, beside = (sum(len(t[0]) for t in texts if t[1] == main and (main or t[2])) for main in (True, False))
            return "\n\n".join(t[0] for t in texts if not branches or t[1] or t[2] and (t[3] or beside > within))

        out.append(select(1, low) or select(1, set()) or select(2, set()))
    return out


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def made_site(n=14, seed=3):
    """Pages of one host without a telling class name: a box in each article, a strip above and one below are the same on all
    pages; a lead above the article is each page's own, and so is a note below it, which is more than the rest on odd pages."""
    rng, pages = random.Random(seed), []
    for i in range(n):
        lead, body, more, note = f"Lead {i} {sentence(rng)}", f"Body {i} {sentence(rng)}", f"More {i} {sentence(rng)}", f"Note {i} {sentence(rng, 90 if i % 2 else 4)}"
        html = f"<html><body><div class=qone>Follow the daily bulletin</div><p>{lead}</p><article><h1>Title {i}</h1><p>{body}</p><div class=qthree>Read all that we offer</div><p>{more}</p></article>"
        html += f"<div class=qfour>{note}</div><div class=qfive>All rights kept</div></body></html>"
        pages.append((f"http://made.example/{i}", html, f"{lead}\n\nTitle {i}\n\n{body}\n\n{more}" + f"\n\n{note}" * (i % 2)))
    return pages


def test_the_tree_decides_on_a_site_without_telling_names(spark):
    made = made_site()
    out = {r.url: r.text for r in H.extract_main_text(spark.createDataFrame([(u, h) for u, h, _ in made], "url string, html string")).collect()}
    assert out == {u: want for u, _, want in made}
    assert all("Read all that we offer" in H.page_text(h) and "Note" not in H.page_text(h) for _, h, _ in made)  # without the tree


def test_like_a_plain_tree(spark, sf_dir):
    given = [(r.url, r.html) for r in table(spark, sf_dir, "pages").collect()]
    some = [(u, h) for u, h, _ in made_site(9, 5)] + [(u.replace("made", "few"), h) for u, h, _ in made_site(4, 6)]
    pages = [*given, *some, (None, "<p>no url</p>"), ("http://x.example/", None), ("http://x.example/", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id int, url string, html string")
    found = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    assert [found[i] for i in range(len(pages))] == plain_extract(pages)


def test_joined_verdicts_like_broadcast_ones(spark, monkeypatch):
    made = made_site(9, 8)
    df = spark.createDataFrame([(u, h) for u, h, _ in made], "url string, html string")
    monkeypatch.setattr(H, "BROADCAST_NODES", 0)
    assert {r.url: r.text for r in H.extract_main_text(df).collect()} == {u: want for u, _, want in made}


@pytest.mark.parametrize("html, text", [
    ('<div class="widget"><article><p>One</p></article></div>', "One"),
    ('<main class="related"><p>Two</p></main>', "Two"),
    ('<div id="page" class="site banner"><main><p>Three</p></main></div>', "Three"),
    ("<form action=x><main>Four</main></form>", "Four"),
    ('<div role="banner"><main>Five</main></div>', "Five"),
    ("<article>a <math><mi>x</mi><annotation>tex</annotation></math> b<xmp><b>&amp;</b></xmp><svg><title>t</title><text x=1>lab</text></svg> c</article>", "a x b\n\n<b>&amp;</b>\n\nlab c"),
    ("<div class=content>text</div><div class=comments><article class=comment>bad</article></div>", "text"),
    ("<main><article>x</article><div class=comments><article>bad</article></div></main>", "x"),
    ("<aside><article>teaser</article></aside><div>y</div>", "y"),
    ("<nav>only a menu</nav>", ""),
])
def test_no_name_empties_a_page(html, text):
    assert H.page_text(html) == text


def test_text_beside_a_teaser(spark):
    """The text stands in a plain box, and one teaser is an article: the tree sees that the box differs from page to page."""
    rng = random.Random(2)
    made = [(f"http://t.example/{i}", f"<div class=content><p>Story {i} {sentence(rng)}</p></div><article>Teaser {i}</article>") for i in range(10)]
    out = H.extract_main_text(spark.createDataFrame(made, "url string, html string")).collect()
    assert all(r.text.startswith("Story ") for r in out)
