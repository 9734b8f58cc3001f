import html
import random
import re
from itertools import product

import pytest

from spanforge.llm.main_text import Page, extracted, links_of, main_text, minimum_cut

LONG = "The council met on Tuesday to discuss the bridge, which has been closed since the flood in spring, and voted to repair it."
MORE = "Engineers said that the work would take a year, and that the old stones, once washed and numbered, could be laid again."
SHORT = "It rained."


def cost(odds, edges, label):
    return sum(max(0, o) if not x else max(0, -o) for o, x in zip(odds, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_minimal(seed):
    draw = random.Random(seed)
    n = draw.randint(1, 10)
    odds = [draw.randint(-60, 60) for _ in range(n)]
    edges = [(draw.randrange(n), draw.randrange(n), draw.randint(0, 50)) for _ in range(draw.randint(0, 20))]
    edges = [e for e in edges if e[0] != e[1]]
    every = [(cost(odds, edges, x), sum(x), x) for x in product([False, True], repeat=n)]
    best = min(every)
    found = minimum_cut(odds, edges)
    assert (cost(odds, edges, found), sum(found)) == best[:2]


def test_long_chains_are_cut():
    n = 20_000
    draw = random.Random(1)
    odds = [draw.randint(-90, 90) for _ in range(n)]
    found = minimum_cut(odds, [(i, i + 1, 60) for i in range(n - 1)])
    # the best labelling of a chain, left to right
    bad, good = 0, 0
    for o in odds:
        bad, good = min(bad, good + 60) + max(0, o), min(good, bad + 60) + max(0, -o)
    assert cost(odds, [(i, i + 1, 60) for i in range(n - 1)], found) == min(bad, good)


PAGES = {
    "plain article": (f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Bridge</h1><p>{LONG}<p>{MORE}</article><footer>&copy; 2020 Town</footer>", f"Bridge\n{LONG}\n{MORE}"),
    "no article element": (f"<body><div id=header><a href=/>Town news</a></div><div id='sidebar'><p>{MORE}</p></div><div class='post-content'><h1>Bridge</h1><div>{LONG}</div><div>{SHORT}</div><div>{MORE}</div></div><div class=footer>All rights reserved. {MORE}</div>", f"Bridge\n{LONG}\n{SHORT}\n{MORE}"),
    "things inside": (
        f"<main><article><p>{LONG}</p><div class='ad-slot'>{MORE} Buy now.</div><form><p>{MORE}</p><input><button>Send</button></form><aside>{MORE}</aside><p>{SHORT}</p><p>{MORE}</p>"
        f"<section id='comments'><h2>2 comments</h2><article class=comment><p>{LONG} I agree.</p></article></section></article></main>",
        f"{LONG}\n{SHORT}\n{MORE}",
    ),
    "notices": (f"<div class='cookie-notice' role='dialog'><p>{MORE}</p></div><div role=main><p>{LONG}</p></div><div style='display: none'>{MORE}</div>", LONG),
    "scripts and comments": (f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p{{}}</style><!-- <p>{MORE}</p> --><article><p>{LONG}</p><noscript><p>x</p></noscript></article>", LONG),
    "references and space": (f"<article><p>Fish &amp; chips&nbsp;cost\n\t &pound;5 &lt;today&gt; &#8212; caf&eacute; &amp;amp; all, said the <b>cook</b>ing<br>school &am", "Fish & chips cost £5 <today> — café &amp; all, said the cooking school &am"),
    "lists and tables": (f"<article><p>{LONG}</p><ul><li>{MORE}<li>{MORE}</ul><table><tr><td>{LONG}<td>{MORE}</table><p>{MORE}</p></article>", "\n".join([LONG, MORE, MORE, LONG, MORE, MORE])),
    "inline advert": (f"<article><p>{LONG} <span class='ad'>Buy <span>this</span> now</span></p><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
    "headers": (f"<header><p>{MORE}</p></header><div id='header'><p>{MORE}</p></div><main><header><h1>Bridge</h1></header><p>{LONG}</p></main>", f"Bridge\n{LONG}"),
    "inserted advert": (f"<article><p>{LONG}</p><ins class='adsbygoogle'>{MORE}</ins><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
    "reader comments": (f"<main><article><h1>T</h1><p>{LONG}</p></article><section class='comments'><h3>Comments</h3><div class='comment'><p>{MORE}</p></div></section></main>", f"T\n{LONG}"),
    "only boilerplate": ("<nav><a href=/>Home</a><a href=/a>About</a></nav><footer>&copy; Town</footer>", ""),
    "no markup": (f"{LONG} {MORE}", f"{LONG} {MORE}"),
    "broken off": (f"<body><article><p>{LONG}</p><p>{MORE}</p></article><footer><a href='x", f"{LONG}\n{MORE}"),
    "odd marks": (f"<article><p>{LONG} 1 < 2 <3</p><p title=\"a > b\">{MORE}</p></article>", f"{LONG} 1 < 2 <3\n{MORE}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_made_pages(name):
    source, text = PAGES[name]
    assert main_text(source) == text


def article(source):
    """The article element of the tables' pages, block by block."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?p>|</?h1>", inner))
    return "\n".join(b for b in blocks if b)


def test_equals_the_article_of_each_page(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    expected = {r["page_id"]: (r["url"], article(r["html"])) for r in pages.collect()}
    found = {r["page_id"]: (r["url"], r["text"]) for r in extracted(pages).collect()}
    assert found == expected


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "y"), (None, "u", f"<article><p>{LONG}", "z"), (2, "u", f"<article>{'<p>' + MORE}" * 5000, ""), (2, "u", "<" * 50_000, ""), (3, "v", "<div>" * 20_000 + LONG, "")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extracted(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(out.collect(), key=str)
    assert len(found) == 12 and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r["text"] for r in found if r["page_id"] in (None, 1)}
    assert by_id == {None: LONG, 1: ""}
    assert extracted(df.limit(0)).collect() == []


def test_edges_follow_the_tree():
    page = Page(f"<div><p>{LONG}</p><p>{MORE}</p></div><div><p>{LONG}</p></div>")
    odds, edges = links_of(page)
    assert len(page.texts) == 3 and len(odds) == 3 + 5
    assert len([e for e in edges if e[0] < 3 and e[1] < 3]) == 2
