"""Main text: names decide at any number of pages, the tree against a plain computation, deep pages, clashing names."""

import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest

from vitrine.llm import html_tree
from vitrine.llm.html_tree import extract_main_text, main_text, page_features, style_tree


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def page(i, inside):
    extra = (
        f"<div class=comments><p>user{i} says something of his own, at length, about page {i}</p></div>"
        f"<section id=related-posts><ul><li><a href=/x>Another story {i}</a></li></ul></section>"
    )
    return (
        f"<body><div class=sidebar><ul><li>Latest {i}</li></ul></div><article><h1>Title {i}</h1><p>Body {i} and its text</p>"
        f"{extra if inside else ''}</article>{'' if inside else extra}</body>"
    )


@pytest.mark.parametrize("inside", [True, False])
def test_names_decide_at_any_number_of_pages(spark, inside):
    rows = [
        (n * 1000 + i, f"http://h{n}.example/{i}", page(i, inside)) for n in (1, 7, 10, 100) for i in range(n)
    ]
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame(spark, rows)).collect()}
    assert all(got[p] == f"Title {p % 1000}\n\nBody {p % 1000} and its text" for p, _, _ in rows)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><div class='post share-buttons-on'><p>All of the text is here</p></div><p>End</p></article>", "All of the text is here\n\nEnd"),
        ("<article><p>Short</p><div class=comments><p>A comment that is much longer than the text</p></div></article>", "Short"),
        ("<article><p>The story</p><div class=related><a href=x>A very long headline of some other story</a></div></article>", "The story"),
        ("<div class='page with-sidebar'><p>The whole text of the page</p></div><div class=sidebar><p>Side</p></div>", "The whole text of the page"),
        ("<div class=text><p>Text</p></div><div class=comments><p>A comment longer than the text is</p></div>", "Text"),
    ],
)
def test_a_name_is_overruled_only_where_it_holds_most_of_the_plain_text(html, want):
    assert main_text(f"<html><body>{html}</body></html>") == want


def test_tree_against_a_plain_computation(spark):
    rnd = random.Random(12)
    pages = []
    for i in range(20):
        items = "".join(f"<li>{rnd.choice(['a', 'b', f'item {i}'])}</li>" for _ in range(rnd.randint(1, 3)))
        pages.append(
            f"<body><div class=top><p>Welcome</p><p>{rnd.choice(['x', 'y'])}</p></div><div id=main{i}><h1>T{i}</h1>"
            f"<div><section><p>Story {rnd.randint(0, 12)}</p></section></div></div><ul>{items}</ul></body>"
        )
    nodes, texts, children = defaultdict(Counter), defaultdict(Counter), {}
    for html in pages:
        for path, kind, n, _, feature in page_features(html):
            if kind == 0:
                nodes[path][feature] += 1
                children[path] = max(children.get(path, 0), n)
            else:
                texts[path][feature] += 1
    want = {}
    for path, found in nodes.items():
        m = sum(found.values())
        own = -sum(n / m * math.log(n / m) for n in found.values()) / math.log(m) if m > 1 else 1.0
        if texts[path]:
            logs = [math.log(n) for n in texts[path].values()]
            content = 1 - sum(logs) / len(logs) / math.log(m) if m > 1 else 1.0
            weight = html_tree.DAMPING ** children[path]
            own = (1 - weight) * own + weight * content
        want[path] = (m, own)
    rows = [(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)]
    got = {r["path"]: (r["pages"], r["importance"]) for r in style_tree(frame(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for path, (m, importance) in want.items():
        assert got[path][0] == m and math.isclose(got[path][1], importance, abs_tol=1e-9)


def test_deep_pages_cost_what_their_length_costs():
    html = "".join(f"<div>text {i}" for i in range(10_000))
    tracemalloc.start()
    began = time.perf_counter()
    features = page_features(html)
    text = main_text(html)
    seconds, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(features) <= 10_001 + 10_000 * (html_tree.ABOVE + 1)
    assert peak < 100_000_000 and seconds < 20
    assert text.split("\n\n")[::5000] == ["text 0", "text 5000"]


def test_columns_of_any_name_survive(spark):
    names = ["_h", "_host", "_low", "_common", "__h", "path", "host", "low", "text"]
    rows = [(1, "http://h.example/1", page(1, True), *names)]
    schema = "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names)
    row = extract_main_text(spark.createDataFrame(rows, schema)).first()
    assert all(row[n] == n for n in names if n != "text") and row["text"].startswith("Title 1")
