"""Container names that tell what an element has, and silent elements that never end."""

from __future__ import annotations

import random
import time

from subtide.llm import html


def test_names_around_the_article_do_not_silence_it(spark):
    weights = html.train(html.labelled_pages(spark))
    text = "<p>It was a long day and the town had much to say.</p><p>And so it did.</p>"
    want = "It was a long day and the town had much to say.\nAnd so it did."
    for page in (
        f'<body class="has-sidebar">{text}</body>',
        f'<body class="sidebar">{text}</body>',
        f'<body><div class="layout with-sidebar">{text}</div></body>',
        f'<body><article class="post tag-news">{text}</article></body>',
        f'<body><div class="content has-comments">{text}<div class="comments">Nice post of you</div></div></body>',
        f"<body><div><svg><path></div><div>{text}</div></body>",
    ):
        assert html.extract(page, weights) == want, page
    assert html.extract(f'<body><div class="sidebar">Other words here</div><div>{text}</div></body>', weights) == want


def test_a_named_container_around_the_page_does_not_silence_it(spark):
    weights = html.train(html.labelled_pages(spark))
    text = "<article><p>It was a long day and the town had much to say.</p><p>And so it did.</p></article>"
    want = "It was a long day and the town had much to say.\nAnd so it did."
    for name in ("sidebar", "comments", "ad", "related"):
        assert html.extract(f'<body><div class="{name}"><nav>Home</nav>{text}</div><footer>All the rest</footer></body>', weights) == want, name
    assert html.extract(f"<body><form>{text}<input></form></body>", weights) == want
    comments = f'<div class="comments">{"<div><article class=comment><p>What a fine day it was for me too.</p></article></div>" * 9}</div>'
    assert html.extract(f"<body>{text}{comments}</body>", weights) == want


def test_cells_items_and_tags_that_do_not_end(spark):
    weights = html.train(html.labelled_pages(spark))
    page = "<article><table><tr><td>One<td>Two<tr><td>Three</table><ul><li>Four<ul><li>Five</ul><li>Six</ul>a < b and <b c</article>"
    assert html.extract(page, weights) == "One\nTwo\nThree\nFour\nFive\nSix\na < b and <b c"
    assert html.extract('<article><p title="a<b">Seven <math><mi>x</mi></math></p></article>', weights) == "Seven x"
    for part in ("<tr><td>cell words", "<a ", '<a "', "<svg>", "<!", "<!--", "<table><tr><td>", "</p></ul>"):
        n = 500_000 // len(part)
        began = time.perf_counter()
        html.extract("<table>" + part * n, weights)
        assert time.perf_counter() - began < 8, part


def test_region_is_the_best_of_all(spark):
    weights = html.train(html.labelled_pages(spark))
    r = random.Random(3)
    for _ in range(60):
        page = "".join(r.choice(["<nav>", "</nav>", "<p>", "</p>", "<div class=ad>", "<article>", "</article>", "</div>", "one two ", "a b c d e f g ", "<a>x</a>"]) for _ in range(30))
        tokens, nodes = html.runs(page)
        judged = weights.judged(nodes)
        score = list(html.scores(tokens, judged, weights))
        best = max((sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=0.0)
        first, last = html.best_region(tokens, judged, weights)
        assert abs(sum(score[first:last]) - max(best, 0.0)) < 1e-9
