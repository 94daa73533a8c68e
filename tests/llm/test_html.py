import random
import time
from collections import Counter
from pathlib import Path

import pytest

from strandloom.llm import html_text

PAGES = Path("/root/testdata/sf0.001/pages.parquet")


@pytest.mark.parametrize("seed", range(40))
def test_region_is_the_maximum_over_all_regions(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 12)
    costs, gains = [-rng.choice([0, 1, 2, 5]) for _ in range(n)], [rng.choice([-4, -1, 0, 1, 3, 6]) for _ in range(n)]
    score = lambda a, b: sum(gains[a:b]) + sum(costs[a + 1 : b])  # noqa: E731  what lies before the first word is outside
    best = max((score(a, b) for a in range(n) for b in range(a + 1, n + 1)), default=0)
    a, b = html_text.best_region(costs, gains)
    assert (score(a, b) if b else 0) == max(best, 0) and (b > a or best <= 0)


@pytest.mark.parametrize("unit", ["<a ", "<b>x ", '<a b=">" ', "</i>", "<b></i>", "<i><div><b></i>", "<!-- ", "<script>", "<p>x", "<!x ", "<a \"'>"])
def test_broken_pages_take_time_in_proportion(unit):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html_text.main_text("<i><div>" + unit * n, html_text.Weights())
        took.append(time.perf_counter() - began)
    assert took[1] < 10 and took[1] < 10 * took[0] + 0.5


def test_tags_that_never_end_and_quotes_that_never_close():
    assert html_text.main_text("<p>one two three <a href='x", html_text.Weights()) == "one two three <a href='x"
    assert html_text.main_text("<p>one two three <a href='x>four</a> five six", html_text.Weights()) == "one two three four five six"
    assert html_text.main_text('<p title="a > b">one two <!-- no --> three<script src=x>no</script> four', html_text.Weights()) == "one two three four"


@pytest.mark.skipif(not PAGES.exists(), reason="test tables are absent")
def test_regions_without_marks_are_those_with_marks():
    import pandas as pd

    pages = [p for p in pd.read_parquet(PAGES).html if p]
    train, rest = pages[::2], pages[1::2]
    inside, outside = Counter(), Counter()
    for page in train:
        a, b = html_text.features(page)
        inside.update(a)
        outside.update(b)
    weights = html_text.Weights(inside, outside)
    marked = [p for p in rest if any(b.content for b in html_text.read_blocks(p))]
    for page in marked:
        article = "\n".join(b.text for b in html_text.read_blocks(page) if b.content and not b.skipped)
        assert html_text.main_text(page, weights) == article
    agree = sum(html_text.main_text(p, weights, hide=True) == html_text.main_text(p, weights) for p in marked)
    assert agree >= 0.97 * len(marked) > 0


def test_empty_table_repeated_rows_and_clashing_names(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, _html int, feature string"
    empty = spark.createDataFrame([], schema)
    assert html_text.extract(empty, html_text.learn_weights(empty)).count() == 0
    rows = [(1, "u", "<p>some words here</p>", "x", 1, 2, "f")] * 2 + [(None, None, "<main>a b c</main>", None, None, None, None), (3, "v", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    found = html_text.extract(frame, html_text.learn_weights(frame)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found) == [("1", "some words here", 15), ("1", "some words here", 15), ("3", "", 0), ("None", "a b c", 5)]
