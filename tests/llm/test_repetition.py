import random
import time

import numpy as np
import pytest

from strandloom.llm import repetition


def longest(words):
    """For each place, the longest run of words from there that occurs at another place, by comparing all pairs."""
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def covered(words, least):
    return len({p for i, k in enumerate(longest(words)) if k >= least for p in range(i, i + k)})


def judged(text, min_words=4, percent=30, most=40):
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.encode().split()]
    repeat, failed = covered(words, 5), len(words) < 10 or 100 * covered(words, 5) > 20 * len(words)
    kept = not failed and 100 * covered(words, min_words) <= percent * len(words) and max(longest(words), default=0) <= most
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, failed, kept, covered(words, min_words), max(longest(words), default=0)


def made(rng, n, kinds):
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.5:
        at, size = rng.randrange(n - 15), rng.randrange(3, 15)
        words[rng.randrange(n) : 0] = words[at : at + size]
    return "".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b "]) for w in words)


@pytest.mark.parametrize("block", [10, 200_000])
def test_judgement_equals_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(repetition, "BLOCK_WORDS", block)
    rng = random.Random(5)
    texts = [None, "", " \n ", "one", "a a a a a a a a a a a a", "é ü # $ %\nx\nx\nx y", "same line\nsame line\nsame line ", "W w W w A b"]
    texts += [made(rng, rng.choice([5, 12, 40, 90]), rng.choice([2, 5, 400])) for _ in range(40)]
    texts += [" ".join(f"u{i}" for i in range(60)) * 2, " ".join(map(str, [*range(300), *range(41), *range(300, 400)])), " ".join(map(str, [*range(300), *range(40), *range(400, 500)]))]
    rows = repetition.judge(docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:10] == judged(texts[r.doc_id]), texts[r.doc_id]


def test_spans_are_the_maximal_repeats(docs):
    text = "x a b c d e y a b c d e z a b c d q"
    (row,) = repetition.judge(docs([(1, text)])).collect()
    # "a b c d" at the last place is maximal there, as the deeper intervals end before it
    assert row.spans == [[1, 5], [7, 5], [13, 4]]


def test_ranks_sort_suffixes_within_documents():
    words, ends = np.array([2, 1, 2, 1, 2, 5, 5, 5]), np.array([5] * 5 + [8] * 3)
    rank = repetition.suffix_ranks(words, ends)[-1]
    suffixes = [(words[i : ends[i]].tolist(), i) for i in range(8)]
    assert [i for _, i in sorted(suffixes)] == np.argsort(rank).tolist()


def test_repeated_rows_null_ids_and_empty_tables(docs):
    text = " ".join(map(str, range(30)))
    rows = repetition.repetition_digest(docs([(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in rows) == [("1", 30, True), ("1", 30, True), ("2", 0, False), ("None", 30, True)]
    assert repetition.repetition_digest(docs([])).count() == 0


def test_a_text_of_megabytes_that_repeats_throughout(docs):
    began = time.monotonic()
    rows = repetition.judge(docs([(1, "a " * 1_000_000), (2, "ab cd\n" * 300_000)])).drop("spans").collect()
    assert sorted((r.doc_id, r.n_words, r.n_repeat_words, r.longest_repeat, r.kept) for r in rows) == [(1, 1_000_000, 1_000_000, 999_999, False), (2, 600_000, 600_000, 599_998, False)]
    assert time.monotonic() - began < 60
