import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import packing, token_counts, token_files
from strandloom.llm.bpe import CompiledBpe, compiled, public_path

ODD = ["", " ", "a", "  b", "a  b\n\n c ", "don't I'll  YOU'RE\tx", "x<|endoftext|>y <|startoftext|>", "é İstanbul ǅ ß ſ", "日本語 テスト　x", "a\xa0 b", "a\x1c b\x1d", "emoji 👍🏽 ok", "1234 ٣٤ ½", "Σίσυφος", "\r\n a\r\nb", "x" * 300, "word " * 5 + " ", "\n\n\n", "a \n b", "<|x|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_compiled_ids_equal_the_library(name):
    bpe = compiled(public_path(name))
    rng = random.Random(5)
    alphabet = "ab eEtT'.s,\n\t é́ß1 2  -<|>\xa0\x1c日"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(bpe.encode(text.encode()), dtype=bpe.dtype).tolist() == bpe.library.encode(text, add_special_tokens=False).ids, text


def test_memory_of_pieces_is_bounded():
    bpe = CompiledBpe(public_path("word_bpe_49k.json"), frozenset(), remembered=5)
    for text in ("one two three four five six", "seven eight nine", "one two"):
        assert np.frombuffer(bpe.encode(text.encode()), dtype=bpe.dtype).tolist() == bpe.library.encode(text, add_special_tokens=False).ids
    assert len(bpe.word.__self__) <= 5


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_counts_equal_the_library_for_any_cut(text, block):
    counter = token_counts.counter(public_path("word_bpe_49k.json"))
    text = text.encode("utf-8", "ignore").decode()
    want = len(counter.bpe.library.encode(text, add_special_tokens=False).ids)
    assert counter.count(text.encode()) == want
    assert counter.count(text.encode(), block) == want


def test_scan_gives_all_prefixes():
    counter = token_counts.counter(public_path("word_bpe_49k.json"))
    text = b"the quick  brown fox\njumps over it"
    maps = [counter.state_map(text[i : i + 4]) for i in range(0, len(text), 4)]
    for k, m in enumerate(counter.scan(maps)):
        whole = m.tokens + counter.word(m.head) + (counter.word(m.tail) if m.tail else 0)
        assert whole == counter.count(text[: 4 * (k + 1)])


def test_count_query_shape_and_edge_cases(docs):
    found = token_counts.count_tokens(docs([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")]), "word_bpe_49k.json", limit=1)
    rows = sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, True), (3, 3, 2, True), (None, 1, 1, False)]
    assert token_counts.count_tokens(docs([]), "word_bpe_49k.json").count() == 0


def test_token_files_round_trip(docs, tmp_path):
    texts = {5: "hello world", 2: None, 9: "a" * 5000, 1: "", 7: "x y z " * 900}
    frame = token_files.write_corpus(docs(list(texts.items())), "word_bpe_49k.json", f"file://{tmp_path}/c", length=16, batch=4)
    library = compiled(public_path("word_bpe_49k.json")).library
    at = 0
    for row in sorted(token_files.read_documents(frame).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sequence_file_is_a_view(tmp_path):
    path = tmp_path / "x.arrow"
    with open(path, "wb") as sink:
        writer = token_files.SequenceWriter(sink, np.uint16, length=8, batch=2)
        for k in (5, 20, 9):
            writer.add(np.arange(k, dtype=np.uint16).tobytes())
        writer.close()
    import pyarrow as pa

    with pa.memory_map(str(path)) as source:
        file = token_files.SequenceFile(source)
        want = [*range(5), *range(20), *range(9)]
        assert np.concatenate(file.tokens(0, 34)).tolist() == want
        assert not file.sequence(1).flags.owndata
        assert file.sequence(2).tolist() == want[16:24]
        assert file.mask(4).to_pylist() == [True, True] + [False] * 6


def test_packing_covers_every_token_once_without_padding(docs):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["red", "green", "blue", "apple", f"w{i % 7}"]) for _ in range(rng.choice([0, 1, 40, 300]))) for i in range(60)} | {60: None}
    rows = packing.pack(docs(list(texts.items())), "byte_bpe_50k.json", window=64, shard_tokens=1500).collect()
    library = compiled(public_path("byte_bpe_50k.json")).library
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) for r in mine)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total == 64 or total & (total - 1) == 0 and total < 64


def test_neighbours_are_those_of_bm25():
    ids = [np.array(x, dtype=np.uint16) for x in ([1, 2, 3, 4], [9, 9, 9], [1, 2, 7], [3, 4, 1, 2], [8])]
    frequency = np.zeros(10, dtype=np.int64)
    for x in ids:
        frequency[np.unique(x)] += 1
    index = packing.ShardIndex(ids, frequency, 5, 3.0)
    index.used[0] = True
    assert index.neighbours(0) == [3, 2]
    index.used[3] = True
    assert index.neighbours(0) == [2]
    assert sorted(packing.packing_order(packing.ShardIndex(ids, frequency, 5, 3.0), [len(x) for x in ids], 8)) == [0, 1, 2, 3, 4]
    assert packing.packing_order(packing.ShardIndex(ids, frequency, 5, 3.0), [len(x) for x in ids], 8)[:2] == [0, 3]


def test_packing_an_empty_table(docs):
    assert packing.pack(docs([]), "byte_bpe_50k.json").count() == 0


def test_bm25_over_all_terms_equals_brute_force():
    rng = np.random.default_rng(4)
    ids = [rng.zipf(1.5, rng.integers(1, 60)).clip(0, 79).astype(np.uint16) for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=80)
    mean = float(np.mean([len(x) for x in ids]))
    index = packing.ShardIndex(ids, df, len(ids), mean, query_terms=None)
    for seed in range(len(ids)):
        index.used[:] = False
        index.used[seed] = True
        score = {}
        for d, own in enumerate(ids):
            for t in set(ids[seed].tolist()) & set(own.tolist()):
                tf = int((own == t).sum())
                weight = math.log(1 + (len(ids) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
                score[d] = score.get(d, 0.0) + weight
        score.pop(seed, None)
        found = index.neighbours(seed, 5)
        want = sorted(score, key=lambda d: -score[d])[:5]
        assert len(found) == len(want)
        assert np.allclose([score[d] for d in found], [score[d] for d in want], rtol=1e-4)


def test_packing_puts_like_documents_together_and_spreads_repeated_rows(docs):
    rng = random.Random(3)
    topics = [[f"{t}{w}{t}" for w in "abcdefghijkl"] for t in ("qua", "zor", "vex", "mib", "lud", "hop", "jaz", "kri")]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(30))) for i in range(160)]
    found = packing.pack(docs(rows), "byte_bpe_50k.json", window=256, shard_tokens=4000).collect()
    windows = {}
    for r in found:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert np.mean([len(w) for w in windows.values()]) < 1.6
    same = [(None, "one and the same text")] * 300
    encoded = packing.staged(packing.encode_with_statistics(docs(same), "byte_bpe_50k.json", id_col="doc_id", text_col="text", end_id=1), "t").where("df IS NULL")
    shards = packing.dealt(encoded, 1800, 100).groupBy("bucket", "piece", "part").count().collect()
    assert len(shards) > 5 and max(r["count"] for r in shards) < 100


def test_texts_of_every_length_go_through_maps_and_scan(monkeypatch):
    counter = token_counts.TokenCounter(compiled(public_path("word_bpe_49k.json")))
    made, composed = [], []
    state_map, compose = token_counts.TokenCounter.state_map, token_counts.TokenCounter.compose
    monkeypatch.setattr(token_counts.TokenCounter, "state_map", lambda self, b: made.append(len(b)) or state_map(self, b))
    monkeypatch.setattr(token_counts.TokenCounter, "compose", lambda self, a, b: composed.append(1) or compose(self, a, b))
    library = counter.bpe.library
    for n in (0, 1, 3, 700, 1500, 40_000):
        text = "Some words, of 3 kinds " * n
        made.clear(), composed.clear()
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids)
        assert sum(made) == len(text) and len(composed) == len(made) - 1 and max(made) <= token_counts.BLOCK


def test_a_word_of_megabytes_is_counted_and_not_remembered():
    counter = token_counts.TokenCounter(compiled(public_path("word_bpe_49k.json")))
    word = "abcxyz" * 20_000
    assert counter.count(word.encode()) == len(counter.bpe.library.encode(word, add_special_tokens=False).ids)
    assert max(map(len, counter.words)) <= token_counts.LONG_WORD
