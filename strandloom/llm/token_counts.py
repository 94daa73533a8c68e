"""Token counts by a finite-state tokenizer.

The byte-pair encoding of a word, read byte by byte, is a finite-state transducer: after each
prefix exactly one token can end the prefix's encoding (a token is valid after another when the
two encode to themselves together), and what later bytes need to know reaches back no further
than the longest suffix that still is a prefix of some token. A state holds that suffix, the last
token at each of its positions and the counts relative to the present; a transition reads a byte
and emits by how much the count of tokens changes. States are compiled as texts first need them,
and whole words become single transitions of the outer transducer.

A text is read in blocks cut anywhere. A block's state map is constant from its first white space
on (there every state becomes the start state), so it has a short form: the bytes before, the
tokens emitted between, the bytes after the last white space. Maps compose associatively; a
parallel prefix scan over the blocks gives the document's count.

Defined results: null and empty texts have 0 bytes and 0 tokens; white space alone has 0 tokens.
Characters beyond Latin take the library's normaliser and pre-tokenizer before the transducer;
special strings inside a text take the library itself, as its default says.

Scale: one map, no shuffle; state tables and remembered words are bounded per worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import END, CompiledBpe, byte_alphabet, compiled, public_path
from .common import id_text, small_batches, text_bytes

BLOCK = 1 << 12
#: Words longer than this are counted anew each time, so that what is remembered is bounded in bytes too.
LONG_WORD = 64
LIMIT = 2048


class BpeTransducer:
    """Counts the tokens of one pre-token (bytes, with the end mark where the model has one)."""

    def __init__(self, bpe: CompiledBpe, most_states: int = 400_000):
        self.bpe, self.most_states = bpe, most_states
        self.tokens = bpe.ranks
        self.prefixes = {t[:k] for t in bpe.ranks for k in range(1, len(t))}
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: State: (suffix, last token at each of its positions, counts there less the present one).
        self.states: list[tuple[bytes, tuple[bytes | None, ...], tuple[int, ...]]] = [(b"", (None,), (0,))]
        self.number = {self.states[0]: 0}
        #: Of each state: byte -> (next state, tokens emitted).
        self.edges: list[dict[int, tuple[int, int]]] = [{}]

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` may stand after ``last``: together they encode to just these two."""
        if last is None:
            return True
        known = self.valid.get((last, token))
        if known is None:
            if len(self.valid) >= 1_000_000:
                self.valid.clear()
            known = self.bpe.piece_ranks(last + token) == [self.tokens[last], self.tokens[token]]
            self.valid[last, token] = known
        return known

    def compile_edge(self, state: int, byte: int) -> tuple[int, int]:
        suffix, lasts, counts = self.states[state]
        grown = suffix + bytes([byte])
        for k, last in enumerate(lasts):
            token = grown[k:]
            if token in self.tokens and self.follows(last, token):
                emitted = counts[k] + 1
                break
        else:
            raise ValueError(f"no token ends {grown!r}")
        keep = next((k for k in range(len(grown)) if grown[k:] in self.prefixes), len(grown))
        new = (grown[keep:], (*lasts[keep:], token), (*(c - emitted for c in counts[keep:]), 0))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
            self.edges.append({})
        self.edges[state][byte] = (at, emitted)
        return at, emitted

    def count(self, word: bytes) -> int:
        if len(self.states) >= self.most_states:
            self._reset()
        edges, state, total = self.edges, 0, 0
        for byte in word:
            step = edges[state].get(byte)
            if step is None:
                step = self.compile_edge(state, byte)
            state, emitted = step
            total += emitted
        return total


@dataclass(frozen=True)
class StateMap:
    """A block's state map: bytes up to its first white space, tokens emitted, bytes after its last one."""

    head: bytes
    tokens: int
    tail: bytes | None  # None: no white space, all is in head


class TokenCounter:
    """The outer transducer: words by white space, pre-tokens inside words, bytes inside pre-tokens."""

    def __init__(self, bpe: CompiledBpe, remembered: int = 1_000_000):
        if not bpe.word_like:
            raise ValueError("white space must separate words in this model")
        self.bpe, self.inner = bpe, BpeTransducer(bpe)
        self.alphabet = byte_alphabet()
        self.remembered = remembered
        self.words: dict[bytes, int] = {b"": 0}

    def word(self, word: bytes) -> int:
        """Tokens of a text without ASCII white space."""
        known = self.words.get(word)
        if known is None:
            known = self._word(word.decode())
            if len(word) <= LONG_WORD:
                if len(self.words) >= self.remembered:
                    self.words.clear()
                    self.words[b""] = 0
                self.words[word] = known
        return known

    def _word(self, text: str) -> int:
        bpe, mark = self.bpe, END if self.bpe.suffix else b""
        if bpe.ordinary(text):
            return sum(self.inner.count(p + mark) for p in bpe.pre_tokens(text))
        if any(s in text for s in bpe.special):
            return len(bpe.library.encode(text, add_special_tokens=False).ids)
        pieces = bpe.library.pre_tokenizer.pre_tokenize_str(bpe.library.normalizer.normalize_str(text))
        return sum(self.inner.count(bytes(map(self.alphabet.__getitem__, p)) + mark) for p, _ in pieces)

    def state_map(self, block: bytes) -> StateMap:
        words = block.split()
        if not words or len(words) == 1 and len(words[0]) == len(block):
            return StateMap(block, 0, None) if words or not block else StateMap(b"", 0, b"")
        head = words.pop(0) if not block[:1].isspace() else b""
        tail = words.pop() if words and not block[-1:].isspace() else b""
        return StateMap(head, self.emitted(words), tail)

    def emitted(self, words: list[bytes]) -> int:
        try:
            return sum(map(self.words.__getitem__, words))
        except KeyError:
            return sum(map(self.word, words))

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``; associative."""
        if a.tail is None:
            return StateMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.tokens, a.tail + b.head)
        return StateMap(a.head, a.tokens + self.word(a.tail + b.head) + b.tokens, b.tail)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefix scan by doubling; each round's compositions are independent."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps = maps[:step] + [self.compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def total(self, maps: list[StateMap]) -> StateMap:
        """The last element of the scan alone: a balanced tree of compositions."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: bytes, block: int = BLOCK) -> int:
        """Tokens of a text of any length: the maps of its blocks, composed by the scan, from the start state to the end."""
        whole = self.total([self.state_map(text[i : i + block]) for i in range(0, max(1, len(text)), block)])
        return whole.tokens + self.word(whole.head) + (self.word(whole.tail) if whole.tail else 0)


@lru_cache(maxsize=2)
def counter(path: str, dropped: frozenset[bytes] | None = None) -> TokenCounter:
    return TokenCounter(compiled(path, dropped))


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. ``tokenizer``: name of a public vocabulary file."""
    small_batches(docs.sparkSession)
    dropped = compiled(public_path(tokenizer)).dropped

    def run(batches):
        counts = counter(public_path(tokenizer), dropped)
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            tokens = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
