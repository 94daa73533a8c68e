"""Byte-pair encoding with the library's results at a multiple of its speed.

The library file is compiled into a rank table for the byte-level core of tiktoken. A merge list
and a rank table agree exactly when every token that can arise is also what its own text encodes
to; the compiler drops the tokens for which that fails (such a token never arises), so the two
give the same ids. The end-of-word mark, where a model has one, is the byte 0xFF, which UTF-8
never holds.

A text is cut where the pre-tokenizer cuts in any case; the ids of the pieces are remembered.
Anything out of the ordinary (characters beyond Latin, unusual white space, special strings) goes
to the library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

END = b"\xff"
#: Printable ASCII and Latin letters whose case and normal form are plain.
_ORDINARY = re.compile("[\\x21-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017f]*")
#: White space that the line-and-word cut does not know: runs, controls, and characters beyond ASCII.
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n")
_CONTROLS = bytes([*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20)])
_UNEVEN = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_TAIL = b".,;:!?|"
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def merge_encode(symbols: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte-pair encoding from the definition: the leftmost pair of least rank merges, again and again."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (ranks.get((symbols[i], symbols[i + 1]), 1 << 60), i))
        if (symbols[best], symbols[best + 1]) not in ranks:
            break
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


def uneven(text: bytes) -> bool:
    """Whether a text has white space other than single spaces and line ends between words."""
    if any(run in text for run in _RUNS) or len(text.translate(None, _CONTROLS)) < len(text):
        return True
    return not text.isascii() and _UNEVEN.search(text) is not None


class Chunks(dict):
    """Chunk of text -> its packed ids, worked out when missing and remembered within a bound.

    The bound counts entries; chunks above ``LONG`` bytes are not remembered, so it bounds bytes too.
    """

    LONG = 64

    def __init__(self, work_out, bound: int):
        super().__init__()
        self.work_out, self.bound = work_out, bound

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.work_out(chunk)
        if len(chunk) <= self.LONG:
            if len(self) >= self.bound:
                self.clear()
            self[chunk] = found
        return found


class CompiledBpe:
    """One tokenizer file; ``encode`` gives the library's ids (no special tokens added) as packed integers."""

    def __init__(self, path: str, dropped: frozenset[bytes] | None = None, remembered: int = 800_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.vocabulary_size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.dtype = np.dtype("<u2") if self.vocabulary_size <= 1 << 16 else np.dtype("<u4")

        def raw(token: str) -> bytes:
            marked = self.suffix and token.endswith(self.suffix)
            return bytes(alphabet[c] for c in (token[: -len(self.suffix)] if marked else token)) + (END if marked else b"")

        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        #: Rank of a token: bytes, then marked bytes, then merges in order; tokens that never arise have none.
        ranks = {bytes([b]): b for b in range(256)}
        if self.suffix:
            ranks |= {bytes([b]) + END: 256 + b for b in range(255)}
        first = len(ranks)
        #: Tokens that never arise; worked out here unless the caller knows them.
        self.dropped = self._never_arising() if dropped is None else dropped
        ranks |= {a + b: first + 1 + k for (a, b), k in self.merges.items() if a + b not in self.dropped}
        self.ranks = ranks
        self._core = tiktoken.Encoding("compiled", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._encode = self._core.encode_single_piece
        self._packed = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            if token in self.ids:
                self._packed[rank] = np.array(self.ids[token], dtype=self.dtype).tobytes()
        self.special = tuple(special)
        kinds = json.dumps(spec["pre_tokenizer"])
        self.word_like = '"Split"' in kinds
        if self.word_like:
            self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        else:
            self.pattern = regex.compile(_BYTE_LEVEL)
        self.piece = Chunks(self._piece, remembered // 2).__getitem__
        self.word = Chunks(self._chunk, remembered).__getitem__
        self.spaced = Chunks(lambda w: self._chunk(b" " + w), remembered).__getitem__

    def _never_arising(self) -> frozenset[bytes]:
        """The tokens whose own text encodes to something else."""
        found = set()
        for a, b in self.merges:
            token = a + b
            symbols = [bytes([c]) for c in (token.removesuffix(END) if self.suffix else token)]
            if self.suffix and token.endswith(END):
                symbols[-1] += END
            if merge_encode(symbols, self.merges) != [token]:
                found.add(token)
        return frozenset(found)

    def piece_ranks(self, piece: bytes) -> list[int]:
        return self._core.encode_single_piece(piece)

    def _piece(self, piece: bytes) -> bytes:
        """Packed ids of one pre-token (in UTF-8)."""
        ranks = self._encode(piece + END if self.suffix else piece)
        return self._packed[ranks[0]] if len(ranks) == 1 else b"".join(map(self._packed.__getitem__, ranks))

    def ordinary(self, text: str) -> bool:
        """Whether the fast way is right for a text without white space (but a leading space)."""
        return _ORDINARY.fullmatch(text, 1 if text[:1] == " " else 0) is not None and "<|" not in text

    def pre_tokens(self, text: str) -> list[bytes]:
        """Pre-tokens of an ordinary text."""
        return [p.encode() for p in self.pattern.findall(text.lower() if self.word_like else text)]

    def _chunk(self, chunk: bytes) -> bytes:
        """Packed ids of a text without white space but a leading space."""
        core = chunk.rstrip(_TAIL)
        if core.isalpha() or core[:1] == b" " and core[1:].isalpha():  # ASCII letters
            head = self._piece(core.lower() if self.word_like else core)
            return head + self.piece(chunk[len(core) :]) if len(core) < len(chunk) else head
        text, bare = chunk.decode(), core.decode().removeprefix(" ")
        if bare.isalpha() and _ORDINARY.fullmatch(bare):
            head = self._piece((core.decode().lower() if self.word_like else core.decode()).encode())
            return head + self.piece(chunk[len(core) :]) if len(core) < len(chunk) else head
        if text in (" ", "\n") or self.ordinary(text):
            return b"".join(map(self.piece, self.pre_tokens(text)))
        return self.by_library(text)

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Packed ids (little-endian, ``dtype``) of a UTF-8 text."""
        if self.word_like:
            return b"".join(map(self.word, text.split()))
        if uneven(text):
            return b"".join(self.by_library(part) for part in self._even(text.decode()))
        out = []
        for line in text.split(b"\n"):
            first, *rest = line.split(b" ")
            out.append(self.word(first) + b"".join(map(self.spaced, rest)))
        return self.piece(b"\n").join(out)

    def _even(self, text: str) -> list[str]:
        """An unevenly spaced text in parts of some length, cut only at single spaces between words."""
        parts, last = [], 0
        for m in _SAFE_CUT.finditer(text):
            if m.start() - last >= 4096:
                parts.append(text[last : m.start()])
                last = m.start()
        return [*parts, text[last:]]


@lru_cache(maxsize=4)
def compiled(path: str, dropped: frozenset[bytes] | None = None) -> CompiledBpe:
    """The compiled tokenizer of a worker, with what it remembers, kept between tasks."""
    return CompiledBpe(path, dropped)


def public_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder is looked up on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
