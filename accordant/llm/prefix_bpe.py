"""Byte-level BPE by prefix dynamic programming, and its inverse.

For every prefix of a piece exactly one token can be the last of the prefix's encoding: a
token that ends there and forms a valid pair with the last token of the prefix before it.
A pair is valid if merging its bytes gives these two tokens back. ``PrefixEncoding`` keeps
the last token of every prefix, so bytes can be appended, and an edit re-encodes only from
its place to where the stored last tokens agree again.

A text is cut by the pre-tokeniser's pattern and each match is encoded separately; a match
that is itself a token is that token, as in the public library.

Defined results: a null text is encoded as the empty one (no ids, no bytes); repeated rows
are encoded each; ``doc_id`` may be null. Long texts without white space take time in
proportion to their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame

from accordant.llm.chunks import StretchEncoder
from accordant.llm.common import batches_by_size, keep_only, register_cache, texts

# fixed value: what the pattern's \s means to the public library (Unicode White_Space)
WHITE = r"\t-\r \x85\xa0  -     　"
MOST_PAIRS = 500_000
MOST_STRETCHES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.rank = ranks
        self.word = {v: k for k, v in ranks.items()}
        self.tail: dict[bytes, int] = {}  # every ending of a token -> its rank, -1 if none
        for word in ranks:
            for i in range(len(word)):
                self.tail[word[i:]] = -1
        self.tail.update(ranks)
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.longest = max(map(len, ranks), default=0)
        explicit = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.split = regex.compile(explicit).findall

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost of equals. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def usable(self, token: int) -> bool:
        """Merging the token's bytes gives the token."""
        got = self.sound.get(token)
        if got is None:
            got = self.sound[token] = self.merge(self.word[token]) == [self.word[token]]
        return got

    def valid(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            x, y = self.word[a], self.word[b]
            got = self.pairs[key] = self.merge(x + y) == [x, y]
        return got

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append to ``last`` the last token of each prefix of ``data`` longer than it."""
        tail, known = self.tail.get, self.pairs.get
        for end in range(len(last) + 1, len(data) + 1):
            begin = end
            while True:
                begin -= 1
                token = tail(data[begin:end]) if begin >= 0 else None
                if token is None:
                    raise ValueError("no token ends here")
                if token < 0:
                    continue
                if begin:
                    before = last[begin - 1]
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits = self.valid(before, token)
                else:
                    fits = self.usable(token)
                if fits:
                    last.append(token)
                    break

    def piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.read(last)

    def read(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.word[token])
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.piece(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.word.__getitem__, ids))


class PrefixEncoding:
    """The encoding of one byte string that can grow and be edited."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b"") -> None:
        self.bpe, self.data, self.last = bpe, data, []
        bpe.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to end; returns how many prefixes were redone."""
        old, shift = self.last, len(new) - (end - start)
        data = self.data[:start] + new + self.data[end:]
        last, same, done = old[:start], 0, 0
        self.data = data
        while len(last) < len(data):
            self.bpe.extend(data[: len(last) + 1], last)
            done += 1
            here = len(last)
            # a prefix's last token depends on as many before it as the longest token has bytes
            same = same + 1 if here > start + len(new) and last[-1] == old[here - shift - 1] else 0
            if same >= self.bpe.longest:
                last.extend(old[here - shift :])
                break
        self.last = last
        return done

    def ids(self) -> list[int]:
        return self.bpe.read(self.last)


_LOADED: dict = {}
register_cache("prefixes", _LOADED.clear)


def bpe(path: str, pattern: str) -> tuple[PrefixBPE, StretchEncoder]:
    """One per worker process."""
    keep_only("prefixes")
    if (path, pattern) not in _LOADED:
        own = PrefixBPE(load_ranks(path), pattern)
        _LOADED[path, pattern] = own, StretchEncoder(lambda strings: [own.encode(s) for s in strings], True, MOST_STRETCHES)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``: ids as little-endian unsigned 32-bit integers in one binary."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = bpe(path, pattern)[1]
        for b in batches_by_size(batches, "text"):
            flat, counts = encoder.ids(b.column("text").to_pylist())
            raw, ends = flat.astype("<u4").tobytes(), (counts.cumsum() * 4).tolist()
            ids = [raw[e - 4 * c : e] for e, c in zip(ends, counts.tolist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, bytes)``: the bytes that the ids stand for."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keep_only("prefixes")
        if path not in _LOADED:
            words = {v: k for k, v in load_ranks(path).items()}
            size = np.zeros(max(words, default=-1) + 1, np.int64)
            for i, w in words.items():
                size[i] = len(w)
            start = np.cumsum(size) - size
            _LOADED[path] = np.frombuffer(b"".join(words[i] for i in sorted(words)), np.uint8), start, size
        pool, start, size = _LOADED[path]
        for b in batches_by_size(batches, "ids"):
            raw = b.column("ids").to_pylist()
            out = []
            for one in raw:
                ids = np.frombuffer(one or b"", "<u4")
                sizes = size[ids]
                ends = np.cumsum(sizes)
                at = np.repeat(start[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
                out.append(pool[at].tobytes())
            yield pa.record_batch([b.column("doc_id"), b.column("n_tokens"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "bytes"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, bytes binary")
