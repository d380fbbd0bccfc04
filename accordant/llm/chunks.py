"""Token ids of whole texts, each distinct stretch of a text tokenised once per worker.

Both pre-tokenisers used here cut at white space, so the ids of a text are those of its
stretches in order. A worker keeps the ids of stretches it has met (bounded) and gathers
a text's ids from them with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from accordant.llm.common import keep_only, register_cache

# a space that white space or the end follows does not begin a token of its own
_LOOSE = re.compile(r" (?:\s|\Z)")
# once so many are kept, further ones serve their own call only
MOST_STRETCHES = 800_000
MOST_CHARS = 16_000_000


class Stretches(dict):
    """Stretch -> its number; unknown ones are queued when first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self.fresh.append(key)
        self[key] = number = len(self)
        return number


class StretchEncoder:
    """``spaced``: a token may begin with one space (byte-level BPE); else spaces are dropped."""

    def __init__(self, encode: Callable[[list[str]], list], spaced: bool, most: int | None = None, lowers: bool = False) -> None:
        self.encode, self.spaced, self.most, self.lowers = encode, spaced, most, lowers
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.chars, self.asked, self.missed = Stretches(), 0, 0, 0
        self.pool = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def _keys(self, text: str) -> list:
        """Plain strings stand for a space and that string; 1-tuples for themselves."""
        parts = text.split(" ")
        if not self.spaced:
            return parts
        if not _LOOSE.search(text):
            parts[0] = (parts[0],)
            return parts
        keys, held = [], parts[0]
        for part in parts[1:]:
            if part and not part[0].isspace():
                keys.append((held,))
                held = f" {part}"
            else:
                held = f"{held} {part}"
        keys.append((held,))
        return keys

    def _learn(self) -> None:
        fresh = self.numbers.fresh
        if not fresh:
            return
        if self.spaced:
            found = self.encode([k[0] if type(k) is tuple else f" {k}" for k in fresh])
        else:
            found = self.encode(fresh)
        self.chars += sum(len(k[0]) if type(k) is tuple else len(k) for k in fresh)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.pool = np.concatenate([self.pool, flat])
        self.numbers.fresh = []

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's ids."""
        if self.missed > 0.4 * self.asked + 100_000:  # full of what no longer comes
            self._clear()
        kept, chars = len(self.numbers), self.chars
        full = kept > (self.most or MOST_STRETCHES) or chars > MOST_CHARS
        if self.lowers:  # A-Z; the rest is the tokenizer's own affair
            texts = [t.encode().lower().decode() for t in texts]
        keys = [self._keys(t) for t in texts]
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        get = self.numbers.__getitem__
        codes = np.fromiter((get(k) for ks in keys for k in ks), np.int64, int(counts.sum()))
        fresh = self.numbers.fresh
        self._learn()
        sizes = self.length[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(total)
        # each text has a stretch at least, so no slice of reduceat is empty
        per_text = np.add.reduceat(sizes, np.cumsum(counts) - counts) if len(counts) else np.empty(0, np.int64)
        out = self.pool[take]
        if full:
            self.asked, self.missed = self.asked + len(codes), self.missed + len(fresh)
            for k in fresh:
                del self.numbers[k]
            held = int(self.start[kept - 1] + self.length[kept - 1])
            self.pool, self.start, self.length = self.pool[:held], self.start[:kept], self.length[:kept]
            self.chars = chars
        return out, per_text


_LOADED: dict = {}
register_cache("stretches", _LOADED.clear)


def _is_word(s: str) -> bool:
    """One space and then no white space."""
    words = s.split()
    return len(words) == 1 and s[0] == " " and len(words[0]) == len(s) - 1


def _joined(tok, words: list[str]) -> list:
    """Ids of each of ``words`` out of one call over all of them, told apart by offsets."""
    e = tok.encode("".join(words), add_special_tokens=False)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    owner = np.searchsorted(ends, np.fromiter((o[0] for o in e.offsets), np.int64), side="right")
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    ids = e.ids
    return [ids[cuts[i] : cuts[i + 1]] for i in range(len(words))]


def _token_bytes(tok) -> np.ndarray | None:
    """Bytes that each id stands for, where ids of a text spell its very bytes; else None."""
    import json

    made = json.loads(tok.to_str())
    first = made["pre_tokenizer"] or {}
    if made["normalizer"] or made["post_processor"] or first.get("type") != "ByteLevel":
        return None
    if not all(t["special"] for t in made["added_tokens"]):  # special ones are ordinary text here
        return None
    if first.get("add_prefix_space") or not first.get("use_regex") or not hasattr(tok, "encode_batch_fast"):
        return None
    vocab = tok.get_vocab()
    sizes = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
    for token, i in vocab.items():  # a character of a byte-level token is a byte
        sizes[i] = len(token)
    return sizes


def _is_run(s: str) -> bool:
    """Begins with one space and ends with none, so the next one's space begins a token."""
    return len(s) > 1 and s[0] == " " and not s[1].isspace() and not s[-1].isspace()


def _spelled(tok, sizes: np.ndarray, runs: list[str]) -> list | None:
    """Ids of each of ``runs`` out of one call over all of them, told apart by the bytes that
    ids stand for; None if a token lies across two runs."""
    ids = tok.encode_batch_fast(["".join(runs)], add_special_tokens=False)[0].ids
    ends = np.cumsum(sizes[np.array(ids, np.int64)])
    wanted = np.cumsum(np.fromiter((len(s.encode()) for s in runs), np.int64, len(runs)))
    cuts = np.searchsorted(ends, wanted, side="right")
    if not len(ends) or ends[-1] != wanted[-1] or (ends[cuts - 1] != wanted).any():
        return None
    at = [0, *cuts.tolist()]
    return [ids[a:b] for a, b in zip(at, at[1:])]


def _encode_bytes(tok, sizes: np.ndarray, strings: list[str]) -> list:
    """``_encode`` where ids spell the bytes of a text."""
    runs = [i for i, s in enumerate(strings) if _is_run(s)]
    found: list = [None] * len(strings)
    for at in range(0, len(runs), 1000):
        part = runs[at : at + 1000]
        for i, ids in zip(part, _spelled(tok, sizes, [strings[i] for i in part]) or [], strict=False):
            found[i] = ids
    rest = [i for i, f in enumerate(found) if f is None]
    for i, e in zip(rest, tok.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False), strict=True):
        found[i] = e.ids
    return found


def _encode(tok, spaced: bool, strings: list[str]) -> list:
    """Words are encoded many at a time, anything else on its own."""
    whole = strings if spaced else [f" {s}" for s in strings]
    words = [i for i, s in enumerate(whole) if _is_word(s)]
    found: list = [None] * len(strings)
    for at in range(0, len(words), 1000):
        part = words[at : at + 1000]
        for i, ids in zip(part, _joined(tok, [whole[i] for i in part]), strict=True):
            found[i] = ids
    rest = [i for i, f in enumerate(found) if f is None]
    for i, e in zip(rest, tok.encode_batch([strings[i] for i in rest], add_special_tokens=False), strict=True):
        found[i] = e.ids
    return found


def json_encoder(path: str, spaced: bool, most: int | None = None) -> StretchEncoder:
    """The tokenizers library's ids; strings of special tokens in a text are ordinary text."""
    keep_only("stretches")
    if (path, spaced) not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        # where the tokenizer lower-cases anyway, stretches that differ in case are one
        lowers = "Lowercase" in repr(tok.normalizer)
        sizes = _token_bytes(tok) if spaced else None
        encode = (lambda s: _encode(tok, spaced, s)) if sizes is None else (lambda s: _encode_bytes(tok, sizes, s))
        _LOADED[path, spaced] = StretchEncoder(encode, spaced, most, lowers)
    return _LOADED[path, spaced]
