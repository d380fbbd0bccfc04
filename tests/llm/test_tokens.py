"""Token files, packing and prefix BPE against the public libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from accordant.llm import chunks, packing, prefix_bpe, queries, token_files

from .conftest import SF

ALPHABET = " \t\n\r\x0b\x85\xa0 　\x1c  aab'stré1².,!🙂́Σ"


def fuzz(n=1500, seed=1):
    rng = random.Random(seed)
    own = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*own, "", "a", "  ", "<|endoftext|> x <|endoftext|>", "a" * 700, "ab" * 300]


def as_u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def byte_tok():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(queries.BYTE_BPE))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_tok():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(queries.WORD_BPE))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def multi_tok():
    import tiktoken

    with open(P.path(queries.MULTI_BPE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("name", "spaced"), [(queries.BYTE_BPE, True), (queries.WORD_BPE, False)])
def test_stretches_give_the_library_ids(name, spaced, byte_tok, word_tok, monkeypatch):
    want = byte_tok if spaced else word_tok
    for most in (800_000, 50):  # with room, and with every stretch soon beyond it
        monkeypatch.setattr(chunks, "MOST_STRETCHES", most)
        own = chunks.StretchEncoder(chunks.json_encoder(P.path(name), spaced).encode, spaced)
        texts = fuzz()
        for at in range(0, len(texts), 97):
            ids, counts = own.ids(texts[at : at + 97])
            ends = np.cumsum(counts)
            for t, e, n in zip(texts[at : at + 97], ends, counts, strict=True):
                assert ids[e - n : e].tolist() == want(t)


def test_token_files_round_trip(spark, small, byte_tok, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(small, P.path(queries.BYTE_BPE), path, sequence_length=64, file_tokens=5000)
    stored = sorted(token_files.read(spark, path).collect(), key=lambda r: (r.part, r.shard, r.place))
    want = sorted((r.doc_id, byte_tok(r.text) + [0]) for r in small.collect())
    assert [(r.doc_id, r.ids) for r in stored] == [(d, as_u32(i)) for d, i in want]
    for row in spark.read.format("binaryFile").load(path).select("content").collect():
        reader = token_files.open_file(row.content)
        rows = sum(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))
        ids, mask = token_files.sequence(reader, rows - 1)
        assert len(ids) == len(mask) == 64
        assert int(reader.schema.metadata[b"tokens"]) == (rows - 1) * 64 + sum(mask.to_pylist())


def test_op3(spark, byte_tok, small):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_files(spark, SF).collect()}
    at = 0
    for d, t in sorted((r.doc_id, r.text) for r in small.collect()):
        ids = byte_tok(t) + [0]
        assert got[d] == (at, len(ids), zlib.crc32(as_u32(ids)))
        at += len(ids)


def test_op5(spark, word_tok, small):
    rows = queries.op5_best_fit(spark, SF).collect()
    pieces = {}
    for r in small.collect():
        ids = word_tok(r.text) + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            pieces[r.doc_id, k] = (s, len(part), zlib.crc32(as_u32(part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces
    check_places(rows, 4096)
    total = sum(n for _, n, _ in pieces.values())
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1


def check_places(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_as_good_as_best_fit_and_complete(seed):
    rng = np.random.default_rng(seed)
    low, high = sorted(rng.integers(1, 60, 2))
    counts = np.bincount(rng.integers(low, high + 1, rng.integers(1, 300)), minlength=61).astype(np.int64)
    plan = packing.plan(counts, 60)
    pure = sum(t for _, t in packing.best_fit(counts.copy(), 60))
    assert -(-int((counts * np.arange(61)).sum()) // 60) <= plan["sequences"][0] <= pure
    left = counts.copy()
    fixed = packing.reduce_dominated(left, 60)
    used = Counter({s: 0 for s in range(61)})
    for own, times in fixed:
        assert sum(own) <= 60
        used.update({s: n * times for s, n in Counter(own).items()})
    assert all(used[s] + left[s] == counts[s] for s in range(61))


def test_reduction_is_optimal_on_small_instances():
    """Bins after reduction and exact packing of the rest equal the exact optimum."""

    def optimum(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for b in sorted(set(bins)):
                if b + items[i] <= capacity:
                    rest = list(bins)
                    rest[rest.index(b)] += items[i]
                    go(i + 1, rest)
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    rng = random.Random(4)
    for _ in range(150):
        items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = np.bincount(items, minlength=21).astype(np.int64)
        fixed = packing.reduce_dominated(counts, 20)
        rest = sorted(np.repeat(np.arange(21), counts).tolist(), reverse=True)
        assert sum(t for _, t in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_prefix_bpe_equals_the_library(multi_tok):
    own = prefix_bpe.PrefixBPE(prefix_bpe.load_ranks(P.path(queries.MULTI_BPE)), P.PATTERN)
    for t in fuzz():
        assert own.encode(t) == multi_tok.encode_ordinary(t)


def test_edits_and_appends_equal_encoding_anew():
    own = prefix_bpe.PrefixBPE(prefix_bpe.load_ranks(P.path(queries.MULTI_BPE)), P.PATTERN)
    rng = random.Random(2)
    for _ in range(150):
        a = bytes(rng.choice(b"abc the ing\xc3\xa9") for _ in range(rng.randint(0, 300)))
        s = rng.randint(0, len(a))
        e = rng.randint(s, len(a))
        new = bytes(rng.choice(b"abth") for _ in range(rng.randint(0, 9)))
        held = prefix_bpe.PrefixEncoding(own, a)
        held.replace(s, e, new)
        held.append(b"the end")
        anew = prefix_bpe.PrefixEncoding(own, a[:s] + new + a[e:] + b"the end")
        assert (held.last, held.ids()) == (anew.last, anew.ids())
    far = prefix_bpe.PrefixEncoding(own, b"the cat sat on the mat " * 400)
    assert far.replace(100, 103, b"dog") < 400  # an edit redoes its neighbourhood only


def test_op9(spark, multi_tok, small):
    got = {r.doc_id: r for r in queries.op9_prefix_bpe(spark, SF).collect()}
    for r in small.collect():
        ids, g = multi_tok.encode_ordinary(r.text or ""), got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(as_u32(ids)).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_tables(spark, odd, byte_tok, word_tok, multi_tok, tmp_path):
    texts = [r.text for r in odd.collect()]
    path = str(tmp_path / "odd")
    token_files.write(odd, P.path(queries.BYTE_BPE), path)
    read = token_files.read(spark, path).collect()
    assert Counter(r.ids for r in read) == Counter(as_u32(byte_tok(t) + [0]) for t in texts)
    assert [r.doc_id for r in sorted(read, key=lambda r: (r.part, r.shard, r.place))][:2] == [None, None]
    packed = packing.pack(odd, P.path(queries.WORD_BPE)).collect()
    check_places(packed, 4096)
    assert sum(r.length for r in packed) == sum(len(word_tok(t)) + 1 for t in texts)
    coded = prefix_bpe.decode(prefix_bpe.encode(odd, P.path(queries.MULTI_BPE), P.PATTERN), P.path(queries.MULTI_BPE)).collect()
    assert Counter(r.bytes for r in coded) == Counter((t or "").encode() for t in texts)
    none = odd.limit(0)
    token_files.write(none, P.path(queries.BYTE_BPE), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(none, P.path(queries.WORD_BPE)).count() == 0
    assert prefix_bpe.encode(none, P.path(queries.MULTI_BPE), P.PATTERN).count() == 0


def test_words_of_one_call_are_told_apart_by_bytes(monkeypatch):
    """op3_token_files: runs that begin with a space are encoded together, without offsets."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    sizes = chunks._token_bytes(tok)
    assert sizes is not None and chunks._token_bytes(Tokenizer.from_file(P.path("word_bpe_49k.json"))) is None
    strings = [" plain", " it's", "word", " a.\nB", " tail\n", "  two", " ", "", " été中\U0001f600", " <|endoftext|>", " 12 3", " x\x1c", " '", " s"]
    want = [e.ids for e in tok.encode_batch(strings, add_special_tokens=False)]
    monkeypatch.setattr(chunks, "_joined", None)
    assert chunks._encode_bytes(tok, sizes, strings) == want
    runs = [s for s in strings if chunks._is_run(s)]
    assert chunks._spelled(tok, sizes, runs) == [w for s, w in zip(strings, want) if chunks._is_run(s)] and len(runs) == 8
    assert chunks._spelled(tok, sizes, ["un", "der"]) is None
