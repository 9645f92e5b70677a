import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fotolake.llm.common import tokenizer
from fotolake.llm.merging import NONE, RankMerger
from fotolake.llm.packing import balanced, difference, pack, packing_report
from fotolake.llm.token_counts import token_counts
from fotolake.llm.tokens import CachedByteBpe, CachedWordCounts

ODD = [
    "a<|endoftext|>b", "  x  \n\n y ", "", "it's WE'LL 12ab½²ª q \x1c z\x85 k漢字 мир İstanbul ŸÀ", " don't— “q” € ", "\t\t a\r\n",
    "=" * 3000 + "ab" * 700, "é combining", "Ⱥ ȿ", "'S 's'T", "<|startoftext|> tail", "x" * 600, "  line",
]


def library(name):
    return Tokenizer.from_file(tokenizer(name))


def test_counts_equal_the_library(make, awkward):
    rows = awkward + [(100 + i, t) for i, t in enumerate(ODD)]
    lib = library("word_bpe_49k.json")
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    found = token_counts(make(rows), tokenizer("word_bpe_49k.json"), limit=50).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in found)
    assert token_counts(make([]), tokenizer("word_bpe_49k.json")).count() == 0


def test_merger_equals_the_library_word_by_word():
    rng = np.random.default_rng(1)
    lib, merger = library("byte_bpe_50k.json"), RankMerger(tokenizer("byte_bpe_50k.json"))
    words = ["".join(map(chr, rng.integers(97, 103, rng.integers(1, 30)))) for _ in range(500)] + ["aaaaaaaa", "z", "q" * 700]
    ids, counts = merger.merge([w.encode() for w in words])
    cuts = np.cumsum(counts)
    assert [x.tolist() for x in np.split(ids, cuts[:-1])] == [lib.encode(w).ids for w in words]


def test_all_scripts_and_lengths_go_through_the_merger():
    from fotolake.llm.tokens import CachedByteBpe, CachedWordCounts

    rng = random.Random(3)
    texts = ["漢字かな交じり文、と mix 123", "Привет, мир!", "é à naïve", "😀 👩‍👩‍👧", "שָׁלוֹם", "ไทยไม่มีเว้นวรรค" * 40, "a" * 3000, "ab" * 2500 + "c", "aaa aaaa aaaaaaa " * 20, "ẞ ŒÆ ǅ\u200b"]
    texts += ["".join(rng.choice("abcあいшщ éñ😀 1２\n.,") for _ in range(rng.randint(1, 200))) for _ in range(100)]

    class Whole:
        """The library without its encoder."""

        def __init__(self, library):
            self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    for name, kind in (("byte_bpe_50k.json", CachedByteBpe), ("word_bpe_49k.json", CachedWordCounts)):
        own, lib = kind(tokenizer(name)), library(name)
        own.merger.library = own.pieces.library = Whole(own.merger.library)
        own.merger.library.encode = None
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        if kind is CachedByteBpe:
            assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == want
        else:
            assert own.counts(texts) == list(map(len, want))
        words = [t.encode() for t in texts if len(t) < 300]
        ids, counts = own.merger.merge(words)
        assert own.merger.at_once
        own.merger.at_once = False
        slow, slow_counts = own.merger.merge(words)
        assert ids.tolist() == slow.tolist() and counts.tolist() == slow_counts.tolist()


def test_differencing_balances_and_windows_rise():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 257, 600).tolist()
    windows, sums = difference(sizes, 80)
    assert sums.sum() == sum(sizes) and np.array_equal(np.bincount(windows, sizes, 80), sums)
    assert sums.max() - sums.min() < 60
    tight = balanced([600, 600, 600], 1024)
    assert len(set(tight.tolist())) == 3  # two windows would do by their sum, not by their pieces
    assert balanced([5], 1024).tolist() == [0]


def test_packing_is_a_round_trip(make, awkward):
    rows = [(i, t) for i, t in awkward if i not in (None, 3)] + [(100 + i, t) for i, t in enumerate(ODD)]
    lib = library("byte_bpe_50k.json")
    pieces, sequences = defaultdict(list), defaultdict(list)
    found = pack(make(rows), tokenizer("byte_bpe_50k.json")).collect()
    for r in found:
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        whole = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
        assert whole == lib.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for start, ids, total in sorted(pieces[i]):
            assert start == at and total == len(whole)
            at += len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    digests = packing_report(make(rows), tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in digests) == sorted((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in found)
    padded = len(sequences) * 1024 - sum(r["length"] for r in found)
    assert padded < 0.05 * sum(r["length"] for r in found) + 1024 * 4
    assert pack(make([]), tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_keeps_repeated_and_unnamed_rows(make):
    found = packing_report(make([(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), tokenizer("byte_bpe_50k.json")).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "2", "None"]
    assert next(r for r in found if r["doc_id"] == 2)["doc_tokens"] == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ranks_of_pairs_are_found_without_bisection(name, monkeypatch):
    """All pairs of the vocabulary and others get the ranks of a plain table; merging asks no sorted list."""
    path = tokenizer(name)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab, rng = model["vocab"], random.Random(5)
    plain: dict[tuple[int, int], int] = {}
    for i, (a, b) in enumerate(pairs):
        plain.setdefault((vocab[a], vocab[b]), i)
    asked = [*plain, *((rng.randrange(len(vocab)), rng.randrange(len(vocab))) for _ in range(50_000))]
    merger = RankMerger(path)
    monkeypatch.setattr(np, "searchsorted", None)
    found = merger.ranks(*np.array(asked, np.int64).T)
    assert found.tolist() == [plain.get(x, NONE) for x in asked]
    text = "It's they're we'll I'd 's're'x ''tis don't 'S 'm9 caf\u00e9's a'b' 'lle 've"
    kind = CachedByteBpe if name.startswith("byte") else CachedWordCounts
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    if kind is CachedByteBpe:
        assert np.frombuffer(kind(path).ids([text])[0], "<u4").tolist() == ids
    else:
        assert kind(path).counts([text]) == [len(ids)]
