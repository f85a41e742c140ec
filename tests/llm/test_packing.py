"""Token ids of packed documents against the whole tokenizer, and the order of assignment against a plain loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import packing


@pytest.fixture(scope="module")
def pair():
    path = packing.default_tokenizer()
    return packing.WordTokenizer(path), Tokenizer.from_file(path)


def same(pair, text):
    own, whole = pair
    return np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_every_character_below_u0250(pair):
    for c in map(chr, range(0x250)):
        for form in ("{}", "a{}b", "1{}s 2", "{0}{0}", "'{}", "A{} ", "x{} 漢", "!{}"):
            assert same(pair, form.format(c)), (form, c)


@pytest.mark.parametrize("pool", [
    [chr(c) for c in range(0x100)], [chr(c) for c in range(0x3000)], list("ab'stvremld'' -.!1²½\x1c\x1d\x1e\x1f\x85\xa0 　É"),
    [chr(c) for c in range(0x20, 0xD800, 37)] + [chr(c) for c in range(0xE000, 0x110000, 331)] + list("ab '"),
])
def test_random_texts(pair, pool):
    rng = random.Random(len(pool))
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        assert same(pair, text), text


def test_control_characters_keep_their_ids(pair):
    assert np.frombuffer(pair[0].encode("!\x1c"), "<u4").tolist() == pair[1].encode("!\x1c", add_special_tokens=False).ids and len(pair[0].encode("!\x1c")) == 8


def test_the_cache_forgets_but_does_not_err(pair, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 20)
    rng = random.Random(1)
    own = packing.WordTokenizer(packing.default_tokenizer())
    for _ in range(200):
        text = " ".join(rng.choice(["word", "other", "é", "12", "x" * 200]) + str(rng.randrange(99)) for _ in range(30))
        assert same((own, pair[1]), text)
        assert len(own.ids) <= 20 + 60 and all(len(k) <= packing.CACHE_CHARS for k in own.ids)


def test_each_piece_goes_to_the_cheapest_sequence_with_room():
    rng = random.Random(4)
    pieces = [(k, 0, rng.randrange(1, 400)) for k in range(60)]
    size = 500
    got, _ = packing.pack_block(pieces, size, True)
    n = -(-sum(p[2] for p in pieces) // size)
    room, spent, want = [size] * n, [0.0] * n, [[] for _ in range(n)]
    for doc, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while length:
            able = [k for k in range(n) if room[k] >= length]
            k = min(able, key=lambda k: (spent[k], k)) if able else max(range(n), key=lambda k: (room[k], -k))
            m = min(length, room[k])
            want[k].append((doc, start, m))
            room[k] -= m
            spent[k] += packing.cost(m)
            start, length = start + m, length - m
    assert got == want
