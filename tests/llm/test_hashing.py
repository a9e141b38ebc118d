import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catamatch.llm import mph, words


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_slots_are_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    blob = mph.build(*keys)
    assert sorted(mph.slots(blob, *keys).tolist()) == list(range(n))
    other = np.random.default_rng(n + 1).integers(0, 1 << 63, (2, 100), dtype=np.uint64)
    assert (mph.slots(blob, *other) < max(n, 1)).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        mph.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBcé", min_size=1, max_size=4), max_size=20), st.sampled_from([" ", "\n", " \t\r\x0b\x0c"]))
def test_words_hash_by_content(parts, gap):
    got = words.word_hashes(gap.join(parts).encode())
    alone = [words.word_hashes(p.encode())[0] for p in parts]
    assert got.tolist() == alone
    assert len(set(alone)) == len(set(parts))


def test_pieces_do_not_change_hashes(monkeypatch):
    text = ("some words and " + "x" * 40 + " more of them ") * 9
    whole = words.word_hashes(text.encode())
    spans = words.span_hashes(whole, np.arange(20), np.arange(20) + 7)
    monkeypatch.setattr(words, "PIECE", 16)
    small = words.word_hashes(text.encode())
    short = np.array([len(w) <= 16 for w in text.split()])
    assert (small[short] == whole[short]).all()
    assert len(set(small[~short].tolist())) == 1
    monkeypatch.setattr(words, "PIECE", 32)
    assert (words.span_hashes(whole, np.arange(20), np.arange(20) + 7) == spans).all()
    assert spans[0] == words.span_hashes(whole[:7], np.array([0]), np.array([7]))[0]


def test_lower_folds_ascii_only():
    a, b = words.word_hashes("ABÉ".encode(), True), words.word_hashes("abÉ".encode(), True)
    assert a == b and a != words.word_hashes("abé".encode(), True)
