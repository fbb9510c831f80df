import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ionsieve.llm.words import shingles_of, slices, text_bytes, words_of

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n\t 漢", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_and_shingles_against_plain_python(rows):
    data, offsets = text_bytes(pa.array(rows, pa.string()))
    words = words_of(data, offsets)
    expected = [(row or "").encode().lower().split() for row in rows]
    assert words.counts.tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    names: dict[int, bytes] = {}
    assert all(names.setdefault(h, w) == w for h, w in zip(words.hashes.tolist(), flat))
    assert len(names) == len(set(flat))

    found = shingles_of(words, 3)
    shingles = [[tuple(x[k : k + 3]) for k in range(max(1, len(x) - 2))] if x else [] for x in expected]
    assert np.diff(found.first).tolist() == [len(x) for x in shingles]
    flat = [s for x in shingles for s in x]
    names = {}
    assert all(names.setdefault(h, s) == s for h, s in zip(found.hashes.tolist(), flat))
    assert len(names) == len(set(flat))


def test_hashes_do_not_depend_on_the_neighbours():
    alone = words_of(*text_bytes(pa.array(["one two"]))).hashes
    data, offsets = text_bytes(pa.array(["zero", "one two", None, "ONE  TWO"]))
    assert words_of(data, offsets).hashes[1:3].tolist() == alone.tolist() == words_of(data, offsets).hashes[3:].tolist()


def test_slices_take_every_text_once():
    offsets = np.array([0, 5, 5, 40, 41, 42])
    assert [(a, b) for a, b in slices(offsets, 10)] == [(0, 2), (2, 3), (3, 5)]
    assert list(slices(np.array([0]), 10)) == []
