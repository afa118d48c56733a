import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tablecraft.llm.bytehash import shingle_hashes, text_steps, word_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAb é\n\t 😀x"), max_size=40)), max_size=12)


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 50))
def test_words_and_shingles_are_those_of_python(texts, step):
    for kind in (pa.string(), pa.large_string()):
        seen, runs, rows = {}, {}, 0
        for first, last, data, bounds in text_steps(pa.array(texts, kind), step):
            assert first == rows
            rows = last
            hashed, at = word_hashes(data, bounds)
            grams, place = shingle_hashes(data, bounds)
            for i, text in enumerate(texts[first:last]):
                words = split(text)
                mine = list(hashed[at[i]:at[i + 1]])
                assert len(mine) == len(words)
                for w, h in zip(words, mine):
                    assert seen.setdefault(w, h) == h
                expected = [tuple(words[k:k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
                mine = list(grams[place[i]:place[i + 1]])
                assert len(mine) == len(expected)
                for w, h in zip(expected, mine):
                    assert runs.setdefault(w, h) == h
        assert rows == len(texts)
        assert len(set(seen.values())) == len(seen) and len(set(runs.values())) == len(runs)


def test_slices_of_arrow_arrays():
    whole = pa.array(["aa bb", None, "cc", "dd ee ff"])
    for k in range(4):
        parts = [data.tobytes() for _, _, data, _ in text_steps(whole.slice(k))]
        assert b"".join(parts) == "".join(x or "" for x in whole.to_pylist()[k:]).encode()
    assert not list(text_steps(pa.array([], pa.string())))
    assert np.array_equal(next(text_steps(pa.array([None], pa.string())))[3], [0, 0])
