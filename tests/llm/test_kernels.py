import itertools
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from agrolith.llm import kernels as K

texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\té漢.", max_size=40)), max_size=8)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words_are_those_between_ascii_spaces(values):
    h, at = K.word_hashes(pa.array(values, pa.string()))
    words = [(v or "").encode().lower().split() for v in values]
    assert [int(b - a) for a, b in zip(at[:-1], at[1:])] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    for i, a in enumerate(flat):
        for j in range(i):
            assert (h[i] == h[j]) == (a == flat[j])


def test_words_longer_than_a_piece():
    long_ = "y" * (3 * K.PIECE + 5)
    h, _ = K.word_hashes(pa.array([f"a {long_} b", long_, long_ + "z", f"b {long_}"]))
    assert h[1] == h[3] == h[6] and h[4] != h[3] and h[2] == h[5]


def test_grams_depend_on_order():
    h, _ = K.word_hashes(pa.array(["a b a b c a"]))
    g = K.grams(h, 2)
    assert g[0] == g[2] and g[0] != g[1] and len(g) == 5


def test_structured_words_do_not_collide():
    """Words of a and b after the Thue-Morse sequence, which any polynomial modulo 2^64 confuses with their complements."""
    t = [bin(i).count("1") % 2 for i in range(4096)]
    values = []
    for n in (64, 1024, 2048, 4096):
        values += ["".join("ab"[v] for v in t[:n]), "".join("ba"[v] for v in t[:n])]
    blocks = ["12345678", "abcdefgh", "zyxwvuts"]
    values += ["".join(p) for p in itertools.permutations(blocks)] + [w * n for w in ("a", "ab", "12345678") for n in range(1, 40)]
    h, _ = K.word_hashes(pa.array(values))
    assert len(set(h.tolist())) == len(set(values))


def test_hashes_do_not_depend_on_where_a_word_stands():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc\0é") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    alone = K.word_hashes(pa.array(words))[0].tolist()
    text = " ".join(f"{w}\t\n" for w in words)
    assert K.word_hashes(pa.array([text]))[0].tolist() == alone
    big = " ".join(words * 60)
    assert K.word_hashes(pa.array(["x", big]))[0].tolist()[1:] == alone * 60
