import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terravane.llm.tokens import WaveletMatrix, encoder, wavelet_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　́ͅΣςİßẞÅÀ½²ªµº'sdre<|startoftext|><|endoftext|>123"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=ODD, max_size=40), st.lists(st.sampled_from(["I'Ll", "they're", "ÉTÉ", "x²", "é", "a\xa0b", "<|endoftext|>", "ΑΣ", "...", "12"]), max_size=12).map(" ".join)))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_whole():
    other = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words,\n'll and ½"
    assert np.frombuffer(encoder(other).encode(text), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1500), st.integers(0, 80))
def test_wavelet_matrix(ids, value):
    a = np.array(ids, dtype=np.uint32)
    m = WaveletMatrix(wavelet_bytes(a))
    assert m.ids().tolist() == ids
    assert m.count(value) == ids.count(value)
    assert m.count(value, len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2].count(value)
    assert m.occurrences(value) == [i for i, x in enumerate(ids) if x == value]
    assert [m.access(i) for i in range(0, len(ids), 7)] == ids[::7]


def test_wavelet_matrix_wide_ids_and_errors():
    ids = np.array([0, 1 << 20, 5, (1 << 31) + 3], dtype=np.uint32)
    m = WaveletMatrix(wavelet_bytes(ids))
    assert m.ids().tolist() == ids.tolist()
    with pytest.raises(IndexError):
        m.access(4)
    with pytest.raises(IndexError):
        m.select(9, 0)
    with pytest.raises(ValueError):
        WaveletMatrix(b"something else")
