import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzite.llm.scan import text_chunks
from quartzite.llm.tokens import encoded, vocabulary, word_bpe

PATH = vocabulary()
TEXTS = ["", "It's a café  naïve!! x_y 12 we'll they're I'd 'tis 'S o''s !'s 's's 'sre", "Straße ÀÉÎ × ÷ œuvre Œ ŸŁódź İstanbul ſ", "<|endoftext|> a<|startoftext|>b", "tab\tnew\nline\x0b\x0c\r\x1c\x1f\x7f", "½ ² ª µ 中文 😀 é  x", "'s", "a'", "'", "'re've'll'm", "ΟΔΟΣ", None, "x" * 5000, "%%%***!!||| 3.14159"]


def expect(texts):
    return [word_bpe(PATH).whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def got(texts):
    return [[i for ids in x for i in ids.tolist()] for _, part in encoded(pa.array(texts, pa.string()), PATH) for x in part]


def test_equals_the_tokenizer():
    assert got(TEXTS) == expect(TEXTS)
    assert got(TEXTS + TEXTS) == expect(TEXTS) * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAsStmdrevl'’ \n1!éÉßÖŁžß÷xy<|>")), max_size=6))
def test_equals_the_tokenizer_on_any_text(texts):
    assert got(texts) == expect(texts)


def test_counts_and_cache_limit(monkeypatch):
    import quartzite.llm.tokens as t

    monkeypatch.setattr(t, "CACHE_WORDS", 3)
    for _, _, raw, offs in text_chunks(pa.array(TEXTS, pa.string())):
        assert word_bpe(PATH).counts(raw, offs).tolist() == [len(x) for x in expect(TEXTS)]
    assert got(TEXTS) == expect(TEXTS)
    assert np.iinfo(np.int32).max > 49_408


def test_two_words_of_one_linear_hash_and_a_very_long_text():
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    both = f"{thue} {thue.translate(str.maketrans('ab', 'ba'))}"
    assert got([both]) == expect([both])
    long = "Some words, it's 12 more; été\n" * 60_000 + "<|endoftext|> 中文"
    assert got([long]) == expect([long])
