"""Ids of words by their letters, against the tokenizer."""

from arclet.llm import packing
from arclet.llm.queries import tokenizer_path


def test_words_are_known_by_their_letters():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = packing.WordIds(tokenizer_path())
    texts = ["Grün grün, GRÜN. (grün) grün!!", "", " ", "a\xa0b\x85c\x0bd\x1ce f", "İstanbul Kelvin Ångström ẞ ſ ΟΔΟΣ, it's don'T 1,000 x2.", "été ×y \n\t z\r\n", "\U0001f600, 漢字. <|endoftext|>x"]
    got = ids.of_texts(texts)
    for t, own in zip(texts, got):
        assert own == packing._packed(tok.encode(t, add_special_tokens=False).ids), t
    # Of "grün" in five forms the letters are remembered once, and no form.
    assert "grün" in ids.parts and not {"Grün", "grün,", "GRÜN.", "grün!!"} & (ids.known.keys() | ids.parts.keys())
