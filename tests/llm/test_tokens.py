"""The encoder against the library on strings made to break its cuts; widths of ids."""

import random

import numpy as np

from glyphmill.llm import records, tokens

PARTS = [
    " ", "  ", "\n", "\n\n", "\t", " \t", "   ", "a", "foo", "Bar", ",", ".", "!", "'s", "'", "é", "日本", "<|endoftext|>", "<|endo", "\0", "\xa0", "　",
    "\x1c", "\x85", "1", "23", "Ω", "ж", "İ", "́", "😀", "\r\n", "%$", "...", "x" * 70,
]


def same(encoder, texts):
    whole = encoder._tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, own, want in zip(texts, encoder.ids(texts), whole, strict=True):
        assert np.frombuffer(own, "<u4").tolist() == want.ids, repr(text)


def test_random_strings_get_the_library_s_ids():
    rng, encoder = random.Random(11), tokens.Encoder(tokens.vocabulary(), most_kept=500)
    for _ in range(40):
        same(encoder, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(500)])
    same(encoder, ["a\n\n<|endoftext|>b", "a  <|endoftext|>", "<|endoftext|>", " ", "\n", ""])


def test_very_long_texts():
    rng = random.Random(12)
    prose = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    same(tokens.Encoder(tokens.vocabulary()), [prose, prose + "  \n ", "y" * 200_000, " " * 50_000 + prose[:1000], prose[:200_000] + "<|endoftext|>" + prose[:200_000]])


def test_wide_ids_stay_whole():
    ids = np.array([0, 65_535, 65_536, 70_000], "<u4").tobytes()
    assert records.unpack(records.pack(7, ids, short=False)) == (7, ids)
    assert tokens.encoder(tokens.vocabulary()).size == 50_257
