"""Chunk joins: ids assembled from any cut of a text against those of the whole text."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from packetlake.llm import chunkreuse
from packetlake.llm.common import tokenizer_path
from packetlake.llm.wordpieces import pack, word_pieces

PLAIN = "The quick brown fox's tail, don't they've 123 4567 nothing-like_this (see: a.b@c.de) "
SAMPLES = {
    "words": PLAIN * 12,
    "chinese": "数据处理引擎需要在大规模集群上运行，并且结果必须完整。" * 20,
    "one run of letters": "".join(random.Random(1).choices("abcdefghij", k=1500)),
    "one run of han": "".join(random.Random(2).choices("数据处理引擎需要在大规模", k=500)),
    "base64": "".join(random.Random(3).choices("ABCDEFabcdef0123456789+/", k=1500)),
    "quotes": "".join(random.Random(4).choices(["'s", "'", "s", "t", "'ll", "!", "d", " "], k=800)),
    "added tokens": "".join(random.Random(5).choices(["<|endoftext|>", "<|endof", "text|>", "|>", "<|", "a", " "], k=300)),
    "marks": "".join(random.Random(6).choices(["e", "́", "̧", "å", "ᄀ", "ᅡ", " ", "ño", "é"], k=800)),
    "white space": "".join(random.Random(7).choices([" ", "\n", "\x1c", " ", "\x85", "ab", "c1"], k=800)),
    "emoji": "".join(random.Random(8).choices(["\U0001f600", "‍", "\U0001f468", "x", "İ", "ß", " "], k=500)),
}


def chunks_of(text, rng, least=1):
    """A random cut of the text into chunks, of which some are known."""
    library = word_pieces(tokenizer_path()).tokenizer
    at = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(8))})
    known = []
    for a, b in zip(at, at[1:]):
        part = text[a:b]
        if len(part.encode()) < least or rng.random() < 0.2:
            continue
        encoding = library.encode(part, add_special_tokens=False)
        enter, leave = chunkreuse.anchors(part, encoding)
        body = chunkreuse.narrow(pack(encoding.ids))
        known.append({"start": len(text[:a].encode()), "length": len(part.encode()), "enter": enter, "leave": leave, "body": body})
    return known


@pytest.mark.parametrize("name", SAMPLES)
def test_joins_of_any_cut_give_the_ids_of_the_whole(name):
    text = SAMPLES[name]
    encoder = word_pieces(tokenizer_path())
    expected = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    rng = random.Random(name)
    for _ in range(150):
        chunks = chunks_of(text, rng)
        got = chunkreuse.joined(text.encode(), chunks, lambda t: encoder.encode([t])[0])
        assert np.frombuffer(got, "<u4").tolist() == expected


@pytest.mark.parametrize("name", ["words", "chinese", "base64"])
def test_most_text_is_not_encoded_again(name):
    """Chunks are reused, also where no white space stands in them."""
    text, encoder, sent = SAMPLES[name], word_pieces(tokenizer_path()), []

    def encode(part):
        sent.append(len(part.encode()))
        return encoder.encode([part])[0]

    half = len(text) // 2
    library = encoder.tokenizer
    chunks = []
    for a, b in ((0, half), (half, len(text))):
        encoding = library.encode(text[a:b], add_special_tokens=False)
        enter, leave = chunkreuse.anchors(text[a:b], encoding)
        chunks.append({"start": len(text[:a].encode()), "length": len(text[a:b].encode()), "enter": enter, "leave": leave, "body": chunkreuse.narrow(pack(encoding.ids))})
    chunkreuse.joined(text.encode(), chunks, encode)
    assert sum(sent) < len(text.encode()) / 2


def test_disagreement_widens_the_join():
    """An added token and a word that lie across the cut are found by encoding again."""
    encoder, windows = word_pieces(tokenizer_path()), []
    text = "some words come before it here <|endoftext|> and some words come behind it as well, until the end"
    for cut in range(32, 44):
        chunks = []
        for a, b in ((0, cut), (cut, len(text))):
            encoding = encoder.tokenizer.encode(text[a:b], add_special_tokens=False)
            enter, leave = chunkreuse.anchors(text[a:b], encoding)
            chunks.append({"start": a, "length": b - a, "enter": enter, "leave": leave, "body": chunkreuse.narrow(pack(encoding.ids))})
        got = chunkreuse.joined(text.encode(), chunks, lambda t: windows.append(t) or encoder.encode([t])[0])
        assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(windows) > 12
