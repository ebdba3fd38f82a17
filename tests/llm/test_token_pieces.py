"""Texts encoded by pieces: equal to the library, and the library asked only where it must be."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from boxwright.llm.tokenstore import Encoder, Pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = (
    ["a", "B", "\xe9", "\xdf", "\u4e2d", "\u044f", "1", "\u0663", "\xb2", "\u2167", "_", "-", "'", "'s", "'ll", "'re", "'T", "ve", " ", "  "]
    + ["\t", "\n", "\r\n", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", "\u200b", "\u0301", "\x1c", "\0", "!", "\u2026", "\u201c"]
    + ["\U0001f600", "\U0001d4b3", "\u0378", "\ue000", "<|endoftext|>", "<|endof", "|>", "\ufeff", "\u017f", "\u0130"]
)


def same(found: list[bytes], library: Tokenizer, texts: list[str], width: int = 2) -> bool:
    want = library.encode_batch(texts, add_special_tokens=False)
    return [np.frombuffer(x, f"<u{width}").tolist() for x in found] == [x.ids for x in want]


def test_pieces_give_the_ids_of_whole_texts():
    pick, plane = random.Random(11), [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["", " " * 3000, "x" * 3000] + [f"a{c} b{c}1'{c}s  {c}\n" for c in plane[::7] + plane[:0x500]]
    texts += ["".join(pick.choices(SIGNS, k=pick.randrange(25))) for _ in range(5000)]
    assert same(Encoder(PATH).encode(texts), Tokenizer.from_file(PATH), texts)


def test_library_gets_whole_texts_only_where_it_must():
    class Asked:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    asked, texts = [], ["Plain words, it's 12.5  here.\n", "Größe für 中文", "hi <|endoftext|> there", "a \U0001f600", "\u0378x"]
    words = Encoder(PATH)
    library, words.library = words.library, Asked()
    assert same(words.encode(texts), Tokenizer.from_file(PATH), texts)
    assert asked == texts[2:]


def test_few_pieces_are_kept(monkeypatch):
    monkeypatch.setattr(Pieces, "HELD", 5)
    texts = [f"w{i} w{i % 3} " + "y" * 200 for i in range(60)]
    words = Encoder(PATH)
    assert same(words.encode(texts), Tokenizer.from_file(PATH), texts)
    assert len(words.pieces) <= 5 and len(words.pieces.old) <= 5 and max(map(len, words.pieces)) < 200


@pytest.mark.parametrize("change", ["lower", "prefix", "space", "truncation", "dropout"])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    other = Tokenizer.from_file(PATH)
    if change == "lower":
        other.normalizer = normalizers.Lowercase()
    elif change == "prefix":
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "space":
        other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    elif change == "truncation":
        other.enable_truncation(3)
    else:
        other.model.dropout = 1.0
    other.save(str(tmp_path / "t.json"))
    texts, words = ["Some Words, it's  HERE", " x"], Encoder(str(tmp_path / "t.json"))
    assert words.pieces is None and same(words.encode(texts), other, texts, words.width)
