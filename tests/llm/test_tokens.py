"""Remembered words give the library's own tokens, and their number is bounded."""

import random

import pytest
from kohort.llm import packing, queries, token_counts

ALPHABET = "abcXYZ éÉßÿÀ×÷ªºµ0123'\"!?.,;:-_`~@[]{}()|<>/\\ \t\n\r\x0b\x0c\x1c\x85\xa0ıİŁłſ'st'llDON’t$%&*#^+=½²漢😀ẖ"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 60))) for _ in range(4_000)]
    made += [" ".join("".join(rnd.choice("abcdé.,!'") for _ in range(rnd.randrange(1, 9))) for _ in range(50)) for _ in range(300)]
    return [*made, "b<|endoftext|> c", "日本 語", "é", ""]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


def test_packing_ids_are_the_librarys(texts):
    own, path = library("word_bpe_49k.json"), queries.tokenizer_path("word_bpe_49k.json")
    encoder = packing.Encoder(path, 500, 7)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        for text, ids in zip(part, encoder.encode([t.encode() for t in part]), strict=True):
            assert [*own.encode(text, add_special_tokens=False).ids, 7] == ids.tolist(), repr(text)


def test_tally_is_the_library_and_bounded(texts):
    own, path = library("byte_bpe_50k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    cutter = token_counts.PreTokens(path)
    head = ["a", "b", " a", " b", ".", ",", " abc"]
    tally = token_counts.Tally(cutter, dict(zip(head, cutter.count(head))), learnt=300)
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        total, owner, number, times = tally.batch(part)
        names = [tally.names[j] for j in number]
        for j, n, piece in zip(owner, times, cutter.count(names)):
            total[j] += n * piece
        assert total.tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in part]


def test_whole_cut_texts_do_not_pile_up_names():
    cutter = token_counts.PreTokens(queries.tokenizer_path("byte_bpe_50k.json"))
    tally = token_counts.Tally(cutter, {}, learnt=1000)
    for i in range(40):
        tally.batch([f"two  spaces word{chr(97 + i % 26)}{'x' * i} " + "  ".join(f"{chr(97 + j % 26)}{'y' * (j // 26)}{i}" for j in range(500))])
        assert max(len(tally.names), len(tally.number), len(tally.place)) <= 1000 + 1100
