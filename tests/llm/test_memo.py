"""Merged pre-tokens are remembered over a task's share of a corpus."""

import numpy as np

from adlens.llm import bpe, packing


def test_many_distinct_pieces_are_merged_once():
    tok = bpe.Tokenizer({bytes([k]): k for k in range(256)} | {b"ab": 256}, np.zeros(0x110000, np.uint8))
    pieces = [b"ab%d" % k for k in range(100_000)]
    tok._merged(pieces)
    tok._merged([b"abc"])
    assert tok._merged(pieces[:1]).tolist() == [0]


def test_pieces_of_a_large_task_are_all_remembered():
    tok = bpe.Tokenizer({bytes([k]): k for k in range(256)} | {b"ab": 256}, np.zeros(0x110000, np.uint8))
    tok._merged([b"%d" % k for k in range(400_000)])
    tok._merged([b"abc"])
    assert tok._merged([b"0", b"399999"]).tolist() == [0, 399_999]


def test_merging_looks_up_new_neighbours_only():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    tok = bpe.Tokenizer({bytes([k]): k for k in range(256)} | {b"ab": 256, b"abab": 257, b"cd": 258}, np.zeros(0x110000, np.uint8))
    joins = Counted(tok.joins)
    assert bpe.merge(b"ababxcdabab", tok.single, joins, tok.first) == [257, ord("x"), 258, 257]
    assert joins.asked <= 2 * 7  # seven merges
    assert bpe.merge(b"a", tok.single, joins, tok.first) == [ord("a")] and bpe.merge(b"aab", tok.single, tok.joins) == [ord("a"), 256]


def test_marks_behind_a_word_do_not_send_it_to_the_tokenizer_again():
    import public_tokenizers

    class Spied:
        def __init__(self, real):
            self.real, self.asked = real, []

        def encode(self, text, **options):
            self.asked.append(text)
            return self.real.encode(text, **options)

    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    real, words.tokenizer = words.tokenizer, Spied(words.tokenizer)
    text = " ".join(f"{w}{m}" for w in ("plain", "Éleveß", "word") for m in ("$$$", ".", "!?", ").,"))
    text += " it's. don't, 3. é. ... x.. a,b, naïve, end."
    want = np.array(real.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.encode(words.of(text)) == want
    assert not any("plain" in x or "leve" in x or "word" in x for x in words.tokenizer.asked)
