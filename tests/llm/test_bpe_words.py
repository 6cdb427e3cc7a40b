"""Words are merged by pre-token, once each, and equal to the library's whatever stands in them."""

import random

from spliceflow.llm import bpe


def test_letters_are_merged_once():
    enc = bpe.Encoder(bpe.vocabulary())
    met, merge = [], enc.words.merge
    enc.words.merge = lambda word: met.append(word) or merge(word)
    enc.many(["Entiwh, entiwh. ENTIWH! (entiwh) entiwh", "entiwh;\nÉleeau élEEAU..."])
    assert met == ["entiwh", "Ã©leeau"]


def test_words_met_again_are_kept(monkeypatch):
    met, made = [], bpe._Words.made
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    monkeypatch.setattr(bpe._Words, "made", lambda self, word: met.append(word) or made(self, word))
    enc = bpe.Encoder(bpe.vocabulary())
    for text in ("entiwh often", "entiwh", "entiwh", "entiwh"):  # each text finds the limit reached
        enc.many([text])
    assert met == ["entiwh", "often"]
    assert "often" not in enc.words and "often" not in enc.words.old
    enc.many(["often"])
    assert met == ["entiwh", "often", "often"]


def test_odd_words_match_the_library():
    enc, library, r = bpe.Encoder(bpe.vocabulary(), leaf=64), bpe.load(bpe.vocabulary()), random.Random(7)
    plain = "abcXYZÀÖØöøÿßÉ"
    signs = plain + "×÷ªµºĀʼſKİΣςjJ059!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~̧́̌̇\x0b\x0c\x1c\x85 \x01\x00中あ🙂"
    words = ["".join(r.choice(signs) for _ in range(r.randint(1, 7))) for _ in range(3000)]
    words += ["".join(r.choice(plain) for _ in range(r.randint(1, 90))) + "".join(r.choice(signs) for _ in range(r.randint(0, 3))) for _ in range(3000)]
    words += ["<|endoftext|>", "a<|endoftext|>", "a<|", "endoftext|>", "a<|endoftext|>b", "don't", "'S", "can't.", "J̌", ""]
    texts = ["", " ", *(" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(400))]
    for text, got, whole in zip(texts, enc.many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got[:3] == (len(whole.ids), " ".join(map(str, whole.ids)), library.decode(whole.ids, skip_special_tokens=False)), text
