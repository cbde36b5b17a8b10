"""Words encoded together have the tokens and pieces they have alone."""

import public_tokenizers as P

from orderflow.llm import quality


def vocabularies():
    return quality.read_bytes(P.path(quality.BYTE_BPE)), quality.read_bytes(P.path(quality.PIECE_BPE))


def kept(words):
    return [list(x) for x in (words.tokens, words.ends, words.pieces, words.fallbacks)]


def test_together_as_alone():
    texts = ["the cat's 12.5% (ab) don't ÀÉß žluť a", "x" * 3000 + " 's 're ,, <s> </s> it", "plain", "ﷺ a b ▁c ¨ \x01 ​ 漢字", "ŉ ŀ ~ ` ſ"]
    together, alone = quality.Words(*vocabularies()), quality.Words(*vocabularies())
    alone.begins = None
    for text in texts:
        for w in (together, alone):
            for word in text.encode().split():
                w[word]
            w.settle()
    assert kept(together) == kept(alone) and together.held == alone.held and len(together) == len(together.pieces)


def test_plain_words_take_one_call_a_vocabulary():
    words = quality.Words(*vocabularies())
    calls, whole = [], words.bpe
    words.bpe = type("Counted", (), {"encode_ordinary": lambda self, text: calls.append(text) or whole.encode_ordinary(text)})()
    quality.measure(b"one two three four " * 3 + "fünf".encode(), "en", words, quality.BANDS)
    assert calls == [" one two three four fünf"]
