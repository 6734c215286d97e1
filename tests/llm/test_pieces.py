"""Pieces between letters and marks: encoded once each, and as the library encodes the whole text."""

import random

from tokenizers import Tokenizer

from spanlight.llm import bpe
from spanlight.llm.queries import tokenizer_path
from spanlight.llm.token_files import ChunkEncoder

WORDS = ["the", "entwürfe", "été", "l'eau", "we'll", "x", "ß"]
MARKS = ["***", "%%%", ",", ".", "'", "'s", "(", "<|", "|>", "×", "÷", "´", "—", "́", "̸", "=", "1", "\t", " ", "日", "<|endoftext|>"]


def odd_texts():
    rng = random.Random(41)
    texts = ["".join(rng.choice((rng.choice(WORDS), rng.choice(WORDS).upper(), rng.choice(MARKS), " ")) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    return [None, "", *texts]


def test_words_are_learnt_once_whatever_marks_follow():
    own, learnt = ChunkEncoder(tokenizer_path(), 2), []
    learn = own.learn
    own.learn = lambda pieces: learnt.extend(pieces) or learn(pieces)
    words, marks = [a + b for a in ("ber", "tät", "lich", "ung", "heit") for b in ("en", "er", "is", "ou")], ["***", "%%%", "&&&", "###", ",", "!"]
    text = " ".join(w + m for w in words for m in marks)
    assert own([text])[0].tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert len(learnt) == len(words) + len(marks)


def test_token_ids_around_marks_equal_the_library():
    own = ChunkEncoder(tokenizer_path(), 2)
    texts = odd_texts()
    for text, ids in zip(texts, own(texts), strict=True):
        assert ids.tolist() == [*own.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text


def test_cuts_are_learnt_once_whatever_marks_follow():
    path = tokenizer_path("byte_bpe_50k.json")
    found, learnt = bpe.Vocabulary(bpe.read_vocabulary(path)), []
    learn = found.learn
    found.learn = lambda cuts: learnt.extend(cuts) or learn(cuts)
    words, marks = [a + b for a in ("Ber", "tät", "lich", "ung", "heit") for b in ("en", "er", "is", "ou")], ["***", "%%%", "&&&", "###", ",", "!"]
    text = "".join(f" {w}{m}" for w in words for m in marks)
    assert found.encode([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert len(learnt) == len(words) + len(marks)


def test_bpe_ids_around_marks_and_white_space_equal_the_library():
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(44)
    library, found = Tokenizer.from_file(path), bpe.Vocabulary(bpe.read_vocabulary(path))
    white = ["\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\x1c", "\n", "\r\n", "  ", "Â", "à", "中"]
    texts = odd_texts() + ["".join(rng.choice((rng.choice(white), rng.choice(WORDS), rng.choice(MARKS), " ")) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for text, ids in zip(texts, found.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
