"""Word-by-word ids against the tokenizer on whole texts, with letters that normalising takes apart."""

import random

import pyarrow as pa
import pytest

from panelcast.llm.queries import tokenizer
from panelcast.llm.subwords import WordEncoder

PATH = tokenizer("word_bpe_49k.json")
#: Letters that become a letter and a mark in normal form or in lower case, beside plain ones.
DECOMPOSING = list("İक़ख़ज़ड़ढ़שׁשּׂאַ") + ["J̌", "H̱", "T̈", "W̊", "Y̊", "ẞ", "Σ", "ΑΣ", "ß", "ﬁ", "ǅ", "ª", "ᴬ"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def encoded(encoder, texts, end=2):
    ids, ends = encoder.encode(pa.array(["" if t is None else t for t in texts]), end)
    out = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert all(x[-1] == end for x in out)
    return [x[:-1] for x in out]


def test_known_words(whole):
    texts = ["ISPARİ.", "हरज़,", "אשׁ.", "İ,", "x.", "ABC!", "don't.", "a)b)", "Ispar. ispar,", "<|endoftext|>", "A<|ENDOFTEXT|>.", "", " \n", "\x0b\x0cone\ttwo\r"]
    assert encoded(WordEncoder(PATH), texts) == whole(texts)


def test_every_decomposing_letter_before_every_mark(whole):
    texts = [f"{a}{c}{m} {c}{m}{m} {c.lower()}{m}" for a in ("", "ab", "À") for c in DECOMPOSING for m in ".,;:!?)'\"-"]
    assert encoded(WordEncoder(PATH), texts) == whole(texts)


def test_random_strings(whole):
    rnd = random.Random(6)
    blocks = [range(32, 127), range(9, 14), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x530), range(0x590, 0x600), range(0x900, 0x980), range(0xE00, 0xE80), range(0x1E00, 0x2070), range(0x3040, 0x3100), range(0x4E00, 0x4E40), range(0xFB00, 0xFB50), range(0x1F600, 0x1F640)]
    signs = [chr(c) for b in blocks for c in b]
    encoder = WordEncoder(PATH)
    for _ in range(20):
        texts = ["".join(rnd.choice(rnd.choice([signs, DECOMPOSING, list("  .,;!?)")])) for _ in range(rnd.randint(0, 25))) for _ in range(500)]
        assert encoded(encoder, texts) == whole(texts)


def test_forgetting_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr("panelcast.llm.subwords.REMEMBERED", 20)
    encoder, rnd = WordEncoder(PATH), random.Random(7)
    for _ in range(10):
        texts = [" ".join(f"w{rnd.randint(0, 60)}{rnd.choice('.,! ')}" for _ in range(9)) + " " + "y" * 300 for _ in range(5)]
        assert encoded(encoder, texts) == whole(texts)


def test_lean_pieces_are_the_same(spark, whole, monkeypatch):
    from panelcast.llm import packing, subwords

    rnd = random.Random(11)
    texts = [" ".join("".join(rnd.choices("abcdeİ", k=rnd.randint(1, 9))) for _ in range(rnd.choice([0, 3, 6000]))) for _ in range(40)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = [sorted(map(tuple, packing.pieces(docs, PATH, end_id=1, lean=lean).collect())) for lean in (False, True)]
    assert some[0] == some[1] and sum(r[3] for r in some[1]) == sum(len(x) + 1 for x in whole(texts))
    monkeypatch.setattr(subwords, "LEAN", (40, 3))
    monkeypatch.setattr(subwords, "worker_cache", lambda name, kept={}: kept)
    lean = subwords.word_encoder(PATH, lean=True)
    assert lean is subwords.word_encoder(PATH, lean=True) and lean is not subwords.word_encoder(PATH)
    for t in texts[:-1]:
        assert encoded(lean, [t[:200]]) == whole([t[:200]])
        assert len(lean.young) <= 20 and len(lean.old) <= 20 + 60
