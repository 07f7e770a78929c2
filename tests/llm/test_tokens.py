"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from strideflow.llm import bpe

ODD = list("abAB.,'sS tT\n\t\r  1é É éΣσςİIı<|>ﬁ\u0085\x0b\x0c\x1c　 €漢각½ⅷŸ") + [
    "H̱", "é", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'re", "'LL"]


def library():
    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_odd_texts_agree_with_the_library(monkeypatch):
    t, rng = library(), random.Random(2)
    monkeypatch.setattr(bpe, "CUT_BITS", 3)  # cuts everywhere
    encoder = bpe.Encoder(bpe.tokenizer_path())
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(90))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert encoder.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_chunks_are_shared_and_stores_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 10)
    rng, t = random.Random(1), library()
    passage = " ".join(rng.choice(["river", "stone", "Cloud,", "tree."]) + str(rng.randrange(99)) for _ in range(3000))
    encoder = bpe.Encoder(bpe.tokenizer_path())
    a, b = "one two " + passage, "something else, longer, " + passage
    cut = lambda x: {x[i:j] for i, j in zip([0, *bpe.cuts(x)], bpe.cuts(x))}
    assert len(cut(a) & cut(b)) > 0.8 * len(cut(a))
    for text in (a, b, a):
        [ids] = encoder.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_table(odd, nothing):
    t = library()
    out = bpe.encode_digests(odd).collect()

    def row(r):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        return r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    assert sorted(map(tuple, out), key=str) == sorted(map(row, odd.collect()), key=str)
    assert bpe.encode_digests(nothing).count() == 0


def test_other_tokenizers_are_found_out(tmp_path):
    import json

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello World, it IS.\n\n  Two  blanks", "", " ", "ABC abc. Abc, x\ty", "ünï CÖDÉ 漢字 😀 end."] * 3
    lower = public_tokenizers.path("word_bpe_49k.json")
    cased = json.load(open(lower))
    cased["normalizer"] = {"type": "NFC"}
    other = str(tmp_path / "cased.json")
    json.dump(cased, open(other, "w"))
    for path, by_words, plain in ((lower, True, True), (other, True, False), (public_tokenizers.path("byte_bpe_50k.json"), False, False)):
        encoder = bpe.Encoder(path)
        assert (encoder.by_words, encoder.plain) == (by_words, plain), path
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [encoder.decode(ids) for ids in encoder.encode(texts)] == [tokenizer.decode(i, skip_special_tokens=False) for i in got]
