from array import array

import public_tokenizers
from tokenizers import Tokenizer

from cohortlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "word", "Word.", "word,%%%", "don't", "it's.", "word'.", "'s", "x&&&", "###", "<|endoftext|>", "a<|endoftext|>b.", "A<|>", "ÉCOLE!!", "été.", "ΣΑΣ.", "straße$$", "İx.", "日本語。", "日本.", "1234", "a1.", "́.", "ﬁn|", "x y", "한국어!", "ªº.", "a̸>", "x y.", "𠀀𠀀.", "tab\tb.", "ⅷ.", "ʰx,"]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, units, **how):
        self.given += len(units)
        return self.tokenizer.encode_batch_fast(units, **how)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_units_of_any_kind_have_the_ids_of_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    ids = packing.WordIds(tokenizer, "H", True)
    texts = [*ODD, " ".join(ODD), "\n".join(u for u in ODD if "<" not in u and "Σ" not in u), *[f"{u} w{i}" for i, u in enumerate(ODD)]]
    want = [array("H", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert ids(texts) == want and [ids([t])[0] for t in texts] == want
    ids.known, ids.old = {}, ids.known
    assert ids(texts) == want


def test_new_words_are_encoded_many_at_once():
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    words = [letters(i) for i in range(5000)]
    texts = [" ".join(words[:2500]), " ".join(w + m for w, m in zip(words, ["###", ".", ",%%%", "&&&", ""] * 1000, strict=True))]
    counting = Counting(Tokenizer.from_file(PATH))
    got = packing.WordIds(counting, "H", True)(texts)
    assert counting.given < 50
    assert got == [array("H", counting.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
