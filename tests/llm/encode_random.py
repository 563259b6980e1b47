"""Random texts against whole-text encoding: run by test_encoding.py in processes with different hash seeds."""

import random
import sys

import public_tokenizers
from tokenizers import Tokenizer

from tablewright.llm.encoding import OTHER_SPACE, Encoder

PARTS = ["SERİ", "İİ", "BELEDİYESİ", "x", "z", "x²", "¼", "ß", "é", "é", "don't", "'s", "It'S", "..", ".", ",", ",.", "a,b", "12", "3.5", "word", "Word", "ⅷ", "한글", "日本", "ﬁ", "́", "<|endoftext|>", "<|", "\x01", "\x01\x01", "ā", "😀", "ª.", "µ,", "ŉ.", "ǅ.", "а.", "١,", "​", "﻿", "­", "?!", "(a)", "Ünïcode$$$", "ÅÉÎ_-", "ȺȾ.", "aóa&&&", "a<b", "a.<|", "[x]\\", "a\x02b", "ŉŉ", "ªº!", "Ñ's"]
GAPS = [" "] * 12 + ["\n"] * 3 + ["", "", "  ", " \n", "\n\n", "\n ", *OTHER_SPACE]


def main(seed: int, count: int) -> None:
    rng = random.Random(seed)
    texts = ["SERİ, ab", "İİ.", "BELEDİYESİ. ab", "x\rz, \x85", "x²\r, \x85", "", " ", "\n"]
    plain = [g for g in GAPS if g in (" ", "\n")]
    for k in range(count):
        gaps = GAPS if k % 2 else plain
        texts.append("".join(rng.choice(PARTS) + rng.choice(gaps) for _ in range(rng.randrange(1, 9))).strip(" \n" if k % 4 == 0 else "\0"))
    for name, kind in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")):
        coder, whole = Encoder(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name))
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            for text, ids, want in zip(part, coder.encode(part), whole.encode_batch(part, add_special_tokens=False), strict=True):
                assert ids.tolist() == want.ids, (name, text)


if __name__ == "__main__":
    main(int(sys.argv[1]), int(sys.argv[2]))
