import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm.tokens import BYTE_FILE, WORD_FILE, encoder

ODD = [None, "", "a", "  a", " a b  c ", "x\n\ny", "x\n y", "a\tb  c", "\n", "a  b", "it's 12 don't", "a \nb", "café ＡＢ é Σας",
       "<|endoftext|> x<|endoftext|>y", "a\0b c", "a\x85 \x85b", "x\x1c y", "w" * 300 + " b", "naïve—x áb 你好，世界 ½a x_y", "It's o'clock 'tis x.y'z end'", "a \x01 b\x01c", "Don't. (A)... B., É!? 3.5% x')." + " <|ENDOFTEXT|>. <|endoftext|>."]


@pytest.mark.parametrize("name", [WORD_FILE, BYTE_FILE])
def test_units_give_the_library_s_ids(name):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(["a", "b", " ", "\n", "\t", "'s", "1", "!", ".", " ", "é", "."]) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    for text, ids in zip(texts, encoder(name)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_memo_stays_bounded():
    own = type(encoder(WORD_FILE))(public_tokenizers.path(WORD_FILE), limit=10, group_bytes=4)
    list(own(f"w{i} v{i} u{i}" for i in range(50)))
    assert max(len(own.seen.new), len(own.seen.old)) <= 17
