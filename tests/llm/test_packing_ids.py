"""Token ids by units against the library, on texts that test each assumption, and on a tokenizer of another form."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from confab.llm import packing
from confab.llm.paths import tokenizer

ODD = [
    "", " ", "\n\t", "Hello, WORLD's 12,345.67!! don't <|endoftext|>x <|ENDOFTEXT|>", "a≠b é é É ſ K İ ΑΣ ς ΑΣ.", "\x00a b\x00 \x00 c", "日本語のテキスト。 12３４ ½ ²",
    "x" * 50 + " " + "y" * 16 + " " + "z" * 17, "a'b c's 's'T d'LL'", " non break em　ide", "🙂🙂 a🙂b", "foo\x1cbar\x85baz q", "1'2'3 'd1", "ªº µ", "á́b.́c 5́ '́s", "ﬁ ǅ", "...,,;;--", "x" * 300_000,
]


def ids_of(t, texts):
    return [[*x.ids, 0] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_by_units():
    r = random.Random(1)
    letters = list("aabcdzAZ'.,;:?!09 \t\n<|>&-̸́é ßİ日ς\x00") + ["'s", "'re", "'LL"]
    texts = ODD + ["".join(r.choices(letters, k=r.randrange(40))) for _ in range(5000)]
    table = packing.TextIds(tokenizer("word_bpe_49k.json"), max_units=500)
    assert table.by_unit
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for k in range(0, len(texts), 1000):  # the table starts anew on the way
        part = texts[k : k + 1000]
        ids, at = table.encode(part, 0)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == ids_of(t, part)
    ids, at = table.encode([], 0)
    assert len(ids) == 0 and at.tolist() == [0]


def test_ids_of_a_tokenizer_of_another_form():
    """A cased byte-level vocabulary, whose tokens hold blanks, goes to the library whole."""
    table = packing.TextIds(tokenizer("byte_bpe_50k.json"))
    assert not table.by_unit
    ids, at = table.encode(ODD, 0)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == ids_of(Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), ODD)


def test_sets_of_three_are_fixed():
    """Nothing but one long item with two others: the reduction fixes a set of three."""
    n = np.zeros(21, np.int64)
    n[[10, 6, 4]] = 1, 1, 1
    rest, fixed = packing.reduce_dominated(n, 20)
    assert rest.sum() == 0 and fixed == [((10, 6, 4), 1)]
    n = np.bincount([10, 6, 6, 6, 4, 4, 4, 10, 10], minlength=21)
    rest, fixed = packing.reduce_dominated(n, 20)
    assert sum(k for _, k in fixed) == 3 or rest.sum() > 0
