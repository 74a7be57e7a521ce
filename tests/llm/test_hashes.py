"""Words built by exchanging two letters over and over stay apart everywhere."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm.op02_token_counts import token_counts
from tagloom.llm.op05_packing import pack
from tagloom.llm.op06_ngram_join import jaccard_components
from tagloom.llm.op08_line_dedup import without_repeated_lines
from tagloom.llm.op10_decontamination import contamination
from tagloom.llm.texts import span_hashes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def swapped(rounds, a="a", b="b"):
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def hashes(words):
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return span_hashes(np.frombuffer(" ".join(words).encode(), np.uint8), starts, ends).tolist()


def test_hashes_of_exchanged_letters_differ():
    words = [w for n in range(17) for pair in ("ab", "xy", "ac") for w in swapped(n, *pair)]
    words += [w[k:] for w in swapped(9) for k in range(1, 20)]
    assert len(set(hashes(words))) == len(set(words))
    assert hashes(words) == [hashes([w])[0] for w in words]  # place in the buffer does not matter


def test_hashes_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, rng.integers(1, 40))) for _ in range(5000)]
    found = {}
    for w, h in zip(words, hashes(words)):
        assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("rounds", [8, 10, 13])
def test_operators_tell_such_words_apart(spark, rounds):
    x, y = swapped(rounds)
    tail = " b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, x + tail), (2, y + tail), (3, x), (4, y), (5, x + tail)], "doc_id long, text string").coalesce(1)
    coder = Tokenizer.from_file(VOCABULARY)
    ids = {r.doc_id: coder.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, VOCABULARY).collect()} == {k: len(v) for k, v in ids.items()}
    for r in pack(docs, VOCABULARY, with_ids=True).collect():
        want = np.array([*ids[r.doc_id], 1], "<u4")[r.start : r.start + r.length].tobytes()
        assert bytes(r.ids) == want and r.ids_crc32 == zlib.crc32(want)
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, 5, 95, 100).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert {r.doc_id: r.text for r in without_repeated_lines(docs).collect()} == {1: x + tail, 2: y + tail, 3: x, 4: y, 5: ""}
    items = spark.createDataFrame([(1, y)], "item_id long, text string")
    assert {r.doc_id for r in contamination(docs, items).filter("n_hit > 0").collect()} == {2, 4}
