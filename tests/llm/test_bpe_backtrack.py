import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from contactmill.llm import bpe_backtrack, queries
from tests.llm import cases


@pytest.fixture(scope="module")
def file():
    return queries.tokenizer_file(queries.WORD_BPE)


@pytest.fixture(scope="module")
def library(file):
    return Tokenizer.from_buffer(file)


def by_merging(model, word):
    """Ids by doing the merges one by one, the lowest rank and then the leftmost pair first."""
    ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
    parts = [*word[:-1], word[-1] + (model.get("end_of_word_suffix") or "")]
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            return [model["vocab"][p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def small_file(merges, mark="</w>"):
    symbols = list(bpe_backtrack.byte_symbols())
    tokens = [*symbols, *([s + mark for s in symbols] if mark else []), *(a + b for a, b in merges)]
    split = {"type": "Split", "pattern": {"Regex": bpe_backtrack.PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges, "end_of_word_suffix": mark}
    steps = {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "normalizer": None}
    return {"model": model, **steps}


@pytest.mark.parametrize("mark", ["</w>", ""])
@pytest.mark.parametrize("seed", range(12))
def test_equals_merging_for_random_vocabularies(seed, mark, monkeypatch):
    rng = random.Random(seed)
    parts, merges, made = ["a", "b", "c", *(c + mark for c in "abc" if mark)], [], set()
    while len(merges) < 25:
        a, b = rng.choice(parts), rng.choice(parts)
        if (mark and a.endswith(mark)) or a + b in made:
            continue
        made.add(a + b)
        merges.append([a, b])
        parts.append(a + b)
    file = small_file(merges, mark)
    tokenizer = json.dumps({"version": "1.0", "added_tokens": [], **file}).encode()
    tool = bpe_backtrack.Encoder(tokenizer)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert tool.encode(word) == by_merging(file["model"], word), word


def test_equals_the_library_on_awkward_texts(file, library):
    tool, rng, vocab = bpe_backtrack.Encoder(file), random.Random(3), list(library.get_vocab())
    texts = ["", " ", "\x1c\x1da\x85b\x1fc", "ΑΣ ΑΣ", "İİ", "é ẛ̣", "can't you'll", "x<|endoftext|>y <|startoftext|>",
             "Ᲊ ՘a", "a" * 5000, "ab" * 3000, "\x00", "12 345", "日本語", "🙂🙂!!", "﻿​"]
    for _ in range(3000):
        texts.append("".join(rng.choice(vocab).replace("</w>", rng.choice(["", " "])) for _ in range(6)))
        texts.append("".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0x300, 0x3FF), rng.randint(0x1F00, 0x2100)])) for _ in range(25)))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert tool.encode(text) == ids, text
        assert tool.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memos_may_be_emptied_at_any_time(file, library, monkeypatch):
    monkeypatch.setattr(bpe_backtrack, "WORDS", 3)
    monkeypatch.setattr(bpe_backtrack, "PAIRS", 2)
    tool = bpe_backtrack.Encoder(file)
    text = "some words that are not remembered for very long, some words that are"
    assert tool.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    for change in ({"model": {"type": "Unigram"}}, {"decoder": {"type": "ByteLevel"}}, {"normalizer": {"type": "NFKC"}}):
        with pytest.raises(ValueError):
            bpe_backtrack.Encoder(json.dumps({"added_tokens": [], **small_file([["a", "b"]]), **change}).encode())


def test_query_equals_the_library(spark, library):
    rows = queries.op12_bpe_backtrack(spark, cases.folder("sf0.001")).collect()
    docs = spark.read.parquet(cases.folder("sf0.001") + "/documents.parquet").collect()
    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((d.doc_id, len(ids), *digest))
    assert sorted(map(tuple, rows)) == sorted(want)


def test_awkward_rows(spark, file, library):
    rows = bpe_backtrack.encoded(spark, cases.awkward(spark), file).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in cases.ROWS]
    assert cases.ordered((r.doc_id, r.ids) for r in rows) == cases.ordered(want)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe_backtrack.encoded(spark, cases.empty(spark), file).collect() == []
