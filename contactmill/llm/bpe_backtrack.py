"""BPE encoding by longest matches with backtracking, and decoding by an offset table.

A sequence of tokens is what merging by rank gives exactly when each neighbouring pair is stable: no merge
across their border would have come before the merges that made them. The encoder takes the longest token
at each place (one Aho-Corasick pass over the reversed word finds them all), steps to the next shorter one
where the pair with the token before is not stable, and goes back one token where none is left. Places from
which no way led on are marked, so each is tried once and the work is linear in the word's length.

Character classes follow the Unicode tables of Python here and of the library there. They differ only in
characters that Python's version does not know yet; the words of texts with such characters are taken from the
library's own normaliser and splitter, and encoded like all others.

Words repeat, so their ids are kept in a memo of bounded size per worker. Each document is a row of its own:
nothing is shuffled, and a lost task is encoded anew.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from contactmill.llm import common
from contactmill.llm.token_counts import byte_symbols

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
])
#: A fixed value: the word pattern of this family of files. Its words hold no white space and end at any.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Control characters at which Python's split() cuts and the pattern does not.
CONTROLS = re.compile("[\x1c-\x1f]")
#: Words and pairs that a worker remembers before it starts anew.
WORDS = 300_000
PAIRS = 1_000_000


class Encoder:
    """Encodes and decodes as the tokenizers library does with the same file.

    Taken are byte-level BPE files, with or without a mark at word ends, whose merges each make a new token
    later than its parts; normalisers NFC, Replace and Lowercase; words by a Split pattern; any added tokens
    that are matched in the raw text; no post-processor and no decoder. Other files are refused with ValueError.
    """

    def __init__(self, content: bytes):
        file = json.loads(content)
        self._read_model(file["model"])
        self._read_steps(file)
        self._read_added(file.get("added_tokens") or ())
        self.tables = Tokenizer.from_buffer(content)
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}
        self.assigned: set[str] = set()
        self.pairs: dict[tuple[int, int], bool] = {}
        self._index()

    def _read_model(self, model: dict) -> None:
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {odd or model.get('type')}")
        self.vocab, self.mark = model["vocab"], model.get("end_of_word_suffix") or ""
        size = max(self.vocab.values()) + 1
        # Rank of the merge that makes a token (-1: a single symbol) and its two parts.
        self.rank, self.parts = [-1] * size, [(-1, -1)] * size
        self.merged: dict[tuple[int, int], int] = {}
        for i, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            if self.rank[made] >= 0 or max(self.rank[a], self.rank[b]) >= i:
                raise ValueError(f"merge {i} does not make a new token of earlier ones")
            self.rank[made], self.parts[made] = i, (a, b)
            self.merged[a, b] = made
        # Words are written with one character per byte, 256 higher where the word ends with it.
        self.form = {}
        for symbol, byte in byte_symbols().items():
            for text, char in {symbol: chr(byte), symbol + self.mark: chr(byte + 256 * bool(self.mark))}.items():
                if text not in self.vocab:
                    raise ValueError(f"no token for the symbol {text}")
                self.form[self.vocab[text]] = char

    def _read_steps(self, file: dict) -> None:
        if file.get("post_processor") or file.get("decoder"):
            raise ValueError("files with a post-processor or a decoder are not read")
        step = file.get("normalizer") or {"type": "Sequence", "normalizers": []}
        self.normalisers = []
        for s in step["normalizers"] if step["type"] == "Sequence" else [step]:
            if s["type"] not in ("NFC", "Replace", "Lowercase"):
                raise ValueError(f"normaliser {s['type']}")
            pattern = s.get("pattern") or {}
            find = regex.compile(pattern["Regex"] if "Regex" in pattern else regex.escape(pattern.get("String", "")))
            self.normalisers.append((s["type"], find, s.get("content")))
        split, bytewise = (file.get("pre_tokenizer") or {}).get("pretokenizers") or ({}, {})
        plain = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
        if not plain or bytewise["type"] != "ByteLevel" or bytewise["use_regex"] or bytewise["add_prefix_space"]:
            raise ValueError("words are not found by one pattern")
        self.find = regex.compile(split["pattern"]["Regex"])
        self.bytes = byte_symbols()
        # Words of the known pattern end at white space, so what they do with runs of it need not be done.
        self.by_space = split["pattern"]["Regex"] == PATTERN
        if self.by_space:
            self.normalisers = [s for s in self.normalisers if (s[0], s[1].pattern, s[2]) != ("Replace", r"\s+", " ")]

    def _read_added(self, added: list[dict]) -> None:
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that are not matched in the raw text as they are")
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if added else None

    def _index(self) -> None:
        """The automaton, the next shorter token of each, and the texts of all tokens with their offsets."""
        automaton, known, stable = ahocorasick.Automaton(), {}, set(self.form)
        for token in sorted(range(len(self.rank)), key=self.rank.__getitem__):
            if self.rank[token] >= 0:
                a, b = self.parts[token]
                self.form[token] = self.form[a] + self.form[b]
                # A token that merging its own text does not give is never matched.
                if {a, b} <= stable and self._stable(a, b, self.rank[token]):
                    stable.add(token)
            if token in stable:
                known[self.form[token]] = token
                automaton.add_word(self.form[token][::-1], token)
        automaton.make_automaton()
        self.automaton = automaton
        self.length = [len(self.form.get(t, "")) for t in range(len(self.rank))]
        self.shorter = [-1] * len(self.rank)
        for form, token in known.items():
            ends = range(len(form) - 1, 0, -1)
            self.shorter[token] = next((known[form[:n]] for n in ends if form[:n] in known), -1)
        texts = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        each = [texts.get(i, "") for i in range(max(texts) + 1)]
        self.texts, self.offsets = "".join(each), [0]
        for text in each:
            self.offsets.append(self.offsets[-1] + len(text))

    def _stable(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of two tokens comes earlier than ``before`` and than the merges that
        made them, which are undone from the last one on. Of equal ranks the left one comes first."""
        rank, merged, parts = self.rank, self.merged, self.parts
        while True:
            across = merged.get((a, b))
            if across is not None and rank[across] < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """The pair table: whether b may follow a. Entries are worked out when first asked for."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stable(a, b, len(self.rank))
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word, which has at least one byte."""
        form = word.decode("latin-1")
        if self.mark:
            form = form[:-1] + chr(ord(form[-1]) + 256)
        n = len(form)
        longest, shorter, length = [-1] * n, self.shorter, self.length
        for end, token in self.automaton.iter(form[::-1]):
            if longest[n - 1 - end] < 0:  # the first one found at a place is the longest
                longest[n - 1 - end] = token
        out, place, token = [], 0, longest[0]
        open_ = bytearray(b"\1") * (n + 1)
        while place < n:
            while token >= 0 and not (open_[place + length[token]] and (not out or self.fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place += length[token]
                token = longest[place] if place < n else -1
            else:
                open_[place] = 0
                last = out.pop()
                place -= length[last]
                token = shorter[last]
        return out

    def normalise(self, text: str) -> str:
        for kind, find, content in self.normalisers:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = find.sub(lambda _, c=content: c, text)
            else:  # character by character: a capital sigma at a word's end is no other letter
                text = text.replace("Σ", "σ").lower()
        return text

    def _chunk(self, chunk: str) -> list[int]:
        """The ids of a piece of normalised text, through the memo of its words."""
        out: list[int] = []
        for word in self.find.findall(chunk):
            ids = self.words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode())
                if len(word) < 64:
                    if len(self.words) >= WORDS:
                        self.words.clear()
                    self.words[word] = ids
            out += ids
        return out

    def _unknown(self, text: str) -> bool:
        """Whether a text holds characters that this Python's Unicode tables do not know."""
        new = set(text) - self.assigned
        self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
        return not new <= self.assigned

    def _part(self, text: str) -> list[int]:
        """The ids of a text without added tokens."""
        out: list[int] = []
        if not text.isascii() and self._unknown(text):
            text = self.tables.normalizer.normalize_str(text) if self.tables.normalizer else text
            for word, _ in self.tables.pre_tokenizer.pre_tokenize_str(text):
                out += self.encode_word(bytes(self.bytes[c] for c in word))
            return out
        text = self.normalise(text)
        if not self.by_space or CONTROLS.search(text):
            return self._chunk(text)
        chunks = self.chunks
        for chunk in text.split():
            ids = chunks.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) < 64:
                    if len(chunks) >= WORDS:
                        chunks.clear()
                    chunks[chunk] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text; added tokens in it stand for themselves."""
        if not self.cut or not self.cut.search(text):
            return self._part(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else self._part(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The texts of the tokens with a space between, as the library joins them where a file names no decoder."""
        texts, offsets = self.texts, self.offsets
        return " ".join([texts[offsets[i] : offsets[i + 1]] for i in ids])


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The encoder of a tokenizer file, one per worker process."""
    key = hashlib.sha256(content).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def _runner(content: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(content)
        for batch in batches:
            ids = [tool.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [tool.decode(i) for i in ids]})

    return run


def encoded(spark: SparkSession, docs: DataFrame, tokenizer: bytes) -> DataFrame:
    """One row per row of docs: doc_id, ids and decoded, the text that the ids stand for.

    ``tokenizer`` is the content of a tokenizer file. Whole texts are encoded; a null text counts as empty,
    which has no ids and decodes to the empty text. Repeated rows and ties are encoded each. Null ids stay
    null. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    common.prepare(spark)
    sent = spark.sparkContext.broadcast(tokenizer)  # a file of fixed size, whatever the tables hold
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs["text"]).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _runner(sent.value)(batches)

    return rows.mapInPandas(run, SCHEMA)
