"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three transducers: the normaliser (prefix and white space), the lexicon
(a trie of pieces) and the byte fallback. A text, normalised, is composed with lexicon and fallback into
a lattice of (position, last piece) states, and its encoding is the shortest path in the tropical
semiring (weights add along a path, the least one wins). A unigram model weighs an arc by the negated score
of its piece. A BPE model allows an arc, at weight zero, only after a piece with which it forms a stable
pair: one that merging leaves as it is; all others weigh infinity. The sequence of pieces in which all neighbours are stable is the one that merging in rank order gives, so
the shortest path is the BPE encoding.

No piece has a space mark after another character, so a text divides before each run of marks and the
parts are composed one by one. Paths of short parts are kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.llm import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries that a worker keeps: paths of short parts in each of two generations, and tested pairs.
MEMO_SIZE = 300_000
STABLE_SIZE = 300_000
MEMO_LENGTH = 64


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> list[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, integer or bytes)."""
    fields, at = [], 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _number(data, at)
            value, at = data[at : at + size], at + size
        fields.append((key >> 3, value))
    return fields


class Transducer:
    """A compiled model: `encode` and `decode`."""

    def __init__(self, content: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _message(content):
            if number == 1:
                piece = dict(_message(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_message(value))
            elif number == 3:
                normalizer = dict(_message(value))
        if normalizer.get(2):
            raise ValueError("models with a character map are not supported")
        if any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.bpe = trainer.get(3, 1) == 2
        self.prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.rank = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        times = Counter(self.rank.values())
        self.tied = {p for p, r in self.rank.items() if times[r] > 1 and len(p) > 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.lexicon = self._lexicon()
        self.divides = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.stable: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _lexicon(self) -> dict:
        """The trie of pieces: one state per prefix, the piece's id under the empty key."""
        root: dict = {}
        for piece, i in self.ids.items():
            if self.pieces[i][2] == NORMAL:
                state = root
                for char in piece:
                    state = state.setdefault(char, {})
                state[""] = i
        return root

    def _surface(self, i: int) -> bytes:
        piece, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        """The input side: white space trimmed if the model says so, spaces marked, a mark put in front."""
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix else text

    def _merge(self, symbols: list[str]) -> int | None:
        """Merge the neighbours of the best rank in place, the leftmost of equal ones; where, or None."""
        ranks = [
            (rank, i)
            for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            if (rank := self.rank.get(a + b)) is not None
        ]
        if not ranks:
            return None
        i = min(ranks)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return i

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1 and self._merge(symbols) is not None:
            pass
        return symbols

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes a piece; None for one that merging never makes."""
        if piece not in self.halves:
            symbols = list(piece)
            while len(symbols) > 2 and self._merge(symbols) is not None:
                pass
            self.halves[piece] = tuple(symbols) if len(symbols) == 2 else None
        return self.halves[piece]

    def _is_stable(self, last: str, piece: str) -> bool:
        """Whether merging leaves the pair as it is; ``last`` is empty before the first piece.

        Both pieces are taken apart again, the one merged later first, in search of a merge over the
        boundary that would have come before.
        """
        for x in (last, piece):
            if len(x) > 1 and self._halves(x) is None:
                return False
        if not last:
            return True
        if last in self.tied or piece in self.tied:
            return self._merged([*last, *piece]) == [last, piece]
        rank, before = self.rank, float("inf")
        while True:
            over = rank.get(last + piece)
            if over is not None and over < before:
                return False
            a, b = (rank[last] if len(last) > 1 else -1.0), (rank[piece] if len(piece) > 1 else -1.0)
            if a > b:
                before, last = a, self._halves(last)[1]
            elif len(piece) > 1:
                # Of equal merges the left one comes first, and the boundary is left of this one.
                before, piece = b + 0.5, self._halves(piece)[0]
            else:
                return True

    def _tested(self, last: str, piece: str) -> bool:
        if len(self.stable) >= STABLE_SIZE:
            self.stable.clear()
        found = self.stable[last, piece] = self._is_stable(last, piece)
        return found

    def _arcs(self, part: str, at: int) -> list[str]:
        """What the lexicon and the byte fallback read at a position, the longest first."""
        state, end, arcs = self.lexicon, at, []
        while end < len(part) and (state := state.get(part[end])) is not None:
            end += 1
            if "" in state:
                arcs.append(part[at:end])
        if not arcs or len(arcs[0]) > 1:
            arcs.insert(0, part[at])  # to the byte fallback
        return arcs[::-1]

    def shortest_path(self, part: str) -> list[str]:
        """The pieces and unknown characters of the best path through the lattice of a part."""
        return self._stable_path(part) if self.bpe else self._best_path(part)

    def _stable_path(self, part: str) -> list[str]:
        """The path of weight zero. All arcs weigh nothing or are absent, so the lattice is composed lazily,
        longest arcs first, and the first path that arrives is a shortest one."""
        size, at, path = len(part), 0, []
        todo, dead = [iter(self._arcs(part, 0))], set()
        stable, test = self.stable, self._tested
        while True:
            last = path[-1] if path else ""
            for piece in todo[-1]:
                if not (stable[last, piece] if (last, piece) in stable else test(last, piece)):
                    continue
                to = at + len(piece)
                if to == size:
                    return [*path, piece]
                if (to, piece) in dead:
                    continue
                path.append(piece)
                at = to
                todo.append(iter(self._arcs(part, at)))
                break
            else:
                todo.pop()
                piece = path.pop()
                dead.add((at, piece))
                at -= len(piece)

    def _best_path(self, part: str) -> list[str]:
        """The path with the least sum of negated scores."""
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * len(part)
        worst = min((score for _, score, _ in self.pieces), default=0.0) - 10
        for at in range(len(part)):
            for piece in self._arcs(part, at):
                score = self.pieces[self.ids[piece]][1] if piece in self.ids else worst
                if best[at][0] - score < best[at + len(piece)][0]:
                    best[at + len(piece)] = (best[at][0] - score, at)
        path, at = [], len(part)
        while at:
            path.append(part[best[at][1] : at])
            at = best[at][1]
        return path[::-1]

    def _coded(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit numbers; unknown characters go through the byte fallback."""
        ids: list[int] = []
        for piece in self.shortest_path(part):
            i = self.ids.get(piece)
            if i is not None and self.pieces[i][2] == NORMAL:
                ids.append(i)
            elif self.bytes_:
                ids += [self.bytes_[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype="<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text without begin and end pieces; none for null and empty texts."""
        marked = self.normalise(text or "")
        memo, out = self.memo, []
        for part in self.parts.findall(marked) if self.divides else [marked] * bool(marked):
            coded = memo.get(part)
            if coded is None:
                coded = self.older.get(part) or self._coded(part)
                if len(part) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_SIZE:
                        # Keep what is still asked for: one generation is looked up before it goes.
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[part] = coded
            out.append(coded)
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that are no UTF-8 become replacement characters, the mark in front goes."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_TRANSDUCERS: dict[bytes, Transducer] = {}


def transducer(content: bytes) -> Transducer:
    """The transducer of a model file, compiled once per worker process."""
    key = hashlib.sha256(content).digest()
    if key not in _TRANSDUCERS:
        _TRANSDUCERS[key] = Transducer(content)
    return _TRANSDUCERS[key]


def _coder(content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(content)
        for batch in batches:
            texts = batch.column("content").to_pylist()
            coded = [tool.encode(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
            values = np.concatenate(coded) if coded else np.empty(0, dtype="<i4")
            same = [tool.decode(c) == t for c, t in zip(coded, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32())),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(same, type=pa.bool_()),
                ],
                names=["doc_id", "ids", "n_ids", "round_trip"],
            )

    return run


def encoded(spark: SparkSession, docs: DataFrame, model: bytes) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_ids and round_trip (decoding gives the text back).

    ``model`` is the content of a SentencePiece model file. Null and empty texts have no ids. Whole
    texts are encoded, however long. Decoding differs from the text only where that holds the space mark
    itself. Repeated rows are encoded each. An empty table gives no rows. Other columns are ignored.
    """
    common.prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_or_empty().alias("content")).mapInArrow(
        _coder(model), f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean"
    )


def decoded(spark: SparkSession, coded: DataFrame, model: bytes) -> DataFrame:
    """The rows with a column ``decoded``: the texts of ``ids``; null where the ids are null."""
    common.prepare(spark)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        tool = transducer(model)
        return pd.Series([None if x is None else tool.decode(np.asarray(x, dtype=np.int64)) for x in ids], dtype=object)

    return coded.withColumn("decoded", text("ids"))
