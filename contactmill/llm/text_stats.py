"""Counts of one text that the quality operators share."""

from __future__ import annotations

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())

# Fields of `counts`, in order.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_same_as_last",
    "n_no_letter", "n_upper", "n_ascii_lower", "n_exclaim", "n_stops", "n_digits", "n_bytes", "n_lines",
    "sum_sq_word_bytes",
)


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """How many words lie in a window of three words that the text holds twice or more."""
    if len(ids) < 4:
        return 0
    if n_distinct < 2_000_000:
        key = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:
        pair = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * n_distinct + ids[2:]
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[where] >= 2
    covered = np.zeros(len(ids), dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """How many lines with a word equal an earlier line."""
    seen: set[bytes] = set()
    found = 0
    for line in raw.split(b"\n"):
        if line in seen:
            found += bool(line.strip(WHITE))
        else:
            seen.add(line)
    return found


def counts(text: str | None) -> list[int]:
    """The numbers named in FIELDS; null counts as the empty text, of which every number is 0."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        return [0, 0, symbols, *[0] * (len(FIELDS) - 3)]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    times = np.bincount(ids)
    lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    bare = np.fromiter((not w.translate(None, NO_LETTERS) for w in known), dtype=bool, count=len(known))
    per_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    return [
        len(words),
        len(raw.translate(None, WHITE).decode()),
        int(sum(per_byte[c] for c in SYMBOLS)),
        duplicate_lines(raw),
        repeated_words(ids, len(known)),
        len(known),
        int((ids[1:] == ids[:-1]).sum()),
        int(times[bare].sum()),
        int(per_byte[65:91].sum()),
        int(per_byte[97:123].sum()),
        int(per_byte[33]),
        int(per_byte[44] + per_byte[46]),
        int(per_byte[48:58].sum()),
        len(raw),
        raw.count(b"\n") + 1,
        int((lengths * lengths * times).sum()),
    ]
