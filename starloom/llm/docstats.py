"""Counts over whole texts that several operators share: words, lines, character classes, repeats."""

from __future__ import annotations

import numpy as np

#: Character classes of bytes. CONTINUED bytes belong to the code point that OTHER began.
PUNCT, LOWER, UPPER, DIGIT, SYMBOL, SPACE, OTHER, CONTINUED, END, BANG, NEWLINE = range(11)
CLASSES = 11


def _table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[128:192] = CONTINUED
    table[192:] = OTHER
    for letters, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b"#*$%&|<>", SYMBOL), (b" \t\r\x0b\x0c", SPACE), (b".?", END), (b"!", BANG), (b"\n", NEWLINE)):
        table[list(letters)] = kind
    return table


TABLE = _table()
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True


class Lines:
    """Counts for every line (texts split at \\n) of a batch of texts.

    ``lines``: lines of each text; ``counts``: (line, class); ``words``: words of each line;
    ``seen``: whether the line has a word and equals an earlier line of its text;
    ``repeated``: words of the line that lie in 3-word windows found twice or more in the text.
    Words are runs without ASCII white space. Per text: ``n_words``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_distinct`` words.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        line = np.cumsum(data == 10)
        total = int(line[-1]) + 1 if len(line) else len(texts[:1])
        self.counts = np.bincount(line * CLASSES + TABLE[data], minlength=total * CLASSES).reshape(total, CLASSES)
        blank = BLANK[data]
        first = ~blank
        first[1:] &= blank[:-1]
        of_word = line[first]
        self.words = np.bincount(of_word, minlength=total)
        self.lines = np.zeros(len(texts), dtype=np.int64)
        self.n_words, self.n_distinct = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        self.n_dup_lines, self.n_repeat_words = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        seen: list[bool] = []
        marks = []
        for k, text in enumerate(texts):
            own = text.split(b"\n")
            self.lines[k] = len(own)
            earlier: set[bytes] = set()
            before = len(seen)
            for x in own:
                if x and not x.isspace():
                    seen.append(x in earlier)
                    earlier.add(x)
                else:
                    seen.append(False)
            self.n_dup_lines[k] = sum(seen[before:])
            words = text.split()
            mark, self.n_distinct[k] = repeats(words)
            self.n_words[k] = len(words)
            self.n_repeat_words[k] = int(mark.sum())
            marks.append(mark)
        self.seen = np.array(seen, dtype=bool)
        mark = np.concatenate(marks) if marks else np.zeros(0, dtype=bool)
        self.repeated = np.bincount(of_word[mark], minlength=total)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a line's values over each text."""
        ends = np.cumsum(self.lines)
        whole = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=values.dtype), np.cumsum(values, axis=0)])
        return whole[ends] - whole[ends - self.lines]


def repeats(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Which words lie in a 3-word window found twice or more, and how many distinct words there are."""
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    mark = np.zeros(n, dtype=bool)
    size = len(number)
    if n < 4 or size == n:
        return mark, size
    if size < 1 << 21:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # pairs first, so that the key of a window fits 64 bits
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        keys = pair[:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        mark[k : n - 2 + k] |= twice
    return mark, size


def code_points(text: bytes) -> int:
    """Code points that are not ASCII white space."""
    kinds = np.frombuffer(text, dtype=np.uint8)
    return int(np.count_nonzero((kinds & 0xC0) != 0x80) - np.count_nonzero(BLANK[kinds]))
