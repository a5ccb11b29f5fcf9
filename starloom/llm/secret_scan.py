"""Secret scan: three patterns, and a linear-chain CRF that tags words as begin, inside or outside a secret.

A word (a run without ASCII white space) is described by its length, its mix of characters and how often that
changes, the kinds of the words beside it, a nearby key word, and how its file looks. The CRF
learns from the stretches around what the patterns find in all documents, and from copies of them in
which what the patterns ask for is withheld: another alphabet and length of the secret, another key word,
no sign, no key word. So it tags secrets of forms that the patterns miss. Stretches of documents
without a hit, and copies in which a plain word stands for the secret, show what is none.

Viterbi covers every word of every text. Most words prefer "outside" by more than any moves
could win back, so they are outside on the best path whatever stands beside them; the chain is
solved exactly between them.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from starloom.llm import crf
from starloom.llm.common import small_batches, text_bytes
from starloom.llm.docstats import BLANK

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "crf")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that announce a secret, in lower case.
KEYS = (*NAMES, b"passphrase", b"pwd", b"bearer", b"credential", b"private_key", b"access_key", b"auth")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Stretches that the fit takes at most, of either kind; words on either side of a hit, words from a document without one (a window by design, at a drawn place); bytes of a stretch.
SAMPLE, AROUND, PLAIN, LONGEST = 3000, 12, 48, 4096
#: Copies of a stretch with a hit in which the secret or what announces it is changed, and copies of all together at least.
COPIES, VARIED = 4, 1500
#: What a span sheds at its ends.
EDGE = b"\"'`([{<>}]),;:.!?|*#%&$"

LENGTHS = np.array([1, 2, 3, 5, 8, 12, 16, 20, 24, 32, 40, 64, 128])
SHAPES = 16
TURNS = np.array([1, 2, 4, 6, 9, 14])
N_LENGTH, N_KIND, N_DIGITS, N_FILE, N_TURNS = len(LENGTHS) + 1, SHAPES, 5, 4, len(TURNS) + 1
SLOTS = ("length", "kind", "digits", "kind_before", "kind_after", "key_before", "assigned", "file", "length_kind", "turns", "turns_kind")
SIZES = (N_LENGTH, N_KIND, N_DIGITS, N_KIND + 1, N_KIND + 1, 4, 4, N_FILE, N_LENGTH * N_KIND, N_TURNS, N_TURNS * N_KIND)
FILE = SLOTS.index("file")
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
ROWS = int(OFFSETS[-1])

_LOWER, _UPPER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.int64)
_KIND[128:] = _LOWER  # letters beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = _LOWER, _UPPER, _DIGIT
_KIND[list(b"+/_=-")] = _SIGN


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def secret_parts(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The byte ranges of the secrets themselves: of an assignment its value."""
    out = []
    for start, end, kind in spans:
        if kind == 0:
            m = ASSIGN.match(text, start)
            out.append((m.start(2), m.end(2)))
        else:
            out.append((start, end))
    return out


class Words:
    """Word places and slots over a batch of texts laid end to end, one newline between them."""

    def __init__(self, texts: list[bytes]):
        whole = b"\n".join(texts)
        data = np.frombuffer(whole, dtype=np.uint8)
        blank = BLANK[data] if len(data) else np.zeros(0, dtype=bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.at = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.first = np.searchsorted(self.starts, self.at)  # first word of each text
        self.lengths = np.diff(np.append(self.first, len(self.starts)))
        n = len(self.starts)
        if not n:
            self.slots = np.zeros((0, len(SLOTS)), dtype=np.int64)
            return
        kinds = _KIND[data]
        pick = np.zeros(len(data) + 1, dtype=np.int64)
        counts = []
        for kind in range(5):
            np.cumsum(kinds == kind, out=pick[1:])
            counts.append(pick[self.ends] - pick[self.starts])
        lower, upper, digit, sign, other = counts
        pick[0] = pick[1] = 0
        np.cumsum(kinds[1:] != kinds[:-1], out=pick[2:])
        turns = np.digitize(pick[self.ends] - pick[self.starts + 1], TURNS)
        size = self.ends - self.starts
        has = (lower > 0).astype(np.int64) + 2 * (upper > 1) + 4 * (digit > 0) + 8 * (sign > 0)
        share = np.digitize(digit / size, [0.001, 0.2, 0.4, 0.7])
        text_of = np.repeat(np.arange(len(texts)), self.lengths)
        before, after = np.full(n, SHAPES), np.full(n, SHAPES)
        same = text_of[1:] == text_of[:-1]
        before[1:][same], after[:-1][same] = has[:-1][same], has[1:][same]
        key, assigned = self.marks(whole, data, same)
        mixed = np.bincount(text_of, weights=(size >= 12) & (digit > 2), minlength=len(texts)) / np.maximum(self.lengths, 1)
        place = np.digitize(mixed, [1e-9, 0.01, 0.1])[text_of]
        length = np.digitize(size, LENGTHS)
        columns = (length, has, share, before, after, key, assigned, place, length * N_KIND + has, turns, turns * N_KIND + has)
        self.slots = np.stack([c + o for c, o in zip(columns, OFFSETS)], axis=1)

    def marks(self, whole: bytes, data: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near before a word a key word stands (0: not, 1: in it, 2: next, 3: two before), and how : or = does."""
        n = len(self.starts)
        low, keyed = whole.lower(), np.zeros(n, dtype=bool)
        for name in KEYS:
            at = low.find(name)
            while at >= 0:
                keyed[np.searchsorted(self.starts, at, side="right") - 1] = True
                at = low.find(name, at + len(name))
        signs = np.flatnonzero((data == 58) | (data == 61))
        holds = np.searchsorted(self.starts, signs, side="right") - 1
        last = np.zeros(n, dtype=bool)
        inner = np.zeros(n, dtype=bool)
        ends = signs == self.ends[holds] - 1
        last[holds[ends]], inner[holds[~ends]] = True, True
        key, assigned = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        key[2:][keyed[:-2] & same[1:] & same[:-1]] = 3
        key[1:][keyed[:-1] & same] = 2
        key[keyed] = 1
        assigned[1:][last[:-1] & same] = 2
        assigned[inner] = 1
        assigned[last] = 3
        return key, assigned


def label_spans(words: Words, k: int, spans: list[tuple[int, int]], labels: np.ndarray) -> None:
    """Mark the words of text ``k`` that these byte ranges touch."""
    for start, end in spans:
        a = np.searchsorted(words.ends, words.at[k] + start, side="right")
        b = np.searchsorted(words.starts, words.at[k] + end)
        if a < b and labels[a] == OUTSIDE:
            labels[a] = BEGIN
        labels[a + 1 : b] = INSIDE


def hit_stretches(starts: np.ndarray, ends: np.ndarray, secrets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges around secrets, each with AROUND words on either side, in a text whose words lie at ``starts`` to ``ends``.

    Ranges that overlap are one while they stay within LONGEST bytes; else they meet between two secrets. Where words
    are long a range is cut within them, a quarter of LONGEST from the secret; a secret beyond half of
    LONGEST is cut too. So every secret has its stretch, and its beginning lies in it.
    """
    found: list[list[int]] = []
    until = 0
    for start, end in sorted(secrets):
        if found and start < until:  # two patterns at one place
            found[-1][1], until = max(found[-1][1], min(end, found[-1][0] + LONGEST)), max(until, end)
            continue
        a = max(0, int(np.searchsorted(ends, start, side="right")) - AROUND)
        b = min(len(ends) - 1, int(np.searchsorted(starts, end)) - 1 + AROUND)
        stop = min(end, start + LONGEST // 2)
        low, high = max(int(starts[a]), start - LONGEST // 4), min(int(ends[b]), stop + LONGEST // 4)
        if found and low < found[-1][1]:
            if high - found[-1][0] <= LONGEST:
                found[-1][1], until = max(high, found[-1][1]), end
                continue
            low = max(low, min(until, start))
            found[-1][1] = min(found[-1][1], low)
        found.append([low, max(high, low + 1)])
        until = end
    return [(low, high) for low, high in found]


def fit_secrets(docs: DataFrame, sample: int = SAMPLE) -> crf.Chain:
    """Fit the CRF on at most ``sample`` stretches around hits of the patterns and as many without any.

    The patterns run over all documents, in one pass that gives both kinds; of the stretches those with the
    smallest hash are taken, equal ones once, so that rows that repeat weigh no more than others. Without any hit all
    weights are 0 and nothing is tagged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.count()
    part = min(1_000_000, int(2_000_000 * sample / max(total, 1)) + 1)
    rows = docs.select(text_bytes().alias("text"), F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)).alias("draw"))
    # the tables' engine leaves out the rows that no pattern can match, but for those that may give a plain stretch
    may_hit = F.col("text").cast("string").rlike(r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{32}")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            words = Words(texts)
            out: list[list] = [[], [], []]
            for k, (text, draw) in enumerate(zip(texts, batch.column(1).to_pylist())):
                a, n = words.first[k], words.lengths[k]
                if not n:
                    continue
                starts, ends = words.starts[a : a + n] - words.at[k], words.ends[a : a + n] - words.at[k]
                secrets = secret_parts(text, base_spans(text))
                ranges = hit_stretches(starts, ends, secrets)
                if not secrets and draw < part:
                    at = int(draw) % max(1, n - PLAIN + 1)
                    low, high = int(starts[at]), int(ends[min(n, at + PLAIN) - 1])
                    ranges = [(low, min(high, low + LONGEST))]
                for low, high in ranges:
                    for column, value in zip(out, (text[low:high], int(words.slots[a, FILE] - OFFSETS[FILE]), bool(secrets))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_())], ["stretch", "file", "hit"])

    found = rows.where(may_hit | (F.col("draw") < part)).mapInArrow(stretches, "stretch binary, file int, hit boolean")
    first = F.row_number().over(Window.partitionBy("hit").orderBy(F.xxhash64("stretch"), "stretch"))
    drawn = found.groupBy("hit", "stretch").agg(F.min("file").alias("file")).withColumn("place", first).where(F.col("place") <= sample).orderBy("hit", "place").collect()
    hits, plain = ([(bytes(r.stretch), r.file) for r in drawn if r.hit == kind] for kind in (True, False))
    if not hits:
        return crf.Chain(np.zeros((ROWS, 3)), np.zeros((3, 3)))
    texts, spans, files = varied(hits, plain)
    words = Words(texts)
    gold = np.zeros(len(words.starts), dtype=np.int64)
    for k, own in enumerate(spans):
        label_spans(words, k, own, gold)
    slots = words.slots.copy()
    slots[:, FILE] = OFFSETS[FILE] + np.repeat(np.array(files), words.lengths)
    return crf.fit(slots, gold, words.lengths, ROWS, 3, epochs=10, batch=256, decay=2e-3)


LOWER_HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = (LOWER_HEX, UPPER_HEX, MIXED, MIXED, MIXED + "-_", MIXED + "+/")


def varied(hits: list[tuple[bytes, int]], plain: list[tuple[bytes, int]], seed: int = 5) -> tuple[list[bytes], list[list[tuple[int, int]]], list[int]]:
    """Texts, the byte ranges of their secrets, and their file bins: the stretches, and some copies of each with a secret.

    In a copy all secrets are drawn anew from another alphabet and length; then the key word is
    another one, or the sign is missing, or both are (only for long secrets), or a plain word stands in the
    place of the secret and nothing is tagged.
    """
    draw = random.Random(seed)
    texts, spans, files = [], [], []
    common = sorted({w for t, _ in plain for w in t.split() if w.isalpha() and len(w) < 16}) or [b"word"]

    def add(parts: list[bytes], secret: list[bool], file: int) -> None:
        own, at = [], 0
        for part, is_secret in zip(parts, secret):
            if is_secret:
                own.append((at, at + len(part)))
            at += len(part)
        texts.append(b"".join(parts))
        spans.append(own)
        files.append(file)

    for text, file in hits:
        found = base_spans(text)
        texts.append(text)
        spans.append(secret_parts(text, found))
        files.append(file)
        for _ in range(max(COPIES, -(-VARIED // len(hits)))):
            how = draw.choice(("alphabet", "key", "sign", "alone", "none"))
            parts, secret, last = [], [], 0
            for start, end, kind in found:
                if start < last:
                    continue
                a, b = secret_parts(text, [(start, end, kind)])[0]
                long = how == "alone" or kind != 0
                value = "".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(24 if long else 12, 64))).encode()
                value = (b"x" if value.isalpha() or value.isdigit() else b"") + value
                key = draw.choice(KEYS)
                before = text[start:a]
                if how == "key":
                    before = key + draw.choice((b"=", b": ", b" = ", b'="', b": '"))
                elif how == "sign":
                    before = key + draw.choice((b" ", b" is ", b' "'))
                elif how == "alone":
                    before = b""
                elif how == "none":
                    value, before = draw.choice(common), draw.choice((before, key + b" ", key + b": ", key + b" = "))
                parts += [text[last:start], before, value]
                secret += [False, False, how != "none"]
                last = b
            add([*parts, text[last:]], [*secret, False], file)
    for text, file in plain:
        add([text], [False], file)
    return texts, spans, files


def tag(words: Words, chain: crf.Chain) -> np.ndarray:
    """Viterbi labels of all words, solved between the words that are surely outside."""
    emissions = chain.emissions(words.slots)
    labels = np.zeros(len(emissions), dtype=np.int8)
    moves = chain.moves
    # a word may as well be OUTSIDE if that wins more than its two moves could lose
    bound = 2 * moves.max() - moves[:, OUTSIDE].min() - moves[OUTSIDE].min()
    unsure = emissions[:, OUTSIDE] - emissions[:, 1:].max(axis=1) <= max(bound, 0)
    if not unsure.any():
        return labels
    starts_text = np.zeros(len(emissions) + 1, dtype=bool)
    starts_text[words.first[words.lengths > 0]] = True
    starts_text[-1] = True
    begins = np.flatnonzero(unsure & (starts_text[:-1] | ~np.concatenate([[False], unsure[:-1]])))
    after = np.concatenate([unsure[1:], [False]])
    ends = np.flatnonzero(unsure & (starts_text[1:] | ~after)) + 1
    lengths = ends - begins
    at = np.flatnonzero(unsure)
    own = emissions[at].copy()
    head = np.cumsum(lengths) - lengths
    inner = ~starts_text[begins]
    own[head[inner]] += moves[OUTSIDE]
    tail = head + lengths - 1
    inner = ~starts_text[ends]
    own[tail[inner]] += moves[:, OUTSIDE]
    labels[at] = crf.viterbi(own, lengths, moves)
    return labels


def crf_spans(words: Words, labels: np.ndarray, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans that the tags name, per text, without quotes and stops at their ends."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    hot = np.flatnonzero(labels)
    k = 0
    while k < len(hot):
        a = b = hot[k]
        doc = int(np.searchsorted(words.first, a, side="right")) - 1
        stop = words.first[doc] + words.lengths[doc]
        while k + 1 < len(hot) and hot[k + 1] == b + 1 < stop and labels[b + 1] == INSIDE:
            k += 1
            b = hot[k]
        k += 1
        start, end = int(words.starts[a] - words.at[doc]), int(words.ends[b] - words.at[doc])
        own = texts[doc][start:end]
        start += len(own) - len(own.lstrip(EDGE))
        end -= len(own) - len(own.rstrip(EDGE))
        if start < end:
            out[doc].append((start, end))
    return out


def find_spans(texts: list[bytes], chain: crf.Chain) -> list[tuple[list, list]]:
    """For each text its base spans and all spans: (start, end, kind) in bytes; CRF spans never overlap base ones."""
    words = Words(texts)
    tagged = crf_spans(words, tag(words, chain), texts)
    out = []
    for text, more in zip(texts, tagged):
        base = base_spans(text)
        whole = list(base)
        if more:
            whole += [(a, b, 3) for a, b in more if not any(a < y and x < b for x, y, _ in base)]
            whole.sort(key=lambda s: (s[0], s[2]))
        out.append((base, whole))
    return out


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """Counts per kind, digest of the base spans, and all spans of every row.

    Spans are of whole matches, in code points, ends exclusive. A null or empty text has none.
    Rows with equal or null doc_id are scanned one by one; columns besides doc_id and text are
    not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for text, (base, whole) in zip(texts, find_spans(texts, chain) if texts else []):
                kinds = [k for _, _, k in whole]
                for column, value in zip(rows, (*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(in_code_points(text, base)).encode()).hexdigest(), joined(in_code_points(text, whole)))):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def mask_secrets(docs: DataFrame, chain: crf.Chain, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span in text replaced by ``mask``; overlapping spans become one.

    Other columns, whatever their names, stay as they are, but for n_chars, which follows a text that was
    masked. A null text stays null.
    """
    small_batches(docs.sparkSession)
    cover = mask.encode("utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = [b"" if t is None else t.encode("utf-8") for t in own]
            found = [whole for _, whole in find_spans(texts, chain)] if texts else []
            for k, whole in enumerate(found):
                if not whole:
                    continue
                out, last = [], 0
                for a, b, _ in whole:
                    if a >= last:
                        out += [texts[k][last:a], cover]
                    last = max(last, b)
                own[k] = b"".join([*out, texts[k][last:]]).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), batch.column(1), pa.array([len(w) for w in found], pa.int64())], ["text", "row", "n"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))
    masked = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("n", LongType())]))
    whole = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in whole:
        whole["n_chars"] = F.when(F.col("n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(whole["n_chars"])
    return masked.select(*[whole[c].alias(c) for c in docs.columns])
