"""Vectorised text helpers for use inside Arrow tasks: slices of batches, word hashes, pre-tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
LETTER, NUMBER, SPACE = 1, 2, 3


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of slices of bytes, and the distinct slices by code. Slices are compared byte by byte, no hash stands for one."""
    length = ends - starts
    edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    packed = data[starts[0]: ends[-1]] if len(starts) and edges[-1] == ends[-1] - starts[0] else gather(data, starts, length)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(packed))])
    found = array.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of 128 bits of slices of bytes, as an array (slices, 2) of unsigned 64-bit integers.

    Up to 15 bytes and their number are 128 bits themselves, stirred by steps that can be undone, so no two short words share
    a digest; longer ones have a BLAKE2 digest.
    """
    length = ends - starts
    own = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(16, np.uint8)), 16)[starts]
    own *= np.arange(16) < length[:, None]
    own[:, 15] = np.minimum(length, 255)
    low, high = own.view("<u8").T
    low = low + mix(high ^ np.uint64(0x2545F4914F6CDD1D))
    high = high + mix(low ^ np.uint64(0xD6E8FEB86659FD93))
    low = low + mix(high)
    out = np.stack([low, high], axis=1)
    long = np.flatnonzero(length > 15)
    if len(long):
        codes, words = distinct_slices(raw, starts[long], ends[long])
        found = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in words]), "<u8").reshape(-1, 2)
        out[long] = found[codes]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def text_spans(texts: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are no ``gaps``, of a string array, null as none: bytes, starts, ends, the first run of each row (one more than rows)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # offset 0
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        raw = _LOWER[raw]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~gaps[raw]
    start = word[1:] & ~word[:-1]  # a word begins at byte i
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    if len(raw):
        start[inner] |= word[inner + 1]
    starts = np.flatnonzero(start)
    end = word[:-1] & ~word[1:]  # a word ended before byte i
    end[inner] |= word[inner] & (inner > 0)
    ends = np.flatnonzero(end)
    return raw, starts, ends, np.searchsorted(starts, offsets)


def text_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string array, null as no words.

    Returns bytes, word starts, word ends, the first word of each row (one more than rows), word digests (words, 2).
    """
    raw, starts, ends, first = text_spans(texts, lower)
    return raw, starts, ends, first, word_digests(raw, starts, ends)


def char_classes() -> np.ndarray:
    """Letter, number, white space or 0 for each code point, as the pre-token pattern sees them."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, table = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[at[m.start(): m.end()]] = kind
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins (one more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), starts


def pretoken_starts(points: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of the byte-BPE pre-token pattern begin, each text by itself.

    The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers, of other characters, each with one
    space before; white space without the last before a word; other white space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[rows] = True
    cut = np.ones(n + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut |= first
    runs = np.flatnonzero(cut)
    begin, stop = runs[:-1], runs[1:]
    gap = stop[(kind[begin] == SPACE) & ~first[stop]]  # white space that something follows
    cut[gap - 1] = True
    cut[gap[points[gap - 1] == 0x20]] = False
    quote = begin[(stop - begin == 1) & (points[begin] == 0x27) & ~first[stop]]
    quote = quote[cut[quote]]
    quote = quote[kind[quote + 1] == LETTER]
    one = points[quote + 1]
    two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
    two[first[np.minimum(quote + 2, n)]] = 0
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    e, el, r, v = (ord(c) for c in "elrv")
    length[((one == r) | (one == v)) & (two == e)] = 3
    length[(one == el) & (two == el)] = 3
    quote, length = quote[length > 0], length[length > 0]
    cut[quote + 1] = False
    cut[quote + length] = True
    return np.flatnonzero(cut[:-1])


def distinct_spans(points: np.ndarray, starts: np.ndarray, text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the spans of code points that begin at ``starts``, and the distinct spans; ``text`` is all of them in UTF-8."""
    width = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=width[1:])
    return distinct_slices(np.frombuffer(text, np.uint8), width[starts], width[np.append(starts[1:], len(points))] if len(starts) else starts)


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` given by start and length, one after another."""
    total = int(length.sum())
    shift = start - (np.cumsum(length) - length)
    return pool[np.repeat(shift, length) + np.arange(total)]


def _followed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the content of hash ``a`` with that of ``b`` behind it."""
    return mix(mix(a ^ np.uint64(0xC2B2AE3D27D4EB4F)) + b * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each stretch of ``length`` word hashes, by where it begins.

    Stretches of 1, 2, 4, … words are mixed from two halves, and those that the length is the sum of are put one behind another.
    """
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    power, size, out, have = mix(hashes), 1, None, 0
    while True:
        if length & size:
            out = power if out is None else _followed(out[: len(power) - have], power[have:])
            have += size
        if have == length:
            return mix(out[: len(hashes) - length + 1] + np.uint64(length))
        power, size = _followed(power[:-size], power[size:]), 2 * size


def sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """``of`` over each stretch of ``width`` values, in log(width) steps."""
    have, out = 1, values
    while 2 * have <= width:
        out = of(out[:-have], out[have:])
        have *= 2
    return of(out[: len(values) - width + 1], out[width - have: len(values) - have + 1]) if width > have else out


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words with one space between."""
    if not len(starts):
        return b""
    length = ends - starts + 1
    padded = np.append(raw, np.uint8(0x20))
    out = gather(padded, starts, length)
    out[np.cumsum(length) - 1] = 0x20
    return out[:-1].tobytes()
