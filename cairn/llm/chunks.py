"""Byte-level BPE over cached parts.

A text is cut only where the vocabulary's pre-tokenizer starts a new piece in any case: at a space that a non-space
follows, whatever stands before it; before and after a line end between characters that aren't white space; before
an ASCII mark that a letter or digit precedes. The parts are encoded apart: their ids together are those of the whole
text. Most parts are single words, which recur; each is encoded once by the library and then looked up by its
characters or bytes. The cache only saves time: a part that isn't in it is encoded.
"""

from __future__ import annotations

import base64
import gc
import json
import string
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

#: Fixed value: the pre-tokenizer's regular expression for which the cuts hold.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text to encode at a time: the more, the more parts are found to be equal before the cache is asked.
STEP = 4 << 20
#: Words that the library gets at a time.
WORDS = 4096

_SPACES = np.zeros(256, bool)
_SPACES[[*range(9, 14), *range(28, 33)]] = True
#: Bytes that begin a character which is certainly not white space.
_SOLID = ~_SPACES
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_MARKS = np.zeros(256, bool)
_MARKS[[ord(x) for x in string.punctuation]] = True
#: ASCII letters and digits.
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(x) for x in string.ascii_letters + string.digits]] = True


def _space_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character, or one that some Unicode versions take for it, starts at each place."""
    a, b, c = (np.concatenate([data, np.zeros(3, np.uint8)])[at + i] for i in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    other = ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return _SPACES[a] | two | general | other


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of all texts start; data holds their bytes end to end."""
    begins = np.zeros(len(data) + 1, bool)
    last = np.zeros(len(data) + 1, bool)  # places right after a text's last byte
    last[offsets[1:]] = True
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[~last[spaces + 1]]
    begins[spaces[~_space_at(data, spaces + 1)]] = True
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    lines = np.flatnonzero(data == 10)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.where(first[lines], ord("x"), data[lines - 1])
    after = np.where(last[lines + 1], ord("x"), data[np.minimum(lines + 1, len(data) - 1)])
    lines = lines[(before < 128) & ~_SPACES[before] & _SOLID[after]]
    begins[lines] = True
    begins[lines + 1] = True
    marks = np.flatnonzero(_MARKS[data])
    marks = marks[~first[marks]]
    one, two = data[marks - 1], data[np.maximum(marks - 2, 0)]
    begins[marks[_PLAIN[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)) | (((two == 0xC4) | (two == 0xC5)) & (one >= 0x80))]] = True
    return np.flatnonzero(begins[:-1])


class ChunkEncoder:
    """encode(column) gives each text's ids as an array of unsigned 32-bit integers.

    many: ids of each of some strings, as bytes of little-endian 32-bit integers. whole: whether texts must not be cut.
    A column's parts are told apart by their bytes; each different one is then looked up, or encoded and kept. Parts
    over longest characters aren't kept; when limit parts are kept, they become the old ones, of which those that
    recur are kept on, and the former old ones go.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], limit: int = 400_000, longest: int = 64, whole: bool = False):
        self.many, self.limit, self.longest, self.uncut = many, limit, longest, whole
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Keep the ids of missing parts; those of the parts that are too long are the result."""
        kept, old, longest = self.kept, self.old, self.longest
        recalled = {x: old[x] for x in missing if x in old} if old else {}
        kept |= recalled
        fresh = [x for x in missing if len(x) <= longest and x not in recalled]
        kept.update(zip(fresh, self.many(fresh), strict=True))
        long = [x for x in missing if len(x) > longest]
        return dict(zip(long, self.many(long), strict=True))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        if self.uncut:
            return [np.frombuffer(x, "<u4") for x in self.many(["" if x is None else x for x in column.to_pylist()])]
        gc.disable()  # so many small objects that last would be gone through again and again
        try:
            return self._encode(column)
        finally:
            gc.enable()

    def _encode(self, column: pa.Array) -> list[np.ndarray]:
        if len(self.kept) > self.limit:
            self.old, self.kept = self.kept, {}
        data, offsets = utf8(column)
        if not len(data):
            return [np.zeros(0, "<u4")] * len(column)
        starts = part_starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = parts.indices.to_numpy()
        keys = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.kept.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        extra = self._learn([keys[i] for i in missing])
        for i in missing:
            k = keys[i]
            found[i] = extra[k] if k in extra else self.kept[k]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, base = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[which]
        to = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(base[which] - to[:-1], counts) + np.arange(to[-1])]
        ends = to[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


#: Bytes of words of Latin letters: ASCII letters, and characters from U+00C0 to U+023F but for two signs, see latin_words().
_LATIN = np.zeros(256, bool)
_LATIN[[ord(x) for x in string.ascii_letters]] = True
_LATIN[0x80:0xC0] = _LATIN[0xC3:0xC9] = True


def latin_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of some strings are a space and then Latin letters only; data holds their bytes end to end."""
    wrong = ~_LATIN[data]
    wrong[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    seen = np.concatenate([[0], np.cumsum(wrong)])
    first, size = offsets[:-1], np.diff(offsets)
    out = size > 1
    first = first[out]
    out[out] = (data[first] == 32) & (seen[first + 1] == seen[first + size[out]])
    return out


def _runs(base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """base[0], base[0] + 1, ... for sizes[0] numbers, then likewise for the next ones."""
    ends = np.cumsum(sizes)
    return np.repeat(base - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class ColumnEncoder(ChunkEncoder):
    """A ChunkEncoder whose kept parts are an Arrow array and their ids one numpy array.

    words: a faster many for latin_words(), of their bytes and offsets, to all ids and the number of each. The kept
    parts and a column's are told apart by their bytes in one step; new ones are encoded and kept. Parts over longest
    characters aren't kept; when over limit parts are kept, the half that most steps had goes on.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], limit: int = 400_000, longest: int = 64, whole: bool = False, words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        super().__init__(many, limit, longest, whole)
        self.words = words
        self.kept = pa.array([], pa.large_string())
        #: All kept parts' ids, and each part's first place and number there; in how many steps it was, of late.
        self.ids, self.base, self.sizes, self.steps = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def _learn(self, parts: pa.Array) -> None:
        """Encode parts and append them to the kept ones."""
        data, offsets = utf8(parts)
        fast = latin_words(data, offsets) if self.words else np.zeros(len(parts), bool)
        sizes = np.zeros(len(parts), np.int64)
        flat, order = [self.ids], np.concatenate([np.flatnonzero(fast), np.flatnonzero(~fast)])
        if fast.any():
            own = np.diff(offsets)[fast]
            ids, sizes[fast] = self.words(data[_runs(offsets[:-1][fast], own)], np.concatenate([[0], np.cumsum(own)]))
            flat.append(ids)
        if not fast.all():
            found = self.many(parts.filter(pa.array(~fast)).to_pylist())
            sizes[~fast] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat.append(np.frombuffer(b"".join(found), "<u4"))
        base = np.zeros(len(parts), np.int64)
        base[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.ids, self.base, self.sizes = np.concatenate(flat), np.append(self.base, base), np.append(self.sizes, sizes)
        self.steps = np.append(self.steps, np.zeros(len(parts), np.float32))

    def _keep(self, which: np.ndarray) -> None:
        """Forget all kept parts but those of some numbers."""
        self.kept, self.ids = self.kept.take(pa.array(which)), self.ids[_runs(self.base[which], self.sizes[which])]
        self.sizes, self.steps = self.sizes[which], self.steps[which]
        self.base = np.cumsum(self.sizes) - self.sizes

    def _encode(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = utf8(column)
        if not len(data):
            return [np.zeros(0, "<u4")] * len(column)
        starts = part_starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        old = len(self.kept)
        # the kept parts differ, so they are the dictionary's first ones, in their order
        told = pa.concat_arrays([self.kept, parts]).dictionary_encode()
        which, fresh = told.indices.to_numpy()[old:], told.dictionary[old:]
        self._learn(fresh)
        self.kept = told.dictionary
        counts = self.sizes[which]
        to = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[_runs(self.base[which], counts)]
        seen = np.zeros(len(self.kept), bool)
        seen[which] = True
        self.steps += seen
        short = pc.less_equal(pc.utf8_length(fresh), self.longest).to_numpy(zero_copy_only=False)
        if not short.all():
            self._keep(np.concatenate([np.arange(old), old + np.flatnonzero(short)]))
        if len(self.kept) > self.limit:
            half = self.limit // 2
            self._keep(np.sort(np.argpartition(-self.steps, half)[:half]))
            self.steps /= 2  # what was frequent once has to stay so
        ends = to[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_ENCODERS: dict[tuple[str, str], tuple] = {}


def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a local rank file, and a ChunkEncoder over it; one of each per process.

    With another pattern than PATTERN texts aren't cut: the library gets them whole.
    """
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain = own.encode_ordinary
        _ENCODERS[path, pattern] = own, ChunkEncoder(lambda parts: [np.array(plain(x), "<u4").tobytes() for x in parts], limit=100_000, whole=pattern != PATTERN)
    return _ENCODERS[path, pattern]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others as characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def file_tokenizer(path: str) -> ChunkEncoder:
    """A ChunkEncoder over a tokenizers file, special tokens' strings taken as text; one per process.

    Latin words go straight to the file's model, as they are one piece; other parts go through the whole tokenizer.
    Files with another pre-tokenizer or model than the plain byte-level ones get whole texts.
    """
    if (path, "") not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        steps = json.loads(own.to_str())
        cut = steps["normalizer"] is None and steps["model"]["type"] == "BPE" and steps["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        small = array("I").itemsize == 4 and sys.byteorder == "little"
        tokenize, spelled = own.model.tokenize, _byte_letters()

        def many(parts: list[str]) -> list[bytes]:
            out, rest = [b""] * len(parts), []
            for i, x in enumerate(parts):
                word = x[1:] if x[:1] == " " else x
                if cut and small and word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                    if not x.isascii():
                        word = word.encode().decode("latin1").translate(spelled)
                    out[i] = array("I", [t.id for t in tokenize(f"Ġ{word}" if x[0] == " " else word)]).tobytes()
                else:
                    rest.append(i)
            for i, found in zip(rest, own.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, "<u4").tobytes()
            return out

        vocabulary = own.get_vocab(with_added_tokens=False)
        lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of each token's bytes
        lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        # the model alone, over words that line ends part
        lined = Tokenizer(own.model)
        lined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        parted = spelled | {32: "\nĠ"}

        def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = []
            for low in range(0, len(offsets) - 1, WORDS):
                block = data[offsets[low] : offsets[min(low + WORDS, len(offsets) - 1)]].tobytes()
                block = block.decode().replace(" ", "\nĠ") if block.isascii() else block.decode("latin1").translate(parted)
                out.append(np.array(lined.encode_batch_fast([block], add_special_tokens=False)[0].ids, "<u4"))
            ids = np.concatenate(out)
            ends = np.cumsum(lengths[ids])  # tokens spell bytes, so a word's last one ends where the word does
            after = np.searchsorted(ends, offsets[1:], side="right")
            if not np.array_equal(ends[after - 1], offsets[1:]):
                raise ValueError("tokens don't spell their words")
            return ids, np.diff(after, prepend=0)

        model = steps["model"]
        spells = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")) and all(x in vocabulary for x in spelled.values())
        _ENCODERS[path, ""] = (ColumnEncoder(many, whole=not cut, words=words if cut and spells else None),)
    return _ENCODERS[path, ""][0]
