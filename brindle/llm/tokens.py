"""Token ids of whole texts: cut into fragments that are encoded independently, each distinct one once."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .common import text_buffers
from .merges import Merges

#: Fragments a worker remembers in each of two generations: one that is asked for again moves to the younger.
CACHED = 250_000
#: Bytes of text that are cut, encoded and joined at once.
TEXT_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, bool)
MARK[list(b",.;:!?|")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The White_Space property, which \\s stands for in the files' patterns, as part of a class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_loaded: dict[tuple, FragmentEncoder] = {}


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; executors look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """The values of about the last CACHED keys asked for, and at most as many older ones."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def find(self, keys: list[bytes], make) -> list[bytes]:
        """The value of each key; ``make`` gives those of keys that aren't known."""
        found = list(map(self.young.get, keys))
        missing = [k for k, v in zip(keys, found, strict=True) if v is None]
        if missing:
            older = list(map(self.old.get, missing))
            new = [k for k, v in zip(missing, older, strict=True) if v is None]
            made = iter(make(new) if new else ())
            values = [next(made) if v is None else v for v in older]
            if len(self.young) + len(missing) > CACHED:
                self.young, self.old = {}, self.young
            self.young.update(zip(missing, values, strict=True))
            rest = iter(values)
            found = [next(rest) if v is None else v for v in found]
        return found


class FragmentEncoder:
    """Encodes texts as the tokenizers library does without special tokens, by fragments.

    Fragments end where a token ends whatever stands around: cuts() says where. A text that holds one of the added tokens
    is encoded whole, by whole(). Words of ASCII letters are merged in numpy, all new ones of a slice at once; other
    fragments are left to other().
    """

    #: Whether white space before a word is part of its first token.
    spaces = False
    #: What the vocabulary appends to a word's last byte.
    end = "</w>"

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        self.path, self.vocabulary = path, model["vocab"]
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.merges = Merges(self.vocabulary, model["merges"], self.end)
        self.known = Cache()
        self._library = None
        split = [x["pattern"]["Regex"] for x in (self.spec["pre_tokenizer"] or {}).get("pretokenizers", ()) if x["type"] == "Split"]
        self.pretokens = regex.compile(split[0].replace("\\s", WHITE)).findall if split else None

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a fragment starts at each byte after the first: ASCII white space after something else, marks after ASCII letters."""
        space = SPACE[data]
        return (space[1:] & ~space[:-1]) | (MARK[data[1:]] & LETTER[data[:-1]])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def other(self, fragments: list[str]) -> list[bytes]:
        """Ids of each fragment; beyond Latin-1, where letters must be composed and lower-cased first, the library's."""
        if self.pretokens is None:
            return self._by_library(fragments)
        near = [max(f) < "\u0100" for f in fragments]
        made = iter(self._cut_and_merged([[t.encode() for t in self.pretokens(f.lower())] for f, x in zip(fragments, near, strict=True) if x]))
        rest = iter(self._by_library([f for f, x in zip(fragments, near, strict=True) if not x]))
        return [next(made if x else rest) for x in near]

    def _by_library(self, fragments: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(fragments, add_special_tokens=False)] if fragments else []

    def _cut_and_merged(self, tokens: list[list[bytes]]) -> list[bytes]:
        """Ids of fragments given as the pieces that the vocabulary's pattern cuts them into, of none too."""
        raw = [t for some in tokens for t in some]
        if not raw:
            return [b""] * len(tokens)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.zeros(len(data) + 1, bool)
        ends[np.cumsum([len(t) for t in raw])] = True
        self.cut_inside(data, ends)
        at = np.flatnonzero(ends)
        ids, n = self.merges.merge(data, at)
        # Pieces before each fragment's end, and ids before each piece's.
        pieces = np.searchsorted(at, np.cumsum([sum(map(len, some)) for some in tokens]), side="right")
        last, made = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], pieces))].tolist(), ids.astype("<u4").tobytes()
        return [made[4 * a : 4 * b] for a, b in zip(last, last[1:], strict=False)]

    def cut_inside(self, data: np.ndarray, ends: np.ndarray) -> None:
        """Marks further ends of pieces."""

    def _new(self, fragments: list[bytes]) -> list[bytes]:
        words = [f.lstrip(b" \t\n\v\f\r").lower() for f in fragments] if not self.spaces else fragments
        plain = [w.isalpha() or (self.spaces and w[:1] == b" " and w[1:].isalpha()) for w in words]  # of bytes: ASCII letters
        easy = [w for w, p in zip(words, plain, strict=True) if p]
        made = iter(self._merged(easy))
        rest = iter(self.other(o) if (o := [f.decode() for f, p in zip(fragments, plain, strict=True) if not p]) else ())
        return [next(made if p else rest) for p in plain]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that the vocabulary's pattern doesn't cut."""
        if not pieces:
            return []
        ids, n = self.merges.merge(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null counts as empty."""
        offsets, data = text_buffers(text)
        if any(data.tobytes().find(a.encode()) >= 0 for a in self.added):
            return self._mixed(text)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = self.cuts(data)
        start[offsets] = True
        at = np.flatnonzero(start)
        fragments = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        values = pa.array(self.known.find(fragments.dictionary.to_numpy(zero_copy_only=False).tolist(), self._new), pa.binary())
        size = np.diff(np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1]) >> 2
        indices = fragments.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(size[indices], dtype=np.int64)))
        ids = values.cast(pa.large_binary()).take(fragments.indices).buffers()[2]
        return np.frombuffer(ids, "<u4", int(ends[-1])), np.diff(ends[np.searchsorted(at, offsets)])

    def _mixed(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for t in text.to_pylist():
            t = t or ""
            one = self.whole(t) if any(a in t for a in self.added) else self.encode(pa.array([t], pa.large_string()))[0]
            parts.append(one)
            counts.append(len(one))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(counts, np.int64)


class SpacedEncoder(FragmentEncoder):
    """For byte-level vocabularies: a space belongs to the token after it."""

    spaces, end = True, ""


def encoder(name: str, kind: type = FragmentEncoder) -> FragmentEncoder:
    """One encoder a worker process and file; ``name`` is a path or the name of a public tokenizer's file."""
    if (name, kind) not in _loaded:
        _loaded[name, kind] = kind(name if os.sep in name else public_path(name))
    return _loaded[name, kind]
