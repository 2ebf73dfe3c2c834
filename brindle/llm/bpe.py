"""Byte-pair encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, whole_documents
from .merges import byte_alphabet
from .tokens import SPACE, TEXT_BYTES, WHITE, SpacedEncoder, encoder

#: What the byte-level pre-tokenizer splits by.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


class ByteBpe(SpacedEncoder):
    """A byte-level BPE vocabulary read from a tokenizers file, encoded and decoded here.

    ``inside[a, b]`` says whether the byte pair a b occurs inside any token. Where it does not, a token must end
    between them whatever merges are tried, so text is cut there and the fragments are encoded independently: everywhere
    that the pattern, too, goes on alike after the cut. That is not so after white space (the pattern looks ahead there),
    before an apostrophe (it may start a contraction) and inside a character.
    """

    def __init__(self, path: str):
        import regex

        super().__init__(path)
        alphabet = byte_alphabet()
        tokens = [b""] * (1 + max([*self.vocabulary.values(), *self.added.values()]))
        self.inside = np.zeros((256, 256), bool)
        for token, i in self.vocabulary.items():
            raw = [alphabet[c] for c in token]
            tokens[i] = bytes(raw)
            self.inside[raw[:-1], raw[1:]] = True
        for token, i in self.added.items():
            tokens[i] = token.encode()
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.pretokens = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.forced = ~self.inside
        self.forced[SPACE] = False
        self.forced[[0x80 + x for x in (*range(11), 0x05, 0x1F, 0x20, 0x28, 0x29, 0x2F)]] = False  # the last bytes of other white space
        self.forced[:, ord("'")] = False
        self.forced[:, 0x80:0xC0] = False

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return self.forced.reshape(-1)[(data[:-1].astype(np.uint16) << 8) | data[1:]]

    def whole(self, text: str) -> np.ndarray:
        """Added tokens are found first, what lies between them is encoded by itself."""
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self.encode(pa.array([text[at : m.start()]], pa.large_string()))[0], np.array([self.added[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, self.encode(pa.array([text[at:]], pa.large_string()))[0]])

    def other(self, fragments: list[str]) -> list[bytes]:
        """Pieces between the pattern's cuts, and inside them the forced ones, are merged each by itself."""
        return self._cut_and_merged([[t.encode() for t in self.pretokens(f)] for f in fragments])

    def cut_inside(self, data: np.ndarray, ends: np.ndarray) -> None:
        ends[1:-1] |= ~self.inside[data[:-1], data[1:]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each id has."""
        data = self.tokens.take(pa.array(ids, pa.uint32())).buffers()[2]
        size = self.sizes[ids]
        return np.frombuffer(data, np.uint8)[: int(size.sum())] if data is not None else np.zeros(0, np.uint8), size


def load(name: str) -> ByteBpe:
    return encoder(name, ByteBpe)


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text).

    Whole texts are encoded, then decoded from their ids; bytes that are no UTF-8 would become U+FFFD. Null texts count
    as empty (0 tokens). Every row gives one row; null and repeated doc_ids pass through.
    """

    def make(batch: pa.RecordBatch) -> dict:
        bpe = load(tokenizer)
        ids, counts = bpe.encode(batch.column("text"))
        data, size = bpe.decode(ids)
        ends = np.cumsum(counts)
        last = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))].tolist()
        raw, text = memoryview(ids.astype("<u4", copy=False).tobytes()), memoryview(data.tobytes())
        of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        decoded = [hashlib.sha256(str(text[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in zip(last, last[1:], strict=False)]
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": decoded}

    return map_arrow(whole_documents(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, limit=TEXT_BYTES)
