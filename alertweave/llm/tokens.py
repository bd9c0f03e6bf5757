"""Encoding texts with a byte-level BPE vocabulary through a sentencepiece model made from it.

The model is serialised directly from the vocabulary file, nothing is trained: every token becomes one piece, its
bytes mapped to printable characters, scored by its negative rank, with identity normalisation.  Sentencepiece
merges the neighbours whose union scores best, which is the merge of lowest rank.  Texts are cut into pre-tokens
first; each pre-token is encoded once for a worker and remembered in a bounded memory.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 200_000  # pre-tokens remembered by a worker
LONG = 256  # longer pre-tokens aren't remembered


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The vocabulary's place: in ``folder``, else where the public tokenizers are installed."""
    if folder is None:
        found = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(found.origin).parent) if found else "/opt/tokenizers"
    return str(Path(folder) / name)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the tokens; piece 0 is the unknown piece, so an id is its piece less 1."""
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in token)
        pieces.append(_field(1, text.encode()) + _field(2, -float(rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str):
        import sentencepiece

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("the ranks of the vocabulary have gaps")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.table = dict(enumerate(byte_characters()))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _pieces(self, words: list[str]) -> list[list[int]]:
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in words]
        return [[i - 1 for i in ids] for ids in self.model.encode(mapped, num_threads=1)]

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text; none for a null or empty one."""
        split, known = self.split, self.known
        cut = [split(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words} - known.keys())
        fresh = dict(zip(new, self._pieces(new), strict=True)) if new else {}
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w] if w in known else fresh[w]
            out.append(ids)
        for w, ids in fresh.items():
            if len(known) >= MEMORY:
                break
            if len(w) <= LONG:
                known[w] = ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker and vocabulary."""
    return Encoder(path)


def _batches(series: pd.Series, most_chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """Parts of a batch whose texts together stay small, a single long text excepted."""
    part: list[str | None] = []
    chars = 0
    for t in series:
        t = None if t is None or t != t else t
        part.append(t)
        chars += len(t or "")
        if chars >= most_chars:
            yield part
            part, chars = [], 0
    yield part


def ids_of(text: Column, path: str | None = None) -> Column:
    """array<int>: the ids of a text, without special tokens; a null or empty text has none."""
    where = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(where)
        for s in texts:
            yield pd.Series([ids for part in _batches(s) for ids in e.encode_batch(part)], dtype=object)

    return encode(text)


def count_of(text: Column, path: str | None = None) -> Column:
    """The number of ids of a text; 0 for a null or empty one."""
    where = path or vocabulary_path()

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(where)
        for s in texts:
            yield pd.Series([len(ids) for part in _batches(s) for ids in e.encode_batch(part)], dtype="int32")

    return count(text)


def text_of(ids: Column, path: str | None = None) -> Column:
    """The text of ids."""
    where = path or vocabulary_path()

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        e = encoder(where)
        return pd.Series([None if r is None else e.decode(r) for r in rows], dtype=object)

    return decode(ids)


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: one row for each document, repeated doc_ids included; other columns don't matter."""
    return documents.select("doc_id", ids_of(F.col("text"), path).alias("ids"))
