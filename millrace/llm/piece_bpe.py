"""Byte-level BPE by a sentencepiece model that is serialised straight from a vocabulary of ranks.

Each byte is written as one printable character, each token as the characters of its
bytes, with its negative rank as score and its rank as id. Sentencepiece merges the
neighbours whose piece scores highest, the leftmost of equal ones first, which is the
order of byte-level BPE: the lowest rank first.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHED_PIECES, _CACHED_CHARS = 1_000_000, 64  # a worker's cache: so many pieces, none longer than this
_CHUNK = 1 << 18  # pieces of a long text at a time
_LONG = 1 << 20  # code points from which a text is taken in chunks


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The character of each byte, by the usual rule: printable Latin-1 stands for itself, the others follow from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return tuple(chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256))


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_characters())


def to_bytes(piece: str) -> bytes:
    """The inverse of `to_piece`."""
    return bytes(map(_inverse().__getitem__, piece))


@functools.cache
def _characters() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


@functools.cache
def _inverse() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with a line for each token: its bytes in base64, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a whole number, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE with piece i for the token of rank i.

    Ranks must be 0..n-1 and hold every single byte, so that nothing is unknown; the unknown
    piece, which a model must have, gets id n. Scores are 32-bit floats, exact to 2**24.
    The normaliser is the identity: no dummy prefix, white space kept and not escaped.
    """
    n = len(ranks)
    if sorted(ranks.values()) != list(range(n)) or n > 1 << 24:
        raise ValueError("ranks must be 0..n-1, with n at most 2**24")
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"the vocabulary lacks single bytes: {lacking[:8]}")
    # fixed values, the numbers of sentencepiece's message fields
    piece, score, kind, unknown = 1, 2, 3, 2
    model_type, bpe, unk_id, bos_id, eos_id, pad_id = 3, 2, 40, 41, 42, 43
    name, dummy_prefix, extra_spaces, escape_spaces = 1, 3, 4, 5
    out = [b""] * (n + 1)
    for token, rank in ranks.items():
        out[rank] = _field(1, _field(piece, to_piece(token).encode()) + _field(score, -float(rank)))
    out[n] = _field(1, _field(piece, b"<unk>") + _field(score, 0.0) + _field(kind, unknown))
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(model_type, bpe) + _field(unk_id, n) + _field(bos_id, none) + _field(eos_id, none) + _field(pad_id, none)
    normaliser = _field(name, b"identity") + _field(dummy_prefix, 0) + _field(extra_spaces, 0) + _field(escape_spaces, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


def latin_pattern(pattern: str) -> re.Pattern:
    """What `pattern` matches in Latin-1 texts: its classes of letters, numbers and white space written out."""
    every = "".join(map(chr, range(256)))
    for name, kind in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        members = "".join(map(re.escape, regex.findall(kind, every)))
        pattern = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m, members=members: m[1] + members, pattern)
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern.replace(r"\S", f"[^{members}]"))


class Codec:
    """Encodes pre-tokens by a serialised model, and decodes ids by the inverse of the byte characters."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # \s by property, as the pattern's own engine has it
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.latin = latin_pattern(pattern)
        self.tokens = [to_bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.whole = {token: struct.pack("<I", i) for i, token in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _matcher(self, text: str):
        """The pattern; its shorter form, which is faster, where the text has Latin-1 characters only."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern
        return self.latin

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pre-tokens that the cache lacks: a token as a whole is its own id, others are merged by the model."""
        merged = []
        for piece in pieces:
            own = self.whole.get(piece.encode())
            if own is None:
                merged.append(piece)
            else:
                self.known[piece] = own
        for piece, ids in zip(merged, self.model.encode([to_piece(x.encode()) for x in merged], num_threads=1)):
            self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def joined(self, runs: list[list[str]]) -> list[bytes]:
        """Ids of each run of pre-tokens, 4 little-endian bytes each."""
        lacking = set().union(*runs).difference(self.known)
        self._learn(lacking)
        out = [b"".join(map(self.known.__getitem__, run)) for run in runs]
        if len(self.known) > _CACHED_PIECES:
            self.known.clear()
        else:
            for piece in lacking:
                if len(piece) > _CACHED_CHARS:
                    del self.known[piece]
        return out

    def encode(self, texts: list[str]):
        """(place of the text, ids as little-endian unsigned 32-bit integers), a long text's in chunks one after the other."""
        runs, places, size = [], [], 0
        for place, text in enumerate(texts):
            if len(text) >= _LONG:
                matches = self._matcher(text).finditer(text)
                while chunk := [m.group() for m in itertools.islice(matches, _CHUNK)]:
                    yield place, self.joined([chunk])[0]
                continue
            runs.append(self._matcher(text).findall(text))
            places.append(place)
            size += len(text)
            if size >= _LONG:
                yield from zip(places, self.joined(runs))
                runs, places, size = [], [], 0
        yield from zip(places, self.joined(runs))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    """One codec, with its cache, for each Python worker."""
    key = (hash(model), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: its whole text encoded, and the ids decoded again.

    Each match of `pattern` is encoded separately, without special tokens. ids_sha256 is over the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 over the bytes that they stand for; with
    `keep_ids` also ids (array<int>) and decoded (binary). A null text counts as empty. Repeated rows
    and null ids are rows like any others; an empty table gives no rows; other columns of `docs` are
    ignored, whatever their names. A text's ids are made and hashed in chunks, so memory beyond the
    text itself doesn't depend on its length (with `keep_ids` it does). The model travels with the
    task: its size is the vocabulary's.
    """
    model = serialise_model(read_ranks(ranks_path))
    kind = docs.select(F.col(f"`{id_col}`").alias("x")).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else "")

    def run(batches):
        codec = _codec(model, pattern)
        for batch in batches:
            rows = [(hashlib.sha256(), hashlib.sha256(), []) for _ in range(batch.num_rows)]
            counts = np.zeros(batch.num_rows, np.int64)
            for place, chunk in codec.encode([text or "" for text in batch.column(1).to_pylist()]):
                ids, back, kept = rows[place]
                decoded = codec.decode(chunk)
                ids.update(chunk)
                back.update(decoded)
                counts[place] += len(chunk) // 4
                if keep_ids:
                    kept.append((chunk, decoded))
            out = [batch.column(0), pa.array(counts), *(pa.array([row[k].hexdigest() for row in rows], pa.string()) for k in (0, 1))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ids = [np.frombuffer(b"".join(chunk for chunk, _ in row[2]), "<i4") for row in rows]
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array([b"".join(part for _, part in row[2]) for row in rows], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
