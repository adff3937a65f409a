"""First-fit decreasing packing of tokenised documents into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import Encoder

DEAL = "_deal"  # a column of the pieces only; those of the input don't come so far
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; sizes are at most `capacity`.

    Items are taken by falling size (ties: by position). A tournament tree over
    the bins holds the most room below each node, so the first bin with room is
    found in one walk down the tree. Bins are numbered in the order they open.
    """
    n = len(sizes)
    leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        need = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """A row for each piece of at most `capacity` ids: every full one, then the rest of the document."""
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("x")).dtypes)["x"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, {DEAL} long" + (", ids array<int>" if keep_ids else "")

    def cut(batches):
        encoder = _encoder(tokenizer)
        seen = 0  # rows of the task so far: tells repeated rows apart
        for whole in batches:
            row = 0
            while row < whole.num_rows:
                stop, size = row, 0
                while stop < whole.num_rows and (stop == row or size < 4 << 20) and stop - row < 4096:
                    size += len(whole.column(1)[stop].as_py() or "")
                    stop += 1
                batch = whole.slice(row, stop - row)
                row = stop
                ids, counts = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                counts = counts + 1
                stream = np.insert(ids, np.cumsum(counts - 1), end_id).astype("<u4")
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(counts[doc] - start, capacity)
                begin = (np.cumsum(counts) - counts)[doc] + start
                crc = [zlib.crc32(stream[a : a + k].tobytes()) for a, k in zip(begin.tolist(), length.tolist())]
                out = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(doc + seen)]
                seen += len(counts)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", DEAL]
                if keep_ids:
                    out.append(pa.array([stream[a : a + k].astype(np.int32) for a, k in zip(begin.tolist(), length.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    group_docs: int = 8192,
    seed: int = 7,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences of at most `capacity` ids.

    A document is its ids, then `end_id`. It is cut only every `capacity` ids;
    full pieces are sequences of their own, and the rests are packed by
    first-fit decreasing with a tournament tree of bin capacities. Documents are
    dealt by a seeded hash of id, content and place in their task to groups of about
    `group_docs`, and groups are packed independently, so a task's memory doesn't
    depend on the corpus, nor on an id or a text that repeats.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids with `keep_ids`). A null text counts as empty: one piece, the end
    id alone. A null or repeated doc_id is packed like any other row, and so are rows
    that repeat as a whole. Texts of any length are tokenised whole. An empty
    table gives no rows. Other columns of `docs` are ignored, whatever their names.
    """
    groups = max(1, round(docs.count() / group_docs))
    pieces = tokenised_pieces(docs, id_col, text_col, tokenizer, capacity, end_id, keep_ids)
    group = F.pmod(F.xxhash64("doc_id", "doc_tokens", DEAL, F.lit(seed)), F.lit(groups)).cast("long")
    schema = StructType([f for f in pieces.schema.fields if f.name != DEAL]).add("sequence_id", "long").add("offset", "long")

    def pack(key, frame):
        frame = frame.sort_values(["length", "doc_id", "start", DEAL], ascending=[False, True, True, True], kind="stable")
        sizes = frame["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, capacity)
        frame["sequence_id"] = (int(key[0]) << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns=["_group", DEAL])

    return pieces.withColumn("_group", group).groupBy("_group").applyInPandas(pack, schema)
