"""Token counts and round trips by a tokenizer file, in Arrow UDFs; one tokenizer for each Python worker."""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _default() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SLICE = 1 << 18  # characters that are encoded at once: an encoding takes some hundred bytes a token


def _slices(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in order, null as empty, in runs of SLICE characters or one longer text."""
    run, size = [], 0
    for v in texts:
        v = v or ""
        if run and size + len(v) > SLICE:
            yield run
            run, size = [], 0
        run.append(v)
        size += len(v)
    if run:
        yield run


def _encoded(path: str, texts: pd.Series) -> Iterator[tuple[str, list[int]]]:
    """Each text with its ids; the encodings of one slice are held at a time."""
    for run in _slices(texts):
        for v, e in zip(run, _tokenizer(path).encode_batch_fast(run, add_special_tokens=False)):
            yield v, e.ids


def bpe_counts(c: Column, path: str | None = None) -> Column:
    """Number of ids of each text; null counts as empty."""
    path = path or _default()

    def go(x: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for _, ids in _encoded(path, x)], dtype="int64")

    return F.pandas_udf(go, LongType())(c)


def bpe_round_trip(c: Column, path: str | None = None) -> Column:
    """Whether decoding the ids gives the text back."""
    path = path or _default()

    def go(x: pd.Series) -> pd.Series:
        t = _tokenizer(path)
        return pd.Series([t.decode(ids, skip_special_tokens=False) == v for v, ids in _encoded(path, x)], dtype="bool")

    return F.pandas_udf(go, BooleanType())(c)


def bpe_ids(c: Column, path: str | None = None) -> Column:
    """The ids of each text, special tokens as ordinary text; null counts as empty."""
    path = path or _default()

    @F.arrow_udf(ArrayType(IntegerType()))
    def go(x: pa.Array) -> pa.Array:
        ids = [np.array(i, np.int32) for _, i in _encoded(path, pd.Series(x.to_pylist(), dtype=object))]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    return go(c)


def special_ids(path: str | None = None) -> list[int]:
    """The ids of a tokenizer file's special tokens."""
    return sorted(_tokenizer(path or _default()).get_added_tokens_decoder())


def vocabulary_size(path: str | None = None) -> int:
    return _tokenizer(path or _default()).get_vocab_size()
