"""Repeated passages by suffix sorting: difference-cover sort, anchors, removal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _letters, _MULT, mixed, powers
from .runtime import materialise
from .words import text_chunks

GRAM = 32  # bytes of the string that an anchor is chosen by
_POS_BITS = 26
_SEGMENT = 1 << 20
BROADCAST_ENTRIES = 100_000  # of some 50 bytes each
CROWD = 4096  # distinct surroundings of one anchor beyond which its windows are compared by hash


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by the difference cover {1, 2} mod 3; values of `s` are at least 0.

    Sorts the triples at the positions not divisible by 3, recurses on their
    names if some repeat, sorts the remaining suffixes by first value and the rank
    behind it, and merges. A suffix that ends comes before one that goes on.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = np.unique(s, return_inverse=True)[1] + 1 if s.max() >= 1 << 20 else s + 1
    wide = int(t.max()).bit_length()
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])

    def triple_order(at):
        if 3 * wide <= 63:
            key = (t[at] << (2 * wide)) | (t[at + 1] << wide) | t[at + 2]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])
        else:
            order = np.lexsort((t[at + 2], t[at + 1], t[at]))
            a = at[order]
            new = np.concatenate([[0], ((t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])).astype(np.int64)])
        return order, np.cumsum(new)

    order, names = triple_order(sample)
    if names[-1] + 1 < len(sample):
        named = np.empty(len(sample), np.int64)
        named[order] = names + 1
        # the gap keeps suffixes of the first half from running into the second
        joined = np.concatenate([named[: len(one)], [0], named[len(one) :]])
        inner = suffix_array(joined)
        inner = inner[inner != len(one)]
        order = np.where(inner > len(one), inner - 1, inner)
    sorted12 = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sorted12] = np.arange(1, len(sorted12) + 1)
    zero = np.arange(0, n, 3)
    span = len(sorted12) + 2
    key0 = t[zero] * span + rank[zero + 1]
    by = np.argsort(key0, kind="stable")
    zero, key0 = zero[by], key0[by]
    sorted12 = sorted12[sorted12 < n]
    first, second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    below = np.searchsorted(t[first] * span + rank[first + 1], key0)
    if int(t.max()) ** 2 * span < 1 << 62:
        base = int(t.max()) + 1
        pack = lambda i: (t[i] * base + t[i + 1]) * span + rank[i + 2]
        below += np.searchsorted(pack(second), pack(zero))
    else:
        every = np.concatenate([second, zero])
        o = np.lexsort((np.concatenate([np.zeros(len(second)), np.ones(len(zero))]), rank[every + 2], t[every + 1], t[every]))
        is_zero = o >= len(second)
        counted = np.cumsum(~is_zero)
        add = np.zeros(len(zero), np.int64)
        add[o[is_zero] - len(second)] = counted[is_zero]
        below += add
    out = np.empty(n, np.int64)
    at0 = np.arange(len(zero)) + below
    out[at0] = zero
    free = np.ones(n, bool)
    free[at0] = False
    out[free] = sorted12
    return out


def repeated_windows(data: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Whether the window that starts at each position occurs at another start too.

    `data` holds contexts one after the other, context i at bounds[i]:bounds[i+1];
    window starts of context i are low[i]..high[i]. Suffixes are sorted and each
    window is compared with its neighbours in that order.
    """
    sizes = np.diff(bounds)
    # a separator of its own ends each context
    s = np.empty(len(data) + len(sizes), np.int64)
    ends = bounds[1:] + np.arange(len(sizes))
    keep = np.ones(len(s), bool)
    keep[ends] = False
    s[keep] = data.astype(np.int64) + len(sizes)
    s[ends] = np.arange(len(sizes))
    order = suffix_array(s)
    shift = np.arange(len(sizes))
    starts = np.zeros(len(s) + 1, np.int64)
    np.add.at(starts, low + shift, 1)
    np.add.at(starts, high + shift + 1, -1)
    valid = np.cumsum(starts)[:-1] > 0
    order = order[valid[order]]
    equal = np.zeros(max(0, len(order) - 1), bool)
    view = np.lib.stride_tricks.sliding_window_view(s, length) if len(s) >= length else None
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s) * powers(_MULT, len(s)))])
        inverse = powers(pow(_MULT, -1, 1 << 64), len(s))
        hashed = (sums[order + length] - sums[order]) * inverse[order]
    maybe = np.flatnonzero(hashed[1:] == hashed[:-1])
    for a in range(0, len(maybe), 4096):
        m = maybe[a : a + 4096]
        equal[m] = (view[order[m]] == view[order[m + 1]]).all(1)
    found = np.zeros(len(s), bool)
    found[order[:-1][equal]] = True
    found[order[1:][equal]] = True
    return found[keep]


def _sliding_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by block-wise prefix and suffix minima."""
    n = len(key)
    pad = -n % width
    full = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(full, axis=1).ravel()
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int):
    """(owner, pos, low, high, h, ctx) of the anchors of a chunk of texts.

    A window of `length` bytes is anchored at the least of its GRAM-byte strings'
    hashes (ties: the first), so equal windows have equal anchors at equal places.
    low..high are the starts of the consecutive windows that share the anchor; h is
    the hash of its string, ctx that of all bytes of those windows. Positions count
    from the chunk's start.
    """
    parts = []
    n = len(data)
    text_start = np.concatenate([[0], ends[:-1] + 1])
    for seg in range(0, max(1, n - length + 1), _SEGMENT):
        stop = min(n, seg + _SEGMENT + length - 1)
        bytes_ = data[seg:stop]
        m = len(bytes_)
        if m < length:
            break
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[bytes_] * powers(_MULT, m))])
            inverse = powers(pow(_MULT, -1, 1 << 64), m)
            gram = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: m - GRAM + 1])
        key = ((gram >> np.uint64(_POS_BITS)) << np.uint64(_POS_BITS)) | np.arange(len(gram), dtype=np.uint64)
        least = _sliding_minimum(key, length - GRAM + 1)
        at = (least & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        start = np.arange(len(at))
        owner = np.searchsorted(ends, start + seg)
        fits = start + seg + length <= ends[np.minimum(owner, len(ends) - 1)]
        start, at, owner = start[fits], at[fits], owner[fits]
        if not len(start):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        low, high, pos, who = start[first], start[last], at[first], owner[first]
        with np.errstate(over="ignore"):
            ctx = (sums[high + length] - sums[low]) * inverse[low]
            ctx = mixed(ctx + mixed((high - low).astype(np.uint64)) * np.uint64(3) + mixed((pos - low).astype(np.uint64)))
        parts.append((who, pos + seg, low + seg, high + seg, gram[pos], ctx))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2)) + (text_start,)
    return tuple(np.concatenate(x) for x in zip(*parts)) + (text_start,)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and a key that stands for the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("key"))


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    def go(batches):
        for batch in batches:
            for row, rows, data, ends in text_chunks(batch, 1):
                who, pos, low, high, h, ctx, first = anchors(data, ends, length)
                base = first[who]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, rows).take(pa.array(who)), *[pa.array(x) for x in (pos - base, low - pos, high - pos, h.view(np.int64), ctx.view(np.int64))]],
                    ["key", "pos", "low", "high", "h", "ctx"],
                )

    return texts.select("key", "text").mapInArrow(go, "key long, pos long, low long, high long, h long, ctx long")


def _bounded(df: DataFrame, lists: str) -> DataFrame:
    """Broadcast a materialised table whose lists are counted to hold few entries; else join by shuffle."""
    entries = df.agg(F.sum(F.size(lists) + 1)).first()[0] or 0
    return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df


def repeated_spans(texts: DataFrame, length: int, block_bytes: int = 1 << 19) -> DataFrame:
    """(key, spans array<struct<a long, b long>>): bytes [a, b) of texts that windows repeated anywhere cover.

    Windows that can be equal share an anchor, so suffixes are dealt by anchor to
    blocks of about `block_bytes`, and each block is sorted by itself. Anchors that
    occur once have no repeated windows; surroundings that occur as a whole more
    than once are repeated altogether, and enter the sort once, as something others
    may match.
    """
    rows = materialise(_anchor_rows(texts, length), "anchors")
    # equal surroundings meet before anything is dealt by anchor alone
    place = F.struct("key", "pos", "low", "high")
    classes = rows.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    classes = materialise(classes.select("h", "ctx", "n", "at.*"), "surroundings")
    whole = classes.where("n > 1").select("h", "ctx")

    crowds = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("high") - F.col("low") + length).alias("bytes")).where("k > 1")
    crowds = materialise(crowds.select("h", (F.col("k") > CROWD).alias("crowded"), "bytes"), "crowds")
    total = crowds.where("not crowded").agg(F.sum("bytes").alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    wanted = classes.join(crowds.select("h", "crowded"), "h")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "ctx", "n", "pos", "low", "high", "crowded")).alias("list"))
    # of equal texts one is cut
    wanted = materialise(wanted.join(texts.groupBy("key").agg(F.min("id").alias("rep")), "key"), "wanted")

    def cut(batches):
        names = ["h", "ctx", "n", "low", "high", "bytes", "crowded"]
        for batch in batches:
            seen: set = set()
            out, size = [], 0
            for text, key, items in zip(batch.column(0), batch.column(1), batch.column(2)):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                raw = text.as_buffer()
                for x in items.as_py():
                    a, b = x["pos"] + x["low"], x["pos"] + x["high"] + length
                    out.append((x["h"], x["ctx"], x["n"], x["low"], x["high"], raw[a:b].to_pybytes(), x["crowded"]))
                    size += b - a
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    cuts = texts.join(_bounded(wanted, "list"), "key").where(F.col("id").eqNullSafe(F.col("rep"))).select("text", "key", "list")
    cuts = cuts.mapInArrow(cut, "h long, ctx long, n long, low long, high long, bytes binary, crowded boolean")
    cuts = materialise(cuts, "cuts")
    once = cuts.where("not crowded").withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))

    def solve(key, table):
        names = ["h", "ctx", "s", "e"]
        h, ctx = table["h"].to_numpy(), table["ctx"].to_numpy()
        _, pick = np.unique(np.stack([h, ctx]), axis=1, return_index=True)
        h, ctx = h[pick], ctx[pick]
        raw = [table["bytes"][int(i)].as_py() for i in pick]
        n, low, high = (table[c].to_numpy()[pick] for c in ("n", "low", "high"))
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        found = repeated_windows(data, bounds, bounds[:-1], bounds[:-1] + high - low, length)
        out = [[], [], [], []]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
        owner = np.searchsorted(bounds, edge[0::2], "right") - 1
        for a, b, o in zip(edge[0::2].tolist(), edge[1::2].tolist(), owner.tolist()):
            while a < b:  # a run may go on into the next surroundings
                stop = min(b, int(bounds[o + 1]))
                if n[o] == 1:
                    for column, x in zip(out, (h[o], ctx[o], a - bounds[o] + low[o], stop - 1 - bounds[o] + low[o])):
                        column.append(int(x))
                a, o = stop, o + 1
        return pa.table([pa.array(c, pa.int64()) for c in out], names)

    found = once.drop("crowded").groupBy("block").applyInArrow(solve, "h long, ctx long, s long, e long")

    def windows(batches):
        for batch in batches:
            for h, ctx, n, low, high, raw in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                data = np.frombuffer(raw, np.uint8)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[data] * powers(_MULT, len(data)))])
                    w = mixed((sums[length:] - sums[:-length]) * powers(pow(_MULT, -1, 1 << 64), len(sums) - length))
                k = len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, h)), pa.array(np.full(k, ctx)), pa.array(np.full(k, n)), pa.array(np.arange(low, low + k)), pa.array(w.view(np.int64))], ["h", "ctx", "n", "o", "w"]
                )

    # crowded anchors: equal windows lie at equal distance from their anchor
    crowd = cuts.where("crowded").drop("crowded").dropDuplicates(["h", "ctx"]).mapInArrow(windows, "h long, ctx long, n long, o long, w long")
    twice = crowd.groupBy("h", "o", "w").agg(F.sum("n").alias("m")).where("m > 1").select("h", "o", "w")
    alike = crowd.where("n = 1").join(twice, ["h", "o", "w"]).select("h", "ctx", F.col("o").alias("s"), F.col("o").alias("e"))

    every = whole.select("h", "ctx", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e")).unionByName(found).unionByName(alike)
    every = materialise(every, "repeats")
    spans = rows.join(every, ["h", "ctx"]).select(
        "key", (F.col("pos") + F.coalesce("s", "low")).alias("a"), (F.col("pos") + F.coalesce("e", "high") + length).alias("b")
    )
    # a text that occurs more than once has its spans as often
    return spans.groupBy("key", "a").agg(F.max("b").alias("b")).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept binary) of every row.

    Every byte that is covered by a `length`-byte string which also starts anywhere
    else, in the same text or another, is removed; overlaps count, matches never
    cross texts, and strings are judged on the input. n_spans counts the maximal
    removed runs. Texts are UTF-8 bytes; a null text is empty. Ids may be null or
    repeat: rows are judged one by one, and equal texts alike. Other columns are
    ignored. An empty table gives no rows.
    """
    texts = _texts(docs, id_col, text_col)
    spans = materialise(repeated_spans(texts, length), "spans")
    joined = texts.join(_bounded(spans, "spans"), "key", "left").select("id", "text", "spans")
    kind = dict(texts.dtypes)["id"]

    def cut(batches):
        for batch in batches:
            out, kept_texts = [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in spans.as_py() or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                if keep_text:
                    kept_texts.append(left)
            columns = [pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(kept_texts, pa.binary())] if keep_text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
