"""Brown class-based bigram language model: exchange clustering, training and scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import mixed, run_hashes
from .runtime import discard, materialise
from .words import text_chunks, word_hashes

END = np.uint64(0x5EED_0E0D)  # stands for the end token; unit number 0
_MERGE = 1 << 21


def _tail_units(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, frequent: int, tails: int) -> np.ndarray:
    """Unit of words by form alone: a hash of the last two bytes and of whether one byte makes up the word."""
    last = data[stops - 1].astype(np.uint64)
    before = np.where(stops - starts > 1, data[np.maximum(stops - 2, 0)], 0).astype(np.uint64)
    return 1 + frequent + (mixed(last * np.uint64(256) + before) % np.uint64(tails)).astype(np.int64)


def _stream(words: np.ndarray, owner: np.ndarray, rows: int, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of words with each text's end token put in; and the text of each."""
    counts = np.bincount(owner, minlength=rows)
    at = np.cumsum(counts)
    return np.insert(words, at, np.full(rows, end, words.dtype)), np.repeat(np.arange(rows), counts + 1)


class _Counter:
    """Counts of integer keys; keeps sorted arrays and merges when they grow."""

    def __init__(self):
        self.keys, self.counts, self.extra = [], [], None
        self.size = 0

    def add(self, keys: np.ndarray, extra: np.ndarray | None = None):
        k, first, n = np.unique(keys, return_index=True, return_counts=True)
        self.keys.append((k, n, None if extra is None else extra[first]))
        self.size += len(k)
        if self.size > _MERGE and len(self.keys) > 1:
            self.merge()

    def merge(self):
        if len(self.keys) > 1:
            keys = np.concatenate([x[0] for x in self.keys])
            n = np.concatenate([x[1] for x in self.keys])
            k, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            extra = None if self.keys[0][2] is None else np.concatenate([x[2] for x in self.keys])[first]
            self.keys = [(k, np.bincount(inverse, weights=n, minlength=len(k)).astype(np.int64), extra)]
            self.size = len(k)
        return self.keys[0] if self.keys else None


def word_counts(docs: DataFrame, frequent: int, tails: int) -> DataFrame:
    """(h, unit, n) of every word of `docs` and of the end token; unit is that of its form."""

    def go(batches):
        counter = _Counter()
        for batch in batches:
            for _, rows, data, ends in text_chunks(batch, 0):
                h, owner, low, starts, stops = word_hashes(data, ends)
                counter.add(np.append(h, np.full(rows, END)), np.append(_tail_units(low, starts, stops, frequent, tails), np.zeros(rows, np.int64)))
                if counter.size > 2 * _MERGE:
                    k, n, unit = counter.merge()
                    if len(k) > _MERGE:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(unit.astype(np.int32)), pa.array(n)], ["h", "unit", "n"])
                        counter = _Counter()
        got = counter.merge()
        if got:
            k, n, unit = got
            for a in range(0, len(k), 1 << 18):
                b = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(k[b].view(np.int64)), pa.array(unit[b].astype(np.int32)), pa.array(n[b].astype(np.int64))], ["h", "unit", "n"])

    return docs.mapInArrow(go, "h long, unit int, n long").groupBy("h", "unit").agg(F.sum("n").alias("n"))


def unit_bigrams(docs: DataFrame, known: np.ndarray, frequent: int, tails: int) -> DataFrame:
    """(pair, n): how often unit a precedes unit b, pair = a * units + b; a text starts after an end token."""
    units = 1 + frequent + tails

    def go(batches):
        counter = _Counter()
        for batch in batches:
            for _, rows, data, ends in text_chunks(batch, 0):
                h, owner, low, starts, stops = word_hashes(data, ends)
                unit, _ = _stream(_units(h, low, starts, stops, known, frequent, tails), owner, rows, 0)
                counter.add(np.append(0, unit[:-1]) * units + unit)
        got = counter.merge()
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1].astype(np.int64))], ["pair", "n"])

    return docs.mapInArrow(go, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _units(h, low, starts, stops, known: np.ndarray, frequent: int, tails: int) -> np.ndarray:
    unit = _tail_units(low, starts, stops, frequent, tails)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        unit = np.where(known[at] == h, 1 + at, unit)
    return unit


def exchange_clustering(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each unit, by the exchange algorithm.

    Starts with units dealt by frequency, then moves one unit at a time to the
    class that raises the bigram class model's likelihood most, until a round
    moves nothing or `rounds` are done. Unit 0, the end token, keeps class 0 to
    itself; units that never occur stay where they were dealt.
    """
    size = len(bigrams)
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total, kind="stable")
    order = order[order != 0]
    classes = max(2, min(classes, size))
    label = np.zeros(size, np.int64)
    label[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), label] = 1
    right, left = bigrams @ member, bigrams.T @ member  # unit x class: followed by, preceded by
    table = member.T @ right
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for u in order[total[order] > 0]:
            a = label[u]
            r, l, own = right[u].copy(), left[u].copy(), bigrams[u, u]
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            rows, cols = table.sum(1), table.sum(0)
            # value of the table with u in class b, relative to u nowhere
            gain = (xlogx(table + r[None, :]) - xlogx(table)).sum(1) + (xlogx(table + l[:, None]) - xlogx(table)).sum(0)
            d = np.diagonal(table)
            gain += xlogx(d + r + l + own) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
            out, into = r.sum() + own, l.sum() + own
            gain -= xlogx(rows + out) - xlogx(rows) + xlogx(cols + into) - xlogx(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                moved += 1
                label[u] = b
                for m, counts in ((right, bigrams[:, u]), (left, bigrams[u])):
                    m[:, a] -= counts
                    m[:, b] += counts
        if not moved:
            break
    return label


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of each word 0..len(at)-1 that an exchange move from class at[word] would choose.

    (word, code, n) are the words' distinct contexts: code c is followed by class c,
    classes + c preceded by class c, 2 * classes followed by the word itself.
    `table` holds the bigrams of classes. Each word is moved as if the others stayed.
    """
    size, k = len(at), len(table)
    dense = np.zeros((size, 2 * k + 1))
    dense[word, code] = n
    right, left, own = dense[:, :k], dense[:, k : 2 * k], dense[:, 2 * k]
    every = np.arange(size)
    gain = np.zeros((size, k))
    for flat, mine, other in ((table.T, right, left), (table, left, right)):
        w, c = np.nonzero(mine)
        x = mine[w, c]
        cells = flat[c]  # entries x classes, without the word
        cells[np.arange(len(w)), at[w]] -= x
        inside = np.flatnonzero(c == at[w])
        cells[inside] -= other[w[inside]]
        cells[inside, c[inside]] -= own[w[inside]]
        np.add.at(gain, w, _xlogx(cells + x[:, None]) - _xlogx(cells))
    d = np.tile(np.diagonal(table), (size, 1))
    d[every, at] -= right[every, at] + left[every, at] + own
    gain += _xlogx(d + right + left + own[:, None]) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    for sums, mine in ((table.sum(1), right), (table.sum(0), left)):
        count = mine.sum(1) + own
        rest = np.tile(sums, (size, 1))  # the neighbours keep theirs wherever the word is
        rest[every, at] -= count
        gain -= _xlogx(rest + count[:, None]) - _xlogx(rest)
    gain[:, 0] = -np.inf
    best = np.argmax(gain, 1)
    return np.where(gain[every, best] > gain[every, at] + 1e-9, best, at)


def _pieces(words: np.ndarray, codes: np.ndarray, start: np.ndarray):
    """Distinct (word, code) of a buffer with counts and the word's first class, as one batch."""
    order = np.lexsort((codes, words))
    words, codes, start = words[order], codes[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (codes[1:] != codes[:-1])]))
    n = np.diff(np.append(first, len(words)))
    return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(codes[first].astype(np.int16)), pa.array(n), pa.array(start[first].astype(np.int16))], ["h", "code", "n", "at"])


def word_classes(docs: DataFrame, known: np.ndarray, label: np.ndarray, joint: np.ndarray, frequent: int, tails: int, tokens: int) -> DataFrame:
    """(h, cls) of every word of `docs` that isn't `known`, by one exchange pass over all of them at once.

    A word starts in the class of its form's unit and moves to the class that its own
    contexts choose; contexts are the classes of its neighbours before the pass.
    Words are dealt by hash to groups of about 2 ** 19 of their `tokens`.
    """
    k = len(joint)

    def go(batches):
        buffer, size = [], 0
        for batch in batches:
            for _, rows, data, ends in text_chunks(batch, 0):
                h, owner, low, starts, stops = word_hashes(data, ends)
                unit, _ = _stream(_units(h, low, starts, stops, known, frequent, tails), owner, rows, 0)
                h, _ = _stream(h, owner, rows, END)
                cls = label[unit]
                i = np.flatnonzero(unit > frequent)  # never the last: texts end with the end token
                again = h[i] == h[i + 1]
                before = i[(i == 0) | (h[i] != h[i - 1])]
                at = np.concatenate([i, before])
                codes = np.concatenate([np.where(again, 2 * k, cls[i + 1]), k + np.where(before > 0, cls[before - 1], 0)])
                buffer.append((h[at], codes, cls[at]))
                size += len(at)
                if size > _MERGE:
                    yield _pieces(*map(np.concatenate, zip(*buffer)))
                    buffer, size = [], 0
        if size:
            yield _pieces(*map(np.concatenate, zip(*buffer)))

    def choose(key, got):
        h, word = np.unique(got["h"].to_numpy(), return_inverse=True)
        code, n = got["code"].to_numpy().astype(np.int64), got["n"].to_numpy()
        at = np.zeros(len(h), np.int64)
        at[word] = got["at"].to_numpy()
        pair, inverse = np.unique(word * (2 * k + 1) + code, return_inverse=True)
        n = np.bincount(inverse, weights=n)
        word, code = pair // (2 * k + 1), pair % (2 * k + 1)
        cls = np.zeros(len(h), np.int64)
        for a in range(0, len(h), 1024):
            b = min(len(h), a + 1024)
            x, y = np.searchsorted(word, [a, b])
            cls[a:b] = best_classes(word[x:y] - a, code[x:y], n[x:y], at[a:b], joint)
        return pa.table([pa.array(h), pa.array(cls.astype(np.int16))], ["h", "cls"])

    contexts = docs.mapInArrow(go, "h long, code short, n long, at short")
    parts = max(1, -(-tokens // (1 << 19)))
    return contexts.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts))).groupBy("part").applyInArrow(lambda key, got: choose(key, got), "h long, cls short")


def _flat(batch: pa.RecordBatch, n_at: int, cls_at: int):
    """(counts, classes, classes before, text) of the tokens of a batch of coded texts."""
    lists = batch.column(cls_at)
    cls = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes  # each text has its end token at least
    before = np.append(0, cls[:-1])
    before[first] = 0
    return batch.column(n_at).flatten().to_numpy(zero_copy_only=False), cls, before, np.repeat(np.arange(len(sizes)), sizes)


class BrownModel:
    """Class transitions, and what each worker needs for words of the bounded table."""

    def __init__(self, known, label, transition, class_n, class_v, table_h, table_n, train_tokens, vocabulary, frequent, tails):
        self.known, self.label, self.transition = known, label, transition
        self.class_n, self.class_v = class_n, class_v
        self.table_h, self.table_n = table_h, table_n
        self.train_tokens, self.vocabulary, self.frequent, self.tails = train_tokens, vocabulary, frequent, tails

    mix = 0.8

    def base(self, n):
        return (n + 0.1) / (self.train_tokens + 0.1 * (self.vocabulary + 1))

    def probability(self, n, trans, cls):
        """The class model and the smoothed unigrams, mixed; `n` is the word's training count."""
        emission = (n + 0.1) / (self.class_n[cls] + 0.1 * (self.class_v[cls] + 1))
        return self.mix * trans * emission + (1 - self.mix) * self.base(n)


def brown_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: int = 64,
    frequent: int = 1023,
    tails: int = 1024,
    table: int = 1 << 19,
    modulus: int = 10,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Training rows are those whose crc32(id as text) isn't divisible by `modulus`.
    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end token per
    text. Counts cover all training words. Exchange clustering begins with units:
    the `frequent` commonest words each, the end token, and all other words by
    their last two bytes (`tails` of them), so the driver holds one units x units
    table whatever the corpus. Then every other training word moves to the class
    that its own contexts choose, in one distributed pass; the classes of the
    forms are those of unseen words only. Class bigrams are counted again after
    that. The score is the sum of log10 of P(class | class before) * P(word | class), mixed
    with the smoothed unigram of `base_score`; both smoothings add 0.1.

    The commonest `table` words are sent to the tasks; the other words' counts
    and classes meet their occurrences in a join by word. Null or empty texts have the end
    token alone; a null id counts as the empty text in crc32. Repeated ids are
    scored row by row. Without training rows all counts are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == 0, F.lit(False)).alias("held_out"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    train = rows.where("not held_out").select("text")
    counts = materialise(word_counts(train, frequent, tails), "words")
    # two words with one hash differ in unit at most: they count as the commoner one's
    top = counts.orderBy(F.desc("n"), "h").limit(frequent + 1).toArrow()
    sums = counts.groupBy("unit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # at most 1 + tails rows
    train_tokens, vocabulary = int(sums["n"].to_numpy().sum()), int(sums["v"].to_numpy().sum())
    top_h = top["h"].to_numpy().view(np.uint64)
    top_n = top["n"].to_numpy()
    real = top_h != END
    known = np.sort(top_h[real][:frequent])
    units = 1 + frequent + tails
    pairs = unit_bigrams(train, known, frequent, tails).toArrow()  # at most units * units rows
    bigrams = np.zeros((units, units))
    bigrams[pairs["pair"].to_numpy() // units, pairs["pair"].to_numpy() % units] = pairs["n"].to_numpy()
    del pairs
    label = exchange_clustering(bigrams, classes)
    k = int(label.max()) + 1
    member = np.zeros((units, k))
    member[np.arange(units), label] = 1
    joint = member.T @ bigrams @ member
    core_h, core_n = top_h[real][:frequent], top_n[real][:frequent]
    core_cls = label[1 + np.searchsorted(known, core_h)]
    ends = int(top_n[~real].sum()) or int(sums["n"].to_numpy()[sums["unit"].to_numpy() == 0].sum())

    rest = word_classes(train, known, label, joint, frequent, tails, train_tokens - int(core_n.sum()) - ends)
    rest = materialise(rest.join(counts.where(F.col("unit") > 0).groupBy("h").agg(F.sum("n").alias("n")), "h"), "classes")
    discard(counts)
    sums = rest.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # at most `classes` rows
    class_n = np.bincount(core_cls, weights=core_n, minlength=k)
    class_v = np.bincount(core_cls, minlength=k).astype(float)
    class_n[0], class_v[0] = ends, min(ends, 1)
    class_n[sums["cls"].to_numpy()] += sums["n"].to_numpy()
    class_v[sums["cls"].to_numpy()] += sums["v"].to_numpy()
    room = max(0, table - len(core_h))
    more = rest.orderBy(F.desc("n"), "h").limit(room).toArrow()
    table_h = np.concatenate([[END], core_h, more["h"].to_numpy().view(np.uint64)])
    table_n = np.concatenate([[ends], core_n, more["n"].to_numpy()])
    table_cls = np.concatenate([[0], core_cls, more["cls"].to_numpy()])
    order = np.argsort(table_h)
    sent = spark.sparkContext.broadcast((known, label, table_h[order], table_n[order], table_cls[order]))  # bounded by table and units
    complete = len(more) == int(sums["v"].to_numpy().sum())

    def code(batches):
        from pyspark import TaskContext

        known, label, table_h, table_n, table_cls = sent.value
        row_at = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n", "cls", "pos", "h"]
        null = lambda t, k: pa.nulls(k, t)
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))
        for batch in batches:
            for row, rows, data, ends in text_chunks(batch, 2):
                h, owner, low, starts, stops = word_hashes(data, ends)
                unit, who = _stream(_units(h, low, starts, stops, known, frequent, tails), owner, rows, 0)
                h, _ = _stream(h, owner, rows, END)
                at = np.minimum(np.searchsorted(table_h, h), len(table_h) - 1)
                found = table_h[at] == h
                n, cls = np.where(found, table_n[at], 0), np.where(found, table_cls[at], label[unit]).astype(np.int16)
                keys = row_at + np.arange(rows)
                row_at += rows
                begin = np.append(0, np.cumsum(np.bincount(who, minlength=rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column(0).slice(row, rows), batch.column(1).slice(row, rows), lists(begin, n), lists(begin, cls), null(pa.int32(), rows), null(pa.int64(), rows)], names
                )
                late = np.flatnonzero(~found) if not complete else []
                if len(late):
                    m = len(late)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[who[late]]), null(batch.column(0).type, m), null(pa.bool_(), m), null(pa.list_(pa.int64()), m), null(pa.list_(pa.int16()), m), pa.array((late - begin[who[late]]).astype(np.int32)), pa.array(h[late].view(np.int64))],
                        names,
                    )

    def settle(batches):
        for batch in batches:
            n, cls, _, who = _flat(batch, 2, 3)
            n, cls = n.copy(), cls.astype(np.int16)
            begin = np.append(0, np.cumsum(np.bincount(who, minlength=batch.num_rows)))
            found = batch.column(4)
            x, at = found.flatten(), np.repeat(begin[:-1], found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = at + x.field("pos").to_numpy()
            n[at], cls[at] = x.field("n").to_numpy(), x.field("cls").to_numpy()
            lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(v)) for v in (n, cls)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "held_out", "n", "cls"])

    kind = dict(rows.dtypes)["doc_id"]
    coded = materialise(rows.mapInArrow(code, f"row long, doc_id {kind}, held_out boolean, n array<long>, cls array<short>, pos int, h long"), "coded")
    texts = coded.where("h is null").select("row", "doc_id", "held_out", "n", "cls")
    if complete:
        texts = texts.drop("row")
    else:
        # the words of the table are settled; the others that training has meet their counts and classes
        late = coded.where("h is not null").select("row", "pos", "h").join(rest, "h").groupBy("row").agg(F.collect_list(F.struct("pos", "n", "cls")).alias("late"))
        texts = texts.join(late, "row", "left").select("doc_id", "held_out", "n", "cls", "late")
        texts = materialise(texts.mapInArrow(settle, f"doc_id {kind}, held_out boolean, n array<long>, cls array<short>"), "settled")
        discard(coded)
    discard(rest)

    def class_bigrams(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            _, cls, before, _ = _flat(batch, 0, 0)
            total += np.bincount(before * k + cls, minlength=k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    pairs = texts.where("not held_out").select("cls").mapInArrow(class_bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most k * k rows
    joint = np.zeros(k * k)
    joint[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    joint = joint.reshape(k, k)
    share = joint.sum(0) / max(joint.sum(), 1)
    transition = (joint + 10.0 * share[None, :]) / (joint.sum(1, keepdims=True) + 10.0)
    if not joint.sum():
        transition = np.full((k, k), 1 / k)
    model = BrownModel(None, label, transition, class_n, class_v, None, None, train_tokens, vocabulary, frequent, tails)

    def score(batches):
        for batch in batches:
            n, cls, before, who = _flat(batch, 2, 3)
            m = batch.num_rows
            base, own = np.log10(model.base(n)), np.log10(model.probability(n, model.transition[before, cls], cls))
            sums = [np.bincount(who, weights=x, minlength=m) for x in (base, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.bincount(who, minlength=m)), pa.array(np.bincount(who, weights=n > 0, minlength=m).astype(np.int64)), *map(pa.array, sums), pa.array(np.full(m, train_tokens, np.int64))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"],
            )

    scored = texts.select("doc_id", "held_out", "n", "cls").mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens")
