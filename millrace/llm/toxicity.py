"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import run_hashes
from .runtime import discard, materialise
from .words import text_chunks


@functools.cache
def _word_bytes() -> np.ndarray:
    """ASCII letters and digits, and every byte of a longer UTF-8 sequence."""
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return inside


def token_sets(data: np.ndarray, ends: np.ndarray):
    """(hashes, owner): distinct lower-cased words of each text."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    inside = _word_bytes()[low]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.insert(edge, 0, 0)
    starts, stops = edge[0::2], edge[1::2]
    h, owner = run_hashes(low, starts, stops), np.searchsorted(ends, starts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], owner[keep]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class LinearModel:
    """Logistic regression on a chosen vocabulary of word hashes, plus dense extra features."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, extra: np.ndarray, bias: float):
        self.words, self.weights, self.extra, self.bias = words, weights, extra, bias

    def margins(self, h: np.ndarray, owner: np.ndarray, rows: int, extra: np.ndarray) -> np.ndarray:
        out = np.full(rows, self.bias)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out += np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=rows)
        return out + extra @ self.extra

    def probabilities(self, h, owner, rows, extra) -> np.ndarray:
        return _sigmoid(self.margins(h, owner, rows, extra))


LEAST = 4  # texts that a word must occur in


def choose_words(n: np.ndarray, k: np.ndarray, rate: float, features: int = 3000, least: int = LEAST) -> np.ndarray:
    """Places of the `features` words that tell most about a label (by G-test, in at least `least` texts): word i is in
    n[i] texts, k[i] of which have the label, as a share `rate` of all has."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(k * np.log(k / (n * rate))) + np.nan_to_num((n - k) * np.log((n - k) / (n * (1 - rate))))
    gain[n < least] = -1
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    return chosen[gain[chosen] > 2.0]


def _rate(labelled: float, rows: float) -> float:
    return float(np.clip(labelled / rows if rows else 0.0, 1e-3, 1 - 1e-3))


def fit_linear(words, chosen, inverse, owner, rows: int, extra: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 150) -> LinearModel:
    """Penalised logistic regression on the words at `chosen` by accelerated gradient steps. Text owner[i] has words[inverse[i]]."""
    rate = _rate(y.sum(), rows)
    index = np.full(len(words), -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    col = index[inverse]
    hit = col >= 0
    col, row = col[hit], owner[hit]
    size = len(chosen) + extra.shape[1] + 1

    def gradient(w):
        z = np.bincount(row, weights=w[col], minlength=rows) + extra @ w[len(chosen) : -1] + w[-1]
        e = _sigmoid(z) - y
        g = np.concatenate([np.bincount(col, weights=e[row], minlength=len(chosen)), extra.T @ e, [e.sum()]]) + l2 * np.append(w[:-1], 0)
        return g

    # diagonal scaling: a bound of the curvature of each weight
    per_row = np.bincount(row, minlength=rows) + (extra != 0).sum(1) + 1.0
    scale = np.concatenate([np.bincount(col, weights=per_row[row], minlength=len(chosen)), (extra**2 * per_row[:, None]).sum(0), [per_row.sum()]]) / 4 + l2 + 1e-9
    w = np.zeros(size)
    w[-1] = np.log(rate / (1 - rate))
    v, t = w.copy(), 1.0
    for _ in range(steps):
        new = v - gradient(v) / scale
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return LinearModel(words[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


class ClassifierChain:
    """One linear model per category; each sees the logits of the categories before it."""

    def __init__(self, models: list[LinearModel], threshold: float):
        self.models, self.threshold = models, threshold

    def probabilities(self, h, owner, rows) -> np.ndarray:
        out = np.zeros((rows, len(self.models)))
        for j, m in enumerate(self.models):
            out[:, j] = m.probabilities(h, owner, rows, _logits(out[:, :j]))
        return out


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_chain(words, inverse, owner, rows: int, labels: np.ndarray, fold: np.ndarray, chosen: list[list[np.ndarray]]) -> ClassifierChain:
    """Later models are trained on earlier categories' out-of-fold probabilities; the threshold of the
    last category is the one with the best out-of-fold F1. chosen[j] has the places in `words` that each
    fold's model of category j chose, and last those of the model of all rows."""
    held = np.zeros(labels.shape)
    models = []
    h = words[inverse]
    for j in range(labels.shape[1]):
        extra = _logits(held[:, :j])
        y = labels[:, j].astype(float)
        for f, at in enumerate(chosen[j][:-1]):
            train, test = fold != f, fold == f
            if not train.any() or not test.any():
                held[test, j] = y.mean() if rows else 0.0
                continue
            renumber = np.cumsum(train, dtype=np.int32) - 1
            t = train[owner]
            model = fit_linear(words, at, inverse[t], renumber[owner[t]], int(train.sum()), extra[train], y[train])
            held[test, j] = model.probabilities(h, owner, rows, extra)[test]
        models.append(fit_linear(words, chosen[j][-1], inverse, owner, rows, extra, y))
    y, p = labels[:, -1].astype(bool), held[:, -1]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    threshold = 0.5
    if rows and y.any():
        f1 = 2 * right / (np.arange(1, rows + 1) + y.sum())
        best = int(np.argmax(f1))
        low = p[order[best + 1]] if best + 1 < rows else 0.0
        threshold = float((p[order[best]] + low) / 2)
    return ClassifierChain(models, threshold)


def word_counts(sample: DataFrame, categories: int, folds: int) -> DataFrame:
    """(word, n0, n1, ..., k0_0, ...) of the words of at least LEAST rows: n<f> rows of fold f have it, k<j>_<f> of them with label j."""
    within = [F.col("fold") == f for f in range(folds)]
    counts = [F.count_if(w).cast("int").alias(f"n{f}") for f, w in enumerate(within)]
    counts += [F.count_if(w & (F.col(f"c{j}") == 1)).cast("int").alias(f"k{j}_{f}") for j in range(categories) for f, w in enumerate(within)]
    rows = sample.select(F.explode("words").alias("word"), "fold", *[f"c{j}" for j in range(categories)])
    return rows.groupBy("word").agg(*counts).where(" + ".join(f"n{f}" for f in range(folds)) + f" >= {LEAST}")


def chosen_words(sample: DataFrame, categories: int, folds: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """(words, chosen): the words that any model of the chain chooses, and for each category the places in them that
    each fold's model and the one of all rows chose. Words are counted by Spark; words that no model can choose stay there."""
    sizes = sample.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"c{j}").alias(f"c{j}") for j in range(categories)]).collect()  # a row a fold
    counts = word_counts(sample, categories, folds).toArrow()
    words = counts["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    of = lambda name: counts[name].to_numpy()[order].astype(float)
    parts = [[g for g in range(folds) if g != f] for f in range(folds)] + [list(range(folds))]
    n = [sum(of(f"n{g}") for g in part) for part in parts]
    picks = []
    for j in range(categories):
        k = [sum(of(f"k{j}_{g}") for g in part) for part in parts]
        rate = [_rate(sum(r[f"c{j}"] for r in sizes if r["fold"] in part), sum(r["rows"] for r in sizes if r["fold"] in part)) for part in parts]
        picks.append([choose_words(*x) for x in zip(n, k, rate, strict=True)])
    union = np.unique(np.concatenate([p for row in picks for p in row]))
    return words[union], [[np.searchsorted(union, p) for p in row] for row in picks]


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("quality", "toxic"),
    sample_rows: int = 20_000,
    folds: int = 3,
) -> ClassifierChain:
    """Fit the chain on at most `sample_rows` labelled documents, the first by hash of their id.

    Rows without an id, or with a category that isn't 0 or 1, aren't used; an id
    that repeats in either table is used once. Without labelled rows every
    probability is that of an empty model, and nothing reaches the threshold.
    The sample's words stay on the executors; the driver gets counts of words and,
    of each row, the words that a model has chosen.
    """
    named = [f"c{j}" for j in range(len(categories))]
    good = labels.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").cast("int").alias(f"c{j}") for j, c in enumerate(categories)])
    for c in named:
        good = good.where(F.col(c).isin(0, 1))
    good = good.where("_id is not null").groupBy("_id").agg(*[F.max(c).alias(c) for c in named])
    good = F.broadcast(good.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))  # at most sample_rows rows
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(good, "_id")
    rows = rows.select("text", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(folds)).alias("fold"), *named, F.xxhash64("_id").alias("key"), F.xxhash64("text").alias("digest"))

    def sets(batches):
        for batch in batches:
            for row, n, data, ends in text_chunks(batch, 0):
                h, owner = token_sets(data, ends)
                starts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(starts), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([words, *[batch.column(i).slice(row, n) for i in range(1, batch.num_columns)]], ["words", *batch.schema.names[1:]])

    plain = "fold long, " + ", ".join(f"{c} int" for c in named) + ", key long"
    sample = rows.mapInArrow(sets, f"words array<long>, {plain}, digest long")
    sample = sample.groupBy("key").agg(F.min_by("words", "digest").alias("words"), *[F.min(c).alias(c) for c in ("fold", *named)])
    sample = materialise(sample.select("words", "fold", *named, "key"), "labelled")
    words, chosen = chosen_words(sample, len(categories), folds)

    def places(batches):
        for batch in batches:
            lists = batch.column(0)
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0)).astype(np.int32)
            hit = words[at] == h if len(words) else np.zeros(len(h), bool)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            starts = np.concatenate([[0], np.cumsum(hit)])[ends].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(starts), pa.array(at[hit]))
            yield pa.RecordBatch.from_arrays([found, *batch.columns[1:]], batch.schema.names)

    got = sample.mapInArrow(places, f"words array<int>, {plain}").orderBy("key").toArrow()  # at most sample_rows rows, in a fixed order
    y = np.array([got[c].to_numpy() for c in named]).T.reshape(got.num_rows, len(categories))
    fold = got["fold"].to_numpy()
    none = [np.zeros(0, np.int32)]
    lengths = np.concatenate([np.asarray(c.value_lengths()) for c in got["words"].chunks] or none)
    inverse = np.concatenate([c.flatten().to_numpy() for c in got["words"].chunks] or none)
    del got
    discard(sample)
    return fit_chain(words, inverse, np.repeat(np.arange(len(y), dtype=np.int32), lengths), len(y), y, fold, chosen)


def toxicity_scores(docs: DataFrame, chain: ClassifierChain, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """`docs` with p_<category> for each category and is_toxic added.

    Null and empty texts have no words: their probabilities are the models' bias
    and they are never toxic. Every row is scored by itself, so ids don't matter.
    Columns of `docs` that have an added column's name are replaced.
    """
    added = [*[f"p_{c}" for c in categories], "is_toxic"]
    base = docs.drop(*added)
    names, at = base.columns, base.columns.index(text_col)
    schema = StructType(list(base.schema.fields))
    for c in added[:-1]:
        schema = schema.add(c, "double")
    schema = schema.add("is_toxic", "boolean")

    def score(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], ["t"])
            for row, n, data, ends in text_chunks(texts, 0):
                h, owner = token_sets(data, ends)
                p = chain.probabilities(h, owner, n)
                words = np.bincount(owner, minlength=n) > 0
                toxic = (p[:, -1] >= chain.threshold) & words
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns, *[pa.array(p[:, j]) for j in range(p.shape[1])], pa.array(toxic)], [*names, *added])

    return base.mapInArrow(score, schema)
