"""Quality classifier by co-training: a text view and a page-metadata view teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import VECTOR, Words, mix, prepare, steps, string_buffers, summed, vector

#: Labelled rows that are fitted on: a bounded sample, drawn by hash. All else, the pseudo-labels that the views give
#: each other too, covers every document.
LABELLED = 10_000
#: Hashed word features; rounds; probability from which a view is sure; share of the labelled rows held out for
#: calibration.
BITS, ROUNDS, SURE, HELD_OUT = 18, 3, 0.95, 0.25
#: Training steps of a view, their rate, and the pull towards zero.
STEPS, RATE, PULL = 60, 0.3, 2e-4
TARGETS = ("quality", "toxic")

_META = 1 << 12
_BREAK = np.arange(256, dtype=np.uint8)
_BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_KIND = np.zeros(256, np.uint8)  # 1: lower, 2: upper, 3: digit, 4: punctuation, 5: space, 0: other bytes
for _c in range(128):
    _KIND[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 5 if _c <= 32 else 4


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, feature`` without repetition: the words of each text (lower case, punctuation aside), and in tenths of
    fine grain how its characters divide, how long its words are and how many differ."""
    rows = len(offsets) - 1
    words = Words(_BREAK[data], offsets, lower=True)
    count = np.diff(words.first)
    own = np.uint64((1 << BITS) - 1024)
    feature = (words.hash % own).astype(np.int64)
    pair = np.unique(words.doc * (1 << BITS) + feature)
    row, feature = pair >> BITS, pair & ((1 << BITS) - 1)
    size = np.maximum(1, np.diff(offsets))
    shares = [np.diff(np.append(0, np.cumsum(_KIND[data] == k))[offsets]) / size for k in range(6)]
    shares.append(np.minimum(1, np.diff(offsets) / np.maximum(1, count) / 20))
    shares.append(np.bincount(row, minlength=rows) / np.maximum(1, count))
    level = np.stack([np.minimum(63, np.sqrt(s) * 64).astype(np.int64) // 2 for s in shares], 1)
    extra = int(own) + np.arange(len(shares)) * 32 + level
    return np.concatenate([row, np.repeat(np.arange(rows), len(shares))]), np.concatenate([feature, extra.ravel()])


def meta_features(docs: DataFrame, columns: list[str]) -> Column:
    """One hashed feature for each metadata column: strings as they are, numbers by magnitude, nulls as such."""
    out = []
    for name in columns:
        kind = dict(docs.dtypes)[name]
        value = F.col(name).cast("string") if kind in ("string", "boolean") else F.floor(F.log2(F.abs(F.col(name).cast("double")) + 1) * 2).cast("string")
        out.append(F.pmod(F.xxhash64(F.lit(name), F.coalesce(value, F.lit(""))), F.lit(_META)).cast("int"))
    return F.array(*out).cast("array<int>")


@dataclass
class View:
    """A logistic model over sparse binary features: weights and the calibration of its score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row, self.weights[feature], rows) + self.bias

    def chance(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * score + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Told:
    """Counts of features in the documents that a view was told to be of either class, and of these documents."""

    up: np.ndarray
    down: np.ndarray
    n_up: float
    n_down: float


def fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, width: int, told: Told | None = None) -> View:
    """A logistic model whose features are weighted by their log count ratio (after Wang and Manning, 2012) over the
    labelled rows and what it was ``told``. Each ratio's factor is fitted on the labelled rows; features that these
    lack get the mean factor."""
    seen = np.bincount(feature, minlength=width)
    up, n_up = np.bincount(feature, y[row], width), y.sum()
    down, n_down = seen - up, (1 - y).sum()
    bias = float(np.log(max(1.0, n_up) / max(1.0, n_down)))
    if told is not None:
        up, down, n_up, n_down = up + told.up, down + told.down, n_up + told.n_up, n_down + told.n_down
    ratio = np.where(up + down >= 3, np.log((up + 0.5) / (n_up + 1)) - np.log((down + 0.5) / (n_down + 1)), 0.0)
    # a feature seen alike in both classes says nothing; its ratio is within its own error
    error = np.sqrt(1 / (up + 0.5) + 1 / (down + 0.5))
    ratio = np.where(np.abs(ratio) > 2 * error, ratio, 0.0)
    use = np.flatnonzero(ratio)
    place = np.full(width, -1, np.int64)
    place[use] = np.arange(len(use))
    keep = place[feature] >= 0
    row, at = row[keep], place[feature[keep]]
    r = ratio[use]
    u, grads = np.zeros(len(use)), np.full(len(use), 1e-6)
    bias_grads = 1e-6
    x = r[at]
    for _ in range(STEPS):
        p = sigmoid(np.bincount(row, x * u[at], len(y)) + bias)
        g = (p - y) / len(y)
        grad = np.bincount(at, g[row] * x, len(use)) + PULL * u / max(1, len(use)) ** 0.5
        grads += grad * grad
        u -= RATE * grad / np.sqrt(grads)
        bias_grads += g.sum() ** 2
        bias -= RATE * g.sum() / np.sqrt(bias_grads)
    unseen = seen[use] == 0
    if unseen.any() and not unseen.all():
        u[unseen] = u[~unseen].mean()
    weights = np.zeros(width)
    weights[use] = r * u
    return View(weights, bias)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a small dense logistic model, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(25):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Model:
    """Both views of one target and how their scores combine; no views where the labels know one class or none."""

    views: list[View]
    mix: np.ndarray
    prior: float

    def chance(self, features: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        if not self.views:
            return np.full(rows, self.prior)
        x = [v.slope * v.score(*f, rows) + v.shift for v, f in zip(self.views, features)]
        return sigmoid(np.column_stack([*x, np.ones(rows)]) @ self.mix)


def tally(targets: list[list[View]], features: list[tuple[np.ndarray, np.ndarray]], rows: int, sizes: list[int]) -> np.ndarray:
    """What the views tell each other about some documents: for each target and view the features of the documents that
    the other view is sure of, by class, and their number; all in one vector that adds up over documents."""
    out = []
    for views in targets:
        chances = [v.chance(v.score(*f, rows)) for v, f in zip(views, features)]
        for view, (row, feature) in enumerate(features[: len(views)]):
            other = chances[1 - view]
            for sure in (other >= SURE, other <= 1 - SURE):
                out += [np.bincount(feature[sure[row]], minlength=sizes[view]), [sure.sum()]]
    return np.concatenate(out) if out else np.zeros(0)


def told(vector: np.ndarray, targets: list[list[View]], sizes: list[int]) -> list[list[Told]]:
    """The parts of a sum of ``tally``."""
    parts = np.split(vector, np.cumsum([n for views in targets for k in range(len(views)) for n in (sizes[k], 1) * 2])[:-1])
    return [[_told(parts) for _ in views] for views in targets]


def _told(parts: list[np.ndarray]) -> Told:
    up, n_up, down, n_down = (parts.pop(0) for _ in range(4))
    return Told(up, down, float(n_up[0]), float(n_down[0]))


def co_train(features: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], ys: list[np.ndarray], rounds: int, exchange: Callable[[list[list[View]]], np.ndarray]) -> list[Model]:
    """A model for each of the targets ``ys`` (null where unknown). ``features[view]``: ``row, feature`` of the labelled rows.

    Each round ``exchange`` sums ``tally`` over all other documents: each view tells the other which ones it is sure
    of, those whose calibrated chance is ``SURE`` or more either way, and the other counts their features with its own."""
    n = len(ys[0])
    known = [np.isfinite(y) for y in ys]
    able = [len(np.unique(y[k])) == 2 for y, k in zip(ys, known)]
    held = []
    for y, k in zip(ys, known):
        h = k & (np.arange(n) % round(1 / HELD_OUT) == 0)
        held.append(h if len(np.unique(y[h])) == 2 and len(np.unique(y[k & ~h])) == 2 else k)
    learnt: list[list[Told]] = [[] for _ in ys]
    targets: list[list[View]] = [[] for _ in ys]
    for k in range(rounds + 1):
        for t, y in enumerate(ys):
            if not able[t]:
                continue
            train = known[t] & ~held[t] if (known[t] & ~held[t]).any() else known[t]
            number = np.cumsum(train) - 1
            targets[t] = []
            for view, (row, feature) in enumerate(features):
                ok = train[row]
                model = fit(number[row[ok]], feature[ok], y[train], sizes[view], learnt[t][view] if learnt[t] else None)
                model.slope, model.shift = logistic(model.score(row, feature, n)[held[t]][:, None], y[held[t]])
                targets[t].append(model)
        if k == rounds or not any(able):
            break
        learnt = told(exchange(targets), targets, sizes)
    out = []
    for t, y in enumerate(ys):
        base = float(y[known[t]].mean()) if known[t].any() else 0.5
        if not able[t]:
            out.append(Model([], np.zeros(0), base))
            continue
        x = np.column_stack([v.slope * v.score(*f, n)[held[t]] + v.shift for v, f in zip(targets[t], features)])
        out.append(Model(targets[t], logistic(x, y[held[t]]), base))
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.value_parent_indices().to_numpy(), column.flatten().to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str], labelled: int, rounds: int) -> list[Model]:
    """A model for each target: fitted on a bounded sample of labelled rows, and on what its views tell each other about
    every other document, a pass over all of them each round."""
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *(F.col(t).cast("double").alias(t) for t in TARGETS))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(7)), *TARGETS).limit(labelled)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), meta_features(docs, meta_cols).alias("meta"))
    marked = slim.join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in steps(offsets):
                row, feature = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                by = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[by], np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature[by].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), lists, *(batch.column(c).slice(a, b - a) for c in ("meta", *TARGETS))], ["id", "words", "meta", *TARGETS])

    schema = "id bigint, words array<int>, meta array<int>, " + ", ".join(f"{t} double" for t in TARGETS)
    known = marked.mapInArrow(run, schema).toArrow().combine_chunks()
    # any order of rows comes from the same rows
    sizes_ = pc.list_value_length(known["words"]).to_numpy() if known.num_rows else np.zeros(0, int)
    known = known.take(pa.array(np.lexsort((sizes_, mix(known["id"].to_numpy().view(np.uint64))))))
    features = [_lists(known[c].combine_chunks()) for c in ("words", "meta")]
    sizes = [1 << BITS, _META]
    ids = np.unique(known["id"].to_numpy())

    def exchange(targets: list[list[View]]) -> np.ndarray:
        width = len(tally(targets, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2, 0, sizes))
        light = [[View(v.weights.astype(np.float32), v.bias, v.slope, v.shift) for v in views] for views in targets]

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                fresh = ~np.isin(batch.column(0).fill_null(-1).to_numpy(), ids) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(fresh))
                data, offsets = string_buffers(batch.column(1))
                for a, b in steps(offsets):
                    text = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    total += tally(light, [text, _lists(batch.column(2).slice(a, b - a))], b - a, sizes)
            yield vector(total)

        total = summed(slim.mapInArrow(tell, VECTOR))
        return np.zeros(width) if total is None else total.astype(float)

    return co_train(features, sizes, [known[t].to_numpy().astype(float) for t in TARGETS], rounds, exchange)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), labelled: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, quality, toxic, keep`` for each row of ``docs``: the chances of either label and whether the document
    is good and not toxic (at a half).

    Two views of a document, its text's words and form and its page's metadata, are trained on a bounded sample of
    labelled rows (``labelled``). In each round each view says of every other document whether it is sure, and the
    other view counts the features of those; only the counts move, a vector of fixed size from each partition.
    Calibrated on labelled rows held out, the views are combined and score every document. Null labels count as
    unknown; without two classes of a label its share among the labels is the chance of all (a half without any). Null
    and empty texts are judged by their metadata and by having no words; a very long text is one document like any
    other, its words counted once; metadata columns that ``docs`` lacks are left out; null ids stay null; repeated rows
    are told and scored each; chances at exactly a half are kept for quality and dropped for toxic; an empty table
    gives an empty one; other columns are ignored, whatever their names."""
    prepare(docs.sparkSession)
    names = [c for c in meta_cols if c in docs.columns]
    models = train(docs, labels, id_col, text_col, names, labelled, rounds)
    for model in models:
        for view in model.views:
            view.weights = view.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in steps(offsets):
                text = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                meta = _lists(batch.column(2).slice(a, b - a))
                quality, toxic = (m.chance([text, meta], b - a) for m in models)
                keep = (quality >= 0.5) & (toxic < 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(quality), pa.array(toxic), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), meta_features(docs, names).alias("meta"))
    return slim.mapInArrow(run, "doc_id bigint, quality double, toxic double, keep boolean")
