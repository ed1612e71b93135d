"""Language-model scoring: a causal self-attention model, trained in numpy on subword ids, over overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import VECTOR, prepare, summed, vector, written
from murmurlake.llm.token_counts import PATTERN, RANKS_PATH, load_ranks

#: Places of a window and how far the next one is: all but the first ``WINDOW - STRIDE`` of a later window are scored.
WINDOW, STRIDE = 32, 24
#: Width of the model; most frequent ids with a vector of their own; classes of the output.
WIDTH, OWN, CLASSES = 16, 1984, 64
#: Rounds of training on every id with the parameters averaged after each; windows in a step; rate, and that of a
#: class's tree.
ROUNDS, BATCH, RATE, TREE_RATE = 1, 128, 0.01, 0.1
#: Windows that are scored together.
TOGETHER = 128
MEMO, MEMO_CHARS = 300_000, 48
#: Segments of a text that are looked up together; the memory is over its bound by no more.
SLICE = 65_536

_RUNS = "[ \\t\\r\\f][ \\t\\r\\f\\n]|\\n[ \\t\\r\\f]|[\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


class Ids(dict):
    """Packed ids (two bytes each) of what stands between two single spaces, its leading space included."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.size = max(ranks.values()) + 1
        if self.size > 1 << 16:
            raise ValueError("ids are stored in two bytes")
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(self.size, bool)
        self.opens[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), np.uint16).tobytes()

    def learn(self, segments: list[str]) -> None:
        """The ids of different segments, encoded as one text: only a segment's first id begins with a space."""
        ids = np.array(self.encode(" " + " ".join(segments)), np.uint16)
        at = np.flatnonzero(self.opens[ids]) * 2
        if len(at) != len(segments):
            self.update((x, self.whole(" " + x)) for x in segments)
            return
        raw, at = ids.tobytes(), [*at.tolist(), None]
        self.update(zip(segments, [raw[a:b] for a, b in zip(at, at[1:])]))

    def of(self, text: str, runs: bool) -> bytes:
        if runs:
            return self.whole(text)
        head, *rest = text.split(" ")
        out = [self.whole(head)]
        for a in range(0, len(rest), SLICE):
            some = rest[a : a + SLICE]
            if len(self) >= MEMO:
                self.clear()
            got = list(map(self.get, some))
            gaps = [i for i, ids in enumerate(got) if ids is None]
            if gaps:
                new = list({some[i] for i in gaps})
                self.learn(new)
                for i in gaps:
                    got[i] = self[some[i]]
                for segment in new:
                    if len(segment) > MEMO_CHARS:
                        del self[segment]
            out += got
        return b"".join(out)


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


@dataclass
class Vocabulary:
    """What the corpus counts make of the ids: ``bucket`` is an id's row of the input vectors (frequent ids have their
    own, others their class's), ``kind`` its output class, ``within`` its log chance in the class."""

    bucket: np.ndarray
    kind: np.ndarray
    within: np.ndarray
    log_class: np.ndarray
    first: np.ndarray
    node: np.ndarray
    right: np.ndarray
    bias: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, own: int, classes: int) -> Vocabulary:
        """Classes of nearly equal mass along descending frequency; each count is raised by one."""
        order = np.lexsort((np.arange(len(counts)), -counts))
        mass = (counts + 1.0)[order]
        before = np.cumsum(mass) - mass
        kind = np.empty(len(counts), np.int64)
        kind[order] = np.minimum(classes - 1, (before / mass.sum() * classes).astype(np.int64))
        total = np.bincount(kind, counts + 1.0, classes)
        bucket = kind + own
        bucket[order[:own]] = np.arange(min(own, len(order)))
        return cls(bucket, kind, np.log((counts + 1.0) / total[kind]), np.log(np.maximum(total, 1.0) / total.sum()), *tree(order, mass, kind[order]))

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``place, node, right``: the decisions that lead to each of the ids in its class, the first ones of all ids,
        then the second ones and so on; place is an id's index in ids. The longest way comes first among the first
        ones, and later ones keep that order, so the places of each are the beginning of those before."""
        first = self.first.take(ids)
        size = self.first[1:].take(ids) - first
        most = size.max(initial=0)
        order = np.argsort((most - size).astype(np.min_scalar_type(most)), kind="stable")
        first = first.take(order)
        longer = (len(ids) - np.cumsum(np.bincount(size))[:-1]).tolist()
        place, at, a = np.empty(sum(longer), np.int64), np.empty(sum(longer), np.int64), 0
        for level, n in enumerate(longer):
            place[a : a + n] = order[:n]
            np.add(first[:n], level, out=at[a : a + n])
            a += n
        return place, self.node.take(at), self.right.take(at)


def tree(order: np.ndarray, mass: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, node, right, bias``: a binary tree over each class's ids that halves the mass at each node. The nodes of
    id i are ``node[first[i]:first[i + 1]]`` and whether it is on their right; by the biases alone, logits of going
    right, an id has its share in the class. A node is known by the place where it cuts the order."""
    n = len(order)
    sums = np.append(0.0, np.cumsum(mass))
    low, high = np.searchsorted(kind, kind, "left"), np.searchsorted(kind, kind, "right")
    bias, parts = np.zeros(n, np.float32), []
    at = np.flatnonzero(high - low > 1)
    while len(at):
        a, b = low[at], high[at]
        cut = np.clip(np.searchsorted(sums, (sums[a] + sums[b]) / 2), a + 1, b - 1)
        bias[cut] = np.log((sums[b] - sums[cut]) / (sums[cut] - sums[a]))
        right = at >= cut
        parts.append((order[at], cut, right))
        low[at], high[at] = np.where(right, cut, a), np.where(right, b, cut)
        at = at[high[at] - low[at] > 1]
    ids, node, right = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    by = np.argsort(ids, kind="stable")
    return np.searchsorted(ids[by], np.arange(n + 1)), node[by], right[by], bias


def initial(vocabulary: Vocabulary, own: int, classes: int, width: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(6)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return {
        "e": normal(own + classes + 1, width),  # the last row stands before a document's first id
        "p": normal(WINDOW, width),
        "q": normal(width, width),
        "k": normal(width, width),
        "v": normal(width, width),
        "o": normal(width, width),
        "u": normal(width, classes) * np.float32(0.3),
        "c": vocabulary.log_class.astype(np.float32),
    }


_MASK = np.tril(np.ones((256, 256), np.float32))


def rows_summed(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones((x.shape[-1], 1), x.dtype)).reshape(*x.shape[:-1], 1)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y`` with a matrix y, as one product over all places."""
    return (x.reshape(-1, x.shape[-1]) @ y).reshape(*x.shape[:-1], -1)


def turned(x: np.ndarray) -> np.ndarray:
    """Each window's transpose, laid out anew, which products run through faster."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` over all places, summed window by window, so that what is multiplied stays in the nearest cache."""
    return np.matmul(x.transpose(0, 2, 1), y).sum(0)


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = rows_summed(x * x)
    scale /= x.dtype.type(x.shape[-1])
    scale += x.dtype.type(1e-5)
    np.divide(1, np.sqrt(scale, out=scale), out=scale)
    return x * scale, scale


def _norm_back(y: np.ndarray, scale: np.ndarray, dy: np.ndarray) -> np.ndarray:
    out = y * (rows_summed(dy * y) / y.dtype.type(-y.shape[-1]))
    out += dy
    out *= scale
    return out


def attend(weight_of: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Attention scores to masked exponentials, in place; they are kept small enough to need no shift."""
    weight = np.exp(np.clip(weight_of, -30, 30, out=weight_of), out=weight_of)
    weight *= mask
    return weight


def hidden(w: dict[str, np.ndarray], x: np.ndarray, skip: int = 0) -> dict[str, np.ndarray]:
    """Of windows of input buckets: what the classes are scored by (``b``) at the places from ``skip`` on, each from
    that place and those before it, all windows and places at once under one causal mask. The product of two
    projections is one projection, made once: queries and keys (``near``), values and output (``out``)."""
    t, width = x.shape[1], w["e"].shape[1]
    a = w["e"].take(x, 0)
    a += w["p"][:t]
    a, a_scale = _norm(a)
    late = a[:, skip:]
    near, out = w["q"] @ w["k"].T * a.dtype.type(1 / np.sqrt(width)), w["v"] @ w["o"]
    asked, a_turned = times(late, near), turned(a)
    weight = attend(np.matmul(asked, a_turned), _MASK[skip:t, :t])
    share = 1 / rows_summed(weight)
    mixed = np.matmul(weight, a)
    mixed *= share
    h = times(mixed, out)
    h += late
    b, b_scale = _norm(h)
    return {"a": a, "a_turned": a_turned, "a_scale": a_scale, "near": near, "out": out, "asked": asked, "weight": weight, "share": share, "mixed": mixed, "b": b, "b_scale": b_scale}


def class_scores(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The class scores at every place."""
    return hidden(w, x)["b"] @ w["u"] + w["c"]


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """The model projection by projection, as it is defined; ``hidden`` gives the same with fewer products."""
    width = w["e"].shape[1]
    a, _ = _norm(w["e"].take(x, 0) + w["p"][: x.shape[1]])
    q, k, v = (a @ w[key] for key in "qkv")
    weight = attend(np.matmul(q, k.transpose(0, 2, 1)) / a.dtype.type(np.sqrt(width)), _MASK[: x.shape[1], : x.shape[1]])
    mixed = np.matmul(weight, v) / weight.sum(-1, keepdims=True)
    b, _ = _norm(a + mixed @ w["o"])
    return {"b": b, "z": b @ w["u"] + w["c"]}


def path_logits(w: dict[str, np.ndarray], b: np.ndarray, place: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Logits of going right at each node, given the context ``b[place]``."""
    turn = w["n"].take(node, 0)
    turn *= b.take(place, 0)
    return np.clip(rows_summed(turn)[:, 0] + w["nb"].take(node), -60, 60)


def classes_of(w: dict[str, np.ndarray], b: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts along the last axis, all flat: ``e, factor, total, own``. The exponentials of the class scores are
    ``e * factor``, of large ones less the context's highest; then their sums, and the log chance of class ``kind``."""
    z = np.matmul(b, w["u"]).reshape(-1, len(w["c"]))
    # a context's length is at most the root of its width, so most often no score needs a shift and the constants can wait
    small = np.sqrt(b.shape[-1] * (w["u"] ** 2).sum(0).max()) + np.abs(w["c"]).max() < 60
    if not small:
        z += w["c"]
        z -= z.max(1, keepdims=True)
    factor = np.exp(w["c"]) if small else np.ones_like(w["c"])
    own = z.ravel().take(np.arange(0, z.size, z.shape[1]) + kind)
    if small:
        own += w["c"].take(kind)
    np.exp(z, out=z)
    total = z @ factor
    own -= np.log(total)
    return z, factor, total, own


def scatter(at: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different places in ``at``, ascending, and sums of each of ``rows`` by them."""
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")  # short numbers sort in linear time
    by = at.take(order)
    new = np.ones(len(by), bool)
    np.not_equal(by[1:], by[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return by.take(first), *(np.add.reduceat(x.take(order, 0), first, 0) if len(by) else x for x in rows)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, use: np.ndarray, path: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss in nats over the places in ``use`` whose next class is ``y``, and its gradients. With the ``path`` of
    each next id in its class (for flat places in ``use``) the loss is that of the ids, and ``n``, ``nb`` have a
    gradient for each of the nodes ``at``."""
    f = hidden(w, x)
    a, b, mixed = f["a"], f["b"], f["mixed"]
    kind, width = b.dtype, b.shape[2]
    y, use = y.ravel(), use.ravel().astype(kind)
    count = max(1, int(use.sum()))
    e, factor, total, own = classes_of(w, b, y)
    loss = -float(own @ use / count)
    # a class score's gradient is the class's chance, less one for the own one; what all share is put on the smaller factors
    e.ravel()[np.arange(0, e.size, e.shape[1]) + y] -= total / factor.take(y)
    part = use / kind.type(count) / total
    parts, each = part.reshape(*x.shape, 1), e.reshape(*x.shape, -1)
    g = {"u": outer(b * parts, each) * factor, "c": part @ e * factor}
    db = np.matmul(each, (w["u"] * factor).T)
    db *= parts
    if path is not None:
        place, node, right = path
        near, turn = b.reshape(-1, width).take(place, 0), w["n"].take(node, 0)
        logit = np.clip(rows_summed(near * turn)[:, 0] + w["nb"].take(node), -60, 60)
        up = 1 / (1 + np.exp(-logit))
        d = up - right
        loss -= float(np.log(1 - np.abs(d) + kind.type(1e-30)).sum() / count)
        d /= kind.type(count)
        wide = np.repeat(d, width).reshape(-1, width)
        near *= wide
        g["at"], g["n"], g["nb"] = scatter(node, near, d)
        turn *= wide
        # each level of the ways begins with the same place and has the first places of the one before
        level = [*np.flatnonzero(place == place[:1]).tolist(), len(place)] if len(place) else [0, 0]
        most = level[1]
        rank = np.full(len(y), most)
        rank[place[:most]] = np.arange(most)
        for start, end in zip(level[1:-1], level[2:]):
            turn[: end - start] += turn[start:end]
        db += np.append(turn[:most], np.zeros((1, width), kind), 0).take(rank, 0).reshape(db.shape)
    dh = _norm_back(b, f["b_scale"], db)
    g_out = outer(mixed, dh)
    g["v"], g["o"] = g_out @ w["o"].T, w["v"].T @ g_out
    d_mixed = times(dh, f["out"].T)
    d_mixed *= f["share"]
    d_raw = np.matmul(d_mixed, f["a_turned"])
    # the mean of an attention's gradients is the product of what it mixed
    d_raw -= rows_summed(d_mixed * mixed)
    d_raw *= f["weight"]
    d_asked = np.matmul(d_raw, a)
    g_near = outer(a, d_asked) * kind.type(1 / np.sqrt(width))
    g["q"], g["k"] = g_near @ w["k"], g_near.T @ w["q"]
    da = np.matmul(d_raw.transpose(0, 2, 1), f["asked"])
    da += np.matmul(f["weight"].transpose(0, 2, 1), d_mixed)
    da += times(d_asked, f["near"].T)
    da += dh
    ds = _norm_back(a, f["a_scale"], da)
    g["p"] = np.zeros_like(w["p"])
    g["p"][: x.shape[1]] = ds.sum(0)
    g["e"] = np.zeros_like(w["e"])
    at, sums = scatter(x.ravel(), ds.reshape(-1, width))
    g["e"][at] = sums
    return loss, g


class Adam:
    """Steps for one flat array of parameters."""

    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.s = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        """Moves ``w`` and uses ``g`` up."""
        self.t += 1
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * g
        np.multiply(g, g, out=g)
        self.s *= np.float32(0.98)
        g *= np.float32(0.02)
        self.s += g
        np.sqrt(self.s, out=g)
        g *= np.float32(1 / np.sqrt(1 - 0.98**self.t))
        g += np.float32(1e-6)
        np.divide(self.m, g, out=g)
        g *= np.float32(self.rate / (1 - 0.9**self.t))
        w -= g


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, skip`` of the windows over rows of so many ids: the first ``skip`` places of a window are in the
    one before too, so beyond them every place is in exactly one window."""
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // stride)), 0)
    row = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, number * stride, np.where(number > 0, WINDOW - stride, 0)


def cut(ids: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: input buckets (the ids one place earlier), ids to come, and which places are in the row."""
    first, end = offsets[row] + start, offsets[row + 1]
    at = first[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    target = ids.take(at, mode="clip")
    before = np.empty_like(target)
    before[:, 1:] = vocabulary.bucket.take(target[:, :-1])
    before[:, 0] = np.where(start == 0, OWN + CLASSES, vocabulary.bucket.take(ids.take(first - 1, mode="clip")))
    return before, target, inside


def packed_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and the row offsets among them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), np.uint16).astype(np.int64), (at - at[0]) // 2


def within_class(w: dict[str, np.ndarray], vocabulary: Vocabulary, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log chance of each id in its class given its context; without trees the id's share in the corpus."""
    if "n" not in w:
        return vocabulary.within[ids]
    place, node, right = vocabulary.paths(ids)
    logit = path_logits(w, b, place, node)
    logit *= 1 - 2 * right.astype(logit.dtype)
    np.exp(logit, out=logit)
    logit += 1
    return -np.bincount(place, np.log(logit, out=logit), len(ids))


def score_ids(w: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log chance of each row's ids, each scored once: what a window shares with the one before is only its context."""
    row, start, skip = windows(np.diff(offsets))
    out = np.zeros(len(offsets) - 1)
    for unscored in np.unique(skip):
        of = np.flatnonzero(skip == unscored)
        for a in range(0, len(of), TOGETHER):
            r = row[of[a : a + TOGETHER]]
            x, target, inside = cut(ids, offsets, r, start[of[a : a + TOGETHER]], vocabulary)
            use = inside[:, unscored:]
            at = np.flatnonzero(use)
            b, target = hidden(w, x, unscored)["b"].reshape(-1, w["e"].shape[1]).take(at, 0), target[:, unscored:].ravel().take(at)
            chance = classes_of(w, b, vocabulary.kind.take(target))[3] + within_class(w, vocabulary, b, target)
            out += np.bincount(np.repeat(r, use.sum(1)), chance, len(out))
    return out


def flat_parameters(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train_part(batches: Iterator[np.ndarray], w: dict[str, np.ndarray], vocabulary: Vocabulary) -> tuple[int, dict[str, np.ndarray]]:
    """Windows trained on and the parameters after a pass over batches of ``ids, offsets``; every id is in one window."""
    w = {k: x.copy() for k, x in w.items()}
    dense = sorted(k for k in w if k not in ("n", "nb"))
    values = np.concatenate([w[k].ravel() for k in dense])
    w |= {k: v.reshape(w[k].shape) for k, v in zip(dense, np.split(values, np.cumsum([w[k].size for k in dense])[:-1]))}
    adam, seen = Adam(len(values), RATE), 0
    squares = {k: np.full_like(w[k], 1e-8) for k in ("n", "nb")}
    held: list[tuple[np.ndarray, ...]] = []

    def step(x, target, use):
        target, use = target.ravel(), use.ravel()
        used = np.flatnonzero(use)
        place, node, right = vocabulary.paths(target.take(used))
        _, g = gradients(w, x, vocabulary.kind.take(target), use, (used.take(place), node, right))
        adam.step(values, np.concatenate([g[k].ravel() for k in dense]))
        at = g["at"]
        for k in ("n", "nb"):  # only the nodes on the way to these ids move
            sums = squares[k].take(at, 0)
            sums += g[k] * g[k]
            squares[k][at] = sums
            np.sqrt(sums, out=sums)
            np.divide(g[k], sums, out=sums)
            sums *= np.float32(-TREE_RATE)
            sums += w[k].take(at, 0)
            w[k][at] = sums

    for ids, offsets in batches:
        row, start, _ = windows(np.diff(offsets), WINDOW)
        a = 0
        while a < len(row):
            need = BATCH - sum(len(h[0]) for h in held)
            held.append(cut(ids, offsets, row[a : a + need], start[a : a + need], vocabulary))
            a += need
            if sum(len(h[0]) for h in held) == BATCH:
                step(*(np.concatenate(z) if len(z) > 1 else z[0] for z in zip(*held)))
                seen, held = seen + BATCH, []
    if held:
        x, target, use = (np.concatenate(z) for z in zip(*held))
        step(x, target, use)
        seen += len(x)
    return seen, w


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS_PATH) -> DataFrame:
    """``doc_id, n_tokens, log_chance, perplexity`` for each row of ``docs`` under a model trained on ``docs`` itself.

    Ids are counted over all documents. Every window of every document trains a single-head causal attention
    model: each partition trains on its own windows from the common parameters, and these are averaged by the windows
    seen, for ``ROUNDS`` rounds. An id's chance is its class's times that of each turn on its way down the class's
    binary tree, all given the context. Every id of every text is then scored once, in windows that overlap so that later ones have context.

    Null and empty texts have no ids: chance 0 (log) and no perplexity. Repeated rows train and score each; a null id
    stays null; other columns are ignored; an empty table gives an empty one."""
    spark = docs.sparkSession
    prepare(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ids_of(ranks_path).of
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            runs = pc.match_substring_regex(column, _RUNS).to_pylist()
            ids = pa.array([of(text, run) for text, run in zip(column.to_pylist(), runs)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(slim.mapInArrow(encode, "doc_id bigint, ids binary"), "ids")
    size = ids_of(ranks_path).size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(packed_ids(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counted = table.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    vocabulary = Vocabulary.of(counts, OWN, CLASSES)
    w = initial(vocabulary, OWN, CLASSES, WIDTH) | {"n": np.zeros((size, WIDTH), np.float32), "nb": vocabulary.bias}

    def training(now: dict[str, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, after = train_part((packed_ids(b.column(0)) for b in batches), now, vocabulary)
            if seen:
                change = (flat_parameters(after) - flat_parameters(now)) * np.float32(seen)
                yield vector(np.append(change, np.float32(seen)))

        return run

    for _ in range(ROUNDS):
        total = summed(table.select("ids").mapInArrow(training(w), VECTOR))
        if total is not None:
            w = unflat(flat_parameters(w) + total[:-1] / total[-1], w)

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = packed_ids(batch.column(1))
            n, total = np.diff(offsets), score_ids(w, vocabulary, ids, offsets)
            perplexity = pa.array(np.exp(-total / np.maximum(1, n)), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), perplexity], ["doc_id", "n_tokens", "log_chance", "perplexity"])

    return table.mapInArrow(scoring, "doc_id bigint, n_tokens bigint, log_chance double, perplexity double")
