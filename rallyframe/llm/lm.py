"""Scores of whole texts by a causal self-attention model over subword ids.

The model. A text is its words (lower case A-Z) and an end. Words, each with a space before
it, are cut into ids of a public byte-level BPE vocabulary, and a causal self-attention
network in numpy predicts each id from those before it, in two steps: its group, then the id
in the group. Groups hold ``GROUP`` ids of like frequency, and either only ids that start a
word (the end is one of them, a group of its own) or only others; ids beyond the ``GROUPS`` groups of each
kind fall into ``BINS`` groups in which an id has its share of the training ids. A word's
probability is that of its ids, given that a word starts, times that of a start after it,
so the probabilities of all words add up to one at most. A text's score is the sum of the
log10 probabilities of its words and its end. Context windows of ``WINDOW`` ids overlap by
``OVERLAP``; each id is scored once, with at least ``OVERLAP`` ids before it unless the text
has fewer.

Everything is learned from all training texts. Texts are dealt into chunks and shuffled once; a chunk's ids are
stored as one row. Passes over chunks count ids and train the network: in each of ``ROUNDS``
rounds every chunk runs Adam over its share of its windows, and the parameters are averaged
(input rows and group outputs by how often a chunk has them); sums are made in each task first. The rounds
together take every window once, or more often where there are fewer than
``LEAST_WINDOWS``. For the counts of the base score a chunk sends each of its words once, with its
count, to a bucket of the word's hash; buckets add up and return the counts to each chunk in
the order in which it sent them. No word list is broadcast or gathered.

Rows whose crc32(id as text) mod 10 is 0 teach nothing. Null or empty texts are an end
alone. Repeated rows are scored and counted each. Null ids count as the empty text and are
held out. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.bpe import byte_bpe, loaded
from rallyframe.llm.shared import crc_mod, kept_by_worker, let_go, row_key, stored
from rallyframe.llm.text import U, IdTable, Words, blocks

WINDOW, OVERLAP, WIDTH, HIDDEN = 32, 8, 24, 48
GROUPS, GROUP, BINS, KNOWN_INPUTS = 32, 64, 3, 4096
ROUNDS, LEAST_WINDOWS, BATCH = 8, 57_600, 128
CHUNK_BYTES = 8 << 20
SLICE, SPAN = 4096, 1 << 14
KEEP_WORDS = 600_000
MOD = 10


class Subwords:
    """Ids of words; a table of at most ``KEEP_WORDS`` words, found by 128 bits of their hashes, saves time."""

    def __init__(self, path: str):
        self.bpe = loaded(path)
        self.end = next(iter(self.bpe.special.values()))
        self.size = len(self.bpe.bytes)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.known = IdTable(KEEP_WORDS, self.kind)

    def cut(self, word: bytes) -> list[int]:
        return [i for p in self.bpe.split(" " + word.decode("utf-8", "replace")) for i in self.bpe.encode_bytes(p.encode())]

    def sequence(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after the other, each with the end, and their offsets; ``h``: the words' hashes."""
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        two = words.hashes(seed=29, lower=True)[first] if len(u) else u
        entry = self.known.find(u, two)
        new = np.flatnonzero(entry < 0)
        made = [self.cut(lower_ascii(words.word(k))) for k in first[new].tolist()]
        n0, ids0 = self.known.lists(entry[entry >= 0])
        n1, ids1 = np.array([len(x) for x in made], np.int64), np.array([i for x in made for i in x], self.kind)
        lens, offset = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        lens[entry >= 0], offset[entry >= 0] = n0, np.cumsum(n0) - n0
        lens[new], offset[new] = n1, len(ids0) + np.cumsum(n1) - n1
        self.known.add(u[new], two[new], n1, ids1)
        flat = np.concatenate([ids0, ids1]).astype(np.int64)
        n = lens[inverse] if len(u) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        docs = len(words.first) - 1
        bound = ends[words.first] + np.arange(docs + 1)  # one end for each text before it
        out = np.full(bound[-1], self.end, np.int64)
        if len(flat):
            source = np.repeat(offset[inverse] - ends[:-1], n) + np.arange(ends[-1])
            out[np.arange(ends[-1]) + np.repeat(words.owner(), n)] = flat[source]
        return out, bound


def lower_ascii(word: bytes) -> bytes:
    return word.lower()  # bytes: A-Z only


@kept_by_worker
def subwords(path: str) -> Subwords:
    return Subwords(path)


@dataclass
class Network:
    """Group of each id, place in it (-1: none of its own) with log10 share in the group, input row; parameters."""

    group: np.ndarray
    place: np.ndarray
    share: np.ndarray
    inputs: np.ndarray
    p: dict[str, np.ndarray]
    starts: np.ndarray  #: ids that start a word, the end among them
    n_starts: int  #: groups of such ids; they come first
    end: int


def make_groups(counts: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """From ids' counts: groups, places, log10 shares, input rows, number of groups, and of those whose ids start words (they come first)."""
    smooth = counts + 0.1
    order = np.argsort(-smooth, kind="stable")
    group, place, n = np.zeros(len(counts), np.int64), np.full(len(counts), -1), 0
    for kind in (True, False):
        mine = order[(starts[order] == kind) & (order != end)]
        top, rest = mine[: GROUPS * GROUP], mine[GROUPS * GROUP :]
        group[top], place[top] = n + np.arange(len(top)) // GROUP, np.arange(len(top)) % GROUP
        n += GROUPS
        mass = np.cumsum(smooth[rest])
        if len(rest):
            group[rest] = n + np.minimum(BINS - 1, (mass - smooth[rest]) * BINS // mass[-1]).astype(np.int64)
        n += BINS
        if kind:
            group[end] = n
            n += 1
            n_starts = n
    total = np.bincount(group, smooth, minlength=n)
    share = np.where(place < 0, np.log10(smooth) - np.log10(total[group]), 0.0)
    inputs = KNOWN_INPUTS + group
    inputs[order[:KNOWN_INPUTS]] = np.arange(KNOWN_INPUTS)
    return group, place, share, inputs, n, n_starts


def start_parameters(n_groups: int, group: np.ndarray, place: np.ndarray, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random numbers; biases from the counts."""
    r = np.random.default_rng(seed)
    make = lambda *s, scale=1.0: (r.standard_normal(s) * scale / math.sqrt(s[-2])).astype(np.float32)
    mass = np.bincount(group, counts + 0.1, minlength=n_groups)
    inner = np.full((n_groups, GROUP), -30.0, np.float32)
    at = place >= 0
    inner[group[at], place[at]] = np.log((counts[at] + 0.1) / mass[group[at]])
    return {
        "embed": (r.standard_normal((KNOWN_INPUTS + n_groups, WIDTH)) * 0.3).astype(np.float32),
        "place": (r.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
        "q": make(WIDTH, WIDTH), "k": make(WIDTH, WIDTH), "v": make(WIDTH, WIDTH), "o": make(WIDTH, WIDTH, scale=0.5),
        "w1": make(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": make(HIDDEN, WIDTH, scale=0.5),
        "out": make(WIDTH, n_groups, scale=0.5), "bias": np.log(mass / mass.sum() + 1e-6).astype(np.float32),
        "out2": make(n_groups, WIDTH, GROUP, scale=0.5), "bias2": inner,
    }


MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)


def exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of ``z``, in its place, and the row sums (by a product, which takes a quarter of the time of a sum)."""
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[-1], z.dtype)


def soft(z: np.ndarray) -> np.ndarray:
    z, total = exps(z)
    z *= (1 / total)[..., None]
    return z


def hidden(p: dict[str, np.ndarray], x: np.ndarray, skip: int = 0) -> tuple[np.ndarray, tuple]:
    """States at the places from ``skip`` on of windows x of input rows, and what backward needs."""
    b, t = x.shape
    e = p["embed"].take(x, 0)
    e += p["place"][:t]
    kv = (e.reshape(b * t, WIDTH) @ np.concatenate([p["k"], p["v"]], 1)).reshape(b, t, 2 * WIDTH)
    late = e[:, skip:].reshape(-1, WIDTH)
    q = (late @ (p["q"] / late.dtype.type(math.sqrt(WIDTH)))).reshape(b, t - skip, WIDTH)
    a = q @ kv[..., :WIDTH].transpose(0, 2, 1)
    a += MASK[skip:t, :t]
    a = soft(a)
    c = (a @ kv[..., WIDTH:]).reshape(-1, WIDTH)
    h = c @ p["o"]
    h += late
    z = h @ p["w1"]
    z += p["b1"]
    np.maximum(z, 0, out=z)
    u = z @ p["w2"]
    u += h
    return u, (x, e, late, q, kv, a, c, h, z)


def backward(p: dict[str, np.ndarray], du: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """From the gradient of ``hidden``'s states those of its matrices, and of the inputs at all places."""
    x, e, late, q, kv, a, c, h, z = kept
    b, t = x.shape
    skip, g = t - q.shape[1], {}
    g["w2"] = z.T @ du
    dz = du @ p["w2"].T
    dz *= z > 0
    g["w1"], g["b1"] = h.T @ dz, np.ones(len(dz), dz.dtype) @ dz
    dh = dz @ p["w1"].T
    dh += du
    g["o"] = c.T @ dh
    dc = (dh @ p["o"].T).reshape(b, t - skip, WIDTH)
    ds = dc @ kv[..., WIDTH:].transpose(0, 2, 1)
    ds -= ((ds * a) @ np.ones(t, a.dtype))[..., None]
    ds *= a
    dkv = np.empty_like(kv)
    dkv[..., :WIDTH], dkv[..., WIDTH:] = ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dc
    dq = (ds @ kv[..., :WIDTH]).reshape(-1, WIDTH)
    dq *= dq.dtype.type(1 / math.sqrt(WIDTH))
    dkv = dkv.reshape(b * t, 2 * WIDTH)
    both = e.reshape(b * t, WIDTH).T @ dkv
    g["q"], g["k"], g["v"] = late.T @ dq, both[:, :WIDTH], both[:, WIDTH:]
    de = (dkv @ np.concatenate([p["k"], p["v"]], 1).T).reshape(b, t, WIDTH)
    dh += dq @ p["q"].T
    de[:, skip:] += dh.reshape(b, t - skip, WIDTH)
    return g, de


def by_group(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of targets in which those with a place in a group come first, by group; (group, from, to) of their runs."""
    key = np.where(place >= 0, group, 1 << 15).astype(np.uint16)  # sorted by radix
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = [*np.flatnonzero(np.diff(key, prepend=np.uint16(1 << 15), append=np.uint16(1 << 15))).tolist()]
    return order, [(int(key[a]), a, z) for a, z in zip(at[:-1], at[1:], strict=True)]


def in_groups(p: dict[str, np.ndarray], u: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Outputs inside the groups, of the targets' states in the order of ``by_group``."""
    z = np.empty((runs[-1][2] if runs else 0, GROUP), u.dtype)
    for g, a, b in runs:
        np.matmul(u[a:b], p["out2"][g], out=z[a:b])
        z[a:b] += p["bias2"][g]
    return z


def predicted(p: dict[str, np.ndarray], u: np.ndarray, group: np.ndarray, place: np.ndarray, n_starts: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each target (its group, and its place if it has one), and that of any start of a word."""
    z = u @ p["out"]
    z += p["bias"]
    one, total = exps(z)
    got = one[np.arange(len(u)), group] / total
    starts = one @ (np.arange(one.shape[1]) < n_starts).astype(one.dtype) / total
    order, runs = by_group(group, place)
    one, total = exps(in_groups(p, u[order], runs))
    placed = order[: len(one)]
    got[placed] *= one[np.arange(len(one)), place[placed]] / total
    return np.log10(np.maximum(got, 1e-30)), np.log10(np.maximum(starts, 1e-30))


def summed_rows_at(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by index."""
    index = index.astype(np.uint16) if n <= 1 << 16 else index  # sorted by radix
    order = np.argsort(index, kind="stable")
    index = index[order]
    lead = np.flatnonzero(np.r_[True, index[1:] != index[:-1]]) if len(index) else order
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[index[lead]] = np.add.reduceat(rows.take(order, 0), lead) if len(lead) else 0
    return out


def gradient(p: dict[str, np.ndarray], x: np.ndarray, group: np.ndarray, place: np.ndarray, on: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood of the targets (flat) where ``on``.

    Windows without a target in the ``OVERLAP`` have states only after it.
    """
    t, on = x.shape[1], on.reshape(x.shape)
    early = on[:, :OVERLAP].any(1)
    parts = [(w, skip, *hidden(p, x[w], skip)) for w, skip in ((np.flatnonzero(early), 0), (np.flatnonzero(~early & on.any(1)), OVERLAP)) if len(w)]
    use = [np.flatnonzero(on[w, skip:]) for w, skip, *_ in parts]
    at = [(w[:, None] * t + np.arange(skip, t)).reshape(-1)[i] for (w, skip, *_), i in zip(parts, use, strict=True)]  # among all targets
    at = np.concatenate([np.zeros(0, np.int64), *at])
    order, runs = by_group(group[at], place[at])
    group, place = group[at[order]], place[at[order]]
    w_all = np.concatenate([np.zeros((0, WIDTH), p["out"].dtype), *(u.take(i, 0) for (_, _, u, _), i in zip(parts, use, strict=True))]).take(order, 0)
    each = w_all.dtype.type(1 / max(1, len(at)))
    d = w_all @ p["out"]
    d += p["bias"]
    d = soft(d)
    d[np.arange(len(d)), group] -= 1
    d *= each
    g = {"out": w_all.T @ d, "bias": np.ones(len(d), d.dtype) @ d, "out2": np.zeros_like(p["out2"]), "bias2": np.zeros_like(p["bias2"])}
    du = d @ p["out"].T
    d2 = soft(in_groups(p, w_all, runs))
    d2[np.arange(len(d2)), place[: len(d2)]] -= 1
    d2 *= each
    for j, a, b in runs:
        np.matmul(w_all[a:b].T, d2[a:b], out=g["out2"][j])
        du[a:b] += d2[a:b] @ p["out2"][j].T
    if runs:
        g["bias2"][[j for j, _, _ in runs]] = np.add.reduceat(d2, [a for _, a, _ in runs])
    back = np.empty_like(du)
    back[order] = du
    inputs, first = np.zeros((*x.shape, WIDTH), du.dtype), 0
    for (w, _, u, kept), i in zip(parts, use, strict=True):
        here = np.zeros_like(u)
        here[i] = back[first : first + len(i)]
        first += len(i)
        own, inputs[w] = backward(p, here, kept)
        for c, v in own.items():
            g[c] = g[c] + v if c in g else v
    g["place"] = np.zeros_like(p["place"])
    g["place"][:t] = inputs.sum(0)
    g["embed"] = summed_rows_at(x.reshape(-1), inputs.reshape(-1, WIDTH), len(p["embed"]))
    return {c: g[c] if c in g else np.zeros_like(v) for c, v in p.items()}


def windows(ids: np.ndarray, bound: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input places (-1: the start of a text), target places and whether a target is scored here, by window.

    ``ids`` are texts one after the other with offsets ``bound``; an input is the id before its target.
    """
    return windows_at(*window_list(bound), bound)


def window_list(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and its number in the text."""
    many = np.maximum(1, 1 + -(-(np.diff(bound) - WINDOW) // (WINDOW - OVERLAP)))
    own = np.repeat(np.arange(len(many)), many)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)


def windows_at(own: np.ndarray, nth: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for some windows of the list."""
    at = (nth * (WINDOW - OVERLAP))[:, None] + np.arange(WINDOW)
    inside = at < (bound[own + 1] - bound[own])[:, None]
    scored = inside & ((np.arange(WINDOW) >= OVERLAP) | (nth == 0)[:, None])
    target = np.where(inside, at + bound[own][:, None], 0)
    before = np.where(at == 0, -1, target - 1)
    return before, target, scored


def text_scores(net: Network, ids: np.ndarray, bound: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """log10 probability of each text: of its words, each given that a word starts, and of its end."""
    before, target, scored = windows(ids, bound, net.end)
    x_all = net.inputs[ids]
    own, start = net.share[ids].copy(), np.zeros(len(ids))
    first = target[:, 0] == bound[np.searchsorted(bound, target[:, 0], "right") - 1]
    for mine, skip in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), OVERLAP)):
        for a in range(0, len(mine), batch):
            w = mine[a : a + batch]
            bf, tg, on = before[w], target[w, skip:].reshape(-1), scored[w, skip:].reshape(-1)
            u, _ = hidden(net.p, np.where(bf < 0, net.inputs[net.end], x_all[bf]), skip)
            y = ids[tg[on]]
            got, starts = predicted(net.p, u[on], net.group[y], net.place[y], net.n_starts)
            own[tg[on]] += got
            start[tg[on]] = starts
    begins = net.starts[ids]
    begins[bound[:-1]] = False  # the first start of a text is certain
    inner = own - np.where(net.starts[ids], start, 0.0)  # given that a word starts
    total = np.concatenate([[0.0], np.cumsum(inner + np.where(begins, start, 0.0))])
    return total[bound[1:]] - total[bound[:-1]]


def passed(held: DataFrame, kind: str, size: int, work) -> np.ndarray:
    """Sum over all chunks of the array of ``size`` that ``work`` makes of (ids, bound, chunk): in each task first, then by slices."""

    def run(batches):
        let_go()
        total = np.zeros(size)
        for b in batches:
            for chunk, ids, bound, train in zip(b["chunk"].to_pylist(), b["ids"], b["bound"], b["train"], strict=True):
                ids, bound, use = np.frombuffer(ids.as_buffer(), kind), np.frombuffer(bound.as_buffer(), np.int64), np.frombuffer(train.as_buffer(), bool)
                n = np.diff(bound)
                total += work(ids[np.repeat(use, n)], np.concatenate([[0], np.cumsum(n[use])]), chunk)
        at = range(0, size, SLICE)
        yield pa.record_batch([pa.array(range(len(at)), pa.int64()), pa.array([total[a : a + SLICE].astype(np.float32 if short else float).tobytes() for a in at], pa.binary())], names=["slice", "data"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32 if short else float).astype(float) for x in table["data"])
        return pa.table({"slice": table["slice"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    short = size > 100_000  # parameters go as single floats
    parts = held.select("chunk", "ids", "bound", "train").mapInArrow(run, "slice long, data binary")
    got = {r["slice"]: np.frombuffer(r["data"]) for r in parts.groupBy("slice").applyInArrow(added, "slice long, data binary").collect()}  # as many as slices
    return np.concatenate([np.zeros(0), *(got[k] for k in range(len(got)))]) if got else np.zeros(size)


def n_windows(bound: np.ndarray) -> int:
    return int(np.maximum(1, 1 + -(-(np.diff(bound) - WINDOW) // (WINDOW - OVERLAP))).sum())


def share_of_round(n: int, epochs: int, k: int, chunk: int, seed: int) -> np.ndarray:
    """The windows, of ``n``, that a chunk takes in round ``k``; all rounds together take each ``epochs`` times."""
    lo, hi = n * epochs * k // ROUNDS, n * epochs * (k + 1) // ROUNDS
    each = [np.random.default_rng([seed, chunk, e]).permutation(n)[max(lo - e * n, 0) : hi - e * n] for e in range(lo // n, -(-hi // n))]
    return np.concatenate([np.zeros(0, np.int64), *each])


def learn(net: Network, ids: np.ndarray, bound: np.ndarray, chunk: int, k: int, epochs: int, rate: float = 0.01, seed: int = 2) -> np.ndarray:
    """Adam over a chunk's windows of round ``k``: counts of input rows and of groups, number of windows, parameters times these."""
    flat = np.concatenate([v.reshape(-1) for v in net.p.values()])
    ends = np.cumsum([v.size for v in net.p.values()]).tolist()
    p = {c: flat[e - v.size : e].reshape(v.shape) for (c, v), e in zip(net.p.items(), ends, strict=True)}  # parts of one array
    own, nth = window_list(bound)
    mine = share_of_round(len(own), epochs, k, chunk, seed)
    met, used = np.zeros(len(p["embed"])), np.zeros(len(p["out2"]))
    m1, m2, g, work = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.zeros(SPAN, np.float32)
    steps = -(-len(mine) // BATCH)
    for step in range(1, steps + 1):
        pick = mine[(step - 1) * BATCH : step * BATCH]
        bf, tg, on = windows_at(own[pick], nth[pick], bound)  # a batch at a time: a chunk's windows all at once take 50 bytes an id
        tg, on = tg.reshape(-1), on.reshape(-1)
        x = np.where(bf < 0, net.inputs[net.end], net.inputs[ids[bf]])
        y = ids[tg]
        np.concatenate([v.reshape(-1) for v in gradient(p, x, net.group[y], net.place[y], on).values()], out=g)
        met += np.bincount(x.reshape(-1), minlength=len(met))
        used += np.bincount(net.group[y[on]], minlength=len(used))
        lr = rate * min(1, step / 20) * (1 - 0.9 * (k + step / steps) / ROUNDS)
        one, two = lr / (1 - 0.9**step), 1 / math.sqrt(1 - 0.99**step)
        for at in range(0, len(flat), SPAN):  # in place and by parts that stay in a core's own cache
            s = slice(at, at + SPAN)
            w = work[: len(flat[s])]
            np.subtract(g[s], m1[s], out=w)
            w *= np.float32(0.1)
            m1[s] += w
            np.multiply(g[s], g[s], out=w)
            w -= m2[s]
            w *= np.float32(0.01)
            m2[s] += w
            np.sqrt(m2[s], out=w)
            w *= np.float32(two)
            w += np.float32(1e-6)
            np.divide(m1[s], w, out=w)
            w *= np.float32(one)
            flat[s] -= w
    weight = {"embed": met[:, None], "out2": used[:, None, None], "bias2": used[:, None]}
    return np.concatenate([met, used, [len(mine)], *((v * weight.get(c, len(mine))).reshape(-1) for c, v in p.items())])


def train(held: DataFrame, kind: str, counts: np.ndarray, n: int, starts: np.ndarray, end: int) -> Network:
    """Rounds over ``n`` windows of all training texts, parameters averaged after each."""
    group, place, share, inputs, many, n_starts = make_groups(counts, starts, end)
    net = Network(group, place, share, inputs, start_parameters(many, group, place, counts), starts, n_starts, end)
    epochs = -(-LEAST_WINDOWS // n) if n else 0
    rows, size = len(net.p["embed"]), sum(v.size for v in net.p.values())
    for k in range(ROUNDS if n else 0):
        now = held.sparkSession.sparkContext.broadcast(net)
        total = passed(held, kind, rows + many + 1 + size, lambda ids, bound, chunk, now=now, k=k: learn(now.value, ids, bound, chunk, k, epochs))
        met, used, taken, at = total[:rows], total[rows : rows + many], total[rows + many], rows + many + 1
        weight = {"embed": met[:, None], "out2": used[:, None, None], "bias2": used[:, None]}
        for c, v in net.p.items():
            x, at = total[at : at + v.size].reshape(v.shape), at + v.size
            w = weight.get(c, np.full([1] * v.ndim, taken))
            net.p[c] = np.where(w > 0, x / np.maximum(w, 1), v).astype(np.float32)
        now.unpersist()
    return net


def by_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the buckets in sorted hashes."""
    return np.searchsorted((h >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1, dtype=U))


def word_starts(path: str) -> np.ndarray:
    """Which ids start a word: those with a leading space, and the end."""
    sub = subwords(path)
    starts = np.array([b.startswith(b" ") for b in sub.bpe.bytes])
    starts[sub.end] = True
    return starts


def packed(dealt: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of each chunk, in the order of keys. One with bucket -1: the texts' row ids, ids, words (as places among the
    chunk's distinct words, three bytes each), offsets of both, which texts train. For each bucket one with the hashes
    of the chunk's distinct words, and how often each is in training texts."""
    types = dict(dealt.dtypes)

    def run(table: pa.Table) -> pa.Table:
        sub, table = subwords(path), table.sort_by("k")
        train = np.asarray(table["train"]).astype(bool)
        ids, bounds, word_bounds, hashes, inverses, counts, base = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [], [], 0
        for a, z, words in blocks(table["t"]):
            h = words.hashes(seed=17, lower=True)
            seq, bound = sub.sequence(words, h)
            ids.append(seq.astype(sub.kind))
            bounds.append(bound[1:] + base)
            base += len(seq)
            word_bounds.append(words.first[1:] + word_bounds[-1][-1])
            u, inverse = np.unique(h, return_inverse=True)
            hashes.append(u)
            inverses.append(inverse)
            counts.append(np.bincount(inverse[train[a:z][words.owner()]], minlength=len(u)))
        u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), minlength=len(u)).astype("<u4")
        place, at = [], 0
        for own, inv in zip(hashes, inverses, strict=True):
            place.append(inverse[at : at + len(own)][inv].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
            at += len(own)
        cuts = by_bucket(u, buckets)
        full = np.flatnonzero(np.diff(cuts)).tolist()
        m = len(full)
        none = lambda x: pa.array([x] + [None] * m, pa.binary())
        rows = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table["i"].combine_chunks())
        return pa.table({
            "chunk": pa.array([table["chunk"][0].as_py()] * (m + 1), pa.int64()), "bucket": pa.array([-1, *full], pa.int64()), "i": pa.concat_arrays([rows, pa.nulls(m, rows.type)]),
            "ids": none(b"".join(x.tobytes() for x in ids)), "bound": none(np.concatenate(bounds).tobytes()), "train": none(train.tobytes()), "words": none(b"".join(place)), "word_bound": none(np.concatenate(word_bounds).tobytes()),
            "h": pa.array([None, *(u[cuts[b] : cuts[b + 1]].tobytes() for b in full)], pa.binary()), "n": pa.array([None, *(n[cuts[b] : cuts[b + 1]].tobytes() for b in full)], pa.binary()),
        })

    schema = f"chunk long, bucket long, i array<{types['i']}>, ids binary, bound binary, train binary, words binary, word_bound binary, h binary, n binary"
    return stored(dealt.select("chunk", "k", "i", "t", "train").groupBy("chunk").applyInArrow(run, schema), "packed")


def returned(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, data): counts of a chunk's words over all chunks; chunk -2: number of distinct training words, then of all."""

    def add(table: pa.Table) -> pa.Table:
        hashes, counts = ([np.frombuffer(x.as_buffer(), t) for x in table[c]] for c, t in (("h", U), ("n", "<u4")))
        u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), minlength=len(u)).astype(np.int64)
        cuts = np.cumsum([0] + [len(x) for x in hashes])
        data = [total[inverse[a:z]].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        data.append(np.array([(total > 0).sum(), total.sum()], np.int64).tobytes())
        return pa.table({"chunk": pa.array([*table["chunk"].to_pylist(), -2], pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    return stored(sent.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, data binary"), "counts")


def learned(held: DataFrame, path: str) -> Network:
    """The network that all training texts of the chunks give."""
    sub = subwords(path)
    size = sub.size
    met = passed(held, sub.kind, size + 1, lambda ids, bound, chunk: np.append(np.bincount(ids, minlength=size), n_windows(bound)))
    return train(held, sub.kind, met[:-1], int(met[-1]), word_starts(path), sub.end)


def dealt_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Rows (i, t, k, train, chunk), the number of chunks and of training rows; the chunk only decides where a text is worked on."""
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"), row_key(id_col, text_col).alias("k"), (crc_mod(F.col(id_col), MOD) != 0).alias("train"))
    rows = rows.withColumn("train", F.col("train") & F.col("i").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t")).alias("bytes"), F.sum(F.col("train").cast("long")).alias("train")).first()
    chunks = max(1, -(-(size["bytes"] or 0) // CHUNK_BYTES))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("long")), chunks, int(size["train"] or 0)


def score(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    path = path or byte_bpe()
    spark, sub = docs.sparkSession, subwords(path)
    dealt, chunks, n_train = dealt_rows(docs, id_col, text_col)
    whole = packed(dealt, path, int(min(chunks, 1 << 16)))
    held = whole.filter("bucket = -1")
    back = returned(whole.filter("bucket >= 0").select("chunk", "bucket", "h", "n"))
    totals = [np.frombuffer(r["data"], np.int64) for r in back.filter("chunk = -2").toLocalIterator()]  # one for each bucket
    distinct, n_words = (int(x) for x in np.sum(totals, 0)) if totals else (0, 0)
    n, v = n_words + n_train, distinct + (n_train > 0)
    net = spark.sparkContext.broadcast(learned(held, path))
    kind = sub.kind

    def judged(batches):
        """The network's score of each text of a chunk."""
        let_go()
        for b in batches:
            for chunk, ids, bound in zip(b["chunk"].to_pylist(), b["ids"], b["bound"], strict=True):
                ids, bound = np.frombuffer(ids.as_buffer(), kind), np.frombuffer(bound.as_buffer(), np.int64)
                out, a = np.zeros(len(bound) - 1), 0
                while a < len(out):  # some texts at once, however long each is
                    z = max(a + 1, int(np.searchsorted(bound, bound[a] + (1 << 17), "right")) - 1)
                    out[a:z] = text_scores(net.value, ids[bound[a] : bound[z]].astype(np.int64), bound[a : z + 1] - bound[a])
                    a = z
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([-1], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "bucket", "data"])

    scores = held.select("chunk", "ids", "bound").mapInArrow(judged, "chunk long, bucket long, data binary")

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        """Base scores from the counts that came back, and the network's scores."""
        none = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not table.num_rows:
            return pa.table({"i": pa.array([], table.schema.field("i").type.value_type)} | {c: pa.array([], t) for c, t in none.items()})
        order = np.argsort(np.asarray(got["bucket"]), kind="stable")
        score_, *counts = (np.frombuffer(got["data"][int(o)].as_buffer(), float if j == 0 else np.int64) for j, o in enumerate(order))
        c = np.concatenate([np.zeros(0, np.int64), *counts])
        place = np.zeros((len(table["words"][0].as_buffer()) // 3, 4), np.uint8)
        place[:, :3] = np.frombuffer(table["words"][0].as_buffer(), np.uint8).reshape(-1, 3)
        place = place.reshape(-1).view("<u4").astype(np.int64)
        bound = np.frombuffer(table["word_bound"][0].as_buffer(), np.int64)
        own, docs_ = np.repeat(np.arange(len(bound) - 1), np.diff(bound)), len(bound) - 1
        n_tokens = np.diff(bound) + 1
        known = np.bincount(own, c[place] > 0, minlength=docs_).astype(np.int64) + (n_train > 0)
        rest = math.log10(n + 0.1 * (v + 1))
        base = np.bincount(own, np.log10(c + 0.1)[place], minlength=docs_) + math.log10(n_train + 0.1) - n_tokens * rest
        return pa.table({"i": table["i"].combine_chunks().flatten(), "n_tokens": n_tokens, "n_known": known, "base_score": base, "score": score_})

    back_ = back.filter("chunk >= 0").unionByName(scores)
    joined = held.select("chunk", "i", "words", "word_bound").groupBy("chunk").cogroup(back_.groupBy("chunk"))
    scored = joined.applyInArrow(finish, f"i {dict(dealt.dtypes)['i']}, n_tokens long, n_known long, base_score double, score double")
    out = (crc_mod(F.col("i"), MOD) == 0) | F.col("i").isNull()
    return scored.select(F.col("i").alias(id_col), out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
