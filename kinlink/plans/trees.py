"""Gradient-boosted trees for a binary label, fitted to whole tables in one job.

Every task bins its rows once and keeps them, a byte a value. For each level of each tree the tasks of a barrier stage add up
their histograms of gradients and come to the same splits, so that no round waits for jobs to be planned and no row leaves
its task. Rows are drawn for a tree by a hash of their ids, the same ones whatever the tasks.
"""

from __future__ import annotations

import base64
import io
import secrets
import socket
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
DEPTH = 6
RATE = 0.06
ROWS = 0.85
COLUMNS = 0.9
LEAST_WEIGHT = 2.0
RIDGE = 2.0
#: a task more for so many rows, up to the cores there are
ROWS_A_TASK = 50_000


def edges(rows: DataFrame, names: tuple[str, ...]) -> list[np.ndarray]:
    """The values that part the bins of each feature."""
    at = [i / BINS for i in range(1, BINS)]
    return [np.unique(q) for q in rows.approxQuantile(list(names), at, 0.001)]


def _binned(column: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, column, side="left").astype(np.uint8)  # values up to cuts[i] are in bins up to i


def _drawn(key: np.ndarray, seed: int) -> np.ndarray:
    """Marks ROWS of the rows, by their keys."""
    z = key + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(ROWS * 2**64))


#: joint bins of the features that are counted together
JOINT = 1024


def packs(x: np.ndarray, bins: list[int]) -> list[tuple[np.ndarray, list[int], list[int]]]:
    """Features in few groups: (joint bin of every row, the features, how many bins each has). One count by joint bins has the
    histograms of all features of a group."""
    groups: list[tuple[list[int], list[int]]] = []
    for j in sorted(range(len(bins)), key=lambda j: -bins[j]):
        fits = next((g for g in groups if np.prod(g[1]) * bins[j] <= JOINT), None)
        if fits is None:
            groups.append(fits := ([], []))
        fits[0].append(j)
        fits[1].append(bins[j])
    out = []
    for features, sizes in groups:
        code = np.zeros(x.shape[1], np.uint16)
        for j, k in zip(features, sizes, strict=True):
            code = code * np.uint16(k) + x[j]
        out.append((code, features, sizes))
    return out


def _counted(packed: list[tuple[np.ndarray, list[int], list[int]]], at: np.ndarray, base: np.ndarray, half: int, weights: tuple[np.ndarray, ...], place: np.ndarray) -> np.ndarray:
    """Sums of the weights of rows ``at`` by feature, node and bin (weights x features x nodes x BINS); place: where each
    feature goes, -1 for those not wanted."""
    out = np.zeros((len(weights), int(place.max()) + 1, half, BINS))
    for code, features, sizes in packed:
        if (place[features] < 0).all():
            continue
        size = int(np.prod(sizes))
        key = base * size + code[at]
        for w, weight in enumerate(weights):
            joint = np.bincount(key, weight, half * size).reshape(half, *sizes)
            for axis, (j, k) in enumerate(zip(features, sizes, strict=True), 1):
                if place[j] >= 0:
                    out[w, place[j], :, :k] = joint.sum(axis=tuple(i for i in range(1, len(sizes) + 1) if i != axis))
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, some: np.ndarray, columns: np.ndarray, total: Callable[[np.ndarray], np.ndarray], packed: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree on the rows ``some`` of x (features x rows; packed: the same by packs()): feature (-1: none) and last bin to
    the left of each inner node in heap order, values of the leaves, and the leaf of every row. total() adds up what the
    tasks found."""
    packed = packed or packs(x, [BINS] * len(x))
    inner, n = (1 << DEPTH) - 1, x.shape[1]
    feature, cut = np.full(inner, -1), np.full(inner, BINS)
    flat, rows = x.ravel(), np.arange(n)
    place = np.full(len(x), -1)
    place[columns] = np.arange(len(columns))
    node = np.zeros(n, np.intp)  # within its level
    last = np.zeros(0)
    for level in range(DEPTH):
        count = 1 << level
        half = max(1, count >> 1)  # of two children the one with fewer rows is counted, the other one is the rest
        at, base = some, node[some]
        if level:
            held = total(np.bincount(base, minlength=count).astype(float))
            right_one = held[1::2] < held[::2]
            least = (base & 1) == right_one[base >> 1]
            at, base = some[least], base[least] >> 1
        sums = total(_counted(packed, at, base, half, (g[at], h[at]), place))
        if level:
            rest = last - sums
            sums = np.stack([np.where(right_one[:, None], rest, sums), np.where(right_one[:, None], sums, rest)], 3).reshape(2, len(columns), count, BINS)
        last = sums
        left = sums.cumsum(axis=3)
        whole = left[:, :, :, -1:]
        right = whole - left
        worth = lambda s: s[0] ** 2 / (np.maximum(s[1], 0) + RIDGE)
        gain = np.where((left[1] >= LEAST_WEIGHT) & (right[1] >= LEAST_WEIGHT), worth(left) + worth(right) - worth(whole), 0.0)
        gain = gain.transpose(1, 0, 2).reshape(count, -1)
        best = gain.argmax(axis=1)
        good = gain[np.arange(count), best] > 1e-6
        first = count - 1
        feature[first : first + count] = np.where(good, columns[best // BINS], -1)
        cut[first : first + count] = np.where(good, best % BINS, BINS)
        here = slice(first, first + count)
        node = 2 * node + (flat.take((np.maximum(feature[here], 0) * n).take(node) + rows) > cut[here].take(node))
    size = 1 << DEPTH
    sums = total(np.stack([np.bincount(node[some], g[some], size), np.bincount(node[some], h[some], size)]))
    return feature, cut, RATE * sums[0] / (sums[1] + RIDGE), node


#: seconds after which a task that hears nothing of another fails, and the stage with it
PATIENCE = 900


def _received(peer: socket.socket, size: int) -> bytes:
    out = bytearray()
    while len(out) < size:
        if not (part := peer.recv(min(1 << 20, size - len(out)))):
            raise ConnectionError("a task of the stage is gone")
        out += part
    return bytes(out)


class _Sum:
    """Adds up arrays of the tasks of a barrier stage, in their order: the first task hears the others and answers them.
    (allGather of Spark itself takes a second each time; it serves to make the first task known.)"""

    def __init__(self, context: BarrierTaskContext):
        self.me, infos = context.partitionId(), context.getTaskInfos()
        self.others: list[socket.socket] = []
        if len(infos) == 1:
            return
        if self.me:
            port, word = next(m for m in context.allGather("") if m).split(" ")
            peer = socket.create_connection((infos[0].address.rsplit(":", 1)[0], int(port)), PATIENCE)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            peer.sendall(word.encode() + self.me.to_bytes(4, "little"))
            self.others = [peer]
            return
        word = secrets.token_hex(16)
        with socket.create_server(("", 0), backlog=len(infos)) as server:
            server.settimeout(PATIENCE)
            context.allGather(f"{server.getsockname()[1]} {word}")
            known: dict[int, socket.socket] = {}
            while len(known) < len(infos) - 1:
                peer, _ = server.accept()
                peer.settimeout(PATIENCE)
                peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                said = _received(peer, len(word) + 4)
                if secrets.compare_digest(said[:-4], word.encode()):
                    known[int.from_bytes(said[-4:], "little")] = peer
            self.others = [known[i] for i in sorted(known)]

    def __call__(self, a: np.ndarray) -> np.ndarray:
        if not self.others:
            return a
        if self.me:
            self.others[0].sendall(a.tobytes())
            return np.frombuffer(_received(self.others[0], a.nbytes)).reshape(a.shape)
        out = a.copy()
        for peer in self.others:
            out += np.frombuffer(_received(peer, a.nbytes)).reshape(a.shape)
        for peer in self.others:
            peer.sendall(out.tobytes())
        return out


def _fit(cuts: list[np.ndarray], rounds: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        total = _Sum(context)
        got = [(b["k"].to_numpy(), b["label"].to_numpy(), np.stack([_binned(b.column(i).to_numpy(), c) for i, c in enumerate(cuts)])) for b in batches]
        key, y, x = (np.concatenate([p[i] for p in got], axis=-1) if got else e for i, e in enumerate((np.zeros(0, np.int64), np.zeros(0), np.zeros((len(cuts), 0), np.uint8))))
        order = np.argsort(key, kind="stable")  # sums in the same order every time
        key, y, x = key[order].view(np.uint64), y[order], np.ascontiguousarray(x[:, order])
        packed = packs(x, [len(c) + 1 for c in cuts])
        ones, n = total(np.array([y.sum(), float(len(y))]))
        prior = float(np.log(ones / (n - ones)))
        score = np.full(len(y), prior)
        out = []
        for r in range(rounds):
            p = 1 / (1 + np.exp(-score))
            rng = np.random.default_rng((seed, r))
            columns = np.sort(rng.permutation(len(cuts))[: max(1, round(COLUMNS * len(cuts)))])
            *tree, leaf = grow(x, y - p, p * (1 - p), np.flatnonzero(_drawn(key, (seed << 20) + r)), columns, total, packed)
            score += tree[2][leaf]
            out.append(tree)
        for peer in total.others:
            peer.close()
        if total.me == 0:
            f = io.BytesIO()
            np.savez_compressed(f, feature=np.array([t[0] for t in out], np.int16), cut=np.array([t[1] for t in out], np.uint8), value=np.array([t[2] for t in out]), prior=prior, cuts=np.concatenate(cuts), ends=np.cumsum([len(c) for c in cuts]))
            yield pa.RecordBatch.from_arrays([pa.array([f.getvalue()], pa.binary())], names=["model"])

    return run


def fitted(rows: DataFrame, names: tuple[str, ...], rounds: int, seed: int) -> Trees:
    """Trees fitted to rows(source_id, target_id, names..., label)."""
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)))
    ready = rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.xxhash64("source_id", "target_id").alias("k"), F.col("label").cast("double").alias("label"))
    got = ready.repartition(tasks, "k").mapInArrow(_fit(edges(rows, names), rounds, seed), "model binary", barrier=True).collect()
    return Trees(names, base64.b64encode(got[0].model).decode())


def scorer(model: str) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Probabilities of rows given as columns."""
    m = np.load(io.BytesIO(base64.b64decode(model)))
    cuts, prior = np.split(m["cuts"], m["ends"][:-1]), float(m["prior"])
    trees = list(zip(np.maximum(m["feature"], 0).astype(np.intp), m["cut"], m["value"], strict=True))

    def run(columns: list[np.ndarray]) -> np.ndarray:
        x = np.stack([_binned(c, e) for c, e in zip(columns, cuts, strict=True)], 1)
        x, back = np.unique(x, axis=0, return_inverse=True)  # equal rows once
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        score = np.full(len(x), prior)
        for feature, cut, value in trees:
            node = np.zeros(len(x), np.intp)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (flat[start + feature[node]] > cut[node])
            score += value[node - len(feature)]
        return (1 / (1 + np.exp(-score)))[back.ravel()]

    return run


class Trees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds p, the probability of label 1."""

    names = Param(Params._dummy(), "names", "features", typeConverter=TypeConverters.toListString)
    model = Param(Params._dummy(), "model", "the trees, in base64", typeConverter=TypeConverters.toString)

    def __init__(self, names: tuple[str, ...] = (), model: str = ""):
        super().__init__()
        self._set(names=list(names), model=model)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.getOrDefault(self.model)

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            score = scorer(model)
            for columns in batches:
                yield pd.Series(score([c.to_numpy(float) for c in columns]))

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return dataset.withColumn("p", F.pandas_udf(run, "double")(*self.getOrDefault(self.names)))
