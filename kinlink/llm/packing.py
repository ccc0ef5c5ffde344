"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

Every text is measured once, in tokens of a public tokenizer; only these sizes move on. Texts are spread by a hash of
their id over groups of about GROUP texts, packed apart from each other, so that no task ever holds more than one group;
a group costs at most one badly filled container. Within a group containers are filled one after the other: of the items
that fit, the one whose demand (tokens, segments, loss-bearing tokens, each as a share of its limit) has the largest dot
product with what is left of the container goes in. A text longer than the capacity is cut into full pieces and a rest,
any other stays whole.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.scratch import Scratch

GROUP = 4000
#: capacities of one call
MOST_CAPACITIES = 1000
_TIMING = re.compile(r"(?m)^[ \t﻿]*(?:\d+[ \t]*|[^\n]*-+>[^\n]*)$\n?")


@dataclass(frozen=True)
class Limits:
    """Of one container besides its tokens. segments: pieces of texts in it; loss: share of the capacity that may bear loss.
    Times and numbers of cues bear none, which leaves some 53 % of a subtitle's tokens; a text that bears more than the
    limit by itself stands alone."""

    segments_per_token: float = 1 / 32
    least_segments: int = 16
    loss: float = 0.6

    def of(self, capacity: int) -> np.ndarray:
        return np.array([capacity, max(self.least_segments, int(capacity * self.segments_per_token)), self.loss * capacity], float)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return importlib.import_module("public_tokenizers").path(name)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str | None):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = pattern or importlib.import_module("public_tokenizers").PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _measure(path: str, pattern: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path, pattern).encode_ordinary
        for b in batches:
            tokens = [len(encode(t)) for t in b["text"]]
            # numbers and times of cues are given, not learnt
            given = [len(encode("".join(_TIMING.findall(t)))) if n else 0 for t, n in zip(b["text"], tokens, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": tokens, "loss": [max(0, n - g) for n, g in zip(tokens, given, strict=True)]})

    return run


def measured(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, tokens, loss) of documents(doc_id, text) with a text; path: a file of byte-pair ranks."""
    return documents.where("text is not null").select("doc_id", "text").mapInPandas(_measure(path or tokenizer_path(), pattern), "doc_id bigint, tokens int, loss int")


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, limits: Limits | None = None) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (index of text, first token, number of tokens)."""
    limit = (limits or Limits()).of(capacity)
    out: list[list[tuple[int, int, int]]] = []
    index, first, size, bears = [], [], [], []
    for i, (n, m) in enumerate(zip(tokens.tolist(), loss.tolist(), strict=True)):
        whole = n // capacity if n > capacity else 0
        out += [[(i, k * capacity, capacity)] for k in range(whole)]
        rest = n - whole * capacity
        if rest or not n:
            index.append(i)
            first.append(whole * capacity)
            size.append(rest)
            bears.append(round(m * rest / n) if n else 0)
    demand = np.stack([np.array(size, float), np.ones(len(size)), np.array(bears, float)], axis=1) / limit if size else np.zeros((0, 3))
    alone = demand[:, 2] > 1 + 1e-9  # it can't be cut, as it isn't longer than the capacity
    out += [[(index[j], first[j], size[j])] for j in np.flatnonzero(alone)]
    order = np.flatnonzero(~alone)
    order = order[np.argsort(-demand[order, 0], kind="stable")]
    demand = demand[order]
    left = np.arange(len(order))
    while len(left):
        room = np.ones(3)
        box: list[int] = []
        mine = demand[left]
        alive = np.ones(len(left), bool)
        while True:
            fits = alive & (mine <= room + 1e-9).all(axis=1)
            if not fits.any():
                break
            k = int(np.where(fits, mine @ room, -1.0).argmax())
            alive[k] = False
            room = room - mine[k]
            box.append(int(order[left[k]]))
        out.append([(index[j], first[j], size[j]) for j in box])
        left = left[alive]
    return out


def _group(limits: Limits):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        ids = g["doc_id"].to_numpy()
        limit_id, capacity, group = key
        rows = []
        for c, box in enumerate(pack(g["tokens"].to_numpy(), g["loss"].to_numpy(), int(capacity), limits)):
            rows += [(limit_id, int(capacity), (int(group) << 32) + c, p, int(ids[i]), a, n) for p, (i, a, n) in enumerate(box)]
        return pd.DataFrame(rows, columns=["limit_id", "capacity_tokens", "container_id", "position", "doc_id", "first_token", "n_tokens"])

    return run


def packed(documents: DataFrame, capacities: DataFrame, limits: Limits | None = None, path: str | None = None, scratch: Scratch | None = None, group: int = GROUP) -> DataFrame:
    """(limit_id, capacity_tokens, container_id, position, doc_id, first_token, n_tokens): a container for every text of
    documents(doc_id, text), in each capacity of capacities(limit_id, capacity_tokens). Null texts are none; an empty one
    takes a segment and no token. Capacities below 1 are an error. The same input gives the same containers."""
    scratch = scratch or Scratch(documents.sparkSession, "packing")
    sizes = scratch.cut(measured(documents, path))
    groups = max(1, round(sizes.count() / group))
    jobs = capacities.select("limit_id", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).where("limit_id is not null and capacity_tokens is not null").distinct()
    each = sizes.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    # a handful of capacities is the bounded side here; every group is packed once for each
    wanted = [(r.limit_id, r.capacity_tokens) for r in jobs.limit(MOST_CAPACITIES + 1).collect()]
    if len(wanted) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    if any(c < 1 for _, c in wanted):
        raise ValueError("capacities must be positive")
    if not wanted:
        each, wanted = each.limit(0), [(0, 1)]
    each = each.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity_tokens")) for i, c in wanted]))).select("doc_id", "tokens", "loss", "grp", "_c.*")
    return each.groupBy("limit_id", "capacity_tokens", "grp").applyInPandas(_group(limits or Limits()), "limit_id int, capacity_tokens int, container_id bigint, position int, doc_id bigint, first_token int, n_tokens int")


def filling(containers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each capacity: (limit_id, capacity_tokens, texts, tokens, placed, repeated, cut, containers, over, fill). sizes(doc_id,
    tokens) is what was to be packed: placed are its tokens in containers; repeated, texts in pieces that aren't the whole of
    them or overlap; cut, texts in pieces that would have fitted; over, containers with more tokens than they hold; fill, the
    share of their room that is used."""
    keys = ["limit_id", "capacity_tokens"]
    boxes = containers.groupBy(*keys, "container_id").agg(F.sum("n_tokens").alias("n"))
    boxes = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("containers"), F.sum((F.col("n") > F.col("capacity_tokens")).cast("int")).alias("over"), (F.sum("n") / F.sum("capacity_tokens")).alias("fill"))
    pieces = containers.groupBy(*keys, "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    texts = pieces.join(sizes.select("doc_id", "tokens"), "doc_id", "full")
    wrong = (F.col("placed") != F.col("tokens")) | (F.col("end") != F.col("tokens")) | F.col("placed").isNull() | F.col("tokens").isNull()
    texts = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), F.sum("placed").alias("placed"), F.sum(wrong.cast("int")).alias("repeated"), F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).cast("int")).alias("cut"))
    return texts.join(boxes, keys, "left")
