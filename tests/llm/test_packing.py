import numpy as np
import pytest

from kinlink.llm.packing import Limits, filling, measured, pack, packed


def _check(tokens, boxes, capacity, limits=None):
    limits = limits or Limits()
    seen = {}
    for box in boxes:
        assert sum(n for _, _, n in box) <= capacity and len(box) <= max(limits.of(capacity)[1], 1)
        for i, first, n in box:
            seen.setdefault(i, []).append((first, n))
    assert set(seen) == set(range(len(tokens)))
    for i, parts in seen.items():
        parts.sort()
        assert sum(n for _, n in parts) == tokens[i] and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert len(parts) == 1 or tokens[i] > capacity


def test_boxes():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 1500, 400)
    for capacity in (16, 512, 4096):
        boxes = pack(tokens, tokens // 2, capacity)
        _check(tokens, boxes, capacity)
        if capacity >= 512:
            assert len(boxes) <= 1.06 * tokens.sum() / capacity + 1


def test_limits_hold_together():
    tokens = np.array([10] * 50)
    tight = Limits(segments_per_token=0, least_segments=3)
    boxes = pack(tokens, tokens, 1000, tight)
    assert len(boxes) == 17
    bearing = Limits(loss=0.05)
    assert all(sum(n for _, _, n in b) <= 50 for b in pack(tokens, tokens, 1000, bearing))


def test_table(spark):
    rows = [(1, "hello world " * 50), (2, ""), (3, None), (4, "a" * 20_000), (5, "hello world " * 50), (6, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, tokens int")
    limits = spark.createDataFrame([(1, 64), (2, 512), (2, 512), (None, 5)], "limit_id int, capacity_tokens int")
    size = {r.doc_id: r.tokens for r in measured(docs).collect()}
    assert set(size) == {1, 2, 4, 5, 6} and size[2] == 0 and size[6] > 1
    got = packed(docs, limits).collect()
    for limit, capacity in ((1, 64), (2, 512)):
        mine = [r for r in got if r.limit_id == limit]
        for d, n in size.items():
            assert sum(r.n_tokens for r in mine if r.doc_id == d) == n
        boxes = {}
        for r in mine:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
        assert max(boxes.values()) <= capacity
    told = {r.limit_id: r for r in filling(packed(docs, limits), measured(docs)).collect()}
    assert all(told[i].texts == 5 and told[i].tokens == told[i].placed == sum(size.values()) and (told[i].repeated, told[i].cut, told[i].over) == (0, 0, 0) for i in (1, 2))
    lost = filling(packed(docs, limits).where("doc_id <> 1"), measured(docs)).where("limit_id is null").first()
    assert lost.repeated == 1
    assert packed(docs.limit(0), limits).count() == 0 and packed(docs, limits.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packed(docs, spark.createDataFrame([(1, 0)], limits.schema))


def test_capacities_are_never_dropped(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    many = spark.createDataFrame([(i, 10 + i) for i in range(1001)], "limit_id int, capacity_tokens int")
    with pytest.raises(ValueError):
        packed(docs, many)
