"""Label propagation: what shards admit, how groups come together from hashed shards, and what is evened out."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import sharding


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)).filter(lambda p: p[0] != p[1]), st.integers(1, 40)), st.lists(st.integers(-30, 30), min_size=6, max_size=6))
def test_what_is_admitted_fits(asks, room):
    x = sharding.admitted(asks, room)
    assert set(x) <= set(asks) and all(0 <= x[k] <= asks[k] for k in x)
    flow = [sum(v for (s, t), v in x.items() if t == i) - sum(v for (s, t), v in x.items() if s == i) for i in range(6)]
    assert all(f <= max(0, r) for f, r in zip(flow, room))
    for (s, t), v in asks.items():  # nothing that fits alone or as an exchange of two is left
        assert x[s, t] == v or flow[t] >= max(0, room[t])
        assert x[s, t] == v or (t, s) not in asks or x[t, s] == asks[t, s]


def test_full_shards_exchange_rows():
    assert sharding.admitted({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding.admitted({(0, 1): 2, (1, 2): 2, (2, 0): 1}, [0, 0, 0]) == {(0, 1): 1, (1, 2): 1, (2, 0): 1}
    assert sharding.admitted({(0, 1): 5}, [0, 2]) == {(0, 1): 2} and sharding.admitted({}, [1]) == {}


def state(spark, sizes, n_shards, seed):
    rng = random.Random(seed)
    c = Counter((g, rng.randrange(n_shards)) for g, m in enumerate(sizes) for _ in range(m))
    rows = [(g.to_bytes(4, "big"), s, k) for (g, s), k in c.items()]
    return spark.createDataFrame(rows, "g binary, shard int, c long"), rows


def parts_of(rows):
    at = defaultdict(dict)
    for r in rows:
        at[bytes(r[0])][r[1]] = r[2]
    return at


@pytest.mark.parametrize("singles", [0.5, 0.05])
def test_groups_come_together_from_hashed_shards(spark, singles):
    """Most groups are apart at the start and move; propagation alone brings nearly all of them together."""
    sizes = [2] * 300 + [3] * 100 + [7] * 30
    linked = sum(sizes)
    quota = [int(linked / (1 - singles) / 16) + 1] * 16
    df, rows = state(spark, sizes, 16, 5)
    start = parts_of(rows)
    assert sum(len(v) > 1 for v in start.values()) > 0.9 * len(sizes)
    moved = sharding.propagate(df, quota, 64, 4).collect()
    end = parts_of((r.g, r.shard, r.c) for r in moved)
    assert {g: sum(v.values()) for g, v in end.items()} == {g: sum(v.values()) for g, v in start.items()}
    assert sum(len(v) == 1 for v in end.values()) > (0.98 if singles == 0.5 else 0.85) * len(sizes)
    load = Counter()
    for r in moved:
        load[r.shard] += r.c
        assert r.parts == len(end[bytes(r.g)])
    began = Counter()
    for _, s, c in rows:
        began[s] += c
    assert all(load[s] <= max(quota[s], began[s]) for s in range(16))
    stay, held = sharding.even_out(sharding.propagate(df, quota, 64, 4), quota, 4)
    last = parts_of((r.g, r.shard, r.c) for r in stay.collect())
    assert held == [sum(v.get(s, 0) for v in last.values()) for s in range(16)] and all(h <= q for h, q in zip(held, quota))
    assert sum(len(v) for v in last.values()) <= len(sizes) + 15


@pytest.mark.parametrize("seed", range(2))
def test_cut_of_small_tables_is_within_one_of_the_best(spark, seed):
    """Best partitions of 16 rows over 4 shards of 4: (4, 4, 3, 3): no group is cut; (5, 5, 3): one cut for each of the larger; (6, 6, 4): likewise."""
    for sizes, best in (((4, 4, 3, 3), 4), ((5, 5, 3), 5), ((6, 6, 4), 5), ((2,) * 8, 8)):
        df, _ = state(spark, sizes, 4, seed)
        stay, _ = sharding.even_out(sharding.propagate(df, [4] * 4, 64, 1), [4] * 4, 1)
        assert stay.count() <= best + 1


def test_a_group_of_a_third_takes_few_shards(spark):
    sizes = [530] + [2] * 160
    df, _ = state(spark, sizes, 16, 3)
    end = parts_of((r.g, r.shard, r.c) for r in sharding.even_out(sharding.propagate(df, [100] * 16, 64, 4), [100] * 16, 4)[0].collect())
    assert len(end[(0).to_bytes(4, "big")]) <= 7 and sum(len(v) for v in end.values()) <= 6 + 160 + 15
