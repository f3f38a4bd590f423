"""Exact dedup, mixing and the cuckoo index."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from driftwise.llm import exact_dedup, mixing
from driftwise.llm.common import table
from tests.conftest import MEDIUM
from tests.llm import edge


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(1), exact_dedup.CuckooIndex(1), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            if index.get(k) is None:
                index.insert([k, step])
            live.setdefault(k, step)
        else:
            assert index.delete(k) == (live.pop(k, None) is not None)
    assert {c[0]: c[1] for c in index.live()} == live
    assert index.size == len(live)
    assert all((index.get(k) is not None) == (k in live) for k in keys)


def test_exact_groups_edges(spark):
    docs = edge.documents(spark)
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in edge.rows():
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    want = Counter()
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i is not None and i == keep, sha) for i in ids)
    assert Counter(tuple(r) for r in got) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({r[1] or "": 1 for r in edge.rows()})
    assert exact_dedup.exact_groups(edge.none(spark)).collect() == []
    assert exact_dedup.drop_copies(edge.none(spark)).collect() == []


def test_index_update(spark):
    sha = [hashlib.sha256(str(i).encode()).digest() for i in range(4)]
    make = lambda pairs: spark.createDataFrame([(i, bytearray(sha[s])) for i, s in pairs], "__id long, __sha binary")
    index = exact_dedup.build_index(make([(1, 0), (2, 0), (3, 1), (4, 2)]), 4)
    live = make([(1, 0), (4, 2), (8, 2), (9, 3)])
    got = exact_dedup.update_index(index, make([(3, 1), (2, 0)]), make([(9, 3), (8, 2)]), live).collect()
    assert {(bytes(r.digest), r.keep_id, r.group_size) for r in got} == {(sha[0], 1, 1), (sha[2], 8, 2), (sha[3], 9, 1)}


def test_index_updates_equal_an_index_of_the_live_rows(spark):
    rng = random.Random(3)
    sha = [hashlib.sha256(str(i).encode()).digest() for i in range(12)]
    make = lambda pairs: spark.createDataFrame([(i, bytearray(sha[s])) for i, s in pairs], "__id long, __sha binary")
    now = [(rng.choice([None, *range(30)]), rng.randrange(12)) for _ in range(80)]
    for _ in range(2):
        gone = rng.sample(range(len(now)), 40)
        removed, added = [now[i] for i in gone], [(rng.choice([None, *range(40)]), rng.randrange(12)) for _ in range(15)]
        after = [r for i, r in enumerate(now) if i not in gone] + added
        got = exact_dedup.update_index(exact_dedup.build_index(make(now), len(now)), make(removed), make(added), make(after)).collect()
        want = {}
        for i, s in after:
            want.setdefault(sha[s], []).append(i)
        assert {bytes(r.digest): (r.keep_id, r.group_size) for r in got} == {
            d: (max((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items()}
        now = after


def test_mixing_targets_and_balance(spark):
    docs = table(spark, MEDIUM, "documents")
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").toPandas()
    text = {r.doc_id: r for r in docs.collect()}
    assert len(got) == len(text)
    sizes = defaultdict(int)
    for r in text.values():
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, stopped = {}, set()
    while True:  # reshare until none is above its limit
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        level = left / max(1, sum(weight[s] for s in order if s not in stopped))
        more = {s for s in order if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3.0 * sizes[s] if s in stopped else level * weight[s] for s in order}
    for r in got.itertuples():
        assert r.size == len((text[r.doc_id].text or "").encode().split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    taken = got.groupby("source").taken.sum()
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in order)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_flight_keeps_balances_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_UNITS", 50)
    rows = [("g", i, 0, 1, 10 + i % 37, 0.3 + 0.4 * (i % 2), 1000) for i in range(1000)]
    units = spark.createDataFrame(rows, "__group string, __id long, __tie long, __dup long, size long, p double, __n long")
    got = mixing.balanced_sample(units).collect()
    assert len(got) == 1000 and {r.p for r in got} <= {0.0, 1.0}
    words, docs = sum(r[4] * r[5] for r in rows), sum(r[5] for r in rows)
    assert abs(sum(r.p * r.size for r in got) - words) < 0.01 * words
    assert abs(sum(r.p for r in got) - docs) < 5


def test_mixing_edges(spark):
    docs = edge.documents(spark)
    plan = mixing.mix(docs).collect()
    assert len(plan) == docs.count() and all(r.size == 0 or r.taken <= 3 * r.size for r in plan)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(edge.none(spark)).collect() == [] == mixing.mixed_documents(edge.none(spark)).collect()


def test_copies_without_an_id_keep_one_row(spark):
    rows = [(None, "same", "a"), (None, "same", "b"), (None, "same", "c"), (None, "with id", "a"), (None, "with id", "b"), (4, "with id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for parts in (docs, docs.coalesce(1)):
        kept = exact_dedup.drop_copies(parts).collect()
        assert sorted((r.text, r.doc_id) for r in kept) == [("same", None), ("with id", 4)]
