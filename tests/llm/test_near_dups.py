"""SimHash near-dedup and substring dedup against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftwise.llm import common, simhash, substring
from driftwise.llm.common import table
from tests.conftest import MEDIUM
from tests.llm import edge


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def roots(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_links(radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fp = np.array(sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)}), np.uint64)
    group = np.sort(np.array([rng.choice([1, 1, 1, 2, 3]) for _ in fp]))
    i, j = simhash.bit_sliced_links(group, fp, radius)
    want = {(a, b) for a, b in combinations(range(len(fp)), 2) if group[a] == group[b] and bin(int(fp[a]) ^ int(fp[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("rows", [4096, 20])
def test_near_links_span_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(40)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    at = {x: n for n, x in enumerate(signed)}
    near = [(a, b) for a, b in combinations(range(len(fps)), 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert roots(len(fps), [(at[r.a], at[r.b]) for r in got]) == roots(len(fps), near)


def check_groups(got, docs):
    ids = sorted(docs)
    fp = {i: brute_fingerprint(docs[i]) for i in ids}
    links = [(a, b) for a, b in combinations(range(len(ids)), 2) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 2]
    want = roots(len(ids), links)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fp[i], ids[want[n]]) for n, i in enumerate(ids)}


def test_simhash_groups_brute_force(spark):
    docs = table(spark, MEDIUM, "documents").filter("doc_id < 300")
    check_groups(simhash.simhash_groups(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_simhash_edges(spark):
    docs = edge.documents(spark)
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {"0" * 16}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert len(ids) == len(set(ids)) == len({r.component_id for r in got})
    assert simhash.simhash_groups(edge.none(spark)).collect() == []


def passages(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(params=["whole", "split"])
def groups(request, monkeypatch):
    """As they are, and with every key of two rows or more taken for a hot one, texts in small pieces and requests not broadcast."""
    if request.param == "split":
        monkeypatch.setattr(common, "HOT_SHARE", 0.0)
        monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)


def test_passage_classes(spark, groups):
    rng = random.Random(4)
    shared, edited = passages(rng, 52), passages(rng, 70)
    other = list(edited)
    other[35] = "changed"
    short = passages(rng, 40)
    texts = {
        1: passages(rng, 80) + shared + passages(rng, 60), 2: passages(rng, 5) + shared, 3: shared + passages(rng, 300),
        4: passages(rng, 30) + edited + passages(rng, 30), 5: passages(rng, 99) + other,
        6: passages(rng, 40) + short + passages(rng, 40), 7: short + passages(rng, 90), 8: passages(rng, 200),
        9: passages(rng, 40_000) + edited[:60] + passages(rng, 10)}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(20, " ".join(texts[8])), (21, "short text"), (22, "short text"), (23, None), (24, "")]
    got = {r.doc_id: r for r in substring.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 4, 20: 8, 21: 21, 22: 22, 23: 23, 24: 24}
    assert {i: r.class_id for i, r in got.items()} == want
    assert got[6].n_links == 0 and got[1].n_links > 0 and got[8].n_copies == 1 and got[21].n_copies == 0


def test_passages_of_the_table(spark, groups):
    """Every exact passage of 50 words that recurs is found; what is found beyond has 0.8 similar passages."""
    docs = table(spark, MEDIUM, "documents").filter("doc_id < 400")
    texts = {r.doc_id: (r.text or "").lower().encode().split() for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in substring.passage_classes(docs).collect()}
    first = {}
    for i, words in sorted(texts.items()):
        for j in range(len(words) - 49):
            assert got[first.setdefault(b" ".join(words[j:j + 50]), i)] == got[i]


@pytest.mark.parametrize("length", [50, 55, 60])
def test_one_edit_at_each_position(spark, length):
    """A passage with a word replaced, inserted or dropped anywhere is linked whenever brute force finds it similar."""
    rng = random.Random(length)
    texts = {}
    for at in range(length):
        for kind in range(3):
            x = passages(rng, length)
            y = x[:at] + [["other"], ["other", x[at]], []][kind] + x[at + 1:]
            for k, own in enumerate((x, y)):
                texts[6 * at + 2 * kind + k] = (passages(rng, 30) + own + passages(rng, 30)) if at % 2 else own

    def similar(x, y):
        u, v = ([hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)] for w in (x, y))
        return any(len(p & q) >= 0.8 * len(p | q) for p in (set(u[i:i + 46]) for i in range(len(u) - 45)) for q in (set(v[j:j + 46]) for j in range(len(v) - 45)))

    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in substring.passage_classes(docs).collect()}
    want = {i: i - i % 2 if similar(texts[i - i % 2], texts[i - i % 2 + 1]) else i for i in texts}
    assert len(set(want.values())) < 0.6 * len(want)
    assert got == want


def test_substring_edges(spark):
    docs = edge.documents(spark)
    got = substring.passage_classes(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.class_id for r in got if r.doc_id in (6, 7)} == {6: 6, 7: 6}
    assert substring.passage_classes(edge.none(spark)).collect() == []


@pytest.mark.parametrize("probe", [100, 1])
def test_meeting(spark, monkeypatch, probe):
    """Rows of keys that several have, repeats included; the same when every key is taken for a hot one."""
    monkeypatch.setattr(substring, "PROBE_ROWS", probe)
    monkeypatch.setattr(substring, "PROBE_STORED", 1.0)
    monkeypatch.setattr(common, "HOT_SHARE", 0.0)
    monkeypatch.setattr(substring, "HOT_SHARE", 0.0)
    rng = random.Random(8)
    rows = [(rng.randrange(60), rng.randrange(9), rng.randrange(2)) for _ in range(150)]
    df = spark.createDataFrame(rows, "key long, root long, plain long")
    have, named = {}, {}
    for key, root, plain in rows:
        have.setdefault(key, set()).add(root)
        named.setdefault(key, set()).update({root} if plain else ())
    got = sorted(map(tuple, substring.meeting(df, "key", "root").collect()))
    assert got == sorted((*r, min(have[r[0]])) for r in rows if len(have[r[0]]) > 1)
    got = sorted(map(tuple, substring.meeting(df, "key", "root", F.col("plain") == 1).collect()))
    assert got == sorted((*r, min(named[r[0]])) for r in rows if len(have[r[0]]) > 1 and named[r[0]])


def test_links_shuffle_rows_once(spark, monkeypatch):
    """No step before the classes sorts rows for a join with a table of their keys, however large that is."""
    plans, write = [], common.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(substring, "stored", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = random.Random(2)
        x = passages(rng, 60)
        y = x[:30] + ["other"] + x[31:]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((x, y, x + passages(rng, 9)))], "doc_id long, text string")
        assert {r.class_id for r in substring.passage_classes(docs).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {"links", "asks", "halves", "sequences"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "SortMergeJoin" in plan and name in ("shared", "links", "rooted", "asks", "runs", "halves", "sequences")]


def test_sequences_of_a_task_come_once():
    key, root, plain = np.array([5, 7, 5, 5, 7], np.uint64), np.array([1, 1, 1, 2, 1]), np.array([True, False, True, True, True])
    got = [tuple(c.tolist() for c in part) for part in substring._once(iter([(key, root, plain)] * 2), most=100)]
    rows = [r for part in got for r in zip(*part)]
    assert set(rows) == {(5, 1, True), (7, 1, False), (5, 2, True), (7, 1, True)}
    assert len(rows) < 10


def test_runs_at():
    own = substring.Words([str(i).encode() for i in range(40)])
    place = np.array([0, 3, 3, 15])
    assert own.runs_at(place, 25).tolist() == own.runs(25)[place].tolist()


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1000, 400).astype(np.uint64)
    c = substring.compact_windows(h, 46)
    mins = {int(h[x]) for x in c}
    assert all(int(h[a:a + 46].min()) in mins for a in range(len(h) - 45))
