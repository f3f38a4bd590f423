"""Versioned keyed table: merge against a row-by-row replay, atomic switch, refused stale writer."""

import random

import pytest

from driftwise.sources import versions as vs

BASE = "chunk_id string, title string, priority int, is_active boolean, embedding string"
CHANGE = "chunk_id string, op string, seq int, title string, priority int"


def replay(base, changes):
    """The same changes one at a time on a dictionary."""
    rows = {r[0]: list(r[1:]) for r in base}
    purged = {c[0] for c in changes if c[1] == "purge" and c[0] is not None}
    old = {k: v[0] for k, v in rows.items()}
    for key, op, _, title, priority in sorted(changes, key=lambda c: c[2]):
        if key is None:
            continue
        if op == "insert" and key not in rows:
            rows[key] = [title, priority, True, None]
        elif op == "update" and key in rows:
            rows[key][0] = title if title is not None else rows[key][0]
            rows[key][1] = priority if priority is not None else rows[key][1]
        elif op == "delete" and key in rows:
            rows[key][2] = False
    for key, title in old.items():
        if rows[key][0] != title:
            rows[key][3] = None
    return sorted((k, *v) for k, v in rows.items() if k not in purged)


def merged(spark, base, changes):
    out = vs.merge_changes(spark.createDataFrame(base, BASE), spark.createDataFrame(changes, CHANGE), "chunk_id", stale={"embedding": ("title",)})
    assert out.columns == ["chunk_id", "title", "priority", "is_active", "embedding"]
    return sorted(tuple(r) for r in out.collect())


def test_random_change_sets_equal_replay(spark):
    rng = random.Random(3)
    for _ in range(4):
        base = [(f"k{i}", rng.choice(["a", "b"]), rng.choice([1, None]), rng.random() < 0.8, "e") for i in range(30)]
        changes = [
            (rng.choice([None, *(f"k{i}" for i in range(45))]), rng.choice(["insert", "update", "update", "delete", "purge", "other"]) if n % 9 else "purge",
             n, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None]))
            for n in range(120)
        ]
        assert merged(spark, base, changes) == replay(base, changes)


def test_three_kinds_in_one_set_and_empty_sides(spark):
    base = [("a", "t", 1, True, "e"), ("b", "t", 1, True, "e"), ("c", "t", 1, True, "e")]
    changes = [("a", "update", 1, "new", None), ("b", "delete", 1, None, None), ("d", "insert", 1, "n", None), ("d", "update", 2, None, 7), ("x", "update", 1, "lost", 1)]
    assert merged(spark, base, changes) == [("a", "new", 1, True, None), ("b", "t", 1, False, "e"), ("c", "t", 1, True, "e"), ("d", "n", 7, True, None)]
    assert merged(spark, base, []) == base
    assert merged(spark, [], changes[3:4]) == []


def test_switch_is_whole_and_stale_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "chunks")
    with pytest.raises(FileNotFoundError):
        vs.read_version(spark, root)
    first = vs.write_version(spark.createDataFrame([("a", "t", 1, True, "e")], BASE), root)
    reader = vs.read_version(spark, root)
    second = vs.merge_version(spark, root, spark.createDataFrame([("b", "insert", 1, "n", 2)], CHANGE), "chunk_id")
    assert second == vs.current_version(spark, root) != first
    assert reader.count() == 1 and vs.read_version(spark, root, first).count() == 1
    assert vs.read_version(spark, root).count() == 2
    with pytest.raises(RuntimeError):
        vs.write_version(reader, root, based_on=first)
    assert vs.current_version(spark, root) == second  # the refused version never came into force


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "chunks")
    first = vs.write_version(spark.createDataFrame([("a", "t", 1, True, "e")], BASE), root)
    from pyspark.sql import functions as F
    broken = vs.read_version(spark, root).withColumn("title", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        vs.write_version(broken, root, based_on=first)
    assert vs.current_version(spark, root) == first and vs.read_version(spark, root).count() == 1
