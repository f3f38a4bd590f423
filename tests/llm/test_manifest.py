"""Merkle manifest: against a plain Python tree, tiers of several blocks, edges."""

import hashlib
import zlib

from driftwise.llm import merkle
from driftwise.llm.common import table
from tests.conftest import SMALL
from tests.llm import edge

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256(b"".join(p.encode() for p in parts)).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(nodes):
    """Root, and for each node its siblings (before, after) level by level."""
    place, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(place):
            paths[i].append((nodes[p // 8 * 8:p], nodes[p + 1:p // 8 * 8 + 8]))
            place[i] = p // 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = []
    for g in order:
        rs = sorted(groups[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        built.append((rs, *tree([leaf(r, r.text) for r in rs])))
    root, above = tree([b[1] for b in built]) if built else ("", [])
    out = []
    for (rs, sub, paths), up in zip(built, above):
        for r, path in zip(rs, paths):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text)
            for a, b in path + up:
                fold = h(*a, fold, *b)
            out.append((r.doc_id, leaf(r, r.text), sub, root, h(*[x for a, b in path + up for x in a + b]), fold, fold == root))
    return sorted(out, key=str)


def test_manifest_equals_the_plain_tree(spark):
    docs = table(spark, SMALL, "documents")
    got = sorted((tuple(r) for r in merkle.document_manifest(docs).select(COLUMNS).collect()), key=str)
    assert got == brute(docs.collect())
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_edges(spark):
    docs = edge.documents(spark, [(20, "Alone", "zz", "s"), (21, "AB", "", None)])
    got = sorted((tuple(r) for r in merkle.document_manifest(docs).select(COLUMNS).collect()), key=str)
    assert got == brute(docs.collect())
    one = docs.filter("doc_id = 20")
    assert [tuple(r) for r in merkle.document_manifest(one).select(COLUMNS).collect()] == brute(one.collect())
    assert merkle.document_manifest(edge.none(spark)).collect() == []


def test_several_blocks_and_tiers(spark):
    """9 000 leaves of one group fill three blocks, so the proof goes through two tiers; equal rows are leaves of their own."""
    rows = spark.range(9_000).selectExpr("'g' as group", "if(id < 50, 7, id) as doc_id", "sha2(cast(if(id < 50, 7, id) as string), 256) as leaf", "cast(null as string) as checked")
    got = merkle.manifest(rows).collect()
    ids = sorted([7] * 50 + list(range(50, 9_000)))
    root, paths = tree([h(str(i)) for i in ids])
    assert len(got) == 9_000 and all(r.verified and r.root == root == r.subroot for r in got)
    want = sorted((i, h(*[x for a, b in p for x in a + b])) for i, p in zip(ids, paths))
    assert sorted((r.doc_id, r.proof_sha256) for r in got) == want
