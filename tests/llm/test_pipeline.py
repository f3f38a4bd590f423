"""The corpus pipeline stage by stage against its own contracts."""

import hashlib
import struct

import corpus_pipeline
from driftwise.llm import toxicity
from driftwise.llm.common import stored, table
from tests.conftest import SMALL
from tests.llm import edge
from tests.llm.test_near_dups import brute_fingerprint, roots


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SMALL), f"test-{name}"))
    assert all(d.columns == columns for d in kept[:-1])
    start, toxic, exact, near, mixed, bpe = ([r.asDict() for r in d.collect()] for d in kept)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, table(spark, SMALL, "labels")).collect()}
    assert sorted(r["doc_id"] for r in toxic) == sorted(i for i, p in scores.items() if not p)
    best = {}
    for r in toxic:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    ids = sorted(r["doc_id"] for r in exact)
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in exact}
    links = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 2]
    assert sorted(r["doc_id"] for r in near) == sorted(ids[x] for x in set(roots(len(ids), links)))
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and mixed
    import tokenizers

    from driftwise.llm.bpe import default_path

    tok = tokenizers.Tokenizer.from_file(default_path())
    want = []
    for r in mixed:
        own = tok.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(own), hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe) == sorted(want)


def test_edges(spark):
    for docs in (edge.documents(spark), edge.none(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        docs.count()
