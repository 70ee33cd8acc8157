"""The pipeline's stages against brute force, and run() as a whole."""
import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from rankforge.llm.common import table

from .edges import documents
from .test_dedup import brute_classes, fold

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    alive = {k: r.text for k, r in rows.items()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "bpe":
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r for r in out.collect()}
        assert all(got[k] == rows[k] for k in got)
        if name == "language_id":
            want = {k for k, t in alive.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            first = {}
            for k in sorted(alive):
                first.setdefault(fold(alive[k]), k)
            want = set(first.values())
        elif name == "near_dedup":
            keys = sorted(alive)
            want = {min(keys[i] for i in c) for c in brute_classes([(k, alive[k]) for k in keys])}
        else:
            items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, SF, "benchmark").collect()]
            want = {k for k, t in alive.items() if not any(i in " ".join(re.findall(r"\w+", t.lower())) for i in items)}
        assert set(got) == want, name
        alive = {k: alive[k] for k in want}
        docs = docs.filter(docs.doc_id.isin(list(want)))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = out.collect()
    assert {r.doc_id: r.ids for r in rows} == {k: lib.encode(t, add_special_tokens=False).ids for k, t in alive.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run_is_registered_and_has_a_stable_schema(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in entry.oracle_sql()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert 0 < out.count() < 200


def test_edge_rows_and_empty_tables(spark):
    for docs in (documents(spark), documents(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_all_numbered_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
