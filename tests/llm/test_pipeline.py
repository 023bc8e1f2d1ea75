"""The pipeline against brute force on sf0.001: every stage on what the one before kept."""

import corpus_pipeline
from glyphmill.llm.common import documents, write_table

from .test_operators import by_lines, groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows)
        ids = sorted(before)
        if name == "quality":
            assert all(before[d] == t for d, t in after.items())
            labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [d for d in before if d in labels and labels[d].quality == 1]
            bad = [d for d in before if d in labels and labels[d].quality == 0]
            assert sum(d in after for d in good) >= 0.95 * len(good) and sum(d in after for d in bad) <= 0.5 * len(bad)
        elif name == "line_dedup":
            want = by_lines([before[d] for d in ids])
            assert after == {d: want[k][2] for k, d in enumerate(ids)}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            want = groups([before[d] for d in ids])
            assert sorted(after) == sorted({ids[c] for _, c in want.values()})
        else:
            assert after == before
            unmixed = last
        before, last = after, docs
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(packed)
    # The mix takes effect: without it documents come into other sequences.
    places = {(r.doc_id, r.piece): r.sequence_id for r in packed}
    assert places != {(r.doc_id, r.piece): r.sequence_id for r in corpus_pipeline.STAGES[-1][1](spark, unmixed, SF).collect()}
