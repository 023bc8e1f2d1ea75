"""Mixing against the target weights themselves, over many periods."""

import pytest

from glyphmill.llm import pfair


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.1396, "b": 0.8604 / 3, "c": 0.8604 / 3, "d": 0.8604 / 3}])
def test_blocks_keep_to_the_target_weights(spark, weights):
    n = {s: int(20000 * w) + 7 for s, w in weights.items()}
    docs = spark.createDataFrame([(k * 10 + i, s) for i, s in enumerate(weights) for k in range(n[s])], "doc_id long, source string")
    out = pfair.mix_report(docs, weights=weights, block=2).collect()
    assert sorted(r.position for r in out) == list(range(sum(n.values())))
    slots = sorted({(r.slot, r.source) for r in out if r.in_mix})
    assert len(slots) == slots[-1][0] + 1 > 9000
    seen, whole = dict.fromkeys(weights, 0), sum(weights.values())
    for slot, source in slots:
        seen[source] += 1
        assert all(abs(seen[s] - w / whole * (slot + 1)) < 1 for s, w in weights.items())
    after = [r for r in out if not r.in_mix]
    assert all(r.slot >= len(slots) for r in after) and len({(r.slot, r.source, r.block) for r in after}) == len({r.slot for r in after})


def test_columns_of_any_name_outlying_ids_and_repeats(spark):
    names = ["quota", "period", "slot", "number", "weight", "whole", "sources", "turn", "n", "s", "g", "before"]
    rows = [(10**15 if k == 7 else None if k == 8 else k % 1500, f"s{k % 3}", *range(len(names))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{c} int" for c in names))
    out = pfair.mix(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    sizes = [r["count"] for r in docs.select(pfair.range_of(docs["doc_id"], list(range(0, 1500, 50))).alias("r")).groupBy("r").count().collect()]
    assert max(sizes) <= 101


def test_ranges_by_binary_search(spark):
    from bisect import bisect_right

    for cuts in ([], [5], [1, 5], [1, 5, 9], list(range(0, 1000, 3))):
        df = spark.createDataFrame([(v,) for v in [None, -1, 0, 1, 4, 5, 6, 9, 10, 996, 999, 5000]], "v long")
        got = df.select("v", pfair.range_of(df["v"], cuts).alias("r")).collect()
        assert all(r.r == (-1 if r.v is None else bisect_right(cuts, r.v)) for r in got)


def test_many_sources(spark):
    docs = spark.createDataFrame([(k, f"s{k % 100}") for k in range(2000)], "doc_id long, source string")
    out = pfair.mix_report(docs, block=2).collect()
    assert sorted(r.position for r in out) == list(range(2000))
