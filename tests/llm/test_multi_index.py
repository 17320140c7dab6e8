"""Multi-index search: rounds are made where the codes are, also when these are split."""

import numpy as np
import pytest

from quire.llm import multi_index
from quire.runtime import durable


def _nearest(base, queries, k):
    out = []
    for n, q in queries:
        found = sorted((int(np.bitwise_count(np.uint64((c ^ q) & ((1 << 64) - 1)))), i) for i, c in base)[:k]
        out += [(n, r + 1, i, d) for r, (d, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("split,group", [(4_000_000, 4_096), (40, 3)])
def test_rounds_write_nothing(spark, monkeypatch, split, group):
    written = []

    def counted(df, label="stage"):
        written.append(label)
        return durable(df, label)
    monkeypatch.setattr(multi_index, "durable", counted)
    monkeypatch.setattr(multi_index, "GROUP_CODES", split)
    monkeypatch.setattr(multi_index, "GROUP_QUERIES", group)
    monkeypatch.setattr(multi_index, "PACKED", 16)
    rng = np.random.default_rng(4)
    base = [(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 63), (1 << 63) - 1, 300))]
    base += [(1000 + i, base[5][1] ^ (1 << i % 9)) for i in range(60)] + [(2000 + i, base[7][1]) for i in range(40)]
    queries = [*base[::20], base[7], (-1, -1), (-2, 0)]
    rows = lambda x: spark.createDataFrame(x, "id long, code long")
    got = multi_index.hamming_top_k(rows(base), rows(queries), 7)
    assert sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got.collect()) == _nearest(base, queries, 7)
    assert len(written) <= 6  # not more with every round


def test_wide_segments_are_probed_without_listing_their_values_per_query():
    rng = np.random.default_rng(5)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, 50_000)
    index = multi_index._Segments(codes, np.ones(len(codes), dtype=np.int32), [22, 21, 21])
    for code in codes[:3].tolist():
        row, distance = index.nearest(code, 10)
        apart = np.bitwise_count((codes ^ code).view(np.uint64))
        last = np.sort(apart)[9]
        assert sorted(row.tolist()) == np.flatnonzero(apart <= last).tolist() and (apart[row] == distance).all()
        assert set(index.masks) == {(w, s) for w in (21, 22) for s in range(max(s for _, s in index.masks) + 1)}
