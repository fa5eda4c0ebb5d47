import zlib

import numpy as np
from cases import awkward_texts, documents, empty

from vecbench.llm.sharding import permute, shards_by_rows


def test_permutation_is_one_for_any_size():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(permute(np.arange(n), n, 7).tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 7).tolist() != permute(np.arange(1000), 1000, 8).tolist()


def test_shards_of_awkward_rows(spark):
    rows = shards_by_rows(documents(spark).repartition(4), shards=4).collect()
    assert sorted([(r.doc_id, r["size"], r.text_crc32) for r in rows], key=repr) == \
        sorted([(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in awkward_texts()], key=repr)
    counts = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(slots == list(range(len(slots))) for slots in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sorted(r.row_number for r in rows) == list(range(len(rows)))


def test_shuffle_is_reproducible(spark):
    one = {tuple(r) for r in shards_by_rows(documents(spark).repartition(7)).collect()}
    assert one == {tuple(r) for r in shards_by_rows(documents(spark).coalesce(1)).collect()}
    assert shards_by_rows(empty(spark)).count() == 0
