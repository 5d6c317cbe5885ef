"""Packing that stops at its last round keeps what is left."""

import numpy as np

from sheaf.llm import packing


def test_last_round_loses_nothing(spark):
    r = np.random.default_rng(1)
    rows = [(k, 0, 0, int(n), 1) for k, n in enumerate(r.integers(200, 1400, 600))]
    for levels in (1, 2):
        got = packing.pack(spark.createDataFrame(rows, packing.PIECES), shard_rows=20, levels=levels).toPandas()
        assert sorted(got["doc_id"]) == list(range(600))
        assert not got.duplicated(["sequence_id", "offset"]).any() and got.groupby("sequence_id")["length"].sum().max() <= 2048
