"""Ids are looked up for bounded runs of rows, whatever the size of a batch."""
import numpy as np
import pyarrow as pa

from pairforge.operators import encode as EN


def test_encode_runs_are_bounded():
    class Sent:
        value = (pa.array(["a", "b"]), np.array([4, 5]))

    lists = [["a", "b", "c", None] * 50_000, [], None, ["b"]] + [["a", "c"] * 100] * 2000
    b = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["key", "tokens"])
    got = list(EN._looked_up([b], Sent, None, True, False))
    assert [r["key"] for x in got for r in x.to_pylist()] == list(range(len(lists)))
    assert all(x.num_rows == 1 or sum(map(len, x.column("ids").to_pylist())) <= EN._RUN_TOKENS + x.num_rows for x in got) and len(got) > 2
    known = {"a": 4, "b": 5}
    for x in got:
        for r in x.to_pylist():
            words = lists[r["key"]] or []
            assert r["ids"] == [known.get(w, -1) for w in words] + [EN.EOS]
            assert [(z["pos"], z["token"]) for z in r["rare"]] == [(i, w) for i, w in enumerate(words) if w is not None and w not in known]
