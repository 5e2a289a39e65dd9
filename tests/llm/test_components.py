"""Connected components against a plain search, over several partitions and with a hub."""

import numpy as np
import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import components as C  # noqa: E402


@pytest.mark.parametrize("parts", [1, 5])
def test_components_equal_a_plain_search(spark, parts, monkeypatch):
    monkeypatch.setattr(C, "CONTRACTED", 40)
    rng = np.random.default_rng(parts)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(1000, 1001 + i) for i in range(120)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5), (7, None)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for x in sorted(near):
        if x not in seen:
            part, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()] - part:
                    part.add(y)
                    todo.append(y)
            seen |= part
            want |= dict.fromkeys(part, x)
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    assert {r["node"]: r["component"] for r in C.connected_components(df).collect()} == want
    assert C.connected_components(df.where("false")).count() == 0


def test_a_long_chain_of_links_is_contracted_in_seconds():
    import time

    import pyarrow as pa

    n = 1_000_000
    for order in (np.arange(n), np.random.default_rng(1).permutation(n)):
        began = time.time()
        (stars,) = C._contract(iter([pa.record_batch([pa.array(order + 1), pa.array(order)], ["u", "v"])]))
        assert time.time() - began < 10
        assert stars.num_rows == n and set(stars.column("v").to_pylist()) == {0}
