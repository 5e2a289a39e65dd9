"""k-means on a table where centers move for more rounds than the SQL is written out for."""

import duckdb
import numpy as np
import pandas as pd

from lectern.plans import registry


def test_kmeans_takes_the_rounds_of_its_sql(spark, tmp_path):
    x = np.arange(300.0)
    centers, rounds = x[:5].copy(), 0
    while True:
        own = np.abs(x[:, None] - centers[None]).argmin(axis=1)
        moved = np.array([x[own == c].mean() for c in range(5)])
        if (moved == centers).all():
            break
        centers, rounds = moved, rounds + 1
    assert rounds > 16
    vectors = pd.DataFrame({"vec_id": np.arange(300), "embedding": [[v, 1.0] for v in x], "label": 0})
    vectors.to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(tuple(map(int, r)) for r in con.sql(registry.ORACLE_SQL["v4_seeded_kmeans"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["v4_seeded_kmeans"](spark, str(tmp_path)).collect())) == want
