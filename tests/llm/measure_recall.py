"""Recall at 10 of the nearest-neighbour query, over all its queries: python tests/llm/measure_recall.py [folder]."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def main(folder: str) -> None:
    from ravelin.llm.additive_ann import usable
    from ravelin.llm.queries import op3_nearest
    from ravelin.llm.shared import table
    from ravelin.session import local_session

    spark = local_session(memory="8g", app="recall")
    rows = usable(table(spark, folder, "embeddings"), "vec_id", "embedding").toPandas()
    ids, x = rows["id"].to_numpy(), np.array(rows["v"].tolist())
    found: dict[int, list[tuple[float, int]]] = {}
    for r in op3_nearest(spark, folder).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = wanted = 0
    for q in np.flatnonzero(ids % 100 == 0).tolist():
        apart = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        apart[ids == ids[q]] = np.inf
        least = np.sort(apart[np.isfinite(apart)])[:10]
        wanted += len(least)
        hits += sum(s <= least[-1] * (1 + 1e-12) for s, _ in found.get(int(ids[q]), []))  # ties count whichever was found
    print(f"{folder}: {len(ids)} vectors, {len(found)} queries, recall at 10 {hits / wanted:.4f}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/check_l")
