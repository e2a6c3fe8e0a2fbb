"""Product codes by Elkan's iteration, against plain Lloyd rounds over every distance."""

import hashlib

import numpy as np
import pytest

from surfacescan.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, q string, code string, sums int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) of every kept row and all final entries, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    if not fit:
        return [], ""
    kept = [r for r in kept if len(r[1]) == len(fit[0][1])]
    d = len(fit[0][1]) // parts
    q = [[int(np.floor(np.float64(v) * 4096)) for v in r[1]] for r in kept]
    cut = [[tuple(x[p * d : (p + 1) * d]) for p in range(parts)] for x in q]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, v)), e) for e, v in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else v for e, v in enumerate(books[p])]
    out = []
    for r, x in zip(kept, cut):
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in found), sum(s for s, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for v in b for c in v).encode()).hexdigest()


def hold(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, digest = plain(rows)
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vc.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(((i, c, e, by_label[lab], digest) for i, lab, c, e in want), key=repr)


def test_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    grid = [(i, [float(v) / 4096 for v in rng.integers(-3, 4, 16)], int(i % 3)) for i in range(150)]  # many ties
    odd = [(None, [0.5] * 16, None), (None, [0.25] * 16, 1), (7, grid[7][1], None), (7, [0.1] * 16, 2), (900, None, 1), (901, [], 1), (902, [0.1] * 24, 1),
           (903, [float("nan")] + [0.1] * 15, 1), (904, [float("-inf")] + [0.1] * 15, 1), (905, [None] + [0.1] * 15, 1), (906, [-8000.0] * 16, 5)]
    hold(spark, tmp_path, grid + odd)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(3, [0.1] * 8, None)], [(2, [0.1] * 8, 1)] * 40, [(i, [i / 7] * 7, 1) for i in range(9)]])
def test_few_and_equal(spark, tmp_path, rows):
    hold(spark, tmp_path, rows)


def test_too_wide(spark):
    df = spark.createDataFrame([(i, [9000.0 if i == 30 else 0.5] * 8, 1) for i in range(40)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="8192"):
        vc.compress(df)


def test_bounds_spare_distances_and_never_decide():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (8, 16, 8))
    q = np.stack([centres[p, rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 8)) for p in range(8)], axis=1)
    book = q[:16].transpose(1, 0, 2).copy()
    b = vc.first(q, book)
    for _ in range(6):
        sums = vc._sums(q, b.code, 16).reshape(8, 16, 9)
        new = np.where(sums[..., 8:] > 0, sums[..., :8] // np.maximum(sums[..., 8:], 1), book)
        moved = np.sqrt(((new - book) ** 2).sum(axis=2).astype(float)) * vc.UP
        book = new
        b = vc.again(q, book, vc.shifted(b, moved))
        every = ((q[:, :, None, :] - book) ** 2).sum(axis=3)
        assert (b.code == every.argmin(axis=2)).all()
        assert (b.upper.astype(float) ** 2 >= every.min(axis=2)).all() and (b.lower.astype(float) ** 2 <= every).all()
    assert b.compared.sum() < 0.5 * every.size * 7
