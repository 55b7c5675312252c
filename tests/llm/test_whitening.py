import math
from fractions import Fraction

import numpy as np
import pytest

from tradeloom.llm import whitening


def run(spark, rows, kind="float", **kw):
    frame = spark.createDataFrame([(i, v, "?", 1, "?") for i, v in rows], f"vec_id long, embedding array<{kind}>, x string, dim long, id string")
    return whitening.whiten(frame, **kw).collect()


def brute(rows, kind=np.float32, components=4):
    """By dimension: n, deviations, whitened values (either sign) and explained shares, from exact fractions."""
    kept = [(i, [math.floor(256 * Fraction(float(kind(c)))) for c in v]) for i, v in rows if v and None not in v and np.isfinite(np.array(v, dtype=kind)).all()]
    out = {}
    for d in {len(x) for _, x in kept}:
        listed = list({tuple(x) for _, x in kept if len(x) == d})
        n, total = len(listed), [sum(c) for c in zip(*listed)]
        c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, total)] for x in listed]).reshape(n, d)
        v = c.T @ c / n
        value, vectors = np.linalg.eigh(v)
        value, vectors = value[::-1][:components], vectors[:, ::-1][:, :components]
        for i, x in kept:
            if len(x) == d:
                centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total)])
                out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, total)), centred @ vectors / np.sqrt(np.maximum(value, 1e-300)), value / max(np.trace(v), 1e-300)))
    return out


def vectors_of(n, d, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) @ np.diag(np.linspace(2.0, 0.1, d)) + r.standard_normal(d)
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def test_against_brute_force(spark):
    rows = vectors_of(700, 12)
    rows += [(5, rows[5][1]), (None, rows[6][1]), *[(1000 + i, rows[7][1]) for i in range(300)], (2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [float("nan")] * 12), (2004, [float("-inf")] * 12)]
    rows += [(3000 + i, v[:3]) for i, v in vectors_of(40, 3, 2)]
    want = brute(rows)
    signs, met = {}, {}
    for r in run(spark, rows):
        met[r["id"], r["component"]] = met.get((r["id"], r["component"]), 0) + 1
        n, deviation, whitened, explained = want[r["id"]][0]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - explained[c]) <= 1e-10 and r["identity_error"] <= 1e-9
        sign = signs.setdefault((len(whitened), c), 1 if r["whitened"] * whitened[c] > 0 else -1)
        assert abs(r["whitened"] * sign - whitened[c]) < 1e-8
    assert met == {(i, c + 1): len(found) for i, found in want.items() for c in range(len(found[0][2]))}


def test_odd_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    one = run(spark, [(1, [0.5, 0.25])])
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = {(r["id"], r["component"]): r for r in run(spark, [(1, [1.0, 7.0]), (2, [-1.0, 7.0]), (3, [3.0, 7.0])])}
    assert flat[1, 2]["whitened"] is None and abs(flat[2, 1]["whitened"] - -math.sqrt(1.5)) < 1e-12 and flat[3, 1]["explained"] == 1.0 and flat[1, 1]["deviation"] == 0


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.5, -0.001])]
    got = {(r["id"], r["component"]): r for r in run(spark, rows, "double")}
    top, low = (1 << 63) - 1, -(1 << 63)
    total = top + low + 384
    assert got[1, 1]["deviation"] is None and got[3, 1]["deviation"] == (3 * 384 - total) ** 2 + (3 * -1 - 255) ** 2
    assert abs(abs(got[1, 1]["whitened"]) - math.sqrt(1.5)) < 1e-9


@pytest.mark.parametrize("values", [[9, 4, 1, 1e-9], [5, 5, 5, 5], [3, 3 + 1e-9, 3 + 2e-9, 1, 1, 1e-3], [1, 1 + 1e-7, 1 + 3e-7, 1 - 1e-13, 0.2], [1e12, 1e12 - 1, 3, 0, 0], list(np.linspace(1, 2, 40))])
def test_eigenvectors_of_clustered_values(values):
    r = np.random.default_rng(len(values))
    d = len(values)
    q = np.linalg.qr(r.standard_normal((d, d)))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(d) - 0.5 * (q.T @ q))
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.eigenvectors(a)
    assert np.allclose(value, sorted(values, reverse=True), rtol=0, atol=1e-15 * max(values) * d)
    x = x.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-15 * d
    assert np.abs(a @ x - x * value).max() < 4e-16 * d * max(values)
    # Single eigenvectors whose value stands apart are right to double precision.
    for i, v in enumerate(value):
        others = np.delete(value, i)
        gap = np.abs(others - v).min()
        if gap > 1e-8 * max(values):
            j = int(np.argmin(np.abs(np.array(values) - v)))
            assert 1 - abs(float(q[:, j] @ x[:, i])) < 1e-12


def test_refinement_gains_on_float32():
    r = np.random.default_rng(7)
    x = r.standard_normal((500, 64)) * np.linspace(3, 0.2, 64)
    a = x.T @ x
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)[:, ::-1]
    value, fine = whitening.eigenvectors(a)
    off = lambda u: np.abs(u.T @ a @ u - np.diag(np.diag(u.T @ a @ u))).max() / value[0]
    assert off(rough) > 1e-8 and off(fine) < 2e-15
