import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veyra.functions.geometry import clean_ring, ear_clip, in_triangle, locate
from veyra.operators.proximity import ring_faults


def area(t):
    t = t.reshape(-1, 3, 2)
    return np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])).sum() / 2


def shoelace(r):
    x, y = r[:, 0], r[:, 1]
    return abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2


def ray(px, py, r):
    inside, n = False, len(r)
    for i in range(n):
        (x1, y1), (x2, y2) = r[i], r[(i + 1) % n]
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def star(seed, n):
    rng = np.random.default_rng(seed)
    # one corner in each sector, so no turn reaches half a circle and the ring never crosses itself
    a = (np.arange(n) + rng.uniform(0.05, 0.95, n)) * 2 * np.pi / n
    d = rng.uniform(0.3, 1.0, n)
    return np.stack([d * np.cos(a), d * np.sin(a)], 1)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(4, 25))
def test_ears_cover_the_polygon(seed, n):
    ring = star(seed, n)
    t = ear_clip(ring)
    assert area(t) == pytest.approx(shoelace(ring), rel=1e-9)


def test_locate_agrees_with_ray_casting():
    rng = np.random.default_rng(1)
    ring = star(5, 18)
    p = rng.uniform(-1.1, 1.1, (500, 2))
    i, _ = locate(p[:, 0], p[:, 1], ear_clip(ring).reshape(-1, 6))
    assert set(i) == {k for k in range(len(p)) if ray(*p[k], ring)}


def test_clean_ring_drops_nulls_repeats_and_closing_vertex():
    assert clean_ring([0, 0, 1, None, 1, 0], [0, 0, 0, 3, 1, 0]).tolist() == [[0, 0], [1, 0], [1, 1]]
    assert len(ear_clip(clean_ring([0, 1, 0], [0, 1, 0]))) == 0


def test_shared_edges_leave_no_gap():
    t = np.array([[0, 0, 1, 0, 1, 1], [0, 0, 1, 1, 0, 1.0]])
    x = np.linspace(0, 1, 11)
    assert all(in_triangle(np.array([v]), np.array([v]), t[k : k + 1])[0] for v in x for k in (0, 1))


def test_long_rings_clip_in_time_and_areas_add_up():
    rng = np.random.default_rng(1)
    angle, reach = np.sort(rng.random(20_000)) * 2 * np.pi, 1 + 0.9 * rng.random(20_000)
    ring = np.stack([reach * np.cos(angle), reach * np.sin(angle)], 1)
    forced = []
    t = ear_clip(ring, forced)
    area = np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])).sum()
    x, y = ring[:, 0], ring[:, 1]
    assert not forced and len(t) == len(ring) - 2 and abs(area - abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) < 1e-6


def test_crossed_rings_are_reported(spark):
    ring = lambda *p: [{"lng": float(x), "lat": float(y)} for x, y in p]
    rows = [(1, [ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]), (2, [ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)), ring((0, 0), (1, 1))]), (3, None), (None, [ring((0, 0))]), (4, [])]
    df = spark.createDataFrame(rows, "district_id long, rings array<array<struct<lng double, lat double>>>")
    assert {(r.region, r.ring_no): r.fault for r in ring_faults(df, "district_id").collect()} == {(1, 1): None, (2, 1): "crossed", (2, 2): "few"}
