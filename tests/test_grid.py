import random

import numpy as np

from foliary import queries
from foliary.operators import grid, layout, rulings

SF = "/root/testdata/sf0.001"
BOX = "doc_id long, page long, n long, x0 double, y0 double, x1 double, y1 double"


def _box(rng, big):
    x, y = rng.uniform(-50, 900), rng.uniform(-50, 900)
    side = lambda: rng.choice((0, 0, rng.uniform(0, 5), rng.uniform(0, 60), rng.uniform(0, big)))
    return x, y, x + side(), y + side()


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n, big: [(rng.randrange(2), rng.randrange(2), i, *_box(rng, big)) for i in range(n)]
    a = make(400, 300) + [(0, 0, 900, 16.0, 16.0, 32.0, 32.0), (0, 0, 901, None, 1.0, 2.0, 3.0), (None, 0, 902, 0.0, 0.0, 1.0, 1.0), (0, 0, 903, float("nan"), 1.0, 2.0, 3.0), (0, 0, 904, 40.0, 5.0, 20.0, 0.0)]
    b = make(300, 3000) + [(0, 0, 900, 32.0, 32.0, 48.0, 48.0), (0, 0, 905, 32.0, 0.0, 32.0, 64.0)]
    got = grid.meeting(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)).select("n", "b_n").collect()
    want = set()
    for d, p, n, *x in a:
        for e, q, m, *y in b:
            if (d, p) == (e, q) and None not in x and x[0] == x[0] and min(x[0], x[2]) <= y[2] and y[0] <= max(x[0], x[2]) and min(x[1], x[3]) <= y[3] and y[1] <= max(x[1], x[3]):
                want.add((n, m))
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 300 and (900, 900) in want


def test_a_page_with_50000_boxes(spark):
    """Cells of one crowded page and the rectangles behind them; no stage sees the page as one group."""
    rng = np.random.default_rng(3)
    n, m = 50_000, 5_000
    cx, cy = rng.uniform(0, 5000, n), rng.uniform(0, 5000, n)
    rx, ry, w, h = rng.uniform(0, 5000, m), rng.uniform(0, 5000, m), rng.uniform(11, 80, m), rng.uniform(11, 80, m)
    cells = spark.createDataFrame([(1, 1, i, 0, float(a), float(b)) for i, (a, b) in enumerate(zip(cx, cy))], "doc_id long, page long, row_id long, col long, cx double, cy double")
    rects = spark.createDataFrame([(1, 1, i, float(rx[i]), float(ry[i]), float(rx[i] + w[i]), float(ry[i] + h[i]), 7 + i) for i in range(m)], "doc_id long, page long, pos long, x0 double, y0 double, x1 double, y1 double, color int")
    found = layout.cell_colors(cells, rects)
    got = {r.row_id: int(r.color, 16) for r in found.collect()}
    want = {}
    for i in range(m - 1, -1, -1):  # the first rectangle wins
        for k in np.flatnonzero((cx >= rx[i]) & (cx <= rx[i] + w[i]) & (cy >= ry[i]) & (cy <= ry[i] + h[i])).tolist():
            want[k] = 7 + i
    assert got == want and len(want) > 10_000
    assert grid._dealt(cells.selectExpr("doc_id", "page", "cx AS x0", "cy AS y0", "cx AS x1", "cy AS y1"), grid._levels(rects, 16.0), 16.0).count() < 5 * n


def test_no_page_is_joined_whole(spark):
    for name in ("j10_cell_colors", "j13_band_join", "f10_table_overlap"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "_gx" in plan and "_gy" in plan


def test_tables_from_rulings(spark):
    """Grids of lines, broken into pieces and slightly off, against a search over all pairs."""
    rng = random.Random(12)
    segments, seg = [], 0
    for d in range(3):
        for t in range(12):
            x, y, n, m = (t % 4) * 200.0, (t // 4) * 200.0, rng.randrange(2, 6), rng.randrange(2, 6)
            off = lambda: rng.uniform(-0.7, 0.7)
            for i in range(n):
                cut = rng.uniform(30, 60)
                for a, b in ((0, cut), (cut, 120)):  # a line in two pieces
                    segments.append((d, 1, seg, x + a + off(), y + 30 * i + off(), x + b + off(), y + 30 * i + off()))
                    seg += 1
            for j in range(m):
                segments.append((d, 1, seg, x + 30 * j + off(), y + 30 * (n - 1) + 1, x + 30 * j + off(), y + off()))
                seg += 1
        segments += [(d, 1, seg, 900.0, 900.0, 950.0, 960.0), (d, 1, seg + 1, 900.0, 10.0, 900.5, 90.0), (d, 1, seg + 2, 1.0, 800.0, 2.0, 800.0)]
        seg += 3
    frame = spark.createDataFrame(segments, "doc_id long, page long, seg long, x0 double, y0 double, x1 double, y1 double")
    tables = rulings.ruled_tables(frame)
    got = sorted((r.doc_id, r.n_rows, r.n_cols, r.x0, r.y0, r.x1, r.y1) for r in tables.collect())
    snap = lambda v: np.floor(v / 3 + 0.5) * 3
    want = []
    for d in range(3):
        own = {}
        for e, _, s, a, b, c, f in segments:
            across, upright = abs(f - b) <= 3, abs(c - a) <= 3
            if e == d and across != upright:
                own[s] = (across, snap(min(a, c)), snap(min(b, f)), snap(min(a, c) if upright else max(a, c)), snap(min(b, f) if across else max(b, f)))
        label = {s: s for s in own}
        for _ in own:
            before = dict(label)
            for s, p in own.items():
                for t, q in own.items():
                    if p[0] and not q[0] and p[1] - 3 <= q[1] <= p[3] + 3 and q[2] - 3 <= p[2] <= q[4] + 3:
                        label[s] = label[t] = min(label[s], label[t])
            if before == label:
                break
        for k in set(label.values()):
            xs = sorted({own[s][1] for s in own if label[s] == k and not own[s][0]})
            ys = sorted({own[s][2] for s in own if label[s] == k and own[s][0]})
            if len(xs) > 1 and len(ys) > 1:
                want.append((d, len(ys) - 1, len(xs) - 1, xs[0], ys[0], xs[-1], ys[-1]))
    assert got == sorted(want) and len(got) >= 30
    cells = rulings.ruled_cells(tables)
    assert cells.count() == sum(r[1] * r[2] for r in got)
    assert cells.filter("x1 <= x0 OR y1 <= y0").count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(1, 1, i, i + 1) for i in range(300)] + [(1, 2, 5, 9)], "doc_id long, page long, seg long, other long")
    got = {(r.page, r.seg): r.component for r in rulings.components(edges).collect()}
    assert got == {(1, i): 0 for i in range(301)} | {(2, 5): 5, (2, 9): 5}


def test_points_go_to_the_grids_of_their_own_page(spark):
    """Rectangles of six sizes, one size a page: a point went to six grids, wherever it lay."""
    points = spark.createDataFrame([(d, 1, n, 10.0 * n, 10.0 * n, 10.0 * n, 10.0 * n) for d in range(60) for n in range(50)] + [(99, 1, 0, 1.0, 1.0, 1.0, 1.0)], BOX)
    rects = spark.createDataFrame([(d, 1, d, 5.0, 5.0, 5.0 + 15 * 2 ** (d % 6), 25.0) for d in range(60)] + [(98, 1, 0, float("nan"), 0.0, 1.0, 1.0)], BOX)
    levels = grid._levels(rects, grid.CELL)
    near, grids = grid._within(points, rects, ("doc_id", "page"), levels, grid.CELL)
    assert len(levels) == 6 and grid._dealt(points, levels, grid.CELL).count() == 6 * 3001
    assert grid._dealt(near, grids, grid.CELL).count() == 60 * 2  # those at 10 and 20
    assert grid.meeting(points, rects).count() == 120 and "_bits" in grid.meeting(points, rects)._jdf.queryExecution().optimizedPlan().toString()
