"""Strips and pixels of many rasters: what the queries cut, what travels, and results on odd tables."""

import random

import pytest

from tilespark.operators import inventory, packing
from tilespark.plans import layout


def nodes(df, kind):
    """Names of the columns that every node of a kind in the plan puts out."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.initialPlan())
            continue
        if kind in node.nodeName():
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_strips_of_the_picture(spark, small):
    r, strips = layout._crops(spark, small)
    sizes = {x.raster_id: x for x in r.collect()}
    rows = strips.collect()
    assert len(rows) == sum(x.height for x in sizes.values()) and len({(x.raster_id, x.y) for x in rows}) == len(rows)
    for x in rows:
        s = sizes[x.raster_id]
        want = [((s.x0 + k // 3) * 7 + (s.y0 + x.y) * 13 + k % 3 * 5 + (s.raster_id % 5 == 0 and x.y == s.raster_id % 8 and k == s.raster_id % 7 * 3 + 1)) % 251 for k in range(s.width * 3)]
        assert x.pixel_bytes == 3 and bytes(x.data) == bytes(want)


def test_copies_meet_by_their_windows_only(spark, small):
    exchanges = nodes(layout.copy_check(spark, small), "Exchange")
    assert len(exchanges) > 3 and not any(name.endswith("data") for names in exchanges for name in names)


def test_copies_of_any_table_of_strips(spark):
    rng = random.Random(8)
    heads, strips, pairs, want = [], [], [], {}
    for i in range(30):
        w, h = rng.randrange(1, 12), rng.randrange(1, 12)
        rows = [bytes(rng.randrange(256) for _ in range(2 * w)) for _ in range(h)]
        other = [b if rng.random() < 0.8 else None if rng.random() < 0.3 else bytes([b[0] ^ 1]) + b[1:] if rng.random() < 0.5 else b[:-1] + bytes([b[-1] ^ 1]) for b in rows]
        heads += [(i, w, h), (100 + i, w, h)]
        strips += [(i, y, 2, b) for y, b in enumerate(rows)] + [(100 + i, y, 2, b) for y, b in enumerate(other) if b is not None]
        pairs.append((i, 100 + i))
        starts = lambda n: list(dict.fromkeys(round(k * max(0, n - 3) / 2) for k in range(3)))
        cut = lambda b, x: b and b[2 * x : 2 * min(x + 3, w)]
        want[i] = (len(starts(w)) * len(starts(h)), sum(any(cut(rows[y], x) != cut(other[y], x) for y in range(t, min(t + 3, h))) for t in starts(h) for x in starts(w)))
    found = inventory.copy_check(
        spark.createDataFrame(pairs, "source_id int, copy_id int"), spark.createDataFrame(heads, "raster_id int, width int, height int"), spark.createDataFrame(strips, "raster_id int, y int, pixel_bytes int, data binary").repartition(5), window=3, grid=3
    )
    assert {r.source_id: (r.windows, r.differing) for r in found.collect()} == want and 10 < sum(d > 0 for _, d in want.values())


def test_tiles_are_cut_where_strips_lie(spark, small):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    for most in (before, "-1"):
        spark.conf.set(name, most)
        try:
            exchanges = nodes(layout.tile_windows(spark, small), "Exchange")
        finally:
            spark.conf.set(name, before)
        assert len(exchanges) > 2 and not any(x in ("data", "part", "rows", "_row", "_rows") for names in exchanges for x in names)


def test_tiles_of_any_table_of_strips(spark):
    rng = random.Random(5)
    strips, tiles, want = [], [], {}
    for i, (w, h, depth) in enumerate([(700, 9, 2), (5, 40, 1), (40, 3, 3), (300, 300, 1)]):
        rows = {y: bytes(rng.randrange(256) for _ in range(w * depth)) for y in range(h) if i != 1 or y % 7 != 3}
        strips += [(i, y, depth, b) for y, b in rows.items()]
        for k in range(25):  # at any place, some over the edges, some beyond them
            side, x, y = rng.choice([1, 4, 30, 260]), rng.randrange(w + 5), rng.randrange(h + 5)
            tiles.append((f"{i}/{k}", i, side, x, y))
            want[f"{i}/{k}"] = b"".join(rows.get(y + n, b"")[x * depth : (x + side) * depth].ljust(side * depth, b"\0") for n in range(side))
    tiles.append(("none", 9, 3, 0, 0))
    want["none"] = bytes(9)
    found = packing.tile_bytes(spark.createDataFrame(strips, "raster_id int, y int, pixel_bytes int, data binary").repartition(5), spark.createDataFrame(tiles, "tile_id string, raster_id int, scale int, px_x int, px_y int"))
    got = [(r.tile_id, bytes(r.data)) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_rasters_without_pixels_make_no_pairs(spark):
    rasters = spark.createDataFrame([(i, "g", 0, 0, 4, 4) for i in range(200)], "raster_id int, grid string, x0 int, y0 int, width int, height int")
    pixels = spark.createDataFrame([(i, x, y, i % 3) for i in range(0, 200, 20) for x in range(4) for y in range(4)], "raster_id int, x int, y int, b1 int")
    seen = []

    def compare(pairs, own):
        seen.append(pairs.count())
        return inventory.same_pixels(pairs, own)

    found = {tuple(r) for r in inventory.duplicates(rasters, pixels, compare).collect()}
    assert seen == [45] and found == {(i, min(j for j in range(0, 200, 20) if j % 3 == i % 3)) for i in range(60, 200, 20)}


def test_pixels_that_hold_are_those_that_are_the_same(spark, monkeypatch):
    rng = random.Random(6)
    value = lambda x, y: (3 * x + 5 * y + x * y) % 7
    rasters = [(i, rng.choice("gh"), rng.randrange(4), rng.randrange(4), rng.randrange(1, 7), rng.randrange(1, 7)) for i in range(80)]
    pixels = [(i, x, y, value(x0 + x, y0 + y) + (rng.random() < 0.01), None if rng.random() < 0.002 else 1) for i, _, x0, y0, w, h in rasters for x in range(w) for y in range(h) if i % 9 and (i % 4 or rng.random() < 0.9)]
    r = spark.createDataFrame(rasters, "raster_id int, grid string, x0 int, y0 int, width int, height int")
    p = spark.createDataFrame(pixels, "raster_id int, x int, y int, b1 int, b2 int").repartition(3)
    pairs = inventory.contained(r)
    want = {tuple(x) for x in inventory.same_pixels(pairs, p).filter("same").collect()}
    for most in (inventory.FEW, 0):
        monkeypatch.setattr(inventory, "FEW", most)
        assert {tuple(x) for x in inventory.held_pixels(pairs, p).collect()} == want and len(want) > 30
    area = {i: w * h for i, _, _, _, w, h in rasters}
    holders = {}
    for i, o, *_ in want:
        holders.setdefault(i, []).append(o)
    ends = {i: min((-area[o], o) for o in found if o not in holders)[1] for i, found in holders.items()}
    assert {tuple(x) for x in inventory.duplicates(r, p).collect()} == set(ends.items())


def test_equal_crops_make_no_pairs(spark, monkeypatch, tmp_path):
    step = 5005 * 8  # rasters of one place, size and content
    keys = [k + step * i for k in (7, 5) for i in range(200)]
    spark.createDataFrame([(k, "b") for k in keys], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    pairs = []
    for name in ("contained", "_compared"):
        old = getattr(inventory, name, None)

        def spy(*args, name=name, old=old):
            found = old(*args)
            pairs.append((found if name == "contained" else args[0]).count())
            return found

        monkeypatch.setattr(inventory, name, spy, raising=False)
    found = {tuple(r) for r in layout.crop_duplicates(spark, str(tmp_path)).collect()}
    assert sum(pairs) < 10 and found == {(k, keys[0] if k % step == 7 else 5) for k in keys if k not in (5, 7)}


def some_crops(rng, n, odd):
    """Crops of pictures with changed pixels; where ``odd``, also strips that are missing, short, longer than the header says or there twice."""
    value = lambda g, x, y: bytes((7 * x + 13 * y + 5 * b + ord(g)) % 11 for b in range(2))
    sizes = [(i, rng.choice("gh"), rng.randrange(-6, 6), rng.randrange(-6, 6), rng.choice([1, 3, 6, 9, 14]) if odd else rng.randrange(6, 15), rng.choice([1, 4, 6, 9]) if odd else rng.randrange(6, 12)) for i in range(n)]
    strips = []
    for i, g, x0, y0, w, h in sizes:
        changes = {(rng.choice([x0, 0, x0 + w - 1, 3]), rng.choice([y0, 0, y0 + h - 1, 2])) for _ in range(rng.choice([0, 0, 1, 1, 2, 12]))}
        for y in range(h):
            row = b"".join(value(g, x, y0 + y) if (x, y0 + y) not in changes else b"\x63\x63" for x in range(x0, x0 + w))
            luck = rng.random() if odd and i % 5 == 0 else 1
            if luck < 0.03:
                continue
            row = row[:-1] if luck < 0.06 else row + value(g, x0 + w, y0 + y) if luck < 0.2 else row
            strips += [(i, y, 2, row)] * (2 if 0.2 < luck < 0.3 else 1)
    return sizes, strips


@pytest.mark.parametrize(("seed", "odd", "marks", "tried"), [(1, False, 6, 64), (2, False, 2, 1), (3, True, 6, 64), (4, True, 1, 1), (5, False, 6, 1)])
def test_many_crops_are_as_all_their_pairs(spark, monkeypatch, seed, odd, marks, tried):
    monkeypatch.setattr(inventory, "MARKS", marks)
    monkeypatch.setattr(inventory, "TRIED", tried)
    sizes, strips = some_crops(random.Random(seed), 250, odd)
    r = spark.createDataFrame(sizes, "raster_id int, grid string, x0 int, y0 int, width int, height int")
    s = spark.createDataFrame(strips, "raster_id int, y int, pixel_bytes int, data binary").repartition(3)
    want = {tuple(x) for x in inventory.duplicates(r, s, lambda pairs, own: inventory.same_strips(pairs, own, 1)).collect()}
    got = [tuple(x) for x in inventory.duplicate_strips(r, s).collect()]
    assert len(want) > 40 and len(got) == len(set(got)) and set(got) == want
