"""Queries over small tables, against plain Python."""

from boxwright.plans.queries import QUERIES


def clamped(line):
    p = line.split()
    if len(p) != 5:
        return line
    cx, cy, w, h = map(float, p[1:])
    x1, y1, x2, y2 = max(0.0, cx - w / 2), max(0.0, cy - h / 2), min(1.0, cx + w / 2), min(1.0, cy + h / 2)
    new = ((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)
    if all(abs(a - b) <= 1e-9 for a, b in zip(new, (cx, cy, w, h), strict=True)):
        return line
    return f"{p[0]} " + " ".join(f"{v:.6f}" for v in new)


def test_label_repair_takes_every_order(spark, tmp_path):
    items = [(o, n, 3 + 17 * o + 7 * n, 5 * o + 29 * n, float(o + 9 * n)) for o in range(1, 24) for n in range(1, 5)]
    items += [(None, 1, 1, 1, 1.0), (24, 1, None, 1, 1.0)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    files = {}
    for o, _n, part, supp, quantity in items:
        if None in (o, part):
            continue
        cx, cy, w, h = part % 100 / 100, supp % 100 / 100, quantity % 25 / 50, _n % 5 / 10
        box = f"{cx:.6f} {cy:.6f} {w:.6f} {h:.6f}"
        line = {1: f"0 {cx:.6f} {cy:.6f}", 2: f"0.0 {box}", 3: f"1 {box}", 4: f"0 1.2000 {cy:.6f} {w:.6f} {h:.6f}"}.get(part % 11, f"0 {box}")
        files.setdefault(str(o), []).append(line)
    want = {k: ("\n".join(map(clamped, v)), list(map(clamped, v)) != v) for k, v in files.items()}
    got = QUERIES["alg12_label_repair"](spark, str(tmp_path)).collect()
    assert len(got) == 23 and {r.stem: (r.text, r.touched) for r in got} == want


def test_review_order_takes_every_frame(spark, tmp_path):
    events = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 7, float(i * 37 % 101), f'{{"k": {i * 5 % 29}}}') for i in range(1, 251)]
    spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, value double, props string").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    want = sorted((round(i * 5 % 29 % 13 / 100, 4) if i % 5 else 99.0, i % 7, i) for i in range(1, 251))
    got = [(r.score, r.video, r.idx) for r in QUERIES["srt1_review_order"](spark, str(tmp_path)).collect()]
    assert got == want
