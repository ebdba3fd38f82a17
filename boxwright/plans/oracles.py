"""DuckDB SQL for the queries, written apart from the Spark code."""

from __future__ import annotations

DOCS = """docs AS (
  SELECT doc_id, printf('%010d', doc_id) AS path, md5(text) AS digest, coalesce(source, 'none') AS source,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cat AS (SELECT docs.*, quality FROM docs LEFT JOIN lab USING (doc_id)),
held AS (SELECT DISTINCT digest FROM docs WHERE source = 'src0')"""

DISPOSED = (
    DOCS
    + """, ext AS (
  SELECT source, path, digest, coalesce(quality, 0) = 1 AS positive, digest IN (SELECT digest FROM held) AS leak
  FROM cat WHERE source <> 'src0'
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY source, path) AS nth FROM ext WHERE NOT leak
), usable AS (
  SELECT source, path, positive, row_number() OVER (PARTITION BY source, positive ORDER BY md5('7:' || source || '/' || path), path) AS r
  FROM firsts WHERE nth = 1
), caps AS (
  SELECT source, least(count(*) FILTER (positive), 200) AS cap, count(*) FILTER (NOT positive) AS nn FROM usable GROUP BY source
), chosen AS (
  SELECT u.*, cap, least(nn, floor(cap * 0.5)) AS neg_cap,
         CASE WHEN positive THEN r <= cap ELSE r <= least(nn, floor(cap * 0.5)) END AS kept
  FROM usable u JOIN caps USING (source)
), held_out AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7h:' || source || '/' || path), path) AS h FROM chosen WHERE kept
), disposed AS (
  SELECT source, path, positive, 'leak' AS disposition FROM ext WHERE leak
  UNION ALL SELECT source, path, positive, 'dup' FROM firsts WHERE nth > 1
  UNION ALL SELECT source, path, positive, CASE WHEN positive THEN 'over_cap' ELSE 'dropped_neg' END FROM chosen WHERE NOT kept
  UNION ALL SELECT source, path, positive, CASE WHEN h <= floor((cap + neg_cap) * 0.1) THEN 'val_ext' ELSE 'train' END FROM held_out
)"""
)

FRAMES = """raw AS (
  SELECT user_id AS video, event_id AS idx, ts, value, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL
), nb AS (
  SELECT *, lag(value) OVER w AS prev, lead(value) OVER w AS next FROM raw WINDOW w AS (PARTITION BY video ORDER BY ts, idx)
), frames AS (
  SELECT video, idx, ts, value, prev, next, CASE WHEN prev IS NULL THEN 1.5 ELSE abs(value - prev) / 97 END AS motion, (k % 13) / 100.0::DOUBLE AS conf FROM nb
)"""

FILTERED = (
    FRAMES
    + """, st AS (SELECT video, idx, ts, conf, round(motion, 4) AS motion, conf >= 0.10 OR round(motion, 4) >= 1.5 AS strong FROM frames),
nr AS (
  SELECT *, coalesce(bool_or(strong) OVER (PARTITION BY video ORDER BY ts, idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false)
         OR coalesce(bool_or(strong) OVER (PARTITION BY video ORDER BY ts, idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) AS near
  FROM st
), filtered AS (
  SELECT *, CASE WHEN conf < 0 THEN 'review' WHEN conf >= 0.10 OR motion >= 1.5 THEN 'keep' WHEN conf >= 0.04 OR motion >= 0.35 OR near THEN 'review' ELSE 'removed' END AS verdict,
    CASE WHEN conf < 0 THEN 'unreadable file' WHEN conf >= 0.10 THEN printf('yolo %.2f', conf) WHEN motion >= 1.5 THEN printf('motion %.2f', motion)
         WHEN conf >= 0.04 OR motion >= 0.35 THEN printf('weak (yolo %.2f, motion %.2f)', conf, motion)
         WHEN near THEN 'no evidence, but a neighbouring frame has a drone' ELSE 'no evidence' END AS reason
  FROM nr
)"""
)

BOXES = """li AS (
  SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
    (l_partkey % 480)::DOUBLE + 5 AS x, (l_suppkey % 330)::DOUBLE + 8 AS y, (l_partkey % 97)::DOUBLE + 12 AS w, (l_suppkey % 89)::DOUBLE + 12 AS h,
    (trunc(l_quantity)::INT % 9)::DOUBLE AS dx, ((trunc(l_quantity)::INT + l_linenumber) % 7)::DOUBLE AS dy,
    ((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 100)::DOUBLE / 100 AS conf, l_quantity % 5 <> 0 AS seen
  FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
), gt AS (SELECT image, k, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM li),
pr AS (SELECT image, k, x + dx AS x1, y + dy AS y1, x + w + dx AS x2, y + h + dy AS y2, conf FROM li WHERE seen)"""

_COMMON = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_IOU = f"({_COMMON}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - ({_COMMON}))"

BEST = BOXES + f""", best AS (
  SELECT a.image, a.k, (a.x2 - a.x1) * (a.y2 - a.y1) AS area, coalesce(max(CASE WHEN b.image IS NOT NULL THEN {_IOU} END), 0) AS best_iou
  FROM gt a LEFT JOIN pr b ON a.image = b.image GROUP BY ALL
)"""


def matched(thresholds: str) -> str:
    """Greedy one-to-one matching: ground truths in turn, each with its candidates in order of overlap."""
    return f"""{BOXES}, th AS (SELECT unnest([{thresholds}]::DOUBLE[]) AS t),
cand AS (
  SELECT t, a.image, a.k AS g, list(struct_pack(k := b.k, o := {_IOU}) ORDER BY {_IOU} DESC, b.k) AS c
  FROM th, gt a JOIN pr b ON a.image = b.image WHERE b.conf >= t GROUP BY ALL
), img AS (SELECT image, count(*) AS n_gt FROM gt GROUP BY image),
npr AS (SELECT t, image, count(*) AS n_pred FROM th, pr WHERE conf >= t GROUP BY ALL),
walk(t, image, g, used, took) AS (
  SELECT t, image, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM th, img
  UNION ALL
  SELECT s.t, s.image, s.g + 1, CASE WHEN s.free.o >= 0.5 THEN list_append(s.used, s.free.k) ELSE s.used END, CASE WHEN s.free.o >= 0.5 THEN s.free.k END
  FROM (SELECT w.t, w.image, w.g, w.used, list_filter(coalesce(c.c, []), lambda z: NOT list_contains(w.used, z.k))[1] AS free
        FROM walk w JOIN img i USING (image) LEFT JOIN cand c ON c.t = w.t AND c.image = w.image AND c.g = w.g + 1 WHERE w.g < i.n_gt) s
), m AS (
  SELECT w.t, w.image, n_gt, coalesce(n_pred, 0) AS n_pred, count(took) AS hits, coalesce(n_pred, 0) - count(took) AS fp
  FROM walk w JOIN img USING (image) LEFT JOIN npr ON npr.t = w.t AND npr.image = w.image GROUP BY w.t, w.image, n_gt, n_pred
)"""


SWEEP = (
    "WITH RECURSIVE "
    + matched("0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60")
    + """, tot AS (SELECT t AS threshold, sum(n_gt)::BIGINT AS n_gt, sum(hits)::BIGINT AS hits, sum(fp)::BIGINT AS fp FROM m GROUP BY t),
pr2 AS (SELECT *, coalesce(hits / nullif(hits + fp, 0), 0) AS p, coalesce(hits / nullif(n_gt, 0), 0) AS r FROM tot),
sweep AS (SELECT threshold, n_gt, hits, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM pr2)"""
)

LINES = """ll AS (
  SELECT CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, CAST(l_orderkey AS VARCHAR) AS stem, l_orderkey AS image,
    l_linenumber AS line_no, l_partkey % 11 AS kind, (l_partkey % 100)::DOUBLE / 100 AS cx, (l_suppkey % 100)::DOUBLE / 100 AS cy, (l_quantity % 25)::DOUBLE / 50 AS w, (l_linenumber % 5)::DOUBLE / 10 AS h
  FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL
), lines AS (
  SELECT *, CASE kind WHEN 1 THEN printf('0 %.6f %.6f', cx, cy) WHEN 2 THEN printf('0.0 %.6f %.6f %.6f %.6f', cx, cy, w, h) WHEN 3 THEN printf('1 %.6f %.6f %.6f %.6f', cx, cy, w, h)
    WHEN 4 THEN printf('0 1.2000 %.6f %.6f %.6f', cy, w, h) ELSE printf('0 %.6f %.6f %.6f %.6f', cx, cy, w, h) END AS line,
    CASE WHEN kind = 1 THEN 'expected 5 fields, got 3' WHEN kind = 2 THEN 'non-numeric field' WHEN kind = 3 THEN 'class id 1, expected 0' WHEN kind = 4 THEN 'center_x=1.2000 outside [0,1]'
      WHEN w <= 0 OR h <= 0 THEN printf('width/height must be > 0 (got %.4fx%.4f)', w, h)
      WHEN cx - w / 2 < -1e-6 OR cx + w / 2 > 1 + 1e-6 OR cy - h / 2 < -1e-6 OR cy + h / 2 > 1 + 1e-6 THEN 'box extends outside the image' END AS error
  FROM ll
), fixed AS (
  SELECT *, greatest(0.0, cx - w / 2) AS a, greatest(0.0, cy - h / 2) AS b, least(1.0, cx + w / 2) AS c, least(1.0, cy + h / 2) AS d FROM lines
)"""

VECTORS = """vec AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT id, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM vec),
dist AS (SELECT a.id AS a, b.id AS b, sqrt(sum((a.x - b.x) * (a.x - b.x)) / count(*)) AS d FROM e a JOIN e b ON a.i = b.i AND a.id <> b.id GROUP BY ALL)"""

NEAR = VECTORS + ", near AS (SELECT a AS id, min(d) AS distance FROM dist WHERE a % 10 = 0 AND b % 10 <> 0 GROUP BY a)"

_CLASSES = "['drone', ' UAV ', 'Anti-Drone', 'bird', 'flying drone', 'helicopter', 'Small_UAV', 'drones2']"
_TILES = "WITH s AS (SELECT DISTINCT p_size * 40 + 200 AS width, p_size * 23 + 200 AS height FROM part)"
_NAME = "printf('clip %s_frame%06d_jpg.rf.%s.jpg', source, doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))"
_OUT = f"CASE WHEN doc_id % 2 = 0 THEN 'neg_' ELSE '' END || substr(regexp_replace(source || '_' || {_NAME}, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 120)"

_FIXED = """w2 AS (SELECT *, CASE WHEN kind = 4 THEN 1.2::DOUBLE ELSE cx END AS gx FROM lines),
f2 AS (SELECT *, greatest(0.0, gx - w / 2) AS a, greatest(0.0, cy - h / 2) AS b, least(1.0, gx + w / 2) AS c, least(1.0, cy + h / 2) AS d FROM w2),
f3 AS (
  SELECT stem, line_no, line, CASE WHEN kind <> 1 AND (abs((a + c) / 2 - gx) > 1e-9 OR abs((b + d) / 2 - cy) > 1e-9 OR abs(c - a - w) > 1e-9 OR abs(d - b - h) > 1e-9)
    THEN printf('%s %.6f %.6f %.6f %.6f', CASE kind WHEN 2 THEN '0.0' WHEN 3 THEN '1' ELSE '0' END, (a + c) / 2, (b + d) / 2, c - a, d - b) ELSE line END AS fresh
  FROM f2
)"""
_QIOU = _IOU.replace("a.", "q.").replace("b.", "r.")

NORMAL = f"""{DOCS}, cand AS (
  SELECT c.*, c.source || '/images/' || c.path || '.jpg' AS file, CASE WHEN quality IS NOT NULL THEN 'text' WHEN c.doc_id % 4 = 0 THEN 'coco' WHEN c.doc_id % 5 = 0 THEN 'voc' END AS origin,
    CASE WHEN quality IS NOT NULL THEN (quality = 1)::INT WHEN c.doc_id % 4 = 0 THEN (c.doc_id % 8 = 0)::INT WHEN c.doc_id % 5 = 0 THEN 1 END AS boxes, coalesce((quality = 1)::INT, 0) AS dropped FROM cat c
), firsts AS (SELECT digest, min(file) AS f FROM cand WHERE origin IS NOT NULL GROUP BY digest
), normal AS (SELECT cand.*, CASE WHEN origin IS NULL THEN 'unlabelled' WHEN file <> f THEN 'dup' WHEN boxes > 0 THEN 'positive' ELSE 'negative' END AS disposition FROM cand LEFT JOIN firsts USING (digest))"""

ORACLE_SQL = {
    "alg10_leak_safe_merge": f"WITH {DISPOSED} SELECT source, disposition, count(*) AS n, min(path) AS first_path FROM disposed GROUP BY ALL",
    "alg10_dispositions": f"WITH {DISPOSED} SELECT source, path, disposition FROM disposed",
    "agg18_merge_stats": f"""WITH {DISPOSED} SELECT source, count(*) FILTER (disposition IN ('train', 'val_ext') AND positive) AS pos, count(*) FILTER (disposition IN ('train', 'val_ext') AND NOT positive) AS neg,
        count(*) FILTER (disposition = 'leak') AS leaked, count(*) FILTER (disposition = 'dup') AS dup, count(*) FILTER (disposition = 'dropped_neg') AS dropped_neg,
        count(*) FILTER (disposition = 'over_cap') AS over_cap, count(*) FILTER (disposition = 'val_ext') AS held FROM disposed GROUP BY source""",
    "jn3_leaks": f"WITH {DOCS} SELECT source, count(*) AS leaked FROM docs WHERE source <> 'src0' AND digest IN (SELECT digest FROM held) GROUP BY source",
    "set4_difference": f"WITH {DOCS} SELECT path FROM docs WHERE source <> 'src0' AND digest NOT IN (SELECT digest FROM held)",
    "win5_first_per_digest": f"WITH {DOCS} SELECT digest, source, path FROM docs QUALIFY row_number() OVER (PARTITION BY digest ORDER BY source, path) = 1",
    "alg13_validation_report": f"""WITH {LINES}, im AS (
        SELECT o_orderkey AS image, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, o_orderkey % 17 <> 0 AS present FROM orders WHERE o_orderkey IS NOT NULL
      ), per AS (SELECT image, count(*) AS n, count(*) FILTER (error IS NULL) AS ok FROM lines WHERE image % 17 <> 0 GROUP BY image)
      SELECT split, count(*) AS images, count(*) FILTER (ok > 0) AS positives, count(*) FILTER (present AND coalesce(ok, 0) = 0) AS negatives, count(*) FILTER (NOT present) AS missing,
        coalesce(sum(n), 0)::BIGINT AS lines, coalesce(sum(ok), 0)::BIGINT AS boxes, (coalesce(sum(n), 0) - coalesce(sum(ok), 0))::BIGINT AS bad FROM im LEFT JOIN per USING (image) GROUP BY split""",
    "flt1_line_errors": f"WITH {LINES} SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM lines GROUP BY ALL",
    "flt2_out_of_bounds": f"WITH {LINES} SELECT split, count(*) FILTER (abs((a + c) / 2 - cx) > 1e-9 OR abs((b + d) / 2 - cy) > 1e-9 OR abs(c - a - w) > 1e-9 OR abs(d - b - h) > 1e-9) AS moved, count(*) AS lines FROM fixed GROUP BY split",
    "agg3_box_extent": f"WITH {LINES} SELECT round(min(w), 6) AS min_w, round(max(w), 6) AS max_w, round(avg(w), 6) AS avg_w, round(min(h), 6) AS min_h, round(max(h), 6) AS max_h, round(avg(h), 6) AS avg_h, round(count(*) FILTER (w < 0.1 AND h < 0.1) / count(*), 6) AS tiny_share FROM lines",
    "agg4_duplicate_groups": f"WITH {DOCS} SELECT digest, count(*) AS copies, count(DISTINCT split) AS splits, CASE WHEN count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END AS level FROM docs GROUP BY digest HAVING count(*) > 1",
    "jn1_image_labels": f"WITH {DOCS} SELECT split, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS state, count(*) AS n FROM cat GROUP BY ALL",
    "jn2_orphan_labels": f"WITH {DOCS} SELECT doc_id AS stem FROM lab WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE doc_id % 3 <> 0)",
    "agg7_split_counts": f"WITH {DOCS} SELECT split, count(*) AS images, sum(coalesce(quality, 0))::BIGINT AS boxes, count(*) FILTER (coalesce(quality, 0) = 0) AS negatives FROM cat GROUP BY split",
    "jn10_negative_quota": f"WITH {DOCS}, p AS (SELECT split, count(*) FILTER (coalesce(quality, 0) = 1) AS positives FROM cat GROUP BY split) SELECT split, positives, floor(positives / (SELECT sum(positives) FROM p) * 100)::BIGINT AS quota FROM p",
    "jn4_move_plan": f"WITH {DOCS}, mv AS (SELECT DISTINCT source, CASE WHEN substr(md5(source), 1, 1) < '8' THEN 'train' ELSE 'test' END AS to_split FROM docs) SELECT split || ' -> ' || to_split AS move, count(*) AS n FROM docs JOIN mv USING (source) WHERE split <> to_split GROUP BY ALL",
    "flt7_not_yet_labelled": f"WITH {DOCS} SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM lab)",
    "srt2_seeded_fraction": f"WITH {DOCS} SELECT split, path FROM docs QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5('3:' || path), path) <= floor(count(*) OVER (PARTITION BY split) * 0.25)",
    "srt3_seeded_first": f"WITH {DOCS} SELECT path FROM docs ORDER BY md5('5:' || path), path LIMIT 25",
    "alg8_video_split": f"""WITH {DOCS}, r AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM docs)),
      q AS (SELECT *, greatest(1, round_even(n * 0.7, 0)) AS t0, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15, 0)) ELSE 0 END AS v FROM r),
      s AS (SELECT *, CASE WHEN n - t0 - v < 1 AND n >= 3 THEN n - v - 1 ELSE t0 END AS t FROM q)
      SELECT source, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'val' ELSE 'test' END AS split FROM s""",
    "prj_names": f"""SELECT doc_id, printf('clip %s_frame%06d', source, doc_id) AS stem, CASE WHEN doc_id % 7 = 0 THEN printf('still%d', doc_id) ELSE 'v' || source END AS video,
        CASE WHEN doc_id % 7 = 0 THEN 0::BIGINT ELSE doc_id END AS idx, {_OUT} AS out_name, source || '_clip_' || source AS source_of,
        regexp_replace({_NAME}, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS safe FROM documents WHERE doc_id IS NOT NULL""",
    "prj6_class_filter": f"SELECT name, count(*) AS n, trim(name) IN ('drone', 'UAV', 'Anti-Drone', 'flying drone', 'Small_UAV') AS target FROM (SELECT {_CLASSES}[p_partkey % 8 + 1] AS name FROM part WHERE p_partkey IS NOT NULL) GROUP BY ALL",
    "prj22_sampling_step": "SELECT DISTINCT p_size, greatest(1, round_even((CASE WHEN p_size % 9 <= 1 THEN 30.0 ELSE p_size * 1.25 END)::DOUBLE / 5, 0))::INT AS step FROM part",
    "prj_box_conversions": f"""WITH {LINES}, p AS (SELECT *, (cx - w / 2) * 640 AS x1, (cx + w / 2) * 640 AS x2, (cy - h / 2) * 480 AS y1, (cy + h / 2) * 480 AS y2 FROM fixed),
      q AS (SELECT *, greatest(0, least(x1, 640)) AS qa, greatest(0, least(x2, 640)) AS qb, greatest(0, least(y1, 480)) AS qc, greatest(0, least(y2, 480)) AS qd FROM p)
      SELECT stem, line_no, round((a + c) / 2, 6) AS rep_cx, round(c - a, 6) AS rep_w, c - a > 1e-6 AND d - b > 1e-6 AS usable, round(x1, 6) AS px1, round(y2, 6) AS py2,
        CASE WHEN qb - qa >= 1 AND qd - qc >= 1 THEN round((qb - qa) / 640, 6) END AS back_w, CASE WHEN qb - qa >= 1 AND qd - qc >= 1 THEN round((qc + qd) / 2 / 480, 6) END AS back_cy FROM q""",
    "prj13_size_bands": f"WITH {BOXES} SELECT CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END AS band, count(*) AS n FROM gt GROUP BY ALL",
    "prj14_tile_origins": f"""{_TILES}, o AS (
        SELECT width, height, CASE WHEN width <= 640 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, width - 639, 480), width - 640))) END AS xs,
          CASE WHEN height <= 640 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, height - 639, 480), height - 640))) END AS ys FROM s
      ) SELECT width, height, (row_number() OVER (PARTITION BY width, height ORDER BY y, x) - 1)::INT AS tile, x::INT AS x, y::INT AS y FROM (SELECT width, height, x, unnest(ys) AS y FROM (SELECT width, height, ys, unnest(xs) AS x FROM o))""",
    "prj15_grid_tiles": f"""{_TILES}, g AS (SELECT width, height, i, i % 3 AS c, i // 3 AS r, width / 3 AS tw, height / 2 AS th FROM s, range(6) t(i))
      SELECT width, height, i::INT AS tile, greatest(0, trunc(c * tw - tw * 0.25::DOUBLE))::INT AS x1, greatest(0, trunc(r * th - th * 0.25::DOUBLE))::INT AS y1, least(width, trunc((c + 1) * tw + tw * 0.25::DOUBLE))::INT AS x2, least(height, trunc((r + 1) * th + th * 0.25::DOUBLE))::INT AS y2 FROM g
      UNION ALL SELECT width, height, 6, 0, 0, width, height FROM s""",
    "prj_scores": """SELECT l_orderkey, l_linenumber, round(4 * (l_discount * 8) * ((l_linenumber % 5) / 5) * (1 - least(1.0, l_tax * 5 / 0.35::DOUBLE)), 6) AS motion,
        round(l_quantity * 500 * (l_discount * 8) * (0.5::DOUBLE + (l_linenumber % 5) / 5), 4) AS proposal,
        round(CASE WHEN l_linenumber > 1 THEN l_discount * 8 ELSE 0 END + 0.30::DOUBLE * sqrt(l_quantity), 6) AS frame, l_quantity * 500 BETWEEN 12 AND 20000 AND l_tax * 5 <= 0.35::DOUBLE AS usable FROM lineitem""",
    "alg1_greedy_match": f"WITH RECURSIVE {matched('0.25')} SELECT image, n_gt::INT AS n_gt, n_pred::INT AS n_pred, hits::INT AS hits, fp::INT AS fp FROM m",
    "alg2_best_overlap": f"WITH {BEST} SELECT image, k, round(best_iou, 6) AS best_iou FROM best",
    "agg8_recall_report": f"""WITH {BEST}, b AS (SELECT *, CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS band FROM best),
      f AS (SELECT band, count(*) AS gt, count(*) FILTER (best_iou >= 0.5) AS hits, avg(best_iou) AS mean_iou FROM b GROUP BY band UNION ALL SELECT 'ALL', count(*), count(*) FILTER (best_iou >= 0.5), NULL FROM b)
      SELECT band, coalesce(gt, 0) AS gt, coalesce(hits, 0) AS hits, round(coalesce(hits / nullif(gt, 0), 0), 6) AS recall, round(mean_iou, 6) AS mean_iou FROM (SELECT unnest(['small', 'medium', 'large', 'ALL']) AS band) LEFT JOIN f USING (band)""",
    "agg9_by_source": f"WITH RECURSIVE {matched('0.25')} SELECT 's' || (image % 5) AS source, count(*) AS imgs, sum(n_gt)::BIGINT AS gt, sum(hits)::BIGINT AS hit, sum(fp)::BIGINT AS fp, round(coalesce(sum(hits) / nullif(sum(n_gt), 0), 0), 6) AS recall, round(sum(fp) / count(*), 6) AS fp_per_img FROM m GROUP BY ALL",
    "agg10_by_size": f"""WITH RECURSIVE {matched('0.25')} SELECT CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END AS band, count(*) AS gt, count(took) AS hits, round(count(took) / count(*), 6) AS recall
      FROM walk w JOIN gt ON gt.image = w.image AND gt.k = w.g GROUP BY ALL""",
    "agg12_threshold_sweep": f"{SWEEP} SELECT * FROM sweep",
    "agg13_best_threshold": f"{SWEEP} SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
    "srt7_first_misses": f"WITH RECURSIVE {matched('0.25')} SELECT image, g::INT AS k FROM walk WHERE g > 0 AND took IS NULL ORDER BY image, g LIMIT 12",
    "agg14_best_run": "SELECT s_name AS name, round(s_acctbal, 0) AS score, s_suppkey AS seq FROM supplier ORDER BY 2 DESC, 3 LIMIT 1",
    "agg2_dimensions": "SELECT p_size % 7 AS width, p_size % 5 AS height, count(*) AS n FROM part GROUP BY ALL",
    "alg18_proxy_scores": """WITH p AS (SELECT l_orderkey AS image, l_linenumber AS tile, l_partkey % 1000 AS k, l_quantity % 10 / 10 AS conf, ['bird', 'car', 'kite', 'person', 'boat'][l_suppkey % 5 + 1] AS label FROM lineitem WHERE l_orderkey IS NOT NULL),
      b AS (SELECT * FROM p WHERE label IN ('bird', 'kite', 'boat') QUALIFY row_number() OVER (PARTITION BY image ORDER BY conf DESC, tile, k, label) = 1)
      SELECT image, coalesce(b.conf, 0) AS conf, b.label FROM (SELECT DISTINCT image FROM p) LEFT JOIN b USING (image)""",
    "jn7_similar_pairs": f"WITH {VECTORS} SELECT a, b FROM dist WHERE a < b AND d <= 0.1335",
    "alg4_clusters": f"WITH RECURSIVE {VECTORS}, reach(id, other) AS (SELECT id, id FROM vec UNION SELECT r.id, d.b FROM reach r JOIN dist d ON d.a = r.other AND d.d <= 0.1335) SELECT id, min(other) AS cluster FROM reach GROUP BY id",
    "alg6_assign_splits": f"""WITH RECURSIVE {DOCS}, sz AS (SELECT source AS cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM docs GROUP BY source),
      tot AS (SELECT sum(size)::DOUBLE AS n FROM sz),
      w AS (SELECT n * 0.1::DOUBLE AS v, n * 0.1::DOUBLE AS t, n * (1 - 0.1::DOUBLE - 0.1::DOUBLE) AS r FROM tot),
      walk(i, cluster, size, split, hv, ht, hr) AS (
        SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE
        UNION ALL
        SELECT i, cluster, size, split, hv + CASE WHEN split = 'val' THEN size ELSE 0 END, ht + CASE WHEN split = 'test' THEN size ELSE 0 END, hr + CASE WHEN split = 'train' THEN size ELSE 0 END
        FROM (SELECT sz.i, sz.cluster, sz.size, hv, ht, hr, CASE WHEN (v - hv) / greatest(v, 1) >= (t - ht) / greatest(t, 1) AND (v - hv) / greatest(v, 1) >= (r - hr) / greatest(r, 1) THEN 'val'
                WHEN (t - ht) / greatest(t, 1) >= (r - hr) / greatest(r, 1) THEN 'test' ELSE 'train' END AS split FROM walk JOIN sz ON sz.i = walk.i + 1, w)
      ) SELECT cluster, size, split FROM walk WHERE i > 0""",
    "alg5_units": f"WITH {DOCS} SELECT source AS parent, doc_id % 97 AS source_stem, min(path) AS rep, count(*) AS copies FROM docs GROUP BY ALL",
    "agg5_copies_histogram": f"WITH {DOCS} SELECT copies, count(*) AS units FROM (SELECT count(*) AS copies FROM docs GROUP BY source, doc_id % 97) GROUP BY copies",
    "srt6_largest_clusters": f"WITH {DOCS} SELECT digest, count(*) AS size FROM docs GROUP BY digest ORDER BY size DESC, digest LIMIT 4",
    "jn8_nearest": f"WITH {NEAR} SELECT id, round(distance, 6) AS distance FROM near",
    "alg7_leak_audit": f"""WITH {NEAR} SELECT round_even(median(distance), 4) AS median_nearest, round_even(avg((distance <= 0.14)::INT) * 100, 1) AS pct_within_0_14,
        round_even(avg((distance <= 0.15)::INT) * 100, 1) AS pct_within_0_15, round_even(avg((distance <= 0.16)::INT) * 100, 1) AS pct_within_0_16 FROM near""",
    "win1_neighbours": f"WITH {FRAMES} SELECT video, idx, round(prev, 6) AS prev, round(next, 6) AS next, round(motion, 6) AS motion FROM frames",
    "alg9_frame_filter": f"WITH {FILTERED} SELECT video, idx, strong, near, verdict, reason FROM filtered",
    "agg6_verdict_counts": f"WITH {FILTERED} SELECT 's' || (video % 3) AS split, count(*) FILTER (verdict = 'keep') AS keep, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'removed') AS removed FROM filtered GROUP BY ALL",
    "win3_every_step": f"WITH {FRAMES} SELECT idx FROM frames WHERE idx % 6 = 0",
    "win4_top_share": f"""WITH {FRAMES}, s AS (SELECT video % 20 AS "group", idx, row_number() OVER (PARTITION BY video % 20 ORDER BY round(motion, 4) DESC, idx) AS r, count(*) OVER (PARTITION BY video % 20) AS n FROM frames) SELECT "group", idx FROM s WHERE r <= greatest(10, floor(n * 0.75))""",
    "win6_rolling_rate": "SELECT user_id AS source, event_id AS frame_no, round(avg(1.0 / (abs(value) / 100 + 0.01::DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS fps FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL",
    "win7_running_hit_rate": "SELECT user_id AS source, event_id AS frame_no, round(avg((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS hit_rate FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL",
    "win8_min_gap": """WITH RECURSIVE e AS (SELECT user_id AS source, event_id AS frame_no, event_id * 0.25::DOUBLE AS t FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
      taken(source, frame_no, t) AS (
        SELECT source, min(frame_no), min(t) FROM e GROUP BY source
        UNION ALL
        SELECT source, frame_no, t FROM (SELECT e.source, e.frame_no, e.t, row_number() OVER (PARTITION BY e.source ORDER BY e.frame_no) AS r FROM taken k JOIN e ON e.source = k.source AND e.t - k.t >= 300) WHERE r = 1
      ) SELECT source, frame_no FROM taken""",
    "srt1_review_order": f"WITH {FRAMES} SELECT video, idx, coalesce(CASE WHEN idx % 5 <> 0 THEN round(conf, 4) END, 99) AS score FROM frames ORDER BY score, video, idx",
    "agg19_hit_rate": f"WITH {FRAMES} SELECT round(avg((conf >= 0.05)::INT), 6) AS hit_rate, count(*) AS frames FROM frames",
    "snk5_frame_report": f"WITH {FILTERED} SELECT 'train' AS split, CAST(idx AS VARCHAR) AS filename, verdict, printf('%.3f', greatest(conf, 0)) AS yolo_conf, printf('%.2f', motion) AS motion_score, reason FROM filtered",
    "snk6_moves": f"WITH {FILTERED} SELECT 'train' AS prior, CASE WHEN verdict = 'keep' THEN 'train' ELSE verdict || '/train' END AS split, count(*) AS n FROM filtered GROUP BY ALL",
    "alg12_label_repair": f"WITH {LINES}, {_FIXED} SELECT stem, string_agg(fresh, chr(10) ORDER BY line_no, line) AS text, string_agg(fresh, chr(10) ORDER BY line_no, line) <> string_agg(line, chr(10) ORDER BY line_no, line) AS touched FROM f3 GROUP BY stem",
    "alg14_failure_report": f"""{SWEEP}, ev AS (SELECT t, sum(hits) / nullif(sum(hits) + sum(fp), 0) AS p, sum(hits) / nullif(sum(n_gt), 0) AS r FROM m WHERE image % 2 = 0 GROUP BY t),
      best AS (SELECT t FROM ev ORDER BY coalesce(2 * p * r / nullif(p + r, 0), 0) DESC, t LIMIT 1)
      SELECT t AS threshold, count(*) AS imgs, sum(n_gt)::BIGINT AS gt, sum(hits)::BIGINT AS hit, sum(fp)::BIGINT AS fp FROM m JOIN best USING (t) WHERE image % 2 = 1 GROUP BY t""",
    "alg3_nms": f"""WITH RECURSIVE {BOXES}, d AS (
        SELECT image // 8 AS image, (k + floor(x1) * 10 + floor(y1) * 10000)::INT AS k, min(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf)) AS s FROM pr GROUP BY ALL
      ), ranked AS (SELECT image, k, s.conf AS conf, s.x1 AS x1, s.y1 AS y1, s.x2 AS x2, s.y2 AS y2, row_number() OVER (PARTITION BY image ORDER BY s.conf DESC, k) AS i FROM d),
      walk(image, i, kept) AS (
        SELECT DISTINCT image, 0::BIGINT, []::STRUCT(k INT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] FROM ranked
        UNION ALL
        SELECT w.image, r.i, CASE WHEN len(list_filter(w.kept, lambda q: {_QIOU} >= 0.1)) > 0 THEN w.kept
          ELSE list_append(w.kept, struct_pack(k := r.k, conf := r.conf, x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2)) END
        FROM walk w JOIN ranked r ON r.image = w.image AND r.i = w.i + 1
      ), last AS (SELECT image, arg_max(kept, i) AS kept FROM walk GROUP BY image)
      SELECT image, e.k AS k, e.conf AS conf FROM (SELECT image, unnest(kept) AS e FROM last)""",
    "src2_label_states": f"""WITH {LINES}, {_FIXED}, st AS (
        SELECT CASE WHEN kind = 1 THEN 'malformed' WHEN kind = 3 THEN 'dropped' WHEN c - a > 1e-6 AND d - b > 1e-6 THEN 'box' ELSE 'degenerate' END AS state, c - a AS w FROM f2
      ) SELECT state, count(*) AS n, round(sum(CASE WHEN state = 'box' THEN w END), 4) AS width FROM st GROUP BY state""",
    "alg11_normalised": f"WITH {NORMAL} SELECT coalesce(origin, 'none') AS origin, disposition, count(*) AS n, sum(coalesce(boxes, 0))::BIGINT AS boxes FROM normal GROUP BY ALL",
    "agg17_accounting": f"""WITH {NORMAL} SELECT count(*) FILTER (disposition = 'positive') AS positives, count(*) FILTER (disposition = 'negative') AS negatives, coalesce(sum(boxes) FILTER (disposition = 'positive'), 0)::BIGINT AS boxes,
      sum(dropped)::BIGINT AS dropped, count(*) FILTER (disposition = 'unlabelled') AS bad, count(*) FILTER (disposition = 'dup') AS dup FROM normal""",
    "set2_union_of_inputs": f"WITH {DOCS} SELECT split, count(*) AS n FROM docs GROUP BY split",
    "set3_held_out_digests": f"WITH {DOCS} SELECT DISTINCT digest FROM docs WHERE split IN ('val', 'test')",
    "agg11_recall_by_background": f"WITH RECURSIVE {matched('0.25')} SELECT CASE WHEN (image % 10) / 10.0::DOUBLE > 0.4::DOUBLE THEN 'green' ELSE 'other' END AS background, count(*) AS imgs, sum(n_gt)::BIGINT AS gt, sum(hits)::BIGINT AS hit, round(coalesce(sum(hits) / nullif(sum(n_gt), 0), 0), 6) AS recall FROM m GROUP BY ALL",
    "snk1_manifest": f"WITH {DOCS} SELECT split, path, digest FROM docs",
    "src10_report": f"WITH {FILTERED} SELECT 'train' AS split, CAST(idx AS VARCHAR) AS filename, CAST(printf('%.3f', greatest(conf, 0)) AS DOUBLE) AS score FROM filtered",
    "snk8_repair_with_backup": f"""WITH {LINES}, {_FIXED} SELECT 'before' AS kind, 'labels/' || stem || '.txt' AS path, string_agg(line, chr(10) ORDER BY line_no, line) AS text FROM f3 GROUP BY stem
      UNION ALL SELECT 'after', 'labels/' || stem || '.txt', string_agg(fresh, chr(10) ORDER BY line_no, line) FROM f3 GROUP BY stem""",
    "str2_running_counters": """SELECT user_id AS source, event_id AS frame_no, row_number() OVER w AS seen, (sum((value > 50)::INT) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS hit, round(avg((value > 50)::INT) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS hit_rate,
      round(avg(1.0 / (abs(value) / 100 + 0.01::DOUBLE)) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS fps FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "str4_rate_limited": """WITH RECURSIVE e AS (SELECT user_id AS source, event_id AS frame_no, event_id * 0.25::DOUBLE AS t FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL),
      taken(source, frame_no, t, saved) AS (
        SELECT source, min(frame_no), min(t), 1::BIGINT FROM e GROUP BY source
        UNION ALL
        SELECT source, frame_no, t, saved FROM (SELECT e.source, e.frame_no, e.t, k.saved + 1 AS saved, row_number() OVER (PARTITION BY e.source ORDER BY e.frame_no) AS r FROM taken k JOIN e ON e.source = k.source AND e.t - k.t >= 300 WHERE k.saved < 5) WHERE r = 1
      ) SELECT source, frame_no, saved FROM taken""",
}
