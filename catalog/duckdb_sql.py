"""The SQL twin of every registered query that SQL can express."""

from __future__ import annotations

VIEWS = """
WITH RECURSIVE base AS (
  SELECT vec_id AS curve_id, embedding,
         CASE WHEN label < 6 THEN 0 WHEN label < 8 THEN 1 WHEN label = 8 THEN 2 ELSE 3 END AS y_raw
  FROM embeddings),
curves AS (
  SELECT curve_id, y_raw, (y_raw > 0)::INTEGER AS y,
         list_transform(embedding, lambda v, i: v::DOUBLE + CASE WHEN i - 1 = 8 * y_raw THEN 1.5 ELSE 0 END::DOUBLE) AS x,
         list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 127.5::DOUBLE)::INTEGER) AS px
  FROM base),
known AS (
  SELECT *, row_number() OVER (ORDER BY md5('0:' || curve_id), curve_id) AS rk, count(*) OVER () AS nk
  FROM curves WHERE y_raw <> 3),
pool AS (SELECT *, floor(0.8 * nk)::BIGINT AS np FROM known WHERE rk <= floor(0.8 * nk)),
test AS (
  SELECT curve_id, y_raw, y, x FROM known WHERE rk > floor(0.8 * nk)
  UNION ALL SELECT curve_id, y_raw, y, x FROM curves WHERE y_raw = 3),
screened AS (SELECT * FROM pool WHERE rk <= least(400, floor(0.25 * np))),
rest AS (SELECT * FROM pool WHERE rk > least(400, floor(0.25 * np))),
parts AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('1:' || curve_id), curve_id) <= floor(0.8 * count(*) OVER ())
                 THEN 'train' ELSE 'val' END AS part
  FROM screened),
plane AS (
  SELECT curve_id, y_raw, x[9] AS e0, x[17] AS e1, ({pred} % 2)::INTEGER AS pred FROM curves),
centers AS (
  SELECT y_raw - 1 AS cluster, avg(e0) AS e0, avg(e1) AS e1 FROM plane WHERE y_raw IN (1, 2) GROUP BY y_raw),
geometry AS (
  SELECT m0, m1, (c0 - m0) / sqrt((c0 - m0) ** 2 + (c1 - m1) ** 2) AS n0,
         (c1 - m1) / sqrt((c0 - m0) ** 2 + (c1 - m1) ** 2) AS n1
  FROM (SELECT avg(e0) AS m0, avg(e1) AS m1, max(e0) FILTER (cluster = 0) AS c0, max(e1) FILTER (cluster = 0) AS c1
        FROM centers)),
projected AS (
  SELECT p.*, (e0 * n0 + e1 * n1 - (m0 * n0 + m1 * n1)) / (n0 * n0 + n1 * n1) AS projection
  FROM plane p, geometry),
clustered AS (
  SELECT p.*, (SELECT arg_min(c.cluster, (p.e0 - c.e0) ** 2 + (p.e1 - c.e1) ** 2) FROM centers c) AS cluster
  FROM plane p)
"""


def number(tag: str, key: str = "curve_id") -> str:
    return f"('0x' || substr(md5('{tag}:' || {key}), 1, 8))::BIGINT"


def weight(tag: str, key: str = "curve_id") -> str:
    return f"(({number(tag, key)} % 2001 - 1000) / 1000.0::DOUBLE)"


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}.x, {b}.x), lambda p: (p[1] - p[2]) ** 2))"


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0::DOUBLE"


P_BAD = f"({number('score')} % 1000 / 1000.0::DOUBLE)"
PX = "array_to_string({0}, ',')"
BINS = (
    "count(*) FILTER (y_raw = 0) AS n_bad, count(*) FILTER (y_raw = 1) AS n_p1, "
    "count(*) FILTER (y_raw = 2) AS n_p2, count(*) FILTER (y_raw = 3) AS n_p3"
)
CLASSES = "(SELECT unnest([0, 1, 2, 3])::INTEGER AS y_raw)"
RESIZED = "list_transform(range(144), lambda p: px[(floor((p // 12 + 0.5) * 8 / 12) * 8 + floor((p % 12 + 0.5) * 8 / 12))::INTEGER + 1])"
MEANS = (0.485, 0.456, 0.406)
DEVIATIONS = (0.229, 0.224, 0.225)


def crossed(table: str, condition_0: str, condition_1: str, name_0: str, name_1: str, by: str = "") -> str:
    """Four-class counts of two sides, zero-filled."""
    key = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {table}) g, {CLASSES} c" if by else f"{CLASSES} c"
    match = f"t.y_raw = c.y_raw" + (f" AND t.{by} = g.{by}" if by else "")
    shown = f"g.{by}, " if by else ""
    return (
        f"SELECT {shown}c.y_raw, count(*) FILTER (t.y_raw IS NOT NULL AND {condition_0}) AS {name_0}, "
        f"count(*) FILTER (t.y_raw IS NOT NULL AND {condition_1}) AS {name_1} "
        f"FROM {groups} LEFT JOIN {table} t ON {match} GROUP BY {shown}c.y_raw"
    )


def upsampled(label: str) -> str:
    """Common tables ``grown(curve_id, label, copy_no)`` over the whole pool."""
    return f"""
, sizes AS (SELECT {label}, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM pool GROUP BY {label}),
draws AS (
  SELECT {label}, k AS copy_no, ('0x' || substr(md5('42:' || {label} || ':' || k), 1, 15))::BIGINT % n AS pos
  FROM (SELECT {label}, n, unnest(range(1, deficit + 1)) AS k FROM sizes)),
placed AS (
  SELECT curve_id, {label}, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || curve_id), curve_id) - 1 AS pos
  FROM pool),
grown AS (
  SELECT curve_id, {label}, 0::BIGINT AS copy_no FROM pool
  UNION ALL SELECT p.curve_id, p.{label}, d.copy_no FROM draws d JOIN placed p USING ({label}, pos))"""


ROUNDS = """
, ranked AS (SELECT *, ceil(rk / 50.0)::BIGINT AS round FROM pool),
per_round AS (SELECT round, count(*) AS n, sum(y) AS good FROM ranked GROUP BY round),
totals AS (SELECT count(*) AS n, sum(y) AS n_good FROM pool),
steps AS (
  SELECT round, (sum(p.n) OVER (ORDER BY round))::BIGINT AS n_screened,
         (sum(p.n) OVER (ORDER BY round))::DOUBLE / t.n AS frac_screened, (sum(good) OVER (ORDER BY round))::DOUBLE / n_good AS recall
  FROM per_round p, totals t
  UNION ALL SELECT 0, 0, 0.0, 0.0
  UNION ALL SELECT (SELECT max(round) + 1 FROM per_round), n, 1.0, 1.0 FROM totals)"""

HARD = f"""
, positives AS (SELECT * FROM curves WHERE y_raw <> 0),
pairs AS (
  SELECT a.curve_id, b.curve_id AS other, a.y_raw = b.y_raw AS same, sqrt({dist('a', 'b')}) AS d
  FROM positives a JOIN positives b ON a.curve_id <> b.curve_id),
hard AS (
  SELECT curve_id, arg_max(other, d) FILTER (same) AS pos_id, max(d) FILTER (same) AS d_pos,
         arg_min(other, d) FILTER (NOT same) AS neg_id, min(d) FILTER (NOT same) AS d_neg
  FROM pairs GROUP BY curve_id)"""

CLASS_MEANS = f"""
        , means AS (
          SELECT y, list(m ORDER BY i) AS x FROM (
            SELECT y, i, avg(v) AS m FROM (SELECT y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pool) GROUP BY y, i)
          GROUP BY y),
        k AS (
          SELECT t.curve_id, exp(-{dist('t', 'a')} / 8.0::DOUBLE) AS k0, exp(-{dist('t', 'b')} / 8.0::DOUBLE) AS k1,
                 exp(-{dist('a', 'b')} / 8.0::DOUBLE) AS c, 1 + 1e-8::DOUBLE AS s
          FROM test t, means a, means b WHERE a.y = 0 AND b.y = 1),
        by_means AS (SELECT curve_id, greatest(1 - (s * k0 * k0 - 2 * c * k0 * k1 + s * k1 * k1) / (s * s - c * c), 0.0) AS variance FROM k)
        """


def fitted_embedding(epochs: int, rate: float) -> str:
    """The descent written out, a few common tables for each pass: copies dealt to batches, hard triplets, gradient, update."""
    size, margin, decay, epsilon, reach = 32, 1.0, 0.9, 1e-7, 32
    pick = "('0x' || substr(md5('deal:' || {tag} || ':' || curve_id || ':' || copy), 1, 15))::BIGINT"
    start = "((('0x' || substr(md5('42:' || curve_id || ':{o}'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE * 2 - 1) * sqrt(6.0::DOUBLE / (m + 2)))"
    parts = [f"""
        , good AS (SELECT curve_id, x, y_raw, part = 'train' AS fit FROM parts WHERE y_raw <> 0),
        wanting AS (SELECT fit, y_raw, count(*) AS n, max(count(*)) OVER (PARTITION BY fit) - count(*) AS deficit FROM good GROUP BY fit, y_raw),
        hits AS (
          SELECT fit, y_raw, pos, count(*) AS hits FROM (
            SELECT fit, y_raw, ('0x' || substr(md5('42:' || y_raw || ':' || k), 1, 15))::BIGINT % n AS pos
            FROM (SELECT *, unnest(range(1, deficit + 1)) AS k FROM wanting)) GROUP BY ALL),
        copies AS (
          SELECT p.curve_id, p.y_raw, p.fit, unnest(range(1 + coalesce(h.hits, 0))) AS copy
          FROM (SELECT *, row_number() OVER (PARTITION BY fit, y_raw ORDER BY md5('42:' || curve_id), curve_id) - 1 AS pos FROM good) p
          LEFT JOIN hits h USING (fit, y_raw, pos)),
        sized AS (
          SELECT greatest(1, ceil(count(*) FILTER (fit) / {size}.0)::BIGINT) AS nt, greatest(1, ceil(count(*) FILTER (NOT fit) / {size}.0)::BIGINT) AS nv FROM copies),
        kern AS MATERIALIZED (
          SELECT a.curve_id AS i, b.curve_id AS j, exp(-{dist('a', 'b')} / 8.0::DOUBLE) AS k FROM good a JOIN good b ON b.fit),
        w0 AS MATERIALIZED (
          SELECT curve_id AS j, {start.format(o=0)} AS a, {start.format(o=1)} AS b, 0.0::DOUBLE AS sa, 0.0::DOUBLE AS sb
          FROM good, (SELECT count(*) AS m FROM good WHERE fit) WHERE fit)"""]
    for p in range(epochs + 1):
        parts.append(f""",
        e{p} AS MATERIALIZED (SELECT i, sum(k * a) AS e0, sum(k * b) AS e1 FROM kern JOIN w{p} USING (j) GROUP BY i),
        c{p} AS MATERIALIZED (
          SELECT curve_id, copy, y_raw, fit, e0, e1, CASE WHEN fit THEN {pick.format(tag=f"'{p + 1}'")} % nt ELSE -1 - {pick.format(tag="'val'")} % nv END AS batch
          FROM copies JOIN e{p} ON i = curve_id, sized),
        f{p} AS (
          SELECT a.batch, a.curve_id, a.copy, a.e0, a.e1, max(d) FILTER (same) AS dp, arg_max(o, d) FILTER (same) AS p, min(d) FILTER (NOT same) AS dn, arg_min(o, d) FILTER (NOT same) AS q
          FROM c{p} a JOIN c{p} b ON a.batch = b.batch AND (a.curve_id <> b.curve_id OR a.copy <> b.copy),
               LATERAL (SELECT sqrt((a.e0 - b.e0) ** 2 + (a.e1 - b.e1) ** 2) AS d, a.y_raw = b.y_raw AS same, {{'id': b.curve_id, 'e0': b.e0, 'e1': b.e1}} AS o)
          GROUP BY ALL HAVING count(*) FILTER (NOT same) > 0),
        h{p} AS MATERIALIZED (SELECT *, greatest(coalesce(dp, 0) - dn + {margin}, 0) AS term, count(*) OVER (PARTITION BY batch) AS size FROM f{p}),
        l{p} AS MATERIALIZED (
          SELECT sum(term / size) FILTER (batch >= 0) / count(DISTINCT batch) FILTER (batch >= 0) AS trained, count(DISTINCT batch) FILTER (batch >= 0) AS n,
                 avg(term) FILTER (batch < 0) AS watched FROM h{p})""")
        if p < epochs:
            pulls = " UNION ALL ".join(
                f"SELECT {to} AS i, {sign} * (e0 - {o}.e0) / {d} / size AS g0, {sign} * (e1 - {o}.e1) / {d} / size AS g1 FROM h{p} WHERE batch >= 0 AND term > 0 AND {d} > 0"
                for o, d, side in (("p", "dp", 1), ("q", "dn", -1)) for to, sign in (("curve_id", side), (f"{o}.id", -side))
            )
            moved = f"least((SELECT nt FROM sized), {reach}) * {rate}::DOUBLE"
            parts.append(f""",
        u{p} AS (SELECT i, sum(g0) AS g0, sum(g1) AS g1 FROM ({pulls}) GROUP BY i),
        g{p} AS (SELECT j, sum(k * g0) / (SELECT n FROM l{p}) AS g0, sum(k * g1) / (SELECT n FROM l{p}) AS g1 FROM kern JOIN u{p} USING (i) GROUP BY j),
        w{p + 1} AS MATERIALIZED (
          SELECT j, a - {moved} * coalesce(g0, 0) / (sqrt(ta) + {epsilon}) AS a, b - {moved} * coalesce(g1, 0) / (sqrt(tb) + {epsilon}) AS b, ta AS sa, tb AS sb
          FROM (SELECT w.*, g0, g1, {decay}::DOUBLE * sa + (1 - {decay}::DOUBLE) * coalesce(g0, 0) ** 2 AS ta, {decay}::DOUBLE * sb + (1 - {decay}::DOUBLE) * coalesce(g1, 0) ** 2 AS tb FROM w{p} w LEFT JOIN g{p} USING (j)))""")
    tried = " UNION ALL ".join(f"SELECT {p} AS p, coalesce((SELECT watched FROM l{p}), (SELECT trained FROM l{p - 1})) AS loss" for p in range(1, epochs + 1))
    every = " UNION ALL ".join(f"SELECT {p} AS p, j, a, b FROM w{p}" for p in range(1, epochs + 1))
    return "".join(parts) + f""",
        best AS (SELECT p, loss FROM ({tried}) ORDER BY loss, p LIMIT 1)
        SELECT j AS curve_id, {r6('a')} AS w0, {r6('b')} AS w1, {r6('loss')} AS val_loss FROM ({every}) JOIN best USING (p)"""


SQL: dict[str, str] = {
    # sources and sinks
    "load_curves": f"SELECT curve_id, y_raw, len(x)::INTEGER AS n_dims, {r6('list_sum(x)')} AS x_sum FROM curves",
    "ingest_array_archives": f"""
        SELECT row_number() OVER (ORDER BY curve_id) - 1 AS curve_id, y_raw, 16::INTEGER AS n_samples,
               {r6('embedding[2]::DOUBLE')} AS first_force, {r6('embedding[64]::DOUBLE')} AS last_contour,
               {r6('list_sum(list_transform(embedding, lambda v: v::DOUBLE))')} AS x_sum, 8::INTEGER AS height, 8::INTEGER AS width,
               array_to_string(list_transform(px, lambda p: printf('%02X', p)), '') AS image_hex
        FROM base JOIN curves USING (curve_id, y_raw)""",
    "feature_from_images": f"""
        SELECT curve_id, {', '.join(f"len(list_filter(r, lambda p: ((255 - p) / 255.0::DOUBLE - {m}) > 0))::DOUBLE AS f{i}" for i, m in enumerate(MEANS))}
        FROM (SELECT curve_id, {RESIZED} AS r FROM curves)""",
    "export_run": f"""
        SELECT 'curves' AS part_of_run, curve_id, y_raw::VARCHAR AS said, y::DOUBLE AS value FROM curves
        UNION ALL SELECT 'features', curve_id, len(x)::VARCHAR, {r6('list_sum(x) / len(x)')} FROM curves
        UNION ALL SELECT 'split', curve_id, 'pool ' || y_raw, NULL FROM pool
        UNION ALL SELECT 'split', curve_id, 'test ' || y_raw, NULL FROM test
        UNION ALL SELECT 'distances', t.curve_id, count(*) || ' ' || any_value(t.y_raw), {r6(f"avg({dist('t', 's')})")} FROM test t, screened s GROUP BY t.curve_id""",
    "export_rounds": f"""
        SELECT r.round, r.curve_id, r.y_raw, (p.pred = 1) AS predicted_good, {r6('e0')} AS e0, {r6('e1')} AS e1
        FROM (SELECT curve_id, y_raw, ceil(rk / 50.0)::BIGINT AS round FROM pool) r JOIN plane p USING (curve_id)""",
    "save_model": f"""
        SELECT curve_id, {weight('coef')} AS w, 8.0::DOUBLE AS scale, 0.25::DOUBLE AS intercept FROM screened""",
    "round_report": f"""
        , sets AS (
          SELECT 0 AS line_no, 'data   screened' AS head, y_raw, true AS shown FROM screened
          UNION ALL SELECT 1, 'data unscreened', y_raw, true FROM rest
          UNION ALL SELECT 2, 'data (test set)', y_raw, {number('pred')} % 2 = 1 FROM test)
        SELECT line_no, format('{{}}: {{}} --> bad curves: {{}}; P1: {{}}; P2: {{}}; P3: {{}}', head, count(*),
               count(*) FILTER (shown AND y_raw = 0), count(*) FILTER (shown AND y_raw = 1),
               count(*) FILTER (shown AND y_raw = 2), count(*) FILTER (shown AND y_raw = 3)) AS line,
               count(*) FILTER (shown) AS n_counted
        FROM sets GROUP BY line_no, head""",
    "chart_tables": ROUNDS + f"""
        SELECT 'screening' AS series, NULL::BIGINT AS curve_id, {r6('frac_screened')} AS x, {r6('recall')} AS y FROM steps
        UNION ALL SELECT 'random', NULL, {r6('frac_screened')}, {r6('frac_screened')} FROM steps
        UNION ALL SELECT 'perfect', NULL, {r6('frac_screened')}, {r6('least(1.0, frac_screened * n / n_good)')} FROM steps, totals
        UNION ALL SELECT 'embedding', curve_id, {r6('e0')}, {r6('e1')} FROM plane WHERE pred = 1
        UNION ALL SELECT 'novelty', curve_id, {r6('projection')}, {r6(P_BAD)} FROM projected""",
    # projections
    "recode_labels": """
        SELECT curve_id, ((y_raw + 3) % 4)::INTEGER AS y_file,
               CASE WHEN (y_raw + 3) % 4 + 1 = 4 THEN 0 ELSE (y_raw + 3) % 4 + 1 END::INTEGER AS y_raw FROM curves""",
    "binary_label": "SELECT curve_id, y_raw, y FROM curves",
    "invert_image": f"SELECT curve_id, {PX.format('list_transform(px, lambda p: 255 - p)')} AS px FROM curves",
    "replicate_channels": f"SELECT curve_id, {PX.format('flatten(list_transform(px, lambda p: [p, p, p]))')} AS px FROM curves",
    "resize_nearest": f"SELECT curve_id, {PX.format(RESIZED)} AS px FROM curves",
    "normalize_channels": f"""
        SELECT curve_id, (i - 1)::INTEGER AS pos,
               {r6(f"(p / 255.0::DOUBLE - {list(MEANS)}[(i - 1) % 3 + 1]) / {list(DEVIATIONS)}[(i - 1) % 3 + 1]")} AS v
        FROM (SELECT curve_id, unnest(f) AS p, generate_subscripts(f, 1) AS i
              FROM (SELECT curve_id, flatten(list_transform(px, lambda p: [255 - p, 255 - p, 255 - p])) AS f FROM curves))""",
    "rbf_kernel": f"SELECT t.curve_id AS i, s.curve_id AS j, {r6(f'exp(-{dist('t', 's')} / 8.0::DOUBLE)')} AS k FROM test t, screened s",
    "scale_grid": f"""
        , d AS (SELECT {dist('t', 's')} AS d FROM test t, screened s)
        SELECT e::INTEGER AS scale_idx, (2.0::DOUBLE ** (e - 2)) AS scale, {r6('avg(exp(-d / (2.0::DOUBLE ** (e - 2))))')} AS mean_k
        FROM d, range(16) g(e) GROUP BY e""",
    "embed_project": f"""
        SELECT t.curve_id, {r6(f"sum(exp(-{dist('t', 's')} / 8.0::DOUBLE) * {weight('w0', 's.curve_id')})")} AS e0,
               {r6(f"sum(exp(-{dist('t', 's')} / 8.0::DOUBLE) * {weight('w1', 's.curve_id')})")} AS e1
        FROM test t, screened s WHERE s.y_raw <> 0 GROUP BY t.curve_id""",
    "signed_projection": f"SELECT curve_id, {r6('projection')} AS projection FROM projected",
    "centroid_midpoint_normal": f"SELECT {r6('m0')} AS m0, {r6('m1')} AS m1, {r6('n0')} AS n0, {r6('n1')} AS n1 FROM geometry",
    # filters
    "holdout_class": "SELECT curve_id, y_raw FROM known",
    "positives_only": "SELECT curve_id, y_raw FROM pool WHERE y_raw <> 0",
    "predicted_sign_filter": "SELECT curve_id, y_raw, CASE WHEN pred = 1 THEN 'good' ELSE 'bad' END AS side FROM plane",
    "half_plane_filter": """
        SELECT curve_id, y_raw, CASE WHEN projection > 0 THEN 'positive' ELSE 'negative' END AS side
        FROM projected WHERE projection <> 0""",
    "checkpoint_filter": """
        , counts AS (SELECT ceil(rk / 50.0)::BIGINT AS round, max(rk) AS n_screened FROM pool GROUP BY 1)
        SELECT round, n_screened, n_screened = 300 AS is_last FROM counts WHERE n_screened IN (50, 150, 300)""",
    # joins
    "pairwise_distance_self": f"SELECT a.curve_id AS i, b.curve_id AS j, {r6(dist('a', 'b'))} AS d FROM curves a, curves b",
    "pairwise_distance_cross": f"SELECT a.curve_id AS i, b.curve_id AS j, {r6(dist('a', 'b'))} AS d FROM test a, pool b",
    "pairwise_distance_within": f"SELECT i, j, {r6('d')} AS d FROM (SELECT a.curve_id AS i, b.curve_id AS j, {dist('a', 'b')} AS d FROM curves a, curves b) WHERE d <= -ln(0.25::DOUBLE)",
    "anchor_features": f"""
        , t AS (SELECT curve_id, x, row_number() OVER (ORDER BY curve_id) - 1 AS pos FROM parts WHERE part = 'train')
        SELECT p.curve_id, t.pos::INTEGER AS pos, {r6(dist('p', 't'))} AS d FROM pool p, t""",
    "unscreened": "SELECT curve_id, y_raw FROM rest",
    "reveal_labels": "SELECT curve_id, y_raw, y FROM screened",
    "triplet_hard_pairs": HARD + f"SELECT curve_id, pos_id, {r6('d_pos')} AS d_pos, neg_id, {r6('d_neg')} AS d_neg FROM hard",
    # aggregations
    "composition": f"""
        , sets AS (SELECT 'screened' AS part, y_raw FROM screened UNION ALL SELECT 'unscreened', y_raw FROM rest
                   UNION ALL SELECT 'test', y_raw FROM test WHERE {number('pred')} % 2 = 1)
        SELECT part, {BINS} FROM sets GROUP BY part""",
    "class_counts": """
        , c AS (SELECT y_raw, count(*) AS n FROM pool GROUP BY y_raw)
        SELECT arg_max(y_raw, (n, -y_raw)) AS majority, max(n) AS n_majority,
               arg_min(y_raw, (n, y_raw)) AS minority, min(n) AS n_minority FROM c""",
    "validation_accuracy": f"""
        SELECT (2.0::DOUBLE ** (e - 2)) AS scale, {r6(f"avg((('0x' || substr(md5('guess:' || e || ':' || curve_id), 1, 8))::BIGINT % 2 = y)::INTEGER)")} AS accuracy
        FROM pool, range(16) g(e) GROUP BY e""",
    "confusion_classifier": crossed("plane", "pred = 0", "pred = 1", "n_pred_0", "n_pred_1"),
    "confusion_clusters": ", good AS (SELECT * FROM clustered WHERE pred = 1)" + crossed("good", "cluster = 0", "cluster = 1", "n_cluster_0", "n_cluster_1"),
    "confusion_half_planes": crossed("projected", "projection > 0", "projection < 0", "n_positive", "n_negative", by="pred"),
    "triplet_hard_mining": HARD + f"""
        SELECT {r6('avg(greatest(coalesce(d_pos, 0.0) - d_neg + 1.0, 0.0))')} AS loss, count(*) AS n FROM hard WHERE d_neg IS NOT NULL""",
    "cluster_alignment": """
        SELECT (count(*) FILTER (y_raw = 1 AND cluster = 0) + count(*) FILTER (y_raw = 2 AND cluster = 1))
             < (count(*) FILTER (y_raw = 1 AND cluster = 1) + count(*) FILTER (y_raw = 2 AND cluster = 0)) AS swap
        FROM clustered WHERE pred = 1""",
    "positive_totals": "SELECT sum(y)::BIGINT AS n_good, count(*) AS n FROM pool",
    "label_counts": "SELECT y_raw, count(*) AS n FROM curves GROUP BY y_raw",
    # windows
    "cumulative_recall": ROUNDS + f"SELECT round, n_screened, {r6('frac_screened')} AS frac_screened, {r6('recall')} AS recall FROM steps",
    "train_val_split": """
        SELECT curve_id, CASE WHEN row_number() OVER (ORDER BY md5('1:' || curve_id), curve_id) <= floor(0.8 * count(*) OVER ())
               THEN 'train' ELSE 'val' END AS part FROM pool""",
    "round_of_rank": "SELECT curve_id, rk AS screen_rank, ceil(rk / 50.0)::BIGINT AS round FROM pool",
    # sorts
    "seeded_shuffle": """
        SELECT curve_id, row_number() OVER (ORDER BY md5('0:' || curve_id), curve_id) AS shuffle_rank FROM curves""",
    "rank_unscreened": f"SELECT curve_id, {P_BAD} AS p_bad FROM rest ORDER BY p_bad, curve_id",
    "select_next_batch": f"SELECT curve_id, {P_BAD} AS p_bad FROM rest ORDER BY p_bad, curve_id LIMIT 20",
    "best_scale": f"""
        , scores AS (
          SELECT (2.0::DOUBLE ** (e - 2)) AS scale, round(avg((('0x' || substr(md5('guess:' || e || ':' || curve_id), 1, 8))::BIGINT % 2 = y)::INTEGER), 1) AS accuracy
          FROM pool, range(16) g(e) GROUP BY e)
        SELECT scale, accuracy FROM scores ORDER BY accuracy DESC, scale LIMIT 1""",
    "head_split": """
        SELECT curve_id, rk <= floor(0.8 * nk) AS in_pool FROM known""",
    # sets
    "build_test_set": "SELECT curve_id, y_raw FROM test",
    "grow_screened": f"""
        SELECT curve_id, y_raw, 'screened' AS part FROM screened
        UNION ALL SELECT * FROM (SELECT curve_id, y_raw, 'chosen' FROM rest ORDER BY {P_BAD}, curve_id LIMIT 20)""",
    "append_resampled": upsampled("y") + """
        SELECT curve_id, copy_no, row_number() OVER (ORDER BY md5('0:' || curve_id || ':' || copy_no), curve_id, copy_no) AS shuffle_rank FROM grown""",
    # rebalancing
    "upsample_binary": upsampled("y") + "SELECT curve_id, y, copy_no FROM grown",
    "upsample_multiclass": upsampled("y_raw") + "SELECT curve_id, y_raw, copy_no FROM grown",
    "class_weights": f"""
        , c AS (SELECT y_raw, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM pool GROUP BY y_raw)
        SELECT curve_id, y_raw, {r6('total / (k * n)')} AS weight FROM pool JOIN c USING (y_raw)""",
    # learning
    "score_probability": f"""
        , z AS (
          SELECT p.curve_id, sum(exp(-{dist('p', 's')} / 8.0::DOUBLE) * {weight('coef', 's.curve_id')}) + 0.25 AS z
          FROM (SELECT curve_id, x FROM rest UNION ALL SELECT curve_id, x FROM test) p, screened s GROUP BY p.curve_id)
        SELECT curve_id, {r6('1 / (1 + exp(z))')} AS p_bad, {r6('1 / (1 + exp(-z))')} AS p_good, (z > 0)::INTEGER AS pred FROM z""",
    "fit_metric_embedding": fitted_embedding(2, 1e-4),
    "nearest_centroid": "SELECT curve_id, cluster FROM clustered",
    # Elimination of one anchor a step from the covariance of all anchors and test rows: what is left of a test row's own variance.
    "posterior_variance": f"""
        , anchors AS (SELECT x, row_number() OVER (ORDER BY curve_id)::INTEGER AS pos FROM pool),
        these AS (
          SELECT pos, NULL::BIGINT AS curve_id, x FROM anchors
          UNION ALL SELECT 1000000, curve_id, x FROM test),
        covariance AS (
          SELECT t.pos, t.curve_id, list(exp(-{dist('t', 'a')} / 8.0::DOUBLE) + CASE WHEN t.pos = a.pos THEN 1e-8::DOUBLE ELSE 0 END ORDER BY a.pos) AS r
          FROM these t, anchors a GROUP BY t.pos, t.curve_id),
        steps AS (
          SELECT 0 AS k, pos, curve_id, r, 1.0::DOUBLE AS s FROM covariance
          UNION ALL
          SELECT e.k + 1, e.pos, e.curve_id,
                 list_transform(list_zip(e.r[2:], p.r[2:]), lambda z: z[1] - e.r[1] / p.r[1] * z[2]), e.s - e.r[1] * e.r[1] / p.r[1]
          FROM steps e JOIN steps p ON p.pos = e.k + 1 AND e.pos > p.pos)
        SELECT curve_id, {r6('greatest(s, 0.0)')} AS variance FROM steps WHERE len(r) = 0 AND curve_id IS NOT NULL""",
    # The best of all splits by a line: two-means parts are always divided by one, which can be turned until it meets two points.
    "kmeans_two": f"""
        , pts AS (SELECT curve_id, e0, e1 FROM plane WHERE pred = 1),
        sides AS (
          SELECT a.curve_id AS i, b.curve_id AS j, any_value(a.e0) AS ax, any_value(a.e1) AS ay, any_value(b.e0) AS bx, any_value(b.e1) AS by1,
                 count(*) FILTER (l) AS n, coalesce(sum(p.e0) FILTER (l), 0) AS sx, coalesce(sum(p.e1) FILTER (l), 0) AS sy
          FROM pts a JOIN pts b ON a.curve_id < b.curve_id JOIN pts p ON p.curve_id <> a.curve_id AND p.curve_id <> b.curve_id,
               LATERAL (SELECT (b.e0 - a.e0) * (p.e1 - a.e1) - (b.e1 - a.e1) * (p.e0 - a.e0) > 0 AS l)
          GROUP BY 1, 2),
        splits AS (
          SELECT n + u + w AS n0, sx + u * ax + w * bx AS x0, sy + u * ay + w * by1 AS y0
          FROM sides, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS ends(u, w)),
        whole AS (SELECT count(*) AS n, sum(e0) AS sx, sum(e1) AS sy, sum(e0 * e0 + e1 * e1) AS q FROM pts),
        best AS (
          SELECT x0 / n0 AS x0, y0 / n0 AS y0, (sx - x0) / (n - n0) AS x1, (sy - y0) / (n - n0) AS y1,
                 q - (x0 * x0 + y0 * y0) / n0 - ((sx - x0) * (sx - x0) + (sy - y0) * (sy - y0)) / (n - n0) AS cost
          FROM splits, whole WHERE n0 BETWEEN 1 AND n - 1 ORDER BY cost LIMIT 1),
        centers2 AS (SELECT x0 AS e0, y0 AS e1, cost FROM best UNION ALL SELECT x1, y1, cost FROM best)
        SELECT (row_number() OVER (ORDER BY e0, e1) - 1)::INTEGER AS cluster, {r6('e0')} AS e0, {r6('e1')} AS e1, {r6('cost')} AS cost FROM centers2""",
    "posterior_variance_class_means": CLASS_MEANS + f"SELECT curve_id, {r6('variance')} AS variance FROM by_means",
    "novelty_table": CLASS_MEANS + f"SELECT curve_id, y_raw, pred, {r6('projection')} AS projection, {r6('variance')} AS variance FROM projected JOIN by_means USING (curve_id)",

}


def oracle_sql() -> dict[str, str]:
    views = VIEWS.replace("{pred}", number("pred"))
    return {name: views.rstrip() + "\n" + body.strip() for name, body in SQL.items()}
