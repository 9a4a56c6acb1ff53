"""The registered queries as plain SQL, written independently of the Spark code."""

from __future__ import annotations

from showcase import sqltext as q
from showcase.bindings import CUSTOMERS, DEGENERATE, DOCUMENTS, EVENTS, GAPS, LINES, ORDERS, PLANTED, VECTORS
from showcase.sqltext import MEASURES, cte

SEED = 7
COUNTS = "tp, fp, tn, fn"
TRADE_OFF = ("Confidence", "TPR")
THREE_WAY = ("Confidence", "TPR", "TNR")


def r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


# -- profile and encoding -------------------------------------------------------


def _minmax(b):
    return " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min, max({c}) AS max FROM src" for c in b.numeric)


def _fuzzy_labels():
    b, rows = LINES, []
    fmt = "DecreasingLine", "Triangular", "IncreasingLine"
    for i in range(len(b.numeric)):
        p = [f"p{i}_{j}" for j in range(3)]
        rows.append(f"SELECT {i} AS var, 0 AS label, '{fmt[0]}' AS shape, {p[0]} AS x0, {p[1]} AS x1, NULL::DOUBLE AS x2 FROM pts")
        rows.append(f"SELECT {i}, 1, '{fmt[1]}', {p[0]}, {p[1]}, {p[2]} FROM pts")
        rows.append(f"SELECT {i}, 2, '{fmt[2]}', {p[1]}, {p[2]}, NULL FROM pts")
    text = (
        "CASE WHEN x2 IS NULL THEN printf('%s(%.6f, %.6f)', shape, x0, x1) "
        "ELSE printf('%s(%.6f, %.6f, %.6f)', shape, x0, x1, x2) END"
    )
    return cte(*q.labels_ctes(b), ("l", " UNION ALL ".join(rows))) + (
        f"SELECT var, label, shape, {r9('x0', 'x1', 'x2')}, {text} AS label_text FROM l"
    )


def _words(b, n):
    return ", ".join(f"m{i}" for i in range(n))


def _enc_query(b, cols, long_words=1):
    return cte(*q.enc_ctes(b, long_words)) + f"SELECT {cols} FROM enc"


def _item_rows(b, keys, rows="enc", weight="count(*)"):
    """UNION of one row per feature a row has."""
    out = []
    for i in range(q.n_words(b)):
        out.append(
            f"SELECT {keys}, f.var, f.val::INTEGER AS val{', e.n' if rows == 'sig' else ''} FROM {rows} e "
            f"JOIN feat f ON f.var = {i} AND (e.m{i} >> f.val::BIGINT) & 1 = 1"
        )
    return " UNION ALL ".join(out)


def _bitmap_counts():
    b = ORDERS
    feats = _item_rows(b, "(e.o_orderkey // 32768) + 1 AS bucket")
    classes = "SELECT DISTINCT cls FROM enc"
    own = (
        "SELECT (o_orderkey // 32768) + 1 AS bucket, -1 AS var, c.pos::INTEGER AS val FROM enc JOIN "
        f"(SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS pos FROM ({classes})) c USING (cls)"
    )
    return cte(*q.enc_ctes(b), q.features_cte(b), ("i", f"{feats} UNION ALL {own}")) + (
        "SELECT bucket, var, val, count(*) AS n FROM i GROUP BY ALL"
    )


# -- rules ------------------------------------------------------------------------


def _edge_select():
    """The seven edge rules on the orders: price label mask, priority mask."""
    full = "((1::BIGINT << len(dom0)::BIGINT) - 1)"
    rows = [
        (0, 0, "0", "0"),
        (1, 0, "7", full),
        (2, 1, "2", full),
        (3, 1, "2", "0"),
        (4, 1, "2", "0"),
        (5, 2, "3", f"({full} >> 1)"),
        (6, 2, "0", "5"),
    ]
    return " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS rule_id, c.cls, {a}::BIGINT AS r0, ({b})::BIGINT AS r1 FROM dom CROSS JOIN cpos c WHERE c.pos = {k}"
        for i, k, a, b in rows
    )


CPOS = ("cpos", "SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS pos FROM classes")


def _edge_ctes(with_pairs=True):
    b = ORDERS
    parts = [*q.enc_ctes(b), *q.pair_ctes(b, "pairs"), CPOS]
    body = _edge_select()
    if with_pairs:
        body += " UNION ALL SELECT rule_id + 7, cls, r0, r1 FROM pairs"
    return [*parts, ("rules", body), *q.norm_ctes(b)]


def _pair_counts(b):
    return [*q.enc_ctes(b), q.sig_cte(b), *q.pair_ctes(b), *q.norm_ctes(b), *q.count_ctes(b)]


def _single_counts(b):
    return [*q.enc_ctes(b), q.sig_cte(b), *q.single_ctes(b), *q.norm_ctes(b), *q.count_ctes(b)]


def _pair_scored(b, names=TRADE_OFF):
    return [*_pair_counts(b), q.scored_cte(dict.fromkeys([*names, "WRAccNorm"]))]


def _rule_items():
    b = ORDERS
    parts = [
        f"SELECT q.rule_id, q.cls, f.var, f.val::INTEGER AS val FROM norm q JOIN feat f ON f.var = {i} "
        f"AND (q.r{i} >> f.val::BIGINT) & 1 = 1"
        for i in range(2)
    ]
    return cte(*q.enc_ctes(b), *q.pair_ctes(b), *q.norm_ctes(b)) + " UNION ALL ".join(parts)


def _coverage():
    b = ORDERS
    return [*q.enc_ctes(b), *q.pair_ctes(b), *q.norm_ctes(b), ("cover", f"SELECT q.rule_id, e.o_orderkey FROM norm q JOIN enc e ON {q.match_on(b)}")]


def _sets(select):
    a, b = "(m0 & 3) <> 0", "((m0 & 6) <> 0 AND (m1 & 7) <> 0)"
    return cte(*q.enc_ctes(ORDERS)) + f"SELECT o_orderkey FROM enc WHERE {select.format(a=a, b=b)}"


NARROW = "NOT ((m0 & 2) <> 0 AND (m1 & 1) <> 0) AND (m0 & 1) = 0"


def _covering_pairs():
    b = ORDERS
    first = f"SELECT cls, m0, m1 FROM enc WHERE {NARROW} QUALIFY row_number() OVER (PARTITION BY cls ORDER BY o_orderkey) = 1"
    return cte(*q.enc_ctes(b), q.features_cte(b), ("one", first)) + " UNION ALL ".join(
        f"SELECT e.cls, f.var, f.val::INTEGER AS val FROM one e JOIN feat f ON f.var = {i} AND (e.m{i} >> f.val::BIGINT) & 1 = 1"
        for i in range(2)
    )


def _cover_flags():
    b = LINES
    singles = q.single_ctes(b)[2][1]
    hit = lambda rules, cls: f"EXISTS (SELECT 1 FROM {rules} q WHERE q.cls = '{cls}' AND {q.match_on(b)})"
    flags = (
        f"SELECT e.cls, e.n, ({hit('singles', 'A')})::INTEGER AS first_kind, ({hit('pairs', 'N')})::INTEGER AS second_kind FROM sig e"
    )
    return cte(*q.enc_ctes(b), q.sig_cte(b), *q.pair_ctes(b, "pairs"), ("singles", singles), ("flags", flags)) + (
        "SELECT cls, first_kind, second_kind, sum(n)::BIGINT AS n_rows FROM flags "
        "WHERE first_kind + second_kind > 0 GROUP BY ALL"
    )


# -- counts -------------------------------------------------------------------------


def _vector_singles():
    """Each feature of each vector element; counted through items, as there are 192 of them."""
    b = VECTORS
    items = " UNION ALL ".join(
        f"SELECT {i} AS var, j AS val, cls FROM enc CROSS JOIN range(3) t(j) WHERE (m{i} >> j) & 1 = 1"
        for i in range(len(b.numeric))
    )
    return cte(
        *q.enc_ctes(b),
        ("items", items),
        ("cov", "SELECT var, val, count(*) AS covered FROM items GROUP BY ALL"),
        ("pos", "SELECT var, val, cls, count(*) AS tp FROM items GROUP BY ALL"),
        ("tot", "SELECT cls, count(*) AS nc FROM enc GROUP BY cls"),
        ("f", f"SELECT v AS var, j AS val FROM range({len(b.numeric)}) a(v) CROSS JOIN range(3) c(j)"),
        ("g", "SELECT f.*, t.cls, t.nc, row_number() OVER (ORDER BY f.var, f.val, t.cls) - 1 AS rule_id FROM f CROSS JOIN tot t"),
    ) + (
        "SELECT rule_id, cls, coalesce(tp, 0) AS tp, coalesce(covered, 0) - coalesce(tp, 0) AS fp, "
        "((SELECT sum(nc) FROM tot) - nc - coalesce(covered, 0) + coalesce(tp, 0))::BIGINT AS tn, nc - coalesce(tp, 0) AS fn "
        "FROM g LEFT JOIN cov USING (var, val) LEFT JOIN pos USING (var, val, cls)"
    )


PLAIN = [m for m in MEASURES if m != "GrowthRate"]
GROWTH = "CASE WHEN GrowthRate < 'inf'::DOUBLE THEN round(GrowthRate, 9) END AS GrowthRate"


def _violations():
    b = LINES
    damaged = "SELECT rule_id, CASE WHEN rule_id < 20 THEN -tp - 1 ELSE tp END AS tp, fp, tn, fn FROM ct"
    names = ("TPR", "Confidence", "Support")
    bad = " UNION ALL ".join(
        f"SELECT rule_id, '{m}' AS measure, round({m}, 9) AS value FROM s WHERE isnan({m}) OR {m} < -1e-13 OR {m} > 1"
        for m in names
    )
    return cte(*_pair_counts(b), ("d", damaged), q.scored_cte(names, "d", "s")) + (
        f"SELECT rule_id, 'counts' AS measure, NULL::DOUBLE AS value FROM s WHERE tp < 0 OR fp < 0 OR tn < 0 OR fn < 0 UNION ALL {bad}"
    )


# -- reports --------------------------------------------------------------------------


def _rules_text():
    label = lambda j, shape, pts: (
        f"SELECT 0 AS var, {j} AS val, 'Label {j}: ' || printf('{shape}({', '.join(['%.6f'] * len(pts))})', {', '.join(pts)}) AS t FROM pts"
    )
    texts = " UNION ALL ".join(
        [
            label(0, "DecreasingLine", ("p0_0", "p0_1")),
            label(1, "Triangular", ("p0_0", "p0_1", "p0_2")),
            label(2, "IncreasingLine", ("p0_1", "p0_2")),
            "SELECT 1, (unnest(range(len(dom0))))::INTEGER, unnest(dom0) FROM dom",
        ]
    )
    items = " UNION ALL ".join(
        f"SELECT q.rule_id, t.var, t.val, t.t FROM norm q JOIN texts t ON t.var = {i} AND (q.r{i} >> t.val::BIGINT) & 1 = 1"
        for i in range(2)
    )
    line = "chr(9) || 'Variable ' || CASE WHEN var = 0 THEN 'o_totalprice' ELSE 'o_orderpriority' END || ' = ' || string_agg(t || '  ', '' ORDER BY val)"
    return cte(
        *_edge_ctes(),
        ("texts", texts),
        ("items", items),
        ("lines", f"SELECT rule_id, var, {line} AS line FROM items GROUP BY rule_id, var"),
        ("body", "SELECT rule_id, string_agg(line || chr(10), '' ORDER BY var) AS body FROM lines GROUP BY rule_id"),
    ) + "SELECT r.rule_id, r.cls, coalesce(body, '') || 'Consequent: ' || r.cls AS rule_text FROM rules r LEFT JOIN body USING (rule_id)"


SHORT = {
    "AUC": "AUC", "Accuracy": "Acc", "Confidence": "CONF", "Coverage": "Cov", "FPR": "FPR", "GMean": "G-Mean",
    "GrowthRate": "GR", "IsGrowthRate": "GR_Pct", "Jaccard": "Jacc", "SuppDiff": "SuppDiff", "Support": "Supp",
    "TNR": "TNR", "TPR": "TPR", "WRAcc": "WRAcc", "WRAccNorm": "WRAcc_Norm",
}


def six(x):
    # Nine places first and no negative zero: the sign of a noise zero depends on summing order.
    return f"CASE WHEN {x} = 'inf'::DOUBLE THEN 'INFINITY' WHEN isnan({x}) THEN 'NaN' ELSE printf('%.6f', round({x}, 9) + 0::DOUBLE) END"


def rule_key(n):
    return "md5(concat_ws('|', cls, " + ", ".join(f"r{i}" for i in range(n)) + "))"


def _training_report():
    return cte(*_pair_scored(ORDERS, ("Confidence", "Support"))) + (
        f"SELECT (row_number() OVER (ORDER BY cls, rule_id) - 1)::INTEGER AS Rule, {rule_key(2)} AS ID, cls AS Consequent, "
        f"{six('Confidence')} AS CONF, {six('Support')} AS Supp FROM scored"
    )


def _test_report():
    b = DOCUMENTS
    per = ", ".join(f"{six(m)} AS \"{s}\"" for m, s in SHORT.items())
    mean = ", ".join(f"{six(f'avg({m})')} AS \"{s}\"" for m, s in SHORT.items())
    return cte(*_single_counts(b), q.scored_cte(SHORT)) + (
        f"SELECT (row_number() OVER (ORDER BY cls, rule_id) - 1)::VARCHAR AS Rule, cls AS Class, {rule_key(3)} AS ID, "
        f"'------' AS NumRules, {six('num_vars::DOUBLE')} AS NumVars, tp::VARCHAR AS TP, fp::VARCHAR AS FP, tn::VARCHAR AS TN, "
        f"fn::VARCHAR AS FN, {per} FROM scored UNION ALL "
        f"SELECT '------', '------', '------', {six('count(*)::DOUBLE')}, {six('avg(num_vars)')}, '------', '------', '------', '------', {mean} FROM scored"
    )


# -- ranking ----------------------------------------------------------------------------


def _front(names, sense=None):
    src = "scored"
    extra = []
    objs = names
    if sense:
        extra = [("turned", f"SELECT *, {', '.join(f'{e} AS g{i}' for i, e in enumerate(sense))} FROM scored")]
        src, objs = "turned", [f"g{i}" for i in range(len(sense))]
    return cte(*_pair_scored(LINES, names), *extra) + (
        f"SELECT rule_id, cls, {r9(*names)} FROM {src} b WHERE NOT EXISTS "
        f"(SELECT 1 FROM {src} a WHERE a.cls = b.cls AND {q.better(objs)})"
    )


def _rank_ctes(src="scored", out="ranked", objs=TRADE_OFF):
    """Front number = length of the longest chain of dominating vectors."""
    o = ", ".join(f"round({x}, 12) AS {x}" for x in objs)
    return [
        (f"{out}_pts", f"SELECT DISTINCT cls, {o} FROM {src}"),
        (
            f"{out}_chain",
            f"SELECT cls, {', '.join(objs)}, 0 AS depth FROM {out}_pts UNION "
            f"SELECT b.cls, {', '.join('b.' + x for x in objs)}, a.depth + 1 FROM {out}_chain a JOIN {out}_pts b ON a.cls = b.cls AND {q.better(objs)}",
        ),
        (f"{out}_top", f"SELECT cls, {', '.join(objs)}, max(depth)::INTEGER AS rank FROM {out}_chain GROUP BY ALL"),
        (
            out,
            f"SELECT s.*, t.rank FROM {src} s JOIN {out}_top t ON s.cls = t.cls AND "
            + " AND ".join(f"round(s.{x}, 12) = t.{x}" for x in objs),
        ),
    ]


def rcte(*parts):
    return cte(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _crowd_ctes(src="ranked", out="crowded", objs=TRADE_OFF):
    terms = []
    for o in objs:
        w = f"OVER (PARTITION BY cls, rank ORDER BY {o}, rule_id)"
        f = "OVER (PARTITION BY cls, rank)"
        spread = f"(max({o}) {f} - min({o}) {f})"
        gap = f"(lead({o}) {w} - lag({o}) {w})"
        terms.append(
            f"CASE WHEN lag({o}) {w} IS NULL OR lead({o}) {w} IS NULL THEN 'inf'::DOUBLE "
            f"WHEN {spread} > 0 THEN {gap} / {spread} ELSE 0::DOUBLE END"
        )
    return [(out, f"SELECT *, {' + '.join(terms)} AS crowding FROM {src}")]


def _top_ctes(k, src="crowded", out="pop", rounded=True):
    c = "CASE WHEN crowding < 'inf'::DOUBLE THEN round(crowding, 9) ELSE crowding END" if rounded else "crowding"
    return [
        (f"{out}_all", f"SELECT * EXCLUDE (crowding), {c} AS crowding FROM {src}"),
        (
            out,
            f"SELECT *, row_number() OVER (PARTITION BY cls ORDER BY rank, crowding DESC, rule_id)::INTEGER AS slot FROM {out}_all "
            f"QUALIFY slot <= {k}",
        ),
    ]


def _population():
    return [*_pair_scored(LINES), *_rank_ctes(), *_crowd_ctes(), *_top_ctes(30)]


def _duel(parent, draws="draws", out="won"):
    """Winner of two drawn slots: strictly better rank, then crowding, else the first drawn."""
    slot = lambda s: q.pick("size", f"'{SEED}'", "'1'", "'tournament'", "d.cls", "d.draw", f"'{parent}'", f"'{s}'") + " + 1"
    wins = "(b.rank < a.rank OR (b.rank = a.rank AND b.crowding > a.crowding))"
    words = ", ".join(f"CASE WHEN {wins} THEN b.r{i} ELSE a.r{i} END AS p{parent}_{i}" for i in range(5))
    return [
        (f"{out}_d", f"SELECT d.*, {slot('a')} AS sa, {slot('b')} AS sb FROM {draws} d"),
        (
            out,
            f"SELECT d.* EXCLUDE (sa, sb), CASE WHEN {wins} THEN b.rule_id ELSE a.rule_id END AS p{parent}_rule_id, {words} FROM {out}_d d "
            f"JOIN pop a ON a.cls = d.cls AND a.slot = d.sa JOIN pop b ON b.cls = d.cls AND b.slot = d.sb",
        ),
    ]


def _token_order(src="scored", out="ordered"):
    return (
        out,
        f"SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(WRAccNorm, 12) DESC, num_active, rule_id) AS token_rank FROM {src}",
    )


def _token(b):
    first = f"SELECT e.rowid_, e.cls, min(q.token_rank) AS token_rank FROM ordered q JOIN rowed e ON e.cls = q.cls AND {q.match_on(b)} GROUP BY ALL"
    return cte(
        *_pair_scored(b),
        _token_order(),
        ("rowed", "SELECT *, row_number() OVER () AS rowid_ FROM sig"),
        ("firsts", first),
        ("winners", "SELECT DISTINCT cls, token_rank FROM firsts"),
    ) + (
        f"SELECT rule_id, cls, {COUNTS} FROM ordered o WHERE EXISTS (SELECT 1 FROM winners w WHERE w.cls = o.cls AND w.token_rank = o.token_rank) "
        "OR (token_rank = 1 AND NOT EXISTS (SELECT 1 FROM winners w WHERE w.cls = o.cls))"
    )


def _filter(cond):
    order = "(CASE WHEN ok THEN 1 ELSE 0 END) DESC, Confidence DESC, round(WRAccNorm, 12) DESC, num_active, rule_id"
    return cte(
        *_pair_scored(LINES, ("Confidence", "TPR", "Support")),
        ("t", f"SELECT *, {cond} AS ok FROM scored"),
        ("u", f"SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {order}) AS nth FROM t"),
    ) + f"SELECT rule_id, cls, {COUNTS} FROM u WHERE ok OR nth = 1"


def _better_set():
    b = LINES
    parts = [
        *q.enc_ctes(b), q.sig_cte(b), *q.pair_ctes(b, "pairs"),
        ("singles", q.single_ctes(b)[2][1]),
        *q.norm_ctes(b, "pairs", "npairs"),
        ("nsingles", q.norm_ctes(b, "singles", "x")[1][1]),
        *q.count_ctes(b, "nsingles", "ca"), *q.count_ctes(b, "npairs", "cb"),
        q.scored_cte(["WRAccNorm"], "ca", "sa"), q.scored_cte(["WRAccNorm"], "cb", "sb"),
        ("ma", "SELECT cls, round(avg(WRAccNorm), 12) AS m, count(*) AS n FROM sa GROUP BY cls"),
        ("mb", "SELECT cls, round(avg(WRAccNorm), 12) AS m, count(*) AS n FROM sb GROUP BY cls"),
        ("pick", "SELECT cls, (mb.m > ma.m OR (mb.m = ma.m AND mb.n < ma.n)) AS second FROM ma JOIN mb USING (cls)"),
    ]
    return cte(*parts) + (
        f"SELECT rule_id, cls, {COUNTS} FROM sa JOIN pick USING (cls) WHERE NOT second UNION ALL "
        f"SELECT rule_id, cls, {COUNTS} FROM sb JOIN pick USING (cls) WHERE second"
    )


def _elite_and_pairs():
    """``sa``: one-feature rules numbered from 100,000; ``sb``: the pairs; both scored."""
    b = LINES
    names = [*TRADE_OFF, "WRAccNorm"]
    return [
        *q.enc_ctes(b), q.sig_cte(b), *q.pair_ctes(b, "pairs"),
        ("singles", f"SELECT * REPLACE (rule_id + 100000 AS rule_id) FROM ({q.single_ctes(b)[2][1]})"),
        *q.norm_ctes(b, "pairs", "npairs"),
        ("nsingles", q.norm_ctes(b, "singles", "x")[1][1]),
        *q.count_ctes(b, "nsingles", "ca"), *q.count_ctes(b, "npairs", "cb"),
        q.scored_cte(names, "ca", "sa"), q.scored_cte(names, "cb", "sb"),
    ]


def _pick(current, challenger):
    """``chosen``: per class the set with the higher mean WRAccNorm, then the smaller, then the current."""
    return [
        ("ma", f"SELECT cls, round(avg(WRAccNorm), 12) AS m, count(*) AS n FROM {current} GROUP BY cls"),
        ("mb", f"SELECT cls, round(avg(WRAccNorm), 12) AS m, count(*) AS n FROM {challenger} GROUP BY cls"),
        ("pick", "SELECT cls, coalesce(mb.m > ma.m OR (mb.m = ma.m AND mb.n < ma.n), ma.m IS NULL) AS second FROM ma FULL JOIN mb USING (cls)"),
        (
            "chosen",
            f"SELECT s.* FROM {current} s JOIN pick USING (cls) WHERE NOT second UNION ALL BY NAME "
            f"SELECT s.* FROM {challenger} s JOIN pick USING (cls) WHERE second",
        ),
    ]


def _update_elite():
    return cte(*_elite_and_pairs(), ("mine", "SELECT * FROM sb WHERE cls IN ('A', 'N')"), *_pick("sa", "mine")) + (
        f"SELECT rule_id, cls, {COUNTS} FROM chosen"
    )


def _finalise():
    beaten = lambda t: f"EXISTS (SELECT 1 FROM {t} a WHERE a.cls = b.cls AND {q.better(TRADE_OFF)})"
    hit = f"SELECT e.rowid_, e.cls, min(q.token_rank) AS token_rank FROM ordered q JOIN rowed e ON e.cls = q.cls AND {q.match_on(LINES)} GROUP BY ALL"
    order = "(CASE WHEN ok THEN 1 ELSE 0 END) DESC, Confidence DESC, round(WRAccNorm, 12) DESC, num_active, rule_id"
    parts = [
        *_elite_and_pairs(),
        *_rank_ctes("sb"),
        *_crowd_ctes(),
        *_top_ctes(30),
        ("front", f"SELECT * FROM pop b WHERE NOT {beaten('pop')}"),
        ("joint", "SELECT * EXCLUDE (rank, crowding, slot) FROM front UNION ALL BY NAME SELECT * FROM sa"),
        _token_order("joint"),
        ("rowed", "SELECT *, row_number() OVER () AS rowid_ FROM sig"),
        ("firsts", hit),
        ("kept", "SELECT * FROM ordered WHERE (cls, token_rank) IN (SELECT cls, token_rank FROM firsts)"),
        ("competitors", f"SELECT * EXCLUDE (token_rank) FROM kept b WHERE NOT {beaten('kept')}"),
        *_pick("sa", "competitors"),
        ("t", "SELECT *, Confidence >= 0.334::DOUBLE AS ok FROM chosen"),
        ("u", f"SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {order}) AS nth FROM t"),
    ]
    return rcte(*parts) + f"SELECT rule_id, cls, {COUNTS} FROM u WHERE ok OR nth = 1"


def _reinitialise():
    b = ORDERS
    beaten = f"EXISTS (SELECT 1 FROM kept a WHERE a.cls = b.cls AND {q.better(TRADE_OFF)})"
    hit = f"SELECT e.rowid_, e.cls, min(q.token_rank) AS token_rank FROM ordered q JOIN rowed e ON e.cls = q.cls AND {q.match_on(b)} GROUP BY ALL"
    covered = f"EXISTS (SELECT 1 FROM competitors q WHERE q.cls = e.cls AND {q.match_on(b)})"
    pairs = " UNION ALL ".join(
        f"SELECT e.cls, f.var, f.val FROM one e JOIN feat f ON f.var = {i} AND (e.m{i} >> f.val::BIGINT) & 1 = 1" for i in range(2)
    )
    k = q.pick("least(ceil(total * 0.5)::INTEGER + 1, total)", f"'{SEED}'", "'1'", "'covering_n'", "rule_id") + " + 1"
    uu = q.u(f"'{SEED}'", "'1'", "'covering_pair'", "rule_id", "var", "val")
    words = ", ".join(
        f"coalesce((SELECT max_by(1::BIGINT << d.val::BIGINT, d.nth) FROM drawn d WHERE d.rule_id = t.rule_id AND d.var = {w}), 0)::BIGINT AS r{w}"
        for w in range(2)
    )
    parts = [
        *_pair_scored(b), *_rank_ctes(), *_crowd_ctes(), *_top_ctes(10),
        (
            "joint",
            "SELECT * EXCLUDE (rank, crowding, slot) FROM pop WHERE rank = 0 AND cls IN ('F', 'P') "
            "UNION BY NAME SELECT * FROM scored WHERE rule_id < 30 AND cls IN ('F', 'P')",
        ),
        _token_order("joint"),
        ("rowed", "SELECT *, row_number() OVER () AS rowid_ FROM sig"),
        ("firsts", hit),
        ("kept", "SELECT * FROM ordered WHERE (cls, token_rank) IN (SELECT cls, token_rank FROM firsts)"),
        ("competitors", f"SELECT * FROM kept b WHERE NOT {beaten}"),
        ("one", f"SELECT cls, min_by(m0, o_orderkey) AS m0, min_by(m1, o_orderkey) AS m1 FROM enc e WHERE cls IN ('F', 'P') AND NOT {covered} GROUP BY cls"),
        ("prs", f"SELECT *, count(*) OVER (PARTITION BY cls) AS total FROM ({pairs})"),
        ("ids", "SELECT 1649267441664 + (CASE cls WHEN 'F' THEN 0 ELSE 10 END) + slot AS rule_id, cls FROM pop WHERE cls IN ('F', 'P')"),
        ("pu", f"SELECT rule_id, var, val, total, {uu} AS u FROM ids JOIN prs USING (cls)"),
        ("nth", "SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY u, var, val) AS nth FROM pu"),
        ("drawn", f"SELECT * FROM nth WHERE nth <= {k}"),
        ("fresh", f"SELECT rule_id, cls, {words} FROM ids t"),
        ("nfresh", q.norm_ctes(b, "fresh", "x")[1][1]),
        *q.count_ctes(b, "nfresh", "cf"),
    ]
    return rcte(*parts) + (
        f"SELECT c.rule_id, c.cls, {q.masks_text(2, 'f.r')} AS masks, {', '.join('c.' + x for x in COUNTS.split(', '))} "
        "FROM cf c JOIN fresh f USING (rule_id) UNION ALL "
        f"SELECT rule_id, cls, {q.masks_text(2)} AS masks, {COUNTS} FROM pop WHERE cls NOT IN ('F', 'P')"
    )


# -- candidates ---------------------------------------------------------------------------

S = f"'{SEED}'"


def _made(b, body, extra=(), gen_cls=True):
    """Counts of generated rules; ``body`` selects rule_id, cls, r0.."""
    n = q.n_words(b)
    rules = [("made", body)]
    full = [*q.enc_ctes(b), q.sig_cte(b), q.features_cte(b), q.CLASSES, CPOS, q.sizes_cte(b), *extra, *rules]
    norm = q.norm_ctes(b, "made", "norm")[1]
    return cte(*full, norm, *q.count_ctes(b)) + (
        f"SELECT c.rule_id, c.cls, {q.masks_text(n, 'g.r')} AS masks, {', '.join('c.' + x for x in COUNTS.split(', '))} "
        "FROM ct c JOIN made g USING (rule_id)"
    )


def _full(i):
    return f"((1::BIGINT << z{i}::BIGINT) - 1)"


def _random_body(n, words=5):
    cols = ", ".join(f"{q.bits(S, chr(39) + '0' + chr(39), chr(39) + 'random' + chr(39), 'i', chr(39) + str(w) + chr(39))} & {_full(w)} AS r{w}" for w in range(words))
    return f"SELECT i AS rule_id, cls, {cols} FROM range({n}) t(i) JOIN cpos ON pos = i % (SELECT count(*) FROM cpos) CROSS JOIN sizes"


def _oriented_ctes(n, most, words=5):
    us = " UNION ALL ".join(f"SELECT i, {v} AS v, {q.u(S, chr(39)+'0'+chr(39), chr(39)+'oriented_var'+chr(39), 'i', chr(39)+str(v)+chr(39))} AS u FROM range({n}) t(i)" for v in range(words))
    k = q.pick(most, S, "'0'", "'oriented_n'", "i") + " + 1"
    return [
        ("us", us),
        ("chosen", f"SELECT i, v FROM (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY u, v) AS nth FROM us) WHERE nth <= {k}"),
    ]


def _oriented_body(n, words=5):
    cols = []
    for w in range(words):
        raw = f"({q.bits(S, chr(39)+'0'+chr(39), chr(39)+'oriented_bits'+chr(39), 'i', chr(39)+str(w)+chr(39))} & {_full(w)})"
        fix = f"(1::BIGINT << ({q.pick(f'z{w}', S, chr(39)+'0'+chr(39), chr(39)+'oriented_fix'+chr(39), 'i', chr(39)+str(w)+chr(39))})::BIGINT)"
        used = f"EXISTS (SELECT 1 FROM chosen c WHERE c.i = t.i AND c.v = {w})"
        cols.append(
            f"CASE WHEN NOT {used} THEN 0 WHEN bit_count({raw}) = 0 THEN {raw} | {fix} "
            f"WHEN bit_count({raw}) = z{w} THEN {raw} & ~{fix} ELSE {raw} END::BIGINT AS r{w}"
        )
    return f"SELECT i AS rule_id, cls, {', '.join(cols)} FROM range({n}) t(i) JOIN cpos ON pos = i % (SELECT count(*) FROM cpos) CROSS JOIN sizes"


def _covering():
    n, words = 120, 5
    first = "SELECT * FROM sig WHERE (m0 & 1) = 0 QUALIFY row_number() OVER (PARTITION BY cls ORDER BY m0, m1, m2, m3, m4) = 1"
    pairs = " UNION ALL ".join(
        f"SELECT e.cls, f.var, f.val FROM one e JOIN feat f ON f.var = {i} AND (e.m{i} >> f.val::BIGINT) & 1 = 1" for i in range(words)
    )
    k = q.pick("least(ceil(total * 0.5)::INTEGER + 1, total)", S, "'0'", "'covering_n'", "i") + " + 1"
    uu = q.u(S, "'0'", "'covering_pair'", "i", "var", "val")
    extra = [
        ("one", first),
        ("prs", pairs),
        ("mine", f"SELECT row_number() OVER (ORDER BY cls, i) - 1 AS i, cls FROM classes CROSS JOIN range({n}) t(i)"),
        ("pu", f"SELECT i, var, val, {uu} AS u, count(*) OVER (PARTITION BY i) AS total FROM mine JOIN prs USING (cls)"),
        ("nth", "SELECT *, row_number() OVER (PARTITION BY i ORDER BY u, var, val) AS nth FROM pu"),
        ("drawn", f"SELECT * FROM nth WHERE nth <= {k}"),
    ]
    cols = ", ".join(
        f"coalesce((SELECT max_by(1::BIGINT << d.val::BIGINT, d.nth) FROM drawn d WHERE d.i = t.i AND d.var = {w}), 0)::BIGINT AS r{w}"
        for w in range(words)
    )
    return _made(LINES, f"SELECT i AS rule_id, cls, {cols} FROM mine t WHERE cls IN (SELECT cls FROM one)", extra)


def _lit(x):
    return f"'{x}'"


def _npoint_words(a, b, key, gen="'1'", words=5):
    c = [q.pick(words, S, gen, "'cut'", key, _lit(i)) for i in range(2)]
    first, second = [], []
    for w in range(words):
        swap = f"((CASE WHEN {c[0]} < {w} THEN 1 ELSE 0 END) + (CASE WHEN {c[1]} < {w} AND {c[1]} <> {c[0]} THEN 1 ELSE 0 END)) % 2 = 1"
        first.append(f"CASE WHEN {swap} THEN {b}{w} ELSE {a}{w} END")
        second.append(f"CASE WHEN {swap} THEN {a}{w} ELSE {b}{w} END")
    return first, second


def _hux_words(a, b, key, gen="'1'", words=5):
    moved = [f"(xor({a}{w}, {b}{w}) & {q.bits(S, gen, _lit('hux'), key, _lit(w))})" for w in range(words)]
    return [f"xor({a}{w}, {moved[w]})" for w in range(words)], [f"xor({b}{w}, {moved[w]})" for w in range(words)]


def _mutated_words(a, key, gen="'1'", prob=1.0, words=5):
    hit = f"{q.u(S, gen, _lit('mut'), key)} <= {prob}::DOUBLE"
    var = q.pick(words, S, gen, _lit("mut_var"), key)
    clear = f"{q.u(S, gen, _lit('mut_kind'), key)} < 0.5::DOUBLE"
    return [
        f"CASE WHEN NOT ({hit} AND {var} = {w}) THEN {a}{w} WHEN {clear} THEN 0 "
        f"ELSE xor({a}{w}, {q.bits(S, gen, _lit('mut_bits'), key, _lit(w))} & {_full(w)}) END"
        for w in range(words)
    ]


def _cols(words):
    return ", ".join(f"({x})::BIGINT AS r{i}" for i, x in enumerate(words))


def _pairs_extra():
    b = LINES
    return [("pairs", q.pair_ctes(b, "pairs")[2][1])]


def _couples_extra():
    cols = ", ".join([f"a.r{i} AS a{i}" for i in range(5)] + [f"b.r{i} AS b{i}" for i in range(5)])
    k = "5 * (SELECT count(*) FROM cpos)"
    return [
        *_pairs_extra(),
        ("couples", f"SELECT a.rule_id AS pair_id, a.cls, {cols} FROM pairs a JOIN pairs b ON a.rule_id = b.rule_id - {k}"),
    ]


def _crossed(words):
    one, two = words("a", "b", "pair_id")
    body = (
        f"SELECT pair_id * 2 AS rule_id, cls, {_cols(one)} FROM couples UNION ALL "
        f"SELECT pair_id * 2 + 1, cls, {_cols(two)} FROM couples"
    )
    return _made(LINES, body, _couples_extra())


def _mutate():
    words = _mutated_words("r", "rule_id", prob=0.9)
    return _made(LINES, f"SELECT rule_id, cls, {_cols(words)} FROM pairs CROSS JOIN sizes", _pairs_extra())


def _kids():
    uu = q.u(S, _lit(1), _lit("operator"), "cls", "draw")
    op = f"CASE WHEN {uu} < 0.3::DOUBLE THEN 'hux' WHEN {uu} < (0.3::DOUBLE + 0.3::DOUBLE) THEN 'mutation' ELSE 'npoint' END"
    key = "(cls || ':' || draw)"
    x1, x2 = _npoint_words("p0_", "p1_", key)
    h1, h2 = _hux_words("p0_", "p1_", key)
    m = _mutated_words("p0_", key)
    kid = lambda words, child, cond: f"SELECT cls, draw, {child} AS child, op, {_cols(words)} FROM two CROSS JOIN sizes WHERE {cond}"
    kids = " UNION ALL ".join(
        [
            kid(m, 0, "op = 'mutation'"),
            kid(h1, 0, "op = 'hux'"),
            kid(h2, 1, "op = 'hux'"),
            kid(x1, 0, "op = 'npoint'"),
            kid(x2, 1, "op = 'npoint'"),
        ]
    )
    parts = [
        *_population(),
        ("psize", "SELECT cls, count(*) AS size FROM pop GROUP BY cls"),
        ("dr", "SELECT cls, size, unnest(range(size)) AS draw FROM psize"),
        ("ev", f"SELECT cls, draw, size, {op} AS op FROM dr"),
        (
            "planned",
            "SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN op = 'mutation' THEN 1 ELSE 2 END) OVER "
            "(PARTITION BY cls ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ev) WHERE before < size",
        ),
        *_duel(0, "planned", "one"),
        *_duel(1, "one", "two"),
        ("kids", kids),
        ("nth", "SELECT *, row_number() OVER (ORDER BY cls, draw, child) AS nth FROM kids"),
    ]
    return parts


def _reproduce():
    return rcte(*_kids()) + (
        f"SELECT 1099511627776 + nth AS rule_id, cls, op, {q.masks_text(5)} AS masks FROM nth WHERE nth <= (SELECT count(*) FROM pop)"
    )


CREDITS = ("cr", "SELECT op, count(*) AS credit FROM kids GROUP BY op")
PROBS = ("pr", "SELECT op, credit, greatest(credit, 2)::DOUBLE / (SELECT sum(greatest(credit, 2))::DOUBLE FROM cr) AS prob FROM cr")


def _choose():
    return rcte(
        *_kids(),
        CREDITS,
        PROBS,
        ("wheel", "SELECT op, sum(prob) OVER (ORDER BY op) AS upto FROM pr"),
        ("d", f"SELECT o_orderkey, {q.u(S, _lit(1), _lit('operator'), 'o_orderkey')} AS u FROM orders"),
    ) + (
        "SELECT o_orderkey, coalesce((SELECT min(op) FROM wheel WHERE upto > u), (SELECT max(op) FROM wheel)) AS op FROM d"
    )


def _replace():
    b = LINES
    cols = "rule_id, cls, Confidence, TPR"
    rounded = "rule_id, cls, round(Confidence, 9) AS Confidence, round(TPR, 9) AS TPR"
    norm2 = q.norm_ctes(b, "made", "norm2")[1]
    empty = "num_vars = 0"
    pen = f"SELECT rule_id, cls, CASE WHEN {empty} THEN '-inf'::DOUBLE ELSE Confidence END AS Confidence, CASE WHEN {empty} THEN '-inf'::DOUBLE ELSE TPR END AS TPR FROM kid_s"
    parts = [
        *_population(),
        CPOS,
        *_oriented_ctes(90, 1),
        ("made0", _oriented_body(90)),
        ("made", "SELECT rule_id + 100000 AS rule_id, cls, r0, r1, r2, r3, r4 FROM made0"),
        norm2,
        *q.count_ctes(b, "norm2", "ct2"),
        q.scored_cte(TRADE_OFF, "ct2", "kid_s"),
        ("kid_p", pen),
        ("joint", f"SELECT {rounded} FROM pop UNION ALL SELECT {rounded} FROM (SELECT {cols} FROM kid_p)"),
        *_rank_ctes("joint", "jr"),
        *_crowd_ctes("jr", "jc"),
        *_top_ctes(30, "jc", "jt", rounded=False),
    ]
    return rcte(*parts) + "SELECT cls, rank, slot, Confidence, TPR FROM jt"


def _generation():
    b, words = LINES, "r0, r1, r2, r3, r4"
    kept = f"rule_id, cls, {words}, {COUNTS}"
    bare = lambda m: f"CASE WHEN num_vars = 0 THEN '-inf'::DOUBLE ELSE {m} END AS {m}"
    parts = [
        *_kids(),
        ("made", f"SELECT 1099511627776 + nth AS rule_id, cls, {words} FROM nth WHERE nth <= (SELECT count(*) FROM pop)"),
        q.norm_ctes(b, "made", "norm2")[1],
        *q.count_ctes(b, "norm2", "ct2"),
        q.scored_cte(TRADE_OFF, "ct2", "kid_s"),
        ("joint", f"SELECT {kept}, {', '.join(TRADE_OFF)} FROM pop UNION ALL SELECT {kept}, {', '.join(map(bare, TRADE_OFF))} FROM kid_s"),
        *_rank_ctes("joint", "jr"),
        *_crowd_ctes("jr", "jc"),
        *_top_ctes(30, "jc", "jt", rounded=False),
    ]
    return rcte(*parts) + f"SELECT rule_id, cls, rank, slot, {q.masks_text(5)} AS masks, {COUNTS} FROM jt"


def _own_labels():
    degree = (
        "CASE WHEN x <= {a} OR x >= {z} THEN 0::DOUBLE WHEN x < {m} THEN (x - {a}) * (1::DOUBLE / ({m} - {a})) "
        "WHEN x > {m} THEN ({z} - x) * (1::DOUBLE / ({z} - {m})) ELSE 1::DOUBLE END"
    )
    points = [15_000 * (j // 2) for j in range(30)]
    degrees = ", ".join(degree.format(a=f"{m - 30_000}::DOUBLE", m=f"{m}::DOUBLE", z=f"{m + 30_000}::DOUBLE") + f" AS d{j}" for j, m in enumerate(points))
    top = f"greatest({', '.join(f'd{j}' for j in range(30))}) - 1e-11::DOUBLE"
    bits = " + ".join(f"CASE WHEN d{j} >= {top} THEN {1 << j}::BIGINT ELSE 0 END" for j in range(30))
    return cte(
        ("o", f"SELECT o_orderstatus AS cls, {degrees} FROM (SELECT o_orderstatus, o_totalprice::DOUBLE AS x FROM orders)"),
        ("enc", f"SELECT cls, {bits} AS m0 FROM o"),
        q.CLASSES,
        ("rules", "SELECT row_number() OVER (ORDER BY j, cls) - 1 AS rule_id, cls, (1::BIGINT << j::BIGINT) + (1::BIGINT << (29 - j)::BIGINT) AS r0 FROM range(15) t(j), classes"),
    ) + (
        "SELECT rule_id, r.cls, count(*) FILTER (hit AND e.cls = r.cls) AS tp, count(*) FILTER (hit AND e.cls <> r.cls) AS fp, "
        "count(*) FILTER (NOT hit AND e.cls <> r.cls) AS tn, count(*) FILTER (NOT hit AND e.cls = r.cls) AS fn "
        "FROM rules r, LATERAL (SELECT cls, (m0 & r.r0) <> 0 AS hit FROM enc) e GROUP BY rule_id, r.cls"
    )


def _match_bitmap():
    classes = "(SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS rule_id FROM classes)"
    return cte(*q.enc_ctes(VECTORS), q.CLASSES) + (
        f"SELECT e.vec_id, c.rule_id, c.cls AS rule_cls FROM enc e, {classes} c WHERE (e.m0 & 4) <> 0 AND (e.m40 & 3) <> 0 UNION ALL "
        "SELECT vec_id, (SELECT count(*) FROM classes), (SELECT min(cls) FROM classes) FROM enc WHERE (m63 & 4) <> 0"
    )


def _newly(b, old, now):
    hit = lambda rules: f"EXISTS (SELECT 1 FROM {rules} q WHERE q.cls = c.cls AND {q.match_on(b)})"
    return cte(
        *q.enc_ctes(b), q.sig_cte(b), *q.pair_ctes(b, "pairs"), ("singles", q.single_ctes(b)[2][1]),
        ("old", f"SELECT * FROM pairs WHERE {old}"), ("now", f"SELECT * FROM singles WHERE {now}"),
    ) + (
        f"SELECT c.cls AS rule_cls, sum(e.n)::BIGINT AS n FROM sig e CROSS JOIN classes c WHERE {hit('now')} AND NOT {hit('old')} GROUP BY ALL"
    )


def best_of_all(b, objectives=("WRAccNorm", "SuppDiff")):
    """What a search should find: of all rules there are the front, after token competition, filtered as by default."""
    n = q.n_words(b)
    tables = ", ".join(f"(SELECT unnest(range((1::BIGINT << z{i}::BIGINT) - 1)) AS r{i} FROM sizes)" for i in range(n))
    some = " OR ".join(f"r{i} <> 0" for i in range(n))
    rules = f"SELECT row_number() OVER (ORDER BY cls, {', '.join(f'r{i}' for i in range(n))}) AS rule_id, cls, {', '.join(f'r{i}' for i in range(n))} FROM classes, {tables} WHERE {some}"
    beaten = f"EXISTS (SELECT 1 FROM points a WHERE a.cls = b.cls AND {q.better(objectives)})"
    hit = f"SELECT e.rowid_, e.cls, min(q.token_rank) AS token_rank FROM ordered q JOIN rowed e ON e.cls = q.cls AND {q.match_on(b)} GROUP BY ALL"
    order = "(CASE WHEN ok THEN 1 ELSE 0 END) DESC, Confidence DESC, round(WRAccNorm, 12) DESC, num_active, rule_id"
    return cte(
        *q.enc_ctes(b), q.sig_cte(b), q.CLASSES, q.sizes_cte(b), ("rules", rules), *q.norm_ctes(b)[1:], *q.count_ctes(b),
        q.scored_cte(list(dict.fromkeys([*objectives, "WRAccNorm", "Confidence"]))),
        ("points", f"SELECT DISTINCT cls, {', '.join(objectives)} FROM scored"),
        ("best", f"SELECT * FROM points b WHERE NOT {beaten}"),
        ("front", f"SELECT s.* FROM scored s SEMI JOIN best USING (cls, {', '.join(objectives)})"),
        _token_order("front"),
        ("rowed", "SELECT *, row_number() OVER () AS rowid_ FROM sig"),
        ("firsts", hit),
        ("kept", "SELECT * FROM ordered WHERE (cls, token_rank) IN (SELECT cls, token_rank FROM firsts)"),
        ("t", "SELECT *, Confidence >= 0.6::DOUBLE AS ok FROM kept"),
        ("u", f"SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {order}) AS nth FROM t"),
    ) + f"SELECT cls, {q.masks_text(n)} AS masks, {COUNTS} FROM u WHERE ok OR nth = 1"


# -- applying a model to other rows -----------------------------------------------------------

EARLY = "o_orderdate < TIMESTAMP '1999-01-01'"
LATE = "o_orderdate >= TIMESTAMP '1999-01-01'"


def _holdout_ctes():
    b = ORDERS
    ctes = q.enc_ctes(b, rows="late")
    ctes[0] = ("src", f"{b.sql} WHERE {EARLY}")
    unseen = "CASE WHEN o_orderpriority = '5-LOW' THEN '6-NEW' ELSE o_orderpriority END AS o_orderpriority"
    ctes.insert(0, ("late", f"SELECT * REPLACE ({unseen}) FROM ({b.sql} WHERE {LATE})"))
    rules = [
        q.features_cte(b),
        ("classes", "SELECT DISTINCT o_orderstatus AS cls FROM src"),
        q.pair_ctes(b)[2],
        *q.norm_ctes(b),
    ]
    return [*ctes, q.sig_cte(b), *rules]


ORACLES = {
    "single_patterns": cte(*_single_counts(ORDERS), q.scored_cte(["Confidence", "GrowthRate", "WRAccNorm"]))
    + f"SELECT rule_id, cls, {COUNTS}, {r9('Confidence', 'GrowthRate', 'WRAccNorm')} FROM scored",
    "arff_roundtrip": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents "
    "FROM orders GROUP BY ALL",
    "row_index": "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, o_orderkey FROM orders",
    "profile_numeric": cte(("src", LINES.sql)) + _minmax(LINES),
    "profile_nominal": cte(("src", CUSTOMERS.sql))
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, string_agg(v, ',' ORDER BY v) AS domain, count(*)::INTEGER AS n_values FROM (SELECT DISTINCT {c} AS v FROM src)"
        for c in (*CUSTOMERS.nominal, CUSTOMERS.cls)
    ),
    "feature_count": cte(("src", CUSTOMERS.sql))
    + "SELECT (3 + count(DISTINCT r_name) + count(DISTINCT n_name) + count(DISTINCT c_mktsegment))::BIGINT AS n_features FROM src",
    "row_count": cte(("src", DOCUMENTS.sql)) + "SELECT count(*) AS n_rows FROM src",
    "class_counts": cte(("src", DOCUMENTS.sql)) + "SELECT quality AS cls, count(*) AS n FROM src GROUP BY ALL",
    "fuzzy_labels": _fuzzy_labels(),
    "membership": cte(*q.labels_ctes(ORDERS))
    + "SELECT o_orderkey, "
    + ", ".join(f"round({q.degree(ORDERS, 0, j)}, 9) AS d{j}" for j in range(3))
    + " FROM src CROSS JOIN pts",
    "assign_labels": _enc_query(ORDERS, "o_orderkey, m0 AS labels"),
    "encode_rows": _enc_query(CUSTOMERS, "c_custkey, cls, m0, m1, m2"),
    "encode_long_domain": _enc_query(EVENTS, "event_id, cls, m0, m1, m2, m3", 2),
    "null_wildcard": _enc_query(GAPS, "o_orderkey, cls, m0, m1"),
    "degenerate_columns": cte(*q.enc_ctes(DEGENERATE)) + "SELECT cls, m0, m1, m2, m3, count(*) AS n_rows FROM enc GROUP BY ALL",
    "signatures": cte(*q.enc_ctes(LINES)) + "SELECT cls, m0, m1, m2, m3, m4, count(*) AS n_rows FROM enc GROUP BY ALL",
    "items_long": cte(*q.enc_ctes(ORDERS), q.features_cte(ORDERS)) + _item_rows(ORDERS, "e.o_orderkey, e.cls"),
    "feature_support": cte(*q.enc_ctes(LINES), q.sig_cte(LINES), q.features_cte(LINES), ("i", _item_rows(LINES, "e.cls", "sig")))
    + "SELECT var, val, cls, sum(n)::BIGINT AS n FROM i GROUP BY ALL",
    "feature_bitmaps": _bitmap_counts(),
    "rule_shape": cte(*_edge_ctes()) + "SELECT rule_id, cls, num_vars = 0 AS empty, num_vars, num_active FROM norm",
    "rule_items": _rule_items(),
    "rule_filter": cte(*q.enc_ctes(ORDERS)) + "SELECT o_orderkey, cls AS o_orderstatus FROM enc WHERE (m0 & 5) <> 0 AND (m1 & 3) <> 0",
    "rule_coverage": cte(*_coverage()) + "SELECT rule_id, o_orderkey FROM cover",
    "rule_dedupe": cte(
        *q.enc_ctes(ORDERS), q.sig_cte(ORDERS), q.features_cte(ORDERS), q.CLASSES, CPOS, q.sizes_cte(ORDERS),
        ("made", _random_body(600, 2)), q.norm_ctes(ORDERS, "made", "norm")[1], *q.count_ctes(ORDERS),
        ("one", "SELECT min(rule_id) AS rule_id FROM made GROUP BY cls, r0, r1"),
    )
    + f"SELECT c.rule_id, c.cls, {q.masks_text(2, 'g.r')} AS masks, c.tp, c.fp, c.tn, c.fn FROM ct c JOIN made g USING (rule_id) JOIN one USING (rule_id)",
    "cover_union": _sets("{a} OR {b}"),
    "cover_intersect": _sets("{a} AND {b}"),
    "cover_difference": _sets("{b} AND NOT ({a})"),
    "cover_symdiff": _sets("({a}) <> ({b})"),
    "cover_complement": _sets("NOT ({a})"),
    "cover_count": cte(*q.enc_ctes(CUSTOMERS), *q.single_ctes(CUSTOMERS), *q.norm_ctes(CUSTOMERS))
    + f"SELECT q.rule_id, count(*) AS n FROM norm q JOIN enc e ON {q.match_on(CUSTOMERS)} GROUP BY ALL",
    "covered_rows": cte(*_coverage()) + "SELECT o_orderkey FROM cover WHERE rule_id = 5",
    "first_uncovered": cte(*q.enc_ctes(ORDERS)) + f"SELECT cls, min(CASE WHEN {NARROW} THEN o_orderkey END) AS first_rid FROM enc GROUP BY cls",
    "covering_pairs": _covering_pairs(),
    "cover_flags": _cover_flags(),
    "contingency": cte(*_pair_counts(LINES)) + f"SELECT rule_id, cls, {COUNTS} FROM ct",
    "contingency_joined": cte(*_pair_counts(CUSTOMERS)) + f"SELECT rule_id, cls, {COUNTS} FROM ct",
    "contingency_nulls": cte(*_pair_counts(GAPS)) + f"SELECT rule_id, cls, {COUNTS} FROM ct",
    "contingency_degenerate": cte(
        *[p for p in q.enc_ctes(DEGENERATE)],
        q.sig_cte(DEGENERATE),
        ("feat_all", q.features_cte(DEGENERATE)[1]),
        ("feat", "SELECT * FROM feat_all WHERE var <> 2"),
        q.CLASSES,
        q.pair_ctes(DEGENERATE)[2],
        *q.norm_ctes(DEGENERATE),
        *q.count_ctes(DEGENERATE),
    )
    + f"SELECT rule_id, cls, {COUNTS} FROM ct",
    "contingency_bitmap": _vector_singles(),
    "objectives_penalised": cte(
        *_edge_ctes(False), q.sig_cte(ORDERS), *q.count_ctes(ORDERS), q.scored_cte(["WRAccNorm", "SuppDiff"])
    )
    + "SELECT rule_id, cls, num_vars = 0 AS worst, CASE WHEN num_vars > 0 THEN round(WRAccNorm, 9) END AS WRAccNorm, "
    "CASE WHEN num_vars > 0 THEN round(SuppDiff, 9) END AS SuppDiff FROM scored",
    "measures_all": cte(*_pair_counts(LINES), q.scored_cte(MEASURES)) + f"SELECT rule_id, cls, {COUNTS}, {r9(*PLAIN)}, {GROWTH} FROM scored",
    "measures_edges": cte(*_pair_counts(PLANTED), q.scored_cte(MEASURES))
    + f"SELECT rule_id, cls, {r9(*PLAIN)}, {GROWTH}, GrowthRate = 'inf'::DOUBLE AS pure FROM scored",
    "measure_violations": _violations(),
    "mean_diversity": cte(*_pair_scored(LINES))
    + "SELECT cls, round(avg(WRAccNorm), 9) AS mean_diversity, count(*) AS n_rules FROM scored GROUP BY cls",
    "rules_text": _rules_text(),
    "training_report": _training_report(),
    "test_report": _test_report(),
    "written_rules": f"SELECT (row_number() OVER (ORDER BY cls, rule_id) - 1)::INTEGER AS rule, rule_text FROM ({_rules_text()})",
    "written_training": _training_report(),
    "written_test": _test_report(),
    "pareto_front": _front(TRADE_OFF),
    "pareto_front_three": _front(THREE_WAY),
    "pareto_front_minimise": _front(("TPR", "FPR"), ("TPR", "-FPR")),
    "nondominated_rank": rcte(*_pair_scored(LINES), *_rank_ctes()) + "SELECT rule_id, cls, rank FROM ranked",
    "crowding": rcte(*_pair_scored(LINES), *_rank_ctes(), *_crowd_ctes())
    + "SELECT rule_id, cls, rank, CASE WHEN crowding < 'inf'::DOUBLE THEN round(crowding, 9) END AS crowding FROM crowded",
    "select_top": rcte(*_population()) + "SELECT rule_id, cls, rank, slot FROM pop",
    "tournament": rcte(
        *_population(), ("draws", "SELECT cls, slot - 1 AS draw, 30 AS size FROM pop"), *_duel(0)
    )
    + "SELECT cls, draw, p0_rule_id AS rule_id FROM won",
    "token_competition": _token(LINES),
    "token_competition_bitmap": _token(ORDERS),
    "measure_filter": _filter("Confidence >= 0.336::DOUBLE AND Support >= 0.02::DOUBLE"),
    "measure_filter_fallback": _filter("Confidence >= 0.99::DOUBLE"),
    "better_set": _better_set(),
    "init_random": _made(LINES, _random_body(300)),
    "init_oriented": _made(LINES, _oriented_body(300), _oriented_ctes(300, 3)),
    "init_covering": _covering(),
    "crossover_npoint": _crossed(_npoint_words),
    "crossover_hux": _crossed(_hux_words),
    "mutate": _mutate(),
    "generation": _generation(),
    "nondominated_rank_rows": "SELECT o_orderkey, o_orderstatus AS cls, (dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY round(o_totalprice::DOUBLE, 12) DESC) - 1)::INTEGER AS rank FROM orders",
    "match_bitmap": _match_bitmap(),
    "own_labels": _own_labels(),
    "operator_probs": rcte(*_kids(), CREDITS, PROBS) + "SELECT op, credit, round(prob, 12) AS prob FROM pr",
    "choose_operator": _choose(),
    "reproduce": _reproduce(),
    "replace": _replace(),
    "stagnation": _newly(LINES, "rule_id < 20", "rule_id >= 20"),
    "stagnation_bitmap": _newly(ORDERS, "rule_id < 20", "true"),
    "fit_planted": best_of_all(PLANTED),
    "reinitialise": _reinitialise(),
    "update_elite": _update_elite(),
    "finalise": _finalise(),
    "evaluate_holdout": cte(*_holdout_ctes(), *q.count_ctes(ORDERS), q.scored_cte(["AUC", "Confidence", "WRAccNorm"]))
    + f"SELECT rule_id, cls, {COUNTS}, {r9('AUC', 'Confidence', 'WRAccNorm')} FROM scored",
    "match_rows": cte(*_holdout_ctes())
    + f"SELECT e.o_orderkey, q.rule_id, q.cls AS rule_cls FROM norm q JOIN enc e ON {q.match_on(ORDERS)}",
}
