"""Pieces of SQL shared by the plain SQL queries: encoding, rules, matching, hashing."""

from __future__ import annotations

from showcase.bindings import Binding

D = "::DOUBLE"


def cte(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in parts) + "\n"


def labels_ctes(b: Binding) -> list[tuple[str, str]]:
    """``src``, its ranges and the cut points ``p{i}_{j}`` of every numeric column."""
    last = b.n_labels - 1
    rng = ", ".join(f"min({c}){D} AS lo{i}, max({c}){D} AS hi{i}" for i, c in enumerate(b.numeric)) or "count(*) AS one"
    raw, snapped = [], []
    for i in range(len(b.numeric)):
        for j in range(b.n_labels):
            raw.append(f"lo{i} + ((hi{i} - lo{i}) / {last}{D}) * {j}{D} AS q{i}_{j}, hi{i}")
            q = f"q{i}_{j}"
            snapped.append(
                f"CASE WHEN {q} > -1e-4{D} AND {q} < 1e-4{D} THEN 0{D} "
                f"WHEN {q} > hi{i} - 1e-4{D} AND {q} < hi{i} + 1e-4{D} THEN hi{i} ELSE {q} END AS p{i}_{j}"
            )
    # hi columns repeat once per label; keep one of each.
    seen, cols = set(), []
    for text in raw:
        q, hi = text.rsplit(", ", 1)
        cols.append(q)
        if hi not in seen:
            seen.add(hi)
            cols.append(hi)
    return [
        ("src", b.sql),
        ("rng", f"SELECT {rng} FROM src"),
        ("raw", f"SELECT {', '.join(cols) or '1 AS one'} FROM rng"),
        ("pts", f"SELECT {', '.join(snapped) or '1 AS one'} FROM raw"),
    ]


def degree(b: Binding, i: int, j: int) -> str:
    x, p = f"{b.numeric[i]}{D}", lambda k: f"p{i}_{k}"
    if j == 0:
        a, z = p(0), p(1)
        return f"CASE WHEN {x} <= {a} THEN 1{D} WHEN {x} >= {z} THEN 0{D} ELSE ({z} - {x}) * (1{D} / ({z} - {a})) END"
    if j == b.n_labels - 1:
        a, z = p(j - 1), p(j)
        return f"CASE WHEN {x} <= {a} THEN 0{D} WHEN {x} >= {z} THEN 1{D} ELSE ({x} - {a}) * (1{D} / ({z} - {a})) END"
    a, m, z = p(j - 1), p(j), p(j + 1)
    return (
        f"CASE WHEN {x} <= {a} OR {x} >= {z} THEN 0{D} WHEN {x} < {m} THEN ({x} - {a}) * (1{D} / ({m} - {a})) "
        f"WHEN {x} > {m} THEN ({z} - {x}) * (1{D} / ({z} - {m})) ELSE 1{D} END"
    )


def enc_ctes(b: Binding, long_words: int = 1, rows: str = "src") -> list[tuple[str, str]]:
    """... and ``enc(key, cls, m0, m1, ...)``; domains come from ``src``, rows from ``rows``."""
    key = f"{b.key}, " if b.key else ""
    degs = ", ".join(
        f"{degree(b, i, j)} AS d{i}_{j}" for i in range(len(b.numeric)) for j in range(b.n_labels)
    )
    doms = ", ".join(f"list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)) AS dom{k}" for k, c in enumerate(b.nominal)) or "count(*) AS one"
    deg = f"SELECT {rows}.*{', ' + degs if degs else ''} FROM {rows} CROSS JOIN pts"
    masks, word = [], 0
    full = (1 << b.n_labels) - 1
    for i, c in enumerate(b.numeric):
        ds = [f"d{i}_{j}" for j in range(b.n_labels)]
        top = f"greatest({', '.join(ds)}) - 1e-11{D}"
        bits = " + ".join(f"CASE WHEN {d} >= {top} THEN {1 << j} ELSE 0 END" for j, d in enumerate(ds))
        masks.append(
            f"CASE WHEN (SELECT hi{i} FROM rng) IS NULL THEN 0 WHEN {c} IS NULL THEN {full} ELSE {bits} END::BIGINT AS m{word}"
        )
        word += 1
    for k, c in enumerate(b.nominal):
        n = f"len(dom{k})"
        pos = f"(list_position(dom{k}, {c}) - 1)"
        long = c == b.nominal[-1] and long_words > 1
        for w in range(long_words if long else 1):
            # Words of a long domain hold equal shares, the first ones one more.
            parts = long_words if long else 1
            first = f"({n} // {parts} * {w} + least({w}, {n} % {parts}))" if parts > 1 else "0"
            size = f"({n} // {parts} + CASE WHEN {w} < {n} % {parts} THEN 1 ELSE 0 END)" if parts > 1 else n
            masks.append(
                f"CASE WHEN {c} IS NULL THEN (1::BIGINT << ({size})::BIGINT) - 1 "
                f"WHEN {pos} >= {first} AND {pos} < {first} + {size} THEN 1::BIGINT << ({pos} - {first})::BIGINT "
                f"ELSE 0 END::BIGINT AS m{word}"
            )
            word += 1
    return [
        *labels_ctes(b),
        ("dom", f"SELECT {doms} FROM src"),
        ("deg", deg),
        ("enc", f"SELECT {key}{b.cls} AS cls, {', '.join(masks)} FROM deg CROSS JOIN dom"),
    ]


def n_words(b: Binding, long_words: int = 1) -> int:
    return len(b.numeric) + len(b.nominal) + (long_words - 1)


def sig_cte(b: Binding) -> tuple[str, str]:
    ms = ", ".join(f"m{i}" for i in range(n_words(b)))
    return ("sig", f"SELECT cls, {ms}, count(*) AS n FROM enc GROUP BY ALL")


def features_cte(b: Binding) -> tuple[str, str]:
    """``feat(var, val, size)`` over all attributes."""
    parts = [
        f"SELECT {i} AS var, unnest(range({b.n_labels})) AS val, {b.n_labels} AS size" for i in range(len(b.numeric))
    ]
    parts += [
        f"SELECT {len(b.numeric) + k} AS var, unnest(range(len(dom{k}))) AS val, len(dom{k}) AS size FROM dom"
        for k in range(len(b.nominal))
    ]
    return ("feat", "\nUNION ALL ".join(parts))


def masks_of(b: Binding, *terms: tuple[str, str]) -> str:
    """Columns r0.. of a rule holding one value of each given (variable, value)."""
    cols = []
    for i in range(n_words(b)):
        hits = " ".join(f"WHEN {v} = {i} THEN 1::BIGINT << {j}::BIGINT" for v, j in terms)
        cols.append(f"CASE {hits} ELSE 0 END::BIGINT AS r{i}")
    return ", ".join(cols)


CLASSES = ("classes", "SELECT DISTINCT cls FROM enc WHERE cls IS NOT NULL")


def single_ctes(b: Binding) -> list[tuple[str, str]]:
    return [
        features_cte(b),
        CLASSES,
        (
            "rules",
            f"SELECT row_number() OVER (ORDER BY var, val, cls) - 1 AS rule_id, cls, {masks_of(b, ('var', 'val'))} "
            "FROM feat CROSS JOIN classes",
        ),
    ]


def pair_ctes(b: Binding, name: str = "rules") -> list[tuple[str, str]]:
    body = (
        "SELECT row_number() OVER (ORDER BY f.var, f.val, g.var, g.val, cls) - 1 AS rule_id, cls, "
        f"{masks_of(b, ('f.var', 'f.val'), ('g.var', 'g.val'))} "
        "FROM feat f JOIN feat g ON f.var < g.var CROSS JOIN classes"
    )
    return [features_cte(b), CLASSES, (name, body)]


def sizes(b: Binding) -> list[str]:
    return [f"(SELECT coalesce(max(size), 0) FROM feat WHERE var = {i})" for i in range(n_words(b))]


def sizes_cte(b: Binding) -> tuple[str, str]:
    cols = [
        f"(CASE WHEN (SELECT hi{i} FROM rng) IS NULL THEN 0 ELSE {b.n_labels} END) AS z{i}" for i in range(len(b.numeric))
    ]
    cols += [f"len(dom{k}) AS z{len(b.numeric) + k}" for k in range(len(b.nominal))]
    return ("sizes", f"SELECT {', '.join(cols)} FROM dom")


def norm_ctes(b: Binding, src: str = "rules", out: str = "norm") -> list[tuple[str, str]]:
    """Rules with words of non-participating variables set to zero, and their shape."""
    n = n_words(b)
    pop = [f"bit_count(r{i})" for i in range(n)]
    part = [f"({pop[i]} > 0 AND {pop[i]} < z{i})" for i in range(n)]
    words = ", ".join(f"CASE WHEN {part[i]} THEN r{i} ELSE 0 END AS r{i}" for i in range(n))
    num = " + ".join(f"CASE WHEN {part[i]} THEN 1 ELSE 0 END" for i in range(n))
    act = " + ".join(f"CASE WHEN {part[i]} THEN {pop[i]} ELSE 0 END" for i in range(n))
    rest = f"{src}.* EXCLUDE ({', '.join(f'r{i}' for i in range(n))})"
    return [
        sizes_cte(b),
        (out, f"SELECT {rest}, {words}, ({num})::INTEGER AS num_vars, ({act})::INTEGER AS num_active FROM {src} CROSS JOIN sizes"),
    ]


def match_on(b: Binding, row: str = "e", rule: str = "q") -> str:
    """Row covered by normalised, non-empty rule."""
    n = n_words(b)
    some = " OR ".join(f"{rule}.r{i} <> 0" for i in range(n))
    each = " AND ".join(f"({rule}.r{i} = 0 OR ({row}.m{i} & {rule}.r{i}) <> 0)" for i in range(n))
    return f"({some}) AND {each}"


def count_ctes(b: Binding, rules: str = "norm", out: str = "ct", rows: str = "sig") -> list[tuple[str, str]]:
    """Rules with tp, fp, tn, fn."""
    return [
        (
            f"{out}_hit",
            f"SELECT q.rule_id, q.cls, sum(e.n) AS covered, sum(CASE WHEN e.cls = q.cls THEN e.n ELSE 0 END) AS tp "
            f"FROM {rules} q JOIN {rows} e ON {match_on(b)} GROUP BY ALL",
        ),
        (f"{out}_tot", f"SELECT cls, sum(n) AS nc FROM {rows} GROUP BY cls"),
        (
            out,
            "SELECT q.*, coalesce(h.tp, 0)::BIGINT AS tp, (coalesce(h.covered, 0) - coalesce(h.tp, 0))::BIGINT AS fp, "
            f"((SELECT sum(nc) FROM {out}_tot) - coalesce(t.nc, 0) - coalesce(h.covered, 0) + coalesce(h.tp, 0))::BIGINT AS tn, "
            "(coalesce(t.nc, 0) - coalesce(h.tp, 0))::BIGINT AS fn "
            f"FROM {rules} q LEFT JOIN {out}_hit h USING (rule_id, cls) LEFT JOIN {out}_tot t ON q.cls = t.cls",
        ),
    ]


def _r(num: str, den: str, zero: str = "0") -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN ({num}){D} / ({den}){D} ELSE {zero}{D} END)"


TPR, FPR, TNR = _r("tp", "tp + fn"), _r("fp", "fp + tn", "1"), _r("tn", "fp + tn")
CONF, COV = _r("tp", "tp + fp"), _r("tp + fp", "tp + fp + tn + fn")
SHARE = _r("tp + fn", "tp + fp + tn + fn")
WRACC = f"({COV} * ({CONF} - {SHARE}))"
LO, HI = f"((1{D} - {SHARE}) * (0{D} - {SHARE}))", f"({SHARE} * (1{D} - {SHARE}))"
MEASURES = {
    "AUC": f"((1{D} + {TPR} - {FPR}) / 2{D})",
    "Accuracy": _r("tp + tn", "tp + fp + tn + fn"),
    "Confidence": CONF,
    "Coverage": COV,
    "FPR": FPR,
    "GMean": f"sqrt({TPR} * {TNR})",
    "GrowthRate": f"(CASE WHEN {FPR} <> 0 THEN {TPR} / {FPR} WHEN {TPR} = 0 THEN 0{D} ELSE 'inf'{D} END)",
    "InverseFPR": f"(1{D} - {FPR})",
    "IsGrowthRate": f"(CASE WHEN {TPR} > {FPR} THEN 1{D} ELSE 0{D} END)",
    "Jaccard": _r("tp", "tp + fn + fp"),
    "SuppDiff": f"({TPR} - {FPR})",
    "Support": _r("tp", "tp + fp + tn + fn"),
    "TNR": TNR,
    "TPR": TPR,
    "WRAcc": WRACC,
    "WRAccNorm": f"(CASE WHEN {HI} - {LO} <> 0 THEN ({WRACC} - {LO}) / ({HI} - {LO}) ELSE 0{D} END)",
}


def scored_cte(names, src: str = "ct", out: str = "scored") -> tuple[str, str]:
    return (out, f"SELECT {src}.*, {', '.join(f'{MEASURES[m]} AS {m}' for m in names)} FROM {src}")


def masks_text(n: int, prefix: str = "r") -> str:
    return "concat_ws(',', " + ", ".join(f"{prefix}{i}" for i in range(n)) + ")"


# -- counter hashes ----------------------------------------------------------


def _key(parts) -> str:
    return "md5(concat_ws('|', " + ", ".join(p if isinstance(p, str) else f"'{p}'" for p in parts) + "))"


def u(*parts) -> str:
    return f"(('0x' || substr({_key(parts)}, 1, 8))::BIGINT / 4294967296{D})"


def pick(n, *parts) -> str:
    return f"floor({u(*parts)} * {n})::INTEGER"


def bits(*parts) -> str:
    return f"('0x' || substr({_key(parts)}, 1, 15))::BIGINT"


def better(objs, a: str = "a", b: str = "b") -> str:
    """a dominates b, values rounded to twelve decimals."""
    no_worse = " AND ".join(f"round({a}.{o}, 12) >= round({b}.{o}, 12)" for o in objs)
    some = " OR ".join(f"round({a}.{o}, 12) > round({b}.{o}, 12)" for o in objs)
    return f"({no_worse}) AND ({some})"
