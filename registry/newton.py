"""DuckDB SQL that fits models by unrolled Newton steps over aggregated cells.

Each generator takes a CTE body giving cells with a key column ``k``, covariates
``x1..xp`` and a multiplicity ``n``, and returns CTEs ending in one row per key with
coefficients ``b1..``, the inverse information ``v_i_j`` and the log-likelihood ``ll``.
"""

from __future__ import annotations


def _jordan(src: str, size: int, out: str, keep: str) -> str:
    """CTEs that solve h * d = u and invert h by elimination without pivoting."""
    idx = range(1, size + 1)
    ctes = []
    cols = ([f"h_{i}_{j} AS a_{i}_{j}" for i in idx for j in idx]
            + [f"u_{i} AS a_{i}_{size + 1}" for i in idx]
            + [f"{1.0 if i == j else 0.0}::DOUBLE AS a_{i}_{size + 1 + j}" for i in idx for j in idx])
    ctes.append(f"{out}_0 AS (SELECT {keep}, {', '.join(cols)} FROM {src})")
    width = range(1, 2 * size + 2)
    for p in idx:
        cells = []
        for i in idx:
            for j in width:
                pivot = f"a_{p}_{j} / a_{p}_{p}"
                cells.append(f"{pivot} AS a_{i}_{j}" if i == p
                             else f"a_{i}_{j} - a_{i}_{p} * {pivot} AS a_{i}_{j}")
        ctes.append(f"{out}_{p} AS (SELECT {keep}, {', '.join(cells)} FROM {out}_{p - 1})")
    cols = ([f"a_{i}_{size + 1} AS d_{i}" for i in idx]
            + [f"a_{i}_{size + 1 + j} AS v_{i}_{j}" for i in idx for j in idx])
    ctes.append(f"{out} AS (SELECT {keep}, {', '.join(cols)} FROM {out}_{size})")
    return ",\n".join(ctes)


def cox_ctes(cells: str, p: int, name: str = "fit", steps: int = 6, efron: bool = True) -> str:
    """``cells``: (k, t, e, n, x1..xp). Result CTE ``name``: k, b1..bp, v_i_j, ll, ll0."""
    idx = range(1, p + 1)
    pairs = [(i, j) for i in idx for j in idx if i <= j]
    c = f"{name}_c"
    ctes = [f"{c} AS MATERIALIZED ({cells})"]
    beta = f"{name}_b0"
    ctes.append(f"{beta} AS (SELECT DISTINCT k, {', '.join(f'0.0::DOUBLE AS b{i}' for i in idx)} FROM {c})")
    for s in range(steps + 1):
        q = f"{name}_{s}"
        eta = " + ".join(f"b{i} * x{i}" for i in idx)
        moments = (["sum(n * w) AS s0", "sum(n * w * e) AS q0", "sum(n * e) AS d", f"sum(n * e * eta) AS ee"]
                   + [f"sum(n * w * x{i}) AS s_{i}, sum(n * w * e * x{i}) AS q_{i}, sum(n * e * x{i}) AS e_{i}"
                      for i in idx]
                   + [f"sum(n * w * x{i} * x{j}) AS s_{i}_{j}, sum(n * w * e * x{i} * x{j}) AS q_{i}_{j}"
                      for i, j in pairs])
        ctes.append(f"{q}_w AS (SELECT *, exp(eta) AS w FROM (SELECT {c}.*, {eta} AS eta FROM {c} JOIN {beta} USING (k)))")
        ctes.append(f"{q}_t AS (SELECT k, t, {', '.join(moments)} FROM {q}_w GROUP BY k, t)")
        run = ["s0"] + [f"s_{i}" for i in idx] + [f"s_{i}_{j}" for i, j in pairs]
        win = "OVER (PARTITION BY k ORDER BY t DESC ROWS UNBOUNDED PRECEDING)"
        rest = ["q0", "d", "ee"] + [f"q_{i}, e_{i}" for i in idx] + [f"q_{i}_{j}" for i, j in pairs]
        ctes.append(f"{q}_r AS (SELECT k, t, {', '.join(rest)}, "
                    f"{', '.join(f'sum({x}) {win} AS r{x}' for x in run)} FROM {q}_t)")
        frac = "(l / d)" if efron else "0.0"
        v = f"(rs0 - {frac} * q0)"
        m = {i: f"((rs_{i} - {frac} * q_{i}) / {v})" for i in idx}
        inner = [f"sum(ln({v})) AS lg"] + [f"sum({m[i]}) AS m_{i}" for i in idx] + [
            f"sum((rs_{i}_{j} - {frac} * q_{i}_{j}) / {v} - {m[i]} * {m[j]}) AS h_{i}_{j}" for i, j in pairs]
        ctes.append(f"{q}_e AS (SELECT k, t, {', '.join(inner)} FROM "
                    f"(SELECT *, unnest(range(d::BIGINT))::DOUBLE AS l FROM {q}_r WHERE d > 0) GROUP BY k, t)")
        # a covariate that is zero throughout keeps coefficient 0
        full = [f"sum(h_{min(i, j)}_{max(i, j)})" + (f" + CASE WHEN sum(h_{i}_{i}) = 0 THEN 1 ELSE 0 END" if i == j else "")
                + f" AS h_{i}_{j}" for i in idx for j in idx]
        ctes.append(f"{q}_s AS (SELECT k, sum(ee) - sum(lg) AS ll, "
                    f"{', '.join(f'sum(e_{i}) - sum(m_{i}) AS u_{i}' for i in idx)}, {', '.join(full)} "
                    f"FROM {q}_e JOIN {q}_r USING (k, t) GROUP BY k)")
        ctes.append(_jordan(f"{q}_s", p, f"{q}_j", "k, ll"))
        new = f"{name}_b{s + 1}"
        ctes.append(f"{new} AS MATERIALIZED (SELECT k, {', '.join(f'b{i} + d_{i} AS b{i}' for i in idx)} "
                    f"FROM {beta} JOIN {q}_j USING (k))")
        beta = new
    last = f"{name}_{steps}_j"
    ctes.append(f"{name} AS (SELECT f.k, {', '.join(f'b{i}' for i in idx)}, "
                f"{', '.join(f'f.v_{i}_{j}' for i in idx for j in idx)}, f.ll, z.ll AS ll0 "
                f"FROM {name}_b{steps} b JOIN {last} f USING (k) JOIN {name}_0_j z USING (k))")
    return ",\n".join(ctes)


def logit_ctes(cells: str, p: int, name: str = "fit", steps: int = 7) -> str:
    """``cells``: (k, y, n, x1..xp) with x1 the constant. Result CTE ``name``: k, b1..bp, v_i_j, ll."""
    idx = range(1, p + 1)
    c = f"{name}_c"
    ctes = [f"{c} AS MATERIALIZED ({cells})"]
    beta = f"{name}_b0"
    ctes.append(f"{beta} AS (SELECT DISTINCT k, {', '.join(f'0.0::DOUBLE AS b{i}' for i in idx)} FROM {c})")
    for s in range(steps + 1):
        q = f"{name}_{s}"
        eta = " + ".join(f"b{i} * x{i}" for i in idx)
        sums = [f"sum(n * (y - mu) * x{i}) AS u_{i}" for i in idx] + [
            f"sum(n * mu * (1 - mu) * x{i} * x{j}) AS h_{i}_{j}" for i in idx for j in idx]
        ctes.append(f"{q}_s AS (SELECT k, sum(n * (y * eta - ln(1 + exp(eta)))) AS ll, {', '.join(sums)} FROM "
                    f"(SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (SELECT {c}.*, {eta} AS eta FROM {c} "
                    f"JOIN {beta} USING (k))) GROUP BY k)")
        ctes.append(_jordan(f"{q}_s", p, f"{q}_j", "k, ll"))
        new = f"{name}_b{s + 1}"
        ctes.append(f"{new} AS MATERIALIZED (SELECT k, {', '.join(f'b{i} + d_{i} AS b{i}' for i in idx)} "
                    f"FROM {beta} JOIN {q}_j USING (k))")
        beta = new
    ctes.append(f"{name} AS (SELECT f.k, {', '.join(f'b{i}' for i in idx)}, "
                f"{', '.join(f'v_{i}_{j}' for i in idx for j in idx)}, f.ll "
                f"FROM {name}_b{steps} b JOIN {name}_{steps}_j f USING (k))")
    return ",\n".join(ctes)


def linear_ctes(cells: str, p: int, name: str = "fit") -> str:
    """``cells``: (k, y, n, x1..xp) with x1 the constant. Result: k, b1..bp, v_i_j (times sigma^2), ll, n, sigma2."""
    idx = range(1, p + 1)
    c = f"{name}_c"
    ctes = [f"{c} AS MATERIALIZED ({cells})"]
    sums = [f"sum(n * y * x{i}) AS u_{i}" for i in idx] + [
        f"sum(n * x{i} * x{j}) AS h_{i}_{j}" for i in idx for j in idx]
    ctes.append(f"{name}_s AS (SELECT k, sum(n) AS n, {', '.join(sums)} FROM {c} GROUP BY k)")
    ctes.append(_jordan(f"{name}_s", p, f"{name}_j", "k, n"))
    fitted = " + ".join(f"d_{i} * x{i}" for i in idx)
    ctes.append(f"{name}_r AS (SELECT k, sum({c}.n * (y - ({fitted})) * (y - ({fitted}))) AS rss "
                f"FROM {c} JOIN {name}_j USING (k) GROUP BY k)")
    ctes.append(f"{name} AS (SELECT k, n, rss / (n - {p}) AS sigma2, {', '.join(f'd_{i} AS b{i}' for i in idx)}, "
                f"{', '.join(f'v_{i}_{j} * rss / (n - {p}) AS v_{i}_{j}' for i in idx for j in idx)}, "
                f"-0.5 * n * (ln(2 * pi() * rss / n) + 1) AS ll FROM {name}_j JOIN {name}_r USING (k))")
    return ",\n".join(ctes)


def profile_ctes(cells: str, p: int, j: int, name: str = "prof", steps: int = 7) -> str:
    """Profile-likelihood limits of coefficient ``j`` of a logistic model with one key.

    Newton on (log-likelihood = maximum - 3.84/2, zero score elsewhere), from the Wald
    limits. Result CTE ``name``: side (-1, 1) and bj.
    """
    idx = range(1, p + 1)
    fit = f"{name}_f"
    ctes = [logit_ctes(cells, p, fit)]
    c = f"{fit}_c"
    beta = f"{name}_b0"
    ctes.append(f"{beta} AS (SELECT side, ll - 3.841458820694124 / 2 AS target, "
                + ", ".join(f"b{i} + side * sqrt(3.841458820694124 / v_{j}_{j}) * v_{i}_{j} AS b{i}" for i in idx)
                + f" FROM {fit}, (SELECT unnest([-1.0, 1.0])::DOUBLE AS side))")
    for s in range(steps):
        q = f"{name}_{s}"
        eta = " + ".join(f"b{i} * x{i}" for i in idx)
        sums = [f"sum(n * (y - mu) * x{i}) AS g_{i}" for i in idx] + [
            f"sum(n * mu * (1 - mu) * x{i} * x{k}) AS q_{i}_{k}" for i in idx for k in idx]
        ctes.append(f"{q}_m AS (SELECT side, any_value(target) AS target, sum(n * (y * eta - ln(1 + exp(eta)))) AS ll, "
                    f"{', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (SELECT {c}.*, side, target, "
                    f"{eta} AS eta FROM {c}, {beta})) GROUP BY side)")
        rows = []
        for i in idx:
            rows.append(f"{'target - ll' if i == j else f'-g_{i}'} AS u_{i}")
            rows += [f"{f'g_{k}' if i == j else f'-q_{i}_{k}'} AS h_{i}_{k}" for k in idx]
        ctes.append(f"{q}_s AS (SELECT side, target, {', '.join(rows)} FROM {q}_m)")
        ctes.append(_jordan(f"{q}_s", p, f"{q}_j", "side, target"))
        new = f"{name}_b{s + 1}"
        ctes.append(f"{new} AS MATERIALIZED (SELECT side, {beta}.target, {', '.join(f'b{i} + d_{i} AS b{i}' for i in idx)} "
                    f"FROM {beta} JOIN {q}_j USING (side))")
        beta = new
    ctes.append(f"{name} AS (SELECT side, b{j} FROM {beta})")
    return ",\n".join(ctes)
