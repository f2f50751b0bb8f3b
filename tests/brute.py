"""Plain definitions to compare with, one row at a time where that is clearest."""

import numpy as np


def cox_parts(t, e, x, beta, efron=True, w=None):
    n, p = x.shape
    w = np.ones(n) if w is None else w
    risk = w * np.exp(x @ beta)
    ll, u, h = 0.0, np.zeros(p), np.zeros((p, p))
    for time in np.unique(t[e == 1]):
        at, died = t >= time, (t == time) & (e == 1)
        d = died.sum()
        ll += (w[died] * (x[died] @ beta)).sum()
        u += (w[died][:, None] * x[died]).sum(axis=0)
        mean = w[died].mean()
        for l in range(d):
            f = l / d if efron else 0.0
            part = np.where(died, 1 - f, 1.0) * np.where(at, risk, 0.0)
            s0, s1 = part.sum(), part @ x
            s2 = (x * part[:, None]).T @ x
            ll -= mean * np.log(s0)
            u -= mean * s1 / s0
            h += mean * (s2 / s0 - np.outer(s1, s1) / s0**2)
    return ll, u, h


def cox(t, e, x, efron=True, w=None):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        _, u, h = cox_parts(t, e, x, b, efron, w)
        step = np.linalg.solve(h, u)
        b = b + step
        if np.abs(step).max() < 1e-11:
            break
    ll, _, h = cox_parts(t, e, x, b, efron, w)
    return b, np.linalg.inv(h), ll


def logistic(y, x, offset=None):
    x = np.column_stack([np.ones(len(y)), x]) if x.size else np.ones((len(y), 1))
    off = np.zeros(len(y)) if offset is None else offset
    b = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-(x @ b + off)))
        step = np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    eta = x @ b + off
    mu = 1 / (1 + np.exp(-eta))
    return b, np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x), (y * eta - np.logaddexp(0, eta)).sum()


def linear_ll(y, x):
    x = np.column_stack([np.ones(len(y)), x])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ b) ** 2).sum()
    return b, -0.5 * len(y) * (np.log(2 * np.pi * rss / len(y)) + 1)


def auc(x, y):
    pos, neg = x[y == 1], x[y == 0]
    a = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    return a if np.median(neg) <= np.median(pos) else 1 - a


def type3(values, p):
    v = np.sort(values)
    t = len(v) * p - 0.5
    j = int(np.floor(t + 1e-9))
    k = j if abs(t - j) < 1e-9 and j % 2 == 0 else j + 1
    return v[min(max(k, 1), len(v)) - 1]


def threshold(x, loglik):
    """The search by its definition; ``loglik(cut, coarse)`` fits the model with one hinge."""
    probs = [0.05 * k for k in range(1, 20)]
    best = probs[int(np.argmax([loglik(c, True) for c in np.quantile(x, probs)]))]
    low, high = np.quantile(x, [max(best - 0.04, 0.05), min(best + 0.04, 0.95)])
    left = np.unique(x[(x > low) & (x < high)])
    while len(left) > 5:
        q = [type3(left, p) for p in (0, 0.25, 0.5, 0.75, 1)]
        k = int(np.argmax([loglik(c, False) for c in q[1:4]]))
        left = left[(left >= q[k]) & (left <= q[k + 2])]
    if len(left) == 0:
        return round(low, 3)
    if len(left) == 1:
        return round(left[0], 3)
    return round(left[int(np.argmax([loglik(c, False) for c in left]))], 3)
