"""Row-by-row reckoning of the learned benchmark, used only to check the Spark jobs."""

import re
from fractions import Fraction

import numpy as np

from tollway.functions.surface import CODE_LINE_WORDS, MATH_WORDS, TAG_PHRASES, TAG_WORDS, TAGS


def features(prompt):
    code = bool(re.search(r"```|console\.log|</?[a-z][^>]*>", prompt, re.I))
    code = code or bool(re.search(r"^[ \t]*(%s)\b" % "|".join(CODE_LINE_WORDS), prompt, re.I | re.M))
    math = bool(re.search(r"\$[^$]+\$|[∑∫√≈≠≤≥]|\b(%s)\b" % "|".join(MATH_WORDS), prompt, re.I))
    tags = {t for t, w in TAG_WORDS.items() if re.search(r"\b(%s)\b" % "|".join(w), prompt, re.I) or any(k in prompt for k in TAG_PHRASES[t])}
    tags |= {"code"} if code else set()
    tags |= {"math"} if math else set()
    tags = tags or {"general"}
    logs = [np.log1p(len(prompt)), np.log1p(len(re.findall(r"\S+", prompt))), np.log1p(prompt.count("\n") + 1)]
    return np.array([*logs, float(code), float(math), *[float(t in tags) for t in TAGS]])


def ridge_fit(x, y, ridge=1.0):
    mean, scale = x.mean(0), np.ones(x.shape[1])
    scale[:3] = np.where(x.std(0)[:3] > 0, x.std(0)[:3], 1.0)
    kept = np.array([j < 5 or x[:, j].any() for j in range(x.shape[1])])
    z = ((x - mean) / scale)[:, kept]
    w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - y.mean(0)))
    return lambda q: y.mean(0) + ((q - mean) / scale)[:, kept] @ w


def best_split(x, r, leaf):
    best = None
    for f in range(x.shape[1]):
        for v in sorted(set(x[:, f]))[1:]:
            left = x[:, f] < v
            if left.sum() < leaf or (~left).sum() < leaf:
                continue
            gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
            if best is None or round(gain, 10) > best[0]:
                best = (round(gain, 10), f, v, r[left].mean(), r[~left].mean())
    return best


def stump_fit(rounds, rate=0.1, leaf=2):
    def fit(x, y):
        chains = []
        for k in range(y.shape[1]):
            base, chain, r = y[:, k].mean(), [], y[:, k] - y[:, k].mean()
            for _ in range(rounds):
                b = best_split(x, r, leaf)
                if b is None or b[0] <= 1e-10:
                    break
                chain.append(b[1:])
                r = r - rate * np.where(x[:, b[1]] < b[2], b[3], b[4])
            chains.append((base, chain))

        def predict(q):
            cols = []
            for base, chain in chains:
                out = np.full(len(q), base)
                for f, v, lv, rv in chain:
                    out = out + rate * np.where(q[:, f] < v, lv, rv)
                cols.append(out)
            return np.stack(cols, 1)

        return predict

    return fit


def monotone(score, y):
    """Largest-smallest mean form over distinct scores, as (bounds, values)."""

    points = sorted(set(score))
    sums = [sum(t for s, t in zip(score, y) if s == p) for p in points]
    counts = [sum(1 for s in score if s == p) for p in points]
    n = len(points)
    mean = lambda a, b: sum(sums[a : b + 1]) / sum(counts[a : b + 1])
    values = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    return points, values


def pooled(score, y):
    """Adjacent pooling for larger inputs."""

    blocks = []
    for s, t in sorted(zip(score, y)):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += t
            blocks[-1][2] += 1
        else:
            blocks.append([s, t, 1])
    out = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][1] / out[-2][2] > out[-1][1] / out[-1][2]:
            s, t, c = out.pop()
            out[-1] = [s, out[-1][1] + t, out[-1][2] + c]
    return [b[0] for b in out], [b[1] / b[2] for b in out]


def step(bounds, values, s):
    for b, v in zip(bounds, values):
        if b >= s - 1e-12:
            return v
    return values[-1]


class Nested:
    """Everything re-fitted from rows for every fold, with no sharing."""

    def __init__(self, rows, fit, calibrator=monotone):
        self.rows, self.fit, self.calibrator = rows, fit, calibrator
        self.ids = [m[0] for m in rows[0][5]]
        self.x = np.stack([features(r[2]) for r in rows])
        self.y = np.array([[float(m[3]) for m in r[5]] for r in rows])
        self.domain = np.array([r[3] for r in rows])
        self._memo = {}

    def base(self, at, q):
        return self.fit(self.x[at], self.y[at])(self.x[q])

    def calibrated(self, at, q):
        """Fit on rows ``at`` with inner folds, predict rows ``q``, in billionths."""

        key = (tuple(at), tuple(q))
        if key in self._memo:
            return self._memo[key]
        score, target = [], []
        for d in sorted(set(self.domain[at])):
            inner = [i for i in at if self.domain[i] != d]
            test = [i for i in at if self.domain[i] == d]
            score.append(self.base(inner, test))
            target.append(self.y[test])
        score, target = np.concatenate(score), np.concatenate(target)
        raw = self.base(at, q)
        out = np.zeros(raw.shape, dtype=object)
        for k in range(raw.shape[1]):
            bounds, values = self.calibrator([round(float(s), 12) for s in score[:, k]], [float(t) for t in target[:, k]])
            for i in range(len(q)):
                out[i, k] = int(np.rint(step(bounds, values, round(float(raw[i, k]), 12)) * 1e9))
        self._memo[key] = out
        return out

    def cross_fitted(self, at):
        table = {}
        for d in sorted(set(self.domain[at])):
            inner = [i for i in at if self.domain[i] != d]
            test = [i for i in at if self.domain[i] == d]
            for i, p in zip(test, self.calibrated(inner, test)):
                table[i] = list(p)
        return table

    def choose(self, i, predicted, price, budget):
        options = [
            (-(Fraction(predicted[k], 10**9) - price * Fraction(m[1])), m[1], m[0], k)
            for k, m in enumerate(self.rows[i][5]) if m[1] <= budget
        ]
        return min(options)[3] if options else None

    def replay(self, table, price, budget):
        quality, spend = Fraction(0), 0
        for i, predicted in table.items():
            k = self.choose(i, predicted, price, budget)
            if k is None or self.rows[i][5][k][2] > budget:
                return None
            quality += Fraction(self.rows[i][5][k][3])
            spend += self.rows[i][5][k][2]
        return quality, spend

    def prices(self, table, midpoints):
        roots = {Fraction(0)}
        for i, p in table.items():
            models = self.rows[i][5]
            for a in range(len(models)):
                for b in range(a):
                    dc = Fraction(models[a][1]) - Fraction(models[b][1])
                    if dc:
                        root = Fraction(p[a] - p[b], 10**9) / dc
                        if root >= 0:
                            roots.add(root)
        ordered = sorted(roots)
        if midpoints:
            ordered += [(a + b) / 2 for a, b in zip(ordered, ordered[1:])] + [ordered[-1] + 1]
        return sorted(ordered)

    def tune(self, table, budget, midpoints=True):
        best = None
        for price in self.prices(table, midpoints):
            r = self.replay(table, price, budget)
            if r is not None and (best is None or (-r[0], r[1], price) < best):
                best = (-r[0], r[1], price)
        return None if best is None else best[2]

    def run(self, tiers, midpoints=True):
        """Lambdas per (fold, tier) and decisions per (example, tier)."""

        prices, decisions = {}, {}
        everything = range(len(self.rows))
        for d in sorted(set(self.domain)):
            train = [i for i in everything if self.domain[i] != d]
            test = [i for i in everything if self.domain[i] == d]
            table = self.cross_fitted(train)
            final = self.calibrated(train, test)
            for t in tiers:
                prices[(d, t.tier)] = self.tune(table, t.budget, midpoints)
                for i, p in zip(test, final):
                    k = self.choose(i, list(p), prices[(d, t.tier)], t.budget)
                    decisions[(self.rows[i][0], t.tier)] = None if k is None else self.ids[k]
        return prices, decisions
