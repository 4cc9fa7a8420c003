"""Ordered rule lists by incremental reduced-error pruning.

Classes are learned one after the other, the rarest first. For each class rules are grown on two thirds of the
examples not yet covered, condition by condition with the greatest information gain, then pruned on the other third by
cutting off final conditions. A rule that is not right on most of what it covers there falls through; several such
rules in a row, from other splits, end the class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Thresholds tried per statistic and step, at the quantiles of its values.
THRESHOLDS = 48
MOST_CONDITIONS = 8
MOST_RULES = 60
#: A rule must be right on at least this share of what it covers in the pruning third, and cover this many.
LEAST_PRECISION = 0.6
LEAST_COVERED = 3
#: A class ends after so many rules in a row that fell through, each grown on another split.
MOST_FAILURES = 5


@dataclass
class Rule:
    label: str
    conditions: list[tuple[int, bool, float]]  # statistic, at least (else less), threshold

    def covers(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for j, at_least, v in self.conditions[:upto]:
            hit &= x[:, j] >= v if at_least else x[:, j] < v
        return hit


@dataclass
class RuleList:
    names: list[str]
    other: str
    rules: list[Rule] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.other, dtype=object)
        free = np.ones(len(x), bool)
        for r in self.rules:
            hit = free & r.covers(x)
            out[hit] = r.label
            free &= ~hit
        return out

    def case(self) -> str:
        """The rules as one SQL CASE expression over the statistics' columns."""
        whens = [f"WHEN {' AND '.join(f'{self.names[j]} {">=" if ge else "<"} {v!r}D' for j, ge, v in r.conditions) or 'true'} THEN '{r.label}'" for r in self.rules]
        return f"CASE {' '.join(whens)} ELSE '{self.other}' END" if whens else f"'{self.other}'"


def _cuts(v: np.ndarray) -> np.ndarray:
    u = np.unique(v)
    mids = (u[1:] + u[:-1]) / 2
    return mids if len(mids) <= THRESHOLDS else np.unique(np.quantile(mids, np.linspace(0, 1, THRESHOLDS)))


def _grow(x: np.ndarray, pos: np.ndarray, label: str) -> Rule:
    rule, inside = Rule(label, []), np.ones(len(x), bool)
    while len(rule.conditions) < MOST_CONDITIONS and (inside & ~pos).any():
        p, n = (inside & pos).sum(), (inside & ~pos).sum()
        if p == 0:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        xi, pi = x[inside], pos[inside]
        for j in range(x.shape[1]):
            order = np.argsort(xi[:, j], kind="stable")
            v, cum = xi[order, j], np.concatenate([[0], np.cumsum(pi[order])])
            cuts = _cuts(v)
            if not len(cuts):
                continue
            at = np.searchsorted(v, cuts, side="left")
            for at_least, pp, all_ in ((True, p - cum[at], len(v) - at), (False, cum[at], at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / all_) - now), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, at_least, float(cuts[k])))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside = rule.covers(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, pos: np.ndarray) -> Rule:
    best, keep = -2.0, len(rule.conditions)
    for k in range(len(rule.conditions), 0, -1):
        hit = rule.covers(x, k)
        p, n = (hit & pos).sum(), (hit & ~pos).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best:
            best, keep = worth, k
    return Rule(rule.label, rule.conditions[:keep])


def induce(x: np.ndarray, y: np.ndarray, names: list[str], labels: list[str], other: str, seed: int = 7) -> RuleList:
    """An ordered rule list; ties and splits are fixed by ``seed``. No examples give no rules."""
    out = RuleList(names, other)
    rng = np.random.default_rng(seed)
    left = np.arange(len(y))
    for label in sorted(labels, key=lambda c: ((y == c).sum(), c)):
        failures = 0
        for _ in range(MOST_RULES):
            pos = y[left] == label
            if failures == MOST_FAILURES or not pos.any():
                break
            part = np.zeros(len(left), bool)
            for group in (np.flatnonzero(pos), np.flatnonzero(~pos)):
                part[rng.permutation(group)[: -(-2 * len(group) // 3)]] = True
            grow, hold = left[part], left[~part]
            rule = _grow(x[grow], y[grow] == label, label)
            if not rule.conditions:
                break
            rule = _prune(rule, x[hold], y[hold] == label)
            hit = rule.covers(x[hold])
            right = (hit & (y[hold] == label)).sum()
            if right < LEAST_COVERED or right < LEAST_PRECISION * hit.sum():
                failures += 1
                continue
            failures = 0
            out.rules.append(rule)
            left = left[~rule.covers(x[left])]
    return out
