"""Multiplicative fit of attack and defense factors, vectorized over many groups.

Model per group: goals ~ Poisson(base * advantage^home * attack[team] * defense[opponent]).
Each update is the coordinate-wise maximum of the objective in one family of factors. All
groups of a batch advance together, as sums over integer codes, and a group whose factors stand
still leaves the batch.

Without a prior the objective is the likelihood. A prior of ``p`` goals on every factor (a Gamma
density with its mode at 1) makes it strictly concave in the logarithms, so that a group too small to
identify its factors still has exactly one maximum; the base is then the mean goals of the group.
"""
from __future__ import annotations

import numpy as np

# Sweeps before a fit around hubs goes on by Newton steps, and the most of those.
PLAIN_SWEEPS, NEWTON_STEPS = 6, 30
# A Newton step below this share leaves an error of about its square.
NEWTON_STEP = 1e-7


def multiplicative_fit(
    group,
    home,
    team,
    opponent,
    goals,
    weight,
    n_groups,
    n_teams,
    *,
    sweeps,
    home_field_advantage=True,
    prior=0.0,
    tolerance=0.0,
    default_advantage=1.25,
    hub=None,
):
    """Attack and defense per team code, the home advantage per group, and which groups converged.

    Team codes are unique over all groups. ``weight`` is the number of matches a
    row stands for. A group has converged when no update of a sweep changes a factor
    by more than the share ``tolerance``; at most ``sweeps`` are made.

    ``hub`` is 0 or 1 for the (at most two) team codes of a group that take part in all its matches,
    -1 for the others. With it and a prior, groups that still move after ``PLAIN_SWEEPS`` are taken
    close to their maximum by :func:`_hub_newton`; the sweeps that follow find them standing still.
    """
    attack, defense, advantage = np.ones(n_teams), np.ones(n_teams), np.ones(n_groups)
    converged = np.zeros(n_groups, dtype=bool)
    all_goals = np.bincount(group, goals, n_groups)
    if prior:
        matches = np.bincount(group, weight, n_groups)
        base = np.divide(all_goals, matches, out=np.zeros(n_groups), where=matches > 0)
        # fitted goals per row: every update multiplies them by its factors
        fitted = weight * base[group]
    else:
        fitted = np.array(weight, dtype=np.float64)
    rows = group, home, team, opponent
    home_goals = np.bincount(group, goals * home, n_groups)
    scored, conceded = np.bincount(team, goals, n_teams), np.bincount(opponent, goals, n_teams)

    def step(observed, mu, now):
        mu = mu + prior * now
        # nothing fitted: the factor stays as it is
        return np.divide(observed + prior, mu, out=np.ones_like(mu), where=mu > 0)

    def layout(group, home, team, opponent):
        """Home rows, and of every team, opponent and home group its code and one row of it."""
        at_home = np.flatnonzero(home)
        return at_home, group[at_home], *[np.unique(key, return_index=True) for key in (group[at_home], team, opponent)]

    group, home, team, opponent = rows
    at_home, home_group, homes, teams, opponents = layout(*rows)
    left = np.arange(len(group))
    for sweep in range(sweeps + 1):
        if sweep == PLAIN_SWEEPS and sweep < sweeps and hub is not None and prior and tolerance:
            rate = weight[left] * base[group]
            _hub_newton(group, home if home_field_advantage else 0 * home, team, opponent, goals[left], rate, hub, prior, attack, defense, advantage)
            fitted = rate * np.where(home == 1, advantage[group], 1.0) * attack[team] * defense[opponent]
        change = np.zeros(n_groups)
        if not prior:
            fitted *= step(all_goals, np.bincount(group, fitted, n_groups), 1.0)[group]
        if home_field_advantage:
            factor = step(home_goals, np.bincount(home_group, fitted[at_home], n_groups), advantage)
            advantage[homes[0]] *= factor[homes[0]]
            change[homes[0]] = np.abs(factor[homes[0]] - 1)
            fitted[at_home] *= factor[home_group]
        if sweep == sweeps:
            break
        for values, observed, key, (codes, first) in ((attack, scored, team, teams), (defense, conceded, opponent, opponents)):
            factor = step(observed, np.bincount(key, fitted, n_teams), values)
            fitted *= factor[key]
            values[codes] *= factor[codes]
            np.maximum.at(change, group[first], np.abs(factor[codes] - 1))
        if tolerance:
            still = change <= tolerance
            moving = ~still[group]
            # the batch is packed again only when a good part of it stands still
            if 4 * np.count_nonzero(moving) <= 3 * len(moving) or not moving.any():
                converged[np.unique(group)] = True
                converged[np.unique(group[moving])] = False
                rows, fitted, left = tuple(x[moving] for x in rows), fitted[moving], left[moving]
                if not len(fitted):
                    break
                group, home, team, opponent = rows
                at_home, home_group, homes, teams, opponents = layout(*rows)

    if home_field_advantage:
        # without any home goal there is no ratio to speak of
        some = all_goals > 0
        advantage = np.where(some & (advantage > 0), advantage, default_advantage)
    return attack, defense, advantage, converged


def _hub_newton(group, home, team, opponent, goals, rate, hub, prior, attack, defense, advantage):
    """Move the factors of all groups close to their maximum, in place.

    Every row has a hub on one side at least. Given the factors of the hubs and the advantage, that of
    any other team has a closed form, so what is left per group is concave in five logarithms: attack of
    both hubs, defense of both, advantage. A group whose steps don't shrink keeps its factors.
    """
    known = np.unique(group[(hub[team] < 0) & (hub[opponent] < 0)])
    use = ~np.isin(group, known)
    group, home, team, opponent, goals, rate = (x[use] for x in (group, home, team, opponent, goals, rate))
    if not len(group):
        return
    codes, g = np.unique(group, return_inverse=True)
    n, i, j = len(codes), hub[team], hub[opponent]
    total = lambda rows, values: np.bincount(g[rows], values[rows], n)
    seen = np.stack([total(i == 0, goals), total(i == 1, goals), total(j == 0, goals), total(j == 1, goals), total(home == 1, goals)], 1) + prior
    # factors of the hubs as they are now; one that takes no part stays at its prior
    x = np.ones((n, 5))
    for k, side, values in ((0, i, attack), (1, i, attack), (2, j, defense), (3, j, defense)):
        rows = side == k % 2
        x[g[rows], k] = values[(team if k < 2 else opponent)[rows]]
    x[:, 4] = advantage[codes]
    x = np.log(np.maximum(x, 1e-300))

    # matches between hubs: rates per side, opposing side and home flag
    between = (i >= 0) & (j >= 0)
    direct = np.bincount(((g * 2 + i) * 2 + j)[between] * 2 + home[between], rate[between], 8 * n).reshape(n, 2, 2, 2)
    # the other teams: rates per hub and home flag, apart for their attack and their defense
    others = []
    for own, side, first in ((team, j, 2), (opponent, i, 0)):
        rows = (hub[own] < 0)
        code, at, leaf = np.unique(own[rows], return_index=True, return_inverse=True)
        rates = np.bincount((leaf * 2 + side[rows]) * 2 + home[rows], rate[rows], 4 * len(code)).reshape(-1, 4).T
        others.append((code, g[rows][at], first, rates, np.bincount(leaf, goals[rows], len(code)) + prior))

    def shares(factors, of, first, rates):
        low, high, lift = factors[of, first], factors[of, first + 1], factors[of, 4]
        return rates[0] * low, rates[1] * low * lift, rates[2] * high, rates[3] * high * lift

    moving, done = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    now = x
    for _ in range(NEWTON_STEPS):
        factors = np.exp(now)
        slope, bend = seen - prior * factors, np.zeros((n, 5, 5))
        bend[:, range(5), range(5)] = prior * factors
        for a in range(2):
            for d in range(2):
                mu = [direct[:, a, d, h] * factors[:, a] * factors[:, 2 + d] * (factors[:, 4] if h else 1.0) for h in range(2)]
                both = mu[0] + mu[1]
                for row, value in ((a, both), (2 + d, both), (4, mu[1])):
                    slope[:, row] -= value
                    bend[:, row, row] += value
                for row, column, value in ((a, 2 + d, both), (a, 4, mu[1]), (2 + d, 4, mu[1])):
                    bend[:, row, column] += value
                    bend[:, column, row] += value
        for _, of, first, rates, scored in others:
            at_rest, lifted, other_rest, other_lifted = shares(factors, of, first, rates)
            parts = at_rest + lifted, other_rest + other_lifted, lifted + other_lifted
            whole = parts[0] + parts[1] + prior
            q = scored / whole
            second = {(0, 0): parts[0], (1, 1): parts[1], (2, 2): parts[2], (0, 1): 0.0, (0, 2): lifted, (1, 2): other_lifted}
            place = (first, first + 1, 4)
            for k in range(3):
                slope[:, place[k]] -= np.bincount(of, q * parts[k], n)
            for (k, m), value in second.items():
                value = np.bincount(of, q * (value - parts[k] * parts[m] / whole), n)
                bend[:, place[k], place[m]] += value
                if k != m:
                    bend[:, place[m], place[k]] += value
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        longest = np.abs(step).max(1)
        # far from the maximum a whole step may lead beyond it
        step *= (np.minimum(1.0, 1.0 / np.maximum(longest, 1e-300)) * moving)[:, None]
        now = now + step
        done |= moving & (longest <= NEWTON_STEP)
        moving &= ~done
        if not moving.any():
            break

    factors = np.exp(now)
    advantage[codes[done]] = factors[done, 4]
    for k, side, values in ((0, i, attack), (1, i, attack), (2, j, defense), (3, j, defense)):
        rows = (side == k % 2) & done[g]
        values[(team if k < 2 else opponent)[rows]] = factors[g[rows], k]
    for (code, of, first, rates, scored), values in zip(others, (attack, defense)):
        best = scored / (sum(shares(factors, of, first, rates)) + prior)
        values[code[done[of]]] = best[done[of]]


def mean_one(values, group, n_groups):
    """``values`` divided by their mean within each group."""
    total = np.bincount(group, values, n_groups)
    size = np.bincount(group, minlength=n_groups)
    mean = np.divide(total, size, out=np.ones(n_groups), where=total > 0)
    return values / mean[group]
