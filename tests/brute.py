"""Plain enumeration of what the mining job should find, for tiny tables."""

import itertools
import math
from collections import Counter, defaultdict

TIE = 1e-7


def log_choose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def exact_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Probability of all tables with these margins that are no likelier than this one.

    The table probabilities rise to one mode and fall again, so the tables wanted form two
    tails. Each is summed from its inner end outwards and left when the terms no longer
    count, so the cost follows the spread of the distribution and not the size of the margins.
    """
    row, column, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + column - n), min(row, column)
    base = log_choose(n, column)

    def log_p(x):
        return log_choose(row, x) + log_choose(n - row, column - x) - base

    limit = log_p(a) + TIE
    mode = min(max((row + 1) * (column + 1) // (n + 2), low), high)
    if log_p(mode) <= limit:
        return 1.0

    def inner_end(outer, step):
        """Innermost table of one tail that is still no likelier than the one seen."""
        if log_p(outer) > limit:
            return None
        near, far = mode, outer
        while abs(near - far) > 1:
            middle = (near + far) // 2
            if log_p(middle) <= limit:
                far = middle
            else:
                near = middle
        return far

    total = 0.0
    for outer, step in ((low, -1), (high, 1)):
        x = inner_end(outer, step)
        if x is None:
            continue
        term = math.exp(log_p(x))
        while term > 0.0:
            total += term
            if x == outer or term < total * 1e-17:
                break
            if step > 0:
                term *= (row - x) * (column - x) / ((x + 1) * (n - row - column + x + 1))
            else:
                term *= x * (n - row - column + x) / ((row - x + 1) * (column - x + 1))
            x += step
    return min(total, 1.0)


def chi2(a, b, c, d):
    n = a + b + c + d
    m = (a + b) * (c + d) * (a + c) * (b + d)
    return None if m == 0 else n * max(abs(a * d - b * c) - n / 2, 0) ** 2 / m


def pvalue(x):
    return math.erfc(math.sqrt(x / 2))


def reachable(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for start in list(out):
        seen, todo = set(), [start]
        while todo:
            for n in out[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[start] = seen - {start}
    return reach


def node(item):
    return "@" + item[3] if item[3] else item[0]


def deviations(rows, s=0.15, min_corr=0.03, alpha=0.05, edges=(), discovered=(), own_only=(), versions=(), restricted=None, only_true=()):
    """``rows`` is a list of (groups, is_reference, items); an item is (key, value, vtype, family)."""
    restricted = restricted or {}
    total_ref = sum(r[1] for r in rows)
    totals = Counter(g for r in rows for g in r[0])
    reach = reachable(edges)
    ref, own = Counter(), defaultdict(Counter)
    for gs, is_ref, its in rows:
        sets = [(i,) for i in its] + [tuple(sorted(p, key=repr)) for p in itertools.combinations(sorted(its, key=repr), 2)]
        for k in sets:
            ref[k] += is_ref
            for g in gs:
                own[g][k] += 1
    t = min(0.05, s / 2)
    groups = [g for g in totals if totals[g] >= 5]

    def sup(k, g):
        return ref[k] / total_ref if total_ref else 0, own[g][k] / totals[g]

    kept_names = set()
    for g in groups:
        for k in own[g]:
            i = k[0]
            if len(k) == 1 and i[3] in discovered and ref[k] >= 5 and own[g][k] >= 5:
                sr, sg = sup(k, g)
                if sg > s or (sr > s and i[3] not in own_only):
                    kept_names.add((i[3], i[0]))
    result = {}
    for g in groups:
        tot = totals[g]
        first = []
        for k in own[g]:
            if len(k) > 1 or own[g][k] < 5 or ref[k] < 5:
                continue
            key, value, vtype, family = k[0]
            sr, sg = sup(k, g)
            if family in discovered and not (sg > s or (sr > s and family not in own_only)):
                continue
            if family in versions and (family[:-8], key[:-8]) not in kept_names and family[:-8] in discovered:
                continue
            if sr < s and sg < s:
                continue
            first.append(k)
        have = set(first)

        def ignore(k):
            key, value, vtype, family = k[0]
            if vtype == "bool" and value == "false" and ((key, "true", "bool", family),) in have:
                return True
            if vtype == "null" and any(((key, v, "str", family),) in have for v in ("1", "Active")):
                return True
            if key in only_true and not (vtype == "bool" and value == "true"):
                return True
            if family in versions:
                if value is None or value == "Not installed":
                    return True
                p = ((key[:-8], "true", "bool", family[:-8]),)
                if p in have and abs(own[g][k] / tot - own[g][p] / tot) <= 0.01:
                    return True
            return False

        first = [k for k in first if not ignore(k)]
        second = []
        for x, y in itertools.combinations(sorted(first, key=repr), 2):
            a, b = x[0], y[0]
            if a[0] == b[0]:
                continue
            if a[3] in restricted and (b[3] or b[0] not in restricted[a[3]]):
                continue
            if b[3] in restricted and (a[3] or a[0] not in restricted[b[3]]):
                continue
            k = tuple(sorted((a, b), key=repr))
            if own[g][k] < 5 or ref[k] < 5:
                continue
            sr, sg = sup(k, g)
            if sr < s and sg < s:
                continue
            par = [(sup((m,), g), (ref[k] / ref[(m,)], own[g][k] / own[g][(m,)]), (m,)) for m in k]
            clear = all(abs(p[0][0] - p[1][0]) > t or abs(p[0][1] - p[1][1]) > t for p in par)
            if not clear:
                if any(abs(p[0][0] - sr) < t and abs(p[0][1] - sg) < t for p in par):
                    continue
                if all(pvalue(chi2(own[g][p[2]], own[g][k], ref[p[2]], ref[k])) > 0.5 for p in par):
                    continue
            second.append(k)
        a1 = alpha / 2 / len(first) if first else 0
        a2 = min(alpha / 4 / len(second), a1) if second else 0

        def good(k, level):
            sr, sg = sup(k, g)
            if abs(sr - sg) < s:
                return False
            x = chi2(own[g][k], ref[k], tot - own[g][k], total_ref - ref[k])
            return x is not None and pvalue(x) <= level and math.sqrt(x / (tot + total_ref)) >= min_corr

        singles = {k for k in first if good(k, a1)}

        def is_prior(p, o):
            if p[3] and o[3] == p[3] + "-version" and o[0] == p[0] + "-version":
                return True
            return node(p) != node(o) and node(o) in reach.get(node(p), ())

        links = []
        for k in second:
            for p, o in ((k[0], k[1]), (k[1], k[0])):
                if is_prior(p, o) and (o,) in singles:
                    gr, gg = ref[k] / ref[(p,)], own[g][k] / own[g][(p,)]
                    links.append((k, p, o, gr, gg))
        gone = {o for k, p, o, gr, gg in links if abs(gr - gg) < s}
        best, taken = {}, set()
        for k, p, o, gr, gg in links:
            if set(k) & gone:
                continue
            sr, sg = sup((o,), g)
            if abs(sg - gg) < t and abs(sr - gr) < t:
                continue
            taken.add(k)
            rank = (abs(gr - gg), p[0], p[1] or "")
            if o not in best or rank < best[o][0]:
                best[o] = (rank, (p, ref[k], own[g][k], ref[(p,)], own[g][(p,)]))
        out = {}
        for k in singles:
            if k[0] not in gone:
                prior = best.get(k[0])
                out[frozenset(k)] = (ref[k], own[g][k], prior[1] if prior else None)
        for k in second:
            if set(k) & gone or k in taken or not good(k, a2):
                continue
            sg = own[g][k] / tot
            ind = own[g][(k[0],)] / tot * (own[g][(k[1],)] / tot)
            if abs(ind - sg) <= max(0.01, 0.15 * sg):
                continue
            n, na, nb = own[g][k], own[g][(k[0],)], own[g][(k[1],)]
            if exact_two_sided(n, tot - na, tot - nb, tot - n) > a1:
                continue
            out[frozenset(k)] = (ref[k], own[g][k], None)
        result[g] = out
    return result


def collected(rules):
    """Collected rule rows in the same form."""

    def item(i):
        return (i["key"], i["value"], i["vtype"], i["family"])

    out = defaultdict(dict)
    for r in rules.collect():
        p = r["prior"]
        prior = p and (item(p["item"]), p["count_reference"], p["count_group"], p["total_reference"], p["total_group"])
        key = frozenset(item(i) for i in r["items"])
        assert key not in out[r["g"]]
        out[r["g"]][key] = (r["count_reference"], r["count_group"], prior)
    return dict(out)
