"""The whole joint search against brute force."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import policy as P
from tidemill.plans import base
from tidemill.plans.decide import COLS, ENTITY, FLOORS, JOINT_COLS, LIMIT, PARTS, WINDOW_FLOORS, constrained, joint, references
from tidemill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def fine(spark, sf):
    return QUERIES["joint_grid_fine"](spark, sf).collect()


def slow_precision(rows, weights):
    """Average precision over distinct scores, from the top."""
    hits = {}
    for r in rows:
        p = round(sum(w * r[c] for w, c in zip(weights, COLS)), 12)
        n, t = hits.get(p, (0, 0))
        hits[p] = (n + 1, t + r.empty)
    seen = tp = total = 0
    for p in sorted(hits, reverse=True):
        n, t = hits[p]
        seen, tp = seen + n, tp + t
        total += t * tp / seen
    return total / tp if tp else 0.0


def slow_policy(days, weights, cut):
    """(recommended, conflicts, safe load, windows, safe windows) of runs of four steps or more."""
    n = bad = kwh = windows = safe = 0
    for day in days:
        on = [round(sum(w * r[c] for w, c in zip(weights, COLS)), 12) >= cut - 1e-11 for r in day]
        at = 0
        while at < len(day):
            end = at
            while end < len(day) and on[end]:
                end += 1
            if end - at >= 4:
                run = day[at:end]
                n, bad, kwh = n + len(run), bad + sum(r.empty == 0 for r in run), kwh + sum(r.kwh for r in run if r.empty == 1)
                windows, safe = windows + 1, safe + all(r.empty == 1 for r in run)
            at = max(end, at + 1)
    return n, bad, kwh, windows, safe


def test_fine_grid_against_brute_force(spark, sf, fine):
    assert len(fine) == 2 * 231 * 37
    assert {round(r.w1 * 20) for r in fine} == set(range(21))
    rows, mid = base.wide(spark, sf, splits=("val",)).collect(), base.wide(spark, sf, midnight=True, splits=("val",)).collect()
    at = {(r.entity_id, r.grid_order): r for r in fine}
    for e in (0, 1):
        mine, days = [r for r in rows if r.entity_id == e], {}
        for r in sorted((r for r in mid if r.entity_id == e), key=lambda r: r.step):
            days.setdefault(r.anchor_pos, []).append(r)
        for i, j in ((0, 20), (1, 2), (7, 9), (13, 0), (19, 1)):
            order = [(a, b) for a in range(21) for b in range(21 - a)].index((i, j))
            weights = (i / 20, j / 20, (20 - i - j) / 20)
            ap = slow_precision(mine, weights)
            for k in range(0, 37, 4):
                r = at[e, order * 37 + k]
                n, bad, kwh, windows, safe = slow_policy(days.values(), weights, (k * 25 + 50) / 1000)
                assert (r.recommended_intervals, r.recommended_windows, r.safe_windows) == (n, windows, safe)
                assert r.average_precision == pytest.approx(ap, abs=2e-6) and r.safe_kwh == pytest.approx(kwh, abs=2e-6)
                assert r.conflict_rate == pytest.approx(bad / n if n else 0, abs=2e-6)


def slow_picks(rows, floor, limit=0.10):
    """The best row of each entity under a floor, of rows that aren't rounded to six places."""
    out = set()
    for e in {r.entity_id for r in rows}:
        mine = [r for r in rows if r.entity_id == e]
        top = max(r.average_precision for r in mine)
        ok = [r for r in mine if round(r.conflict_rate, 9) <= limit and r.recommended_windows >= 1 and r.coverage > 0 and (floor is None or round(r.average_precision, 9) >= round(top * floor, 9))]
        if ok:
            out.add((e, min(ok, key=lambda r: (-round(r.safe_kwh, 6), round(r.conflict_rate, 9), -round(r.average_precision, 9), -r.safe_windows, r.nonzero, r.grid_order)).grid_order))
    return out


def test_fine_picks_keep_the_reference_limit(spark, sf):
    fine = joint(spark, sf, PARTS).select(*JOINT_COLS).collect()
    assert {tuple(r) for r in QUERIES["select_joint_fine"](spark, sf).collect()} == slow_picks(fine, 0.99)
    floors = {"none": None, "0.95": 0.95, "0.98": 0.98, "0.99": 0.99}
    want = {(f"floor_{n}", *p) for n, f in floors.items() for p in slow_picks(fine, f)}
    got = {tuple(r) for r in QUERIES["candidate_set_fine"](spark, sf).collect()}
    assert {r for r in got if r[0].startswith("floor")} == want
    assert {r[1:] for r in got if r[0] == "decision_optimal"} == slow_picks(fine, None) and {r[1:] for r in got if r[0] == "decision_optimal_0.99"} == slow_picks(fine, 0.99)
    full = joint(spark, sf, PARTS).collect()
    for e in (0, 1):  # roles with a given blend always have a pick
        mine = [r for r in full if r.entity_id == e]
        top = min(mine, key=lambda r: (-round(r.average_precision, 9), r.blend_order)).blend_order
        for role, of in (("forecast_optimal", [r for r in mine if r.blend_order == top]), ("first_alone", [r for r in mine if r.w1 == 1]), ("second_alone", [r for r in mine if r.w2 == 1])):
            met = [r for r in of if round(r.conflict_rate, 9) <= 0.10]
            first = min(met, key=lambda r: (-round(r.safe_kwh, 6), -round(r.empty_recall, 9), r.grid_order)) if met else min(of, key=lambda r: (round(r.conflict_rate, 9), -round(r.safe_kwh, 6), r.grid_order))
            assert (role, e, first.grid_order) in got


def test_each_entity_has_its_own_search(spark):
    # entity 7's precisions are far under entity 3's: a best one over both would leave it nothing under any floor
    rows = [
        (e, i, 0.05 + i % 4 * 0.02, float(i * 37 % 11), 5, (i * 3 + e) % 6, 0.5, top - i * 0.004, 1 + i % 3)
        for e, top in ((3, 0.9), (7, 0.4)) for i in range(30)
    ]
    names = ["entity_id", "grid_order", "conflict_rate", "safe_kwh", "recommended_windows", "safe_windows", "coverage", "average_precision", "nonzero"]
    more = {"blend_order": F.col("grid_order"), "w1": F.lit(0.0), "w2": F.lit(0.0), "empty_recall": F.lit(0.5)}
    grid = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if isinstance(v, float) else 'int'}" for n, v in zip(names, rows[0]))).withColumns(more)
    flags, want, refs = set(), set(), set()
    for e in (3, 7):
        mine = [dict(zip(names, r)) for r in rows if r[0] == e]
        best = max(r["average_precision"] for r in mine)
        for k, (window, floor) in enumerate((w, f) for w in WINDOW_FLOORS for f in FLOORS):
            ok = [r for r in mine if r["conflict_rate"] <= 0.1 and r["safe_windows"] / 5 >= window and (floor is None or round(r["average_precision"], 9) >= round(best * floor, 9))]
            flags |= {(e, k, r["grid_order"], int(r in ok)) for r in mine}
            if ok:
                first = min(ok, key=lambda r: (-r["safe_kwh"], -r["safe_windows"] / 5, r["conflict_rate"], -r["average_precision"], -r["safe_windows"], r["nonzero"], r["grid_order"]))
                want.add((e, k, first["grid_order"]))
                if window == 0:
                    first = min(ok, key=lambda r: (-r["safe_kwh"], r["conflict_rate"], -r["average_precision"], -r["safe_windows"], r["nonzero"], r["grid_order"]))
                    refs.add((e, "floor_none" if floor is None else f"floor_{floor:.2f}", first["grid_order"]))
    tried = constrained(grid, LIMIT)
    assert {tuple(r) for r in tried.select("entity_id", "constraint_order", "grid_order", "feasible").collect()} == flags
    picked = P.select_window_aware(tried, ENTITY)
    assert {tuple(r) for r in picked.select("entity_id", "constraint_order", "grid_order").collect()} == want and {e for e, _, _ in want} == {3, 7}
    groups = {}
    for e, k, g in sorted(want):
        groups.setdefault((e, g), []).append(k)
    assert {tuple(r) for r in P.dedupe_strategies(picked, ENTITY).collect()} == {(*at, 15 if 15 in ks else ks[0], "|".join(map(str, ks))) for at, ks in groups.items()}
    got = references(grid, LIMIT).collect()
    assert {(r.entity_id, r.constraint_order, r.grid_order) for r in got if r.kind == "window_aware"} == want
    assert {(r.entity_id, r.role, r.grid_order) for r in got if r.kind == "reference" and r.role.startswith("floor")} == refs
    assert sum(r.kind == "window_aware" for r in got) == len(want) and {r.role for r in got if r.kind == "reference"} >= {"forecast_optimal", "decision_optimal"}


def test_a_pair_without_a_feasible_row_stops_on_demand(spark):
    cols = "grid_order int, conflict_rate double, safe_kwh double, average_precision double, recommended_windows int, safe_windows int, coverage double, nonzero int"
    grid = spark.createDataFrame([(0, 0.02, 5.0, 0.6, 4, 4, 0.1, 1), (1, 0.02, 9.0, 0.9, 4, 2, 0.2, 2), (2, 0.4, 99.0, 0.9, 9, 9, 0.5, 3)], cols)
    both = P.constraint_grid(grid, (0.0, 0.9), (None, 0.99), 0.1)
    assert {r.constraint_order: r.grid_order for r in P.select_window_aware(both).collect()} == {0: 1, 1: 1, 2: 0}
    with pytest.raises(Exception, match="no feasible row"):
        P.select_window_aware(both, strict=True).collect()
    some = both.where("constraint_order < 3")
    assert {r.constraint_order: r.grid_order for r in P.select_window_aware(some, strict=True).collect()} == {0: 1, 1: 1, 2: 0}
