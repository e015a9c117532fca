"""Plain-Python model of the history features, run by run, for comparison."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import date, timedelta

SCHEMA = (
    "id long, date date, race_id long, course string, type string, class string, dist string, going string,"
    " draw int, pos string, btn double, horse string, wgt string, hg string, jockey string, trainer string,"
    " prize string, official_rating int, jockey_allowance int"
)


def random_rows(seed: int, n: int = 300, hot: bool = False, nulls: bool = True) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        is_hot = hot and rng.random() < 0.34
        horse = "HOT" if is_hot else rng.choice(["A", "B", "C", "D", None if nulls else "E"])
        rows.append({
            "id": i + 1, "date": date(2019, 1, 1) + timedelta(days=rng.randrange(900)),
            "race_id": 7 if is_hot else rng.randrange(40), "course": rng.choice(["York", "Ayr", "Cork"]),
            "type": rng.choice(["Flat", "NH Flat", "Hurdle"]),
            "class": rng.choice(["Class 1", "Class 4", "Class 6", "Open", None]), "dist": "5f",
            "going": "Good", "draw": rng.randrange(12), "pos": rng.choice(["1", "2", "3", "4", "9", "PU", None]),
            "btn": rng.choice([0.0, 1.0, 2.0, 7.0, None]), "horse": horse,
            "wgt": rng.choice(["9-7", "8-13", None]), "hg": rng.choice(["b", "t", "", None]),
            "jockey": "J" if is_hot else rng.choice(["J1", "J2"]), "trainer": "T" if is_hot else rng.choice(["T1", "T2"]),
            "prize": rng.choice(["£1,234.50", "£900", "n/a", None]),
            "official_rating": rng.choice([50, 61, 77, None]), "jockey_allowance": rng.choice([3, 7, None]),
        })
    ids = [row["id"] for row in rows]
    rng.shuffle(ids)
    for row, new_id in zip(rows, ids, strict=True):
        row["id"] = new_id
    return rows


def half_up(value: float, digits: int) -> float:
    scale = 10**digits
    return math.floor(round(value * scale, 9) + 0.5) / scale


def number(pos):
    return int(pos) if pos is not None and pos.isdigit() else None


def class_no(text):
    digits = "".join(ch for ch in (text or "") if ch.isdigit())
    return float(digits) if digits else 0.0


def history(rows: list[dict], same_day: str = "earlier_rows") -> dict[int, dict]:
    runs, pairs, places = defaultdict(list), defaultdict(list), defaultdict(list)
    value = defaultdict(float)
    for row in rows:
        cash = "".join(ch for ch in (row["prize"] or "") if ch.isdigit() or ch == ".")
        value[row["race_id"]] = max(value[row["race_id"]], float(cash) if cash else 0.0)
    out = {}
    for row in sorted(rows, key=lambda r: (r["date"], r["id"])):
        past, f = runs[row["horse"]], {}
        if past:
            margins = [20.0 if r["btn"] is None else r["btn"] for r in past]
            last = number(past[-1]["pos"])
            f["avg_btn_3"] = half_up(sum(margins[-3:]) / len(margins[-3:]), 2)
            f["avg_btn_5"] = half_up(sum(margins[-5:]) / len(margins[-5:]), 2)
            f["days_since_last"] = (row["date"] - past[-1]["date"]).days
            f["last_pos"] = 20.0 if last is None else float(last)
        else:
            f.update(avg_btn_3=None, avg_btn_5=None, days_since_last=None, last_pos=None)

        classes = []
        for r in past:
            c = class_no(r["class"])
            classes = [] if c == 0 else [*classes, c]
        now = class_no(row["class"])
        if now == 0 or not classes:
            f.update(class_diff=0, avg_class_3=0.0)
        else:
            f["class_diff"] = int(now - classes[-1])
            f["avg_class_3"] = half_up(sum(classes[-3:]) / len(classes[-3:]), 2)

        here = places[row["horse"], row["course"]]
        f["h_course_runs"], f["h_course_wins"] = len(here), sum(p == 1 for p in here)
        placed = sum(p is not None and p <= 3 for p in here)
        f["h_course_place_pc"] = half_up(placed / len(here), 3) if here else 0.0

        oldest = row["date"] - timedelta(days=365)
        together = [
            p for d, p in pairs[row["trainer"], row["jockey"]]
            if d >= oldest and (same_day == "earlier_rows" or d < row["date"])
        ]
        n, wins = len(together), sum(p == 1 for p in together)
        f["combo_runs"], f["combo_wins"] = n, wins
        f["combo_win_pc"] = half_up(wins / n, 3) if n else 0.0
        f["combo_place_pc"] = half_up(sum(p is not None and p <= 3 for p in together) / n, 3) if n else 0.0

        known = past[-1] if past and row["horse"] is not None else None
        worn, before = row["hg"] or "", (known["hg"] or "") if known else ""
        f["gear_change"] = int(worn != "" and worn != before)
        rated = known is not None and row["official_rating"] is not None and known["official_rating"] is not None
        f["or_change"] = row["official_rating"] - known["official_rating"] if rated else 0
        stones = {"9-7": 133, "8-13": 125}.get(row["wgt"])
        f["true_wgt"] = None if stones is None else stones - (row["jockey_allowance"] or 0)
        f["log_prize"] = math.log1p(value[row["race_id"]])
        out[row["id"]] = f

        pos = number(row["pos"])
        past.append(row)
        here.append(pos)
        pairs[row["trainer"], row["jockey"]].append((row["date"], pos))
    return out


def assert_same(df, expected: dict[int, dict]) -> None:
    names = list(next(iter(expected.values())))
    found = {row["id"]: row for row in df.select("id", *names).collect()}
    assert found.keys() == expected.keys()
    for key, want in expected.items():
        for name in names:
            have = found[key][name]
            if want[name] is None or have is None:
                assert have is None and want[name] is None, (key, name, have, want[name])
            else:
                assert abs(have - want[name]) < 1e-9, (key, name, have, want[name])
