"""Synthetic pitch logs with every column of the export, and a plain-Python account of the stages."""

from __future__ import annotations

import datetime as dt
import random

from dugout import columns as C

TYPES = {c: t for t, names in C.RAW_TYPES.items() for c in names}
EXTRA = [f"extra_{i}" for i in range(1, 8)]
NAMES = [*TYPES, *EXTRA]
DDL = ", ".join(f"`{c}` {TYPES.get(c, 'string')}" for c in NAMES)


def pitch(**values):
    row = {c: None for c in NAMES}
    row.update(balls=0, strikes=0, fld_score=3, bat_score=1, sz_top=3.5, sz_bot=1.5, inning=1, inning_topbot="Top",
               stand="R", p_throws="R", pitch_name="x", extra_1="kept")
    row.update(values)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], DDL)


def season_log(seed=3, pitchers=(1, 2), games=6, per_game=25):
    """Shuffled rows with the awkward cases: two pitchers in one game, unclassified pitches at the
    start and in the middle of an appearance, unknown codes, a game that starts mid-count, two
    games on one date, an unknown stance."""
    rnd = random.Random(seed)
    rows = []
    day = dt.date(2023, 4, 1)
    for g in range(games):
        if g != 3:  # games 2 and 3 share a date
            day += dt.timedelta(days=100)
        for p in pitchers:
            ab, pn = 1, 1 if rnd.random() < 0.7 else 2
            for _ in range(per_game):
                rows.append(
                    pitch(
                        pitcher=p, game_pk=100 + g, game_date=day, at_bat_number=ab, pitch_number=pn,
                        batter=rnd.randrange(4), pitch_type=rnd.choice(["FF", "SL", "CH", "ZZ", "UN", None]),
                        release_speed=rnd.random() * 10, description=rnd.choice(["ball", "foul", None]),
                        events=rnd.choice(["single", "walk", None, None]), woba_value=rnd.choice([0.0, 0.9, None]),
                        balls=rnd.randrange(4), strikes=rnd.randrange(3), stand=rnd.choice(["L", "R", None]),
                        game_type="R",
                    )
                )
                if rnd.random() < 0.3:
                    ab, pn = ab + 1, 1
                else:
                    pn += 1
    rnd.shuffle(rows)
    return rows


def expected(rows):
    """What the stages must give, by row key (pitcher, game, raw appearance, pitch number)."""
    out = {}
    known = [r for r in rows if r["pitch_type"] is not None]
    for p in {r["pitcher"] for r in known}:
        mine = sorted(
            (r for r in known if r["pitcher"] == p),
            key=lambda r: (r["game_date"], r["game_pk"], r["at_bat_number"], r["pitch_number"]),
        )
        flat = []
        for g in dict.fromkeys(r["game_pk"] for r in mine):
            game = [r for r in mine if r["game_pk"] == g]
            pa, last = 0, {}
            entries = []
            for i, r in enumerate(game):
                pa += r["pitch_number"] == 1
                e = {"row": r, "pa": pa, "n": i + 1, "seq": i,
                     "prev_speed": game[i - 1]["release_speed"] if i else None,
                     "prev_description": game[i - 1]["description"] if i else None}
                entries.append(e)
                if r["events"] is not None:
                    last[pa] = r["events"]
                last.setdefault(pa, None)
            order = list(dict.fromkeys(e["pa"] for e in entries))
            for e in entries:
                k = order.index(e["pa"])
                e["prev_events"] = last[order[k - 1]] if k else None
            entries.sort(key=lambda e: (e["pa"], e["row"]["pitch_number"], e["seq"]))
            for i, e in enumerate(entries):
                e["prev_type"] = entries[i - 1]["row"]["pitch_type"] if i else None
            flat += entries
        met, seen = {}, {}
        for e in flat:  # already in order of date, game, appearance, pitch
            key = (e["row"]["game_pk"], e["pa"])
            if key not in met:
                batter = e["row"]["batter"]
                met[key] = seen.get(batter, 0)
                seen[batter] = met[key] + 1
            e["met"] = met[key]
        codes = [e["row"]["pitch_type"] if e["row"]["pitch_type"] in C.PITCH_CODES else "OTHER" for e in flat]
        for i, e in enumerate(flat):
            before = codes[max(0, i - 3):i]
            e["rates"] = {c: before.count(c) / len(before) if before else None for c in C.RATE_BUCKETS}
            r = e["row"]
            out[(p, r["game_pk"], r["at_bat_number"], r["pitch_number"])] = e
    return out
