"""Plans, sections and ordered operators against plain loops."""

import itertools
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from strandwork.functions import music, text
from strandwork.operators import aggregates as agg, sequences as seq, topk
from strandwork.plans import catalogue, gains, planner, sections
from strandwork.streaming import state


def one(spark, **columns):
    """The values of columns over one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


# --- candidates of all orders ------------------------------------------------------------------------------------------------
def plain_target(v, i):
    gap = abs(v - i) / max(v, i)
    if gap <= 0.04:
        return i
    if gap <= 0.10:
        return i * 0.65 + v * 0.35
    far = i * 0.7 + v * 0.3
    if gap <= 0.20 or abs(v - far) / v <= 0.12:
        return far
    return v * 0.88 if v > far else v * 1.12


def plain_budget(va, da, vb, db):
    t = plain_target(va, vb)
    material = min(min(210, da * 0.75) * (va / t), min(210, db * 0.75) * (vb / t))
    return max(32, math.floor(min(math.floor(t * 210 / 60), math.floor(t * material / 60)) / 4) * 4)


def plain_rising(marks, total):
    snap = lambda x: math.floor(x / 4) * 4
    out = []
    for m in marks:
        at, before = snap(m), out[-1] if out else 0
        if at <= before:
            at = snap(before + 8)
        if at >= total - 4:
            at = snap(total - 8)
            if at <= before:
                at = before + 4
        out.append(at)
    return out


def plain_edges(marks, total):
    return [*plain_rising([math.floor(m if m > 1 else total * m) for m in marks], total), total]


def plain_plans(total):
    """(family, variant, edges) of the plans that stay: at most twelve, one for each structure."""
    seen, out = set(), []
    for family, (labels, configs) in planner.FAMILIES.items():
        for variant, (marks, transition, beats, db) in enumerate(configs):
            edges = plain_edges(marks, total)
            gains = []
            for label in labels:
                row = {}
                for stem, g in zip(planner.STEMS, planner.PRESETS[label]):
                    if label not in planner.UNMOVED:
                        g = max(0.0, min(1.0, g * 10 ** ((db / 20) if stem in planner.VOCAL else -(db / 40))))
                    row[stem] = round(g / 0.2)  # half to even, as the key has it
                gains.append(tuple(sorted(row.items())))
            ways = tuple("fade" if k == 0 else "crossfade" if k == len(labels) - 1 else transition for k in range(len(labels)))
            key = labels, tuple(edges), ways, tuple(gains)
            if key not in seen and len(out) < 12:
                seen.add(key)
                out.append((family, variant, " ".join(map(str, edges))))
    return out


def test_candidates_of_all_orders(spark):
    got = defaultdict(list)
    for r in catalogue.queries()["candidates"](spark, SF001).collect():
        got[r["o_orderkey"]].append((r["family"], r["variant"], r["edges"]))
    orders = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    assert len(got) == len(orders)
    for r in orders:
        total = plain_budget(60.0 + r[0] % 100, 120.0 + r[1] % 240, 70.0 + r[1] % 90, 100.0 + r[0] % 260)
        assert sorted(got[r[0]]) == sorted(plain_plans(total)), total


def test_pool_is_filled_up_and_capped_for_each_total(spark):
    totals = spark.createDataFrame([(t,) for t in (32, 32, 64, 400)], "total_beats int")
    own = {t: plain_plans(t) for t in (32, 64, 400)}
    plans = planner.pool(totals, most=12)
    got = defaultdict(set)
    for r in plans.collect():
        got[r["total_beats"]].add((r["family"], r["variant"]))
    assert got == {t: {(f, v) for f, v, _ in ps} for t, ps in own.items()}
    spare = planner.generated(totals.distinct()).withColumn("variant", F.col("variant") + 50).withColumn("hash", F.concat("family", "variant"))
    for least, most in ((14, 20), (15, 15), (40, 100), (5, 3)):
        filled = defaultdict(list)
        for r in planner.pool(totals, least, most, spare).collect():
            filled[r["total_beats"]].append((r["family_pos"], r["variant"]))
        for t in own:
            n = len({h for h in planned(t)})
            assert len(filled[t]) == min(most, max(n, min(least, n + 13)))
    few = planner.pool(totals.where("total_beats = 400"), 14, 20, spare).where("variant >= 50").collect()
    assert {r["family_pos"] for r in few} <= {1, 2, 3}  # the first family has most plans, so it is filled last


def planned(total):
    return {(f, v) for f, v, _ in plain_plans(total)} | ({("quick_hit", 2)} if len(plain_plans(total)) == 12 else set())


def test_fallback_layouts_in_full(spark):
    totals = [32, 40, 44, 48, 64, 92, 96, 128, 188, 192, 256, 400]
    rows = {r["total_beats"]: r["sections"] for r in planner.fallback(spark.createDataFrame([(t,) for t in totals], "total_beats int")).collect()}
    for total in totals:
        _, layout, shares = next(x for x in planner.LAYOUTS if total >= x[0])
        edges, n = [], len(shares)
        for k, share in enumerate(shares):
            raw = math.floor(total * share)
            edges.append(raw if total < 48 else max((edges[-1] if edges else 0) + 8, min(raw // 16 * 16, total - (n - k) * 8)))
        got = rows[total]
        assert [s["label"] for s in got] == [x[0] for x in layout] and [s["end_beat"] for s in got] == [*edges, total] and [s["start_beat"] for s in got] == [0, *edges]
        for s, (_, lead, backing, rest) in zip(got, layout):
            assert s["stem_gains"] == dict(zip(planner.STEMS, (lead, backing, *rest)))


def test_plans_of_one_pair_are_filled_up(spark):
    plan = lambda h, f, k, v: (h, f, k, v)
    kept = spark.createDataFrame([plan("a", "x", 0, 0), plan("b", "x", 0, 1), plan("c", "y", 1, 0)], "hash string, family string, family_pos int, variant int")
    spare = spark.createDataFrame([plan("a", "x", 0, 5), plan("d", "x", 0, 2), plan("e", "y", 1, 1), plan("f", "z", 2, 0), plan("f", "z", 2, 1)], kept.schema)
    for least, want in ((2, "abc"), (4, "abcf"), (5, "abcef"), (6, "abcdef"), (60, "abcdef")):
        assert "".join(sorted(r["hash"] for r in planner.filled(kept, spare, least).collect())) == want
    counts = {r["family"]: r["n"] for r in planner.family_counts(spark.createDataFrame([("quick_hit",)] * 2, "family string")).collect()}
    assert counts == {f: 2 * (f == "quick_hit") for f in planner.FAMILIES}


@pytest.mark.parametrize("seed", range(4))
def test_backfill_equals_a_sort(spark, seed):
    rng = random.Random(seed)
    kept = [(i, rng.choice("abc")) for i in range(40)]
    spare = [(rng.randrange(20, 400), rng.choice("abcde")) for _ in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, f string")
    least = rng.choice([30, 60, 120, 500])
    fresh = {}
    for i, f in spare:
        if i not in dict(kept):
            fresh.setdefault(i, set()).add(f)
    ranked = sorted((sum(f == g for _, g in kept), i) for i, fs in fresh.items() for f in list(fs)[:1] if len(fs) == 1)
    spare = [(i, f) for i, f in set(spare) if i in dict(kept) or len(fresh[i]) == 1]
    got = topk.backfilled(frame(kept), frame(spare), "id", "f", "id", least).collect()
    want = sorted([i for i, _ in kept] + [i for _, i in ranked[: max(0, least - len(kept))]])
    assert sorted(r["id"] for r in got) == want


# --- marks and sections ---------------------------------------------------------------------------------------------------------
def plain_grid(marks, total):
    marks = sorted({m for m in (round(x / 4) * 4 for x in marks) if 0 < m < total})
    while True:
        points = [0, *marks, total]
        kept = [m for k, m in enumerate(marks, 1) if m - points[k - 1] >= 4 and points[k + 1] - m >= 4]
        if kept == marks:
            return marks
        marks = kept


def test_marks_on_grids(spark):
    rng = random.Random(6)
    rows = [([rng.uniform(-3, 70) for _ in range(rng.randrange(0, 12))], rng.randrange(1, 66)) for _ in range(60)]
    data = spark.createDataFrame([(k, m, t) for k, (m, t) in enumerate(rows)], "k int, marks array<double>, total int")
    got = {r["k"]: r for r in data.select("k", seq.to_grid(F.col("marks"), F.col("total")).alias("grid"), seq.rising_marks(F.col("marks"), F.col("total")).alias("rising")).collect()}
    for k, (marks, total) in enumerate(rows):
        assert got[k]["grid"] == plain_grid(marks, total)
        assert got[k]["rising"] == plain_rising(marks, total)


def test_bar_grids(spark):
    grid = lambda down, beats, n: one(spark, g=seq.bar_grid(F.array(*map(F.lit, down)).cast("array<double>"), F.array(*map(F.lit, beats)).cast("array<int>"), F.lit(n)))["g"]
    assert grid([0.0, 0.5, 1.0, 9.0], [1], 22050) == [0, 11025, 22050]
    assert grid([0.5], list(range(0, 90, 10)), 22050) == [0, 20480, 22050]
    assert grid([0.5], [1, 2], 100) == [0, 100]


def test_spaced_boundaries_equal_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(s, bar, round(rng.choice([0.01, 0.02, 0.3, 0.5, 0.5, 0.9]) + (rng.random() * 0.01 if s else 0), 6)) for s in range(3) for bar in range(1, 90)]
    got = {r["song"]: r["bars"] for r in seq.boundaries(spark.createDataFrame(rows, "song int, bar int, change double"), ["song"], "bar").collect()}
    for s in range(3):
        x = [h for q, _, h in rows if q == s]
        ordered = sorted(x)
        limit = max(3 * (ordered[len(x) // 2] + ordered[(len(x) - 1) // 2]) / 2, 0.05)
        peaks, k = [], 1
        while k < len(x) - 1:
            e = k
            while e + 1 < len(x) and x[e + 1] == x[k]:
                e += 1
            if x[k - 1] < x[k] and e + 1 < len(x) and x[e + 1] < x[k] and x[k] >= limit:
                peaks.append(((k + 1 + e + 1) // 2, x[k]))  # bars count from 1
            k = e + 1
        kept = []
        for p, h in sorted(peaks, key=lambda q: (q[1], q[0]), reverse=True):
            if all(abs(p - q) >= 4 for q in kept):
                kept.append(p)
        assert got.get(s, []) == sorted(kept)


def plain_absorbed(rows):
    """One merge at a time by the rule of a pass, on a list of [start, end, rank]."""
    rows = [list(r) for r in rows]
    while len(rows) > 1:
        out, k, changed = [], 0, False
        while k < len(rows):
            s, e, r = rows[k]
            left = rows[k - 1][2] if k > 0 else None
            right = rows[k + 1][2] if k < len(rows) - 1 else None
            if e - s < 4 and (left is not None or right is not None):
                changed = True
                if right is None or left is not None and left >= right:
                    out[-1][1], out[-1][2] = e, max(out[-1][2], r)
                else:
                    out.append([s, rows[k + 1][1], max(r, right)])
                    k += 1
            else:
                out.append([s, e, r])
            k += 1
        rows = out
        if not changed:
            break
    return [tuple(r) for r in rows]


def test_short_sections_are_absorbed(spark):
    rng, rows = random.Random(9), []
    for song in range(25):
        at = 0
        for _ in range(rng.randrange(1, 12)):
            n = rng.choice([1, 2, 3, 4, 8])
            rows.append((song, at, at + n, rng.randrange(5)))
            at += n
    got = defaultdict(list)
    for r in seq.absorb_short(spark.createDataFrame(rows, "song int, a int, b int, rank int"), ["song"], "a", "b", "rank").collect():
        got[r["song"]].append((r["a"], r["b"], r["rank"]))
    for song in range(25):
        assert sorted(got[song]) == plain_absorbed([r[1:] for r in rows if r[0] == song])


def test_short_sections_of_all_orders(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").collect():
        lines[r[0]].append(tuple(r[1:]))
    got = defaultdict(list)
    for r in catalogue.queries()["absorbed_sections"](spark, SF001).collect():
        got[r["l_orderkey"]].append((r["start"], r["end"], r["rank"], r["label"]))
    assert set(got) == set(lines)
    merges = 0
    for order, rows in lines.items():
        at, songs = 0, []
        for _, part, supplier, flag in sorted(rows):
            songs.append((at, at + part % 7 + 1, supplier % 5, flag))
            at += part % 7 + 1
        want = plain_absorbed([s[:3] for s in songs])
        assert [s[:3] for s in sorted(got[order])] == want
        assert {s[3] for s in got[order]} <= {s[3] for s in songs}
        merges += len(songs) - len(want)
        if len(songs) == 2 and len(want) == 1:  # the label of the one that absorbs
            first, second = songs
            assert got[order][0][3] == (second if first[1] - first[0] < 4 else first)[3]
    assert merges > 100


def song_bars(spark):
    """A quiet start, a sung loud middle, an end without vocals."""
    level = lambda bar: 0.05 if bar < 8 else 0.9 if bar < 24 else 0.1
    rows = [("s", stem, bar, level(bar) * k * (0.0 if stem == "vocals" and not 8 <= bar < 24 else 1.0)) for stem, k in (("vocals", 1.0), ("drums", 0.8), ("bass", 0.6), ("guitar", 0.5), ("piano", 0.4), ("other", 0.3)) for bar in range(32)]
    return spark.createDataFrame(rows, "song_id string, stem string, bar int, rms double")


def test_sections_of_a_song_with_three_parts(spark):
    rows = sorted(sections.analysed(song_bars(spark)).collect(), key=lambda r: r["start_bar"])
    assert [(r["start_bar"], r["end_bar"]) for r in rows] == [(0, 8), (8, 24), (24, 32)]
    assert rows[0]["label"] == "intro" and rows[1]["label"] == "chorus" and rows[2]["label"] == "instrumental"  # the end is of medium level, without vocals
    assert [r["vocal_status"] for r in rows] == ["vox:no", "vox:yes", "vox:no"] and "DROP" in rows[1]["annotations"]


def test_sections_of_others_keep_their_labels(spark):
    given = spark.createDataFrame([("s", 0, 12, "hook"), ("s", 12, 32, "verse")], "song_id string, start_bar int, end_bar int, label string")
    rows = sorted(sections.enriched(song_bars(spark), given).collect(), key=lambda r: r["start_bar"])
    assert [(r["start_bar"], r["end_bar"], r["label"], r["section_source"]) for r in rows] == [(0, 12, "hook", "enriched"), (12, 32, "verse", "enriched")]
    assert rows[1]["vocal_status"] in ("vox:yes", "vox:fading") and rows[1]["prominence_db"] is not None and rows[0]["energy_level"] != "silent"


def test_degenerate_songs_are_healed(spark):
    kind = "song_id string, energy array<double>, active array<boolean>, sections array<struct<start_bar:int,end_bar:int,label:string>>"
    songs = spark.createDataFrame([("s", [0.0, 0.0], [False], []), ("kept", [0.1], [False], []), ("lost", [], [], [(0, 4, "mine")])], kind)
    rows = {r["song_id"]: r for r in sections.healed(songs, song_bars(spark)).collect()}
    assert {k: r["healed"] for k, r in rows.items()} == {"s": True, "kept": False, "lost": False}
    assert len(rows["s"]["energy"]) == 32 and any(rows["s"]["active"]) and [x["label"] for x in rows["s"]["sections"]] == ["intro", "chorus", "instrumental"]
    assert rows["kept"]["energy"] == [0.1] and rows["lost"]["sections"][0]["label"] == "mine"
    old = spark.createDataFrame([("s", [0.0], [False], [(0, 4, "mine")])], kind)
    assert [x["label"] for x in sections.healed(old, song_bars(spark)).first()["sections"]] == ["mine"]


def test_song_sections_of_users_cover_their_days(spark):
    found = defaultdict(list)
    for r in sorted(catalogue.queries()["song_sections"](spark, SF001).collect(), key=lambda r: r["start_bar"]):
        found[r["song_id"]].append(r)
    days = {r[0]: r[1] for r in spark.read.parquet(f"{SF001}/events.parquet").groupBy("user_id").agg(F.count_distinct(F.to_date("ts"))).collect()}
    assert found.keys() == days.keys()
    for user, rows in found.items():
        assert rows[0]["start_bar"] == 0 and rows[-1]["end_bar"] == days[user] and all(a["end_bar"] == b["start_bar"] and a["label"] != b["label"] for a, b in itertools.pairwise(rows))


# --- names, scales, arrays -------------------------------------------------------------------------------------------------------
def test_names_of_files(spark):
    cases = {
        "a/b/01. Artist_-_Song (Official Audio).mp3": ("Artist", "Song"), "Artist - Song [HD] (Live at Home) {feat. X}.flac": ("Artist", "Song"), "Artist - Song (Remastered).wav": ("Artist", "Song"), "Artist - A - B.mp3": ("Artist", "A - B"),
        "Artist - Song (2011 Remaster)-dQw4w9WgXcQ.mp3": ("Artist", "Song"), "Artist - Song (Lyric Video) (Official   Music Video).mp3": ("Artist", "Song"), "Artist - Song (Official (HD)Audio).mp3": ("Artist", "Song"), "NoSplit.mp3": None,
        " - Song.mp3": None, "12 - Artist - Song.mp3": ("Artist", "Song"), "Artist - Alive.mp3": ("Artist", "Alive"), "Artist - Song (ft Y) (Liver).mp3": ("Artist", "Song"),
    }
    rows = spark.createDataFrame([(n,) for n in cases], "n string").select("n", text.artist_title(F.col("n")).alias("p")).collect()
    assert {r["n"]: r["p"] and tuple(r["p"]) for r in rows} == cases


def test_major_scales_by_steps():
    semitone = lambda n: music.WHITE[n[0]] + n.count("#") - n.count("b")
    for tonic in music.TONICS:
        notes = music.major_scale(tonic)
        assert [(semitone(n) - semitone(tonic)) % 12 for n in notes] == [0, 2, 4, 5, 7, 9, 11]
        assert "".join(n[0] for n in notes) == ("CDEFGAB" * 2)["CDEFGAB".index(tonic[0]) :][:7] and notes[0] == tonic
    assert music.major_scale("A") == ["A", "B", "C#", "D", "E", "F#", "G#"] and music.major_scale("Gb")[3] == "Cb"


def test_chords_in_all_keys(spark):
    for tonic in music.TONICS:
        scale = music.major_scale(tonic)
        chords = [n + q for n, q in zip(scale, ("", "m", "m7", "maj7", "7", "m", "dim"))]
        got = one(spark, **{f"c{k}": music.roman(F.lit(x), F.lit(tonic)) for k, x in enumerate(chords)})
        assert list(got) == ["I", "ii", "iii", "IV", "V", "vi", "vii"]


def test_samples_of_arrays(spark):
    for n, size in itertools.product((1, 3, 60), (0, 1, 2, 3, 7, 61, 200)):
        items = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array().cast("array<int>")
        got = one(spark, even=text.even_sample(items, n), step=text.step_sample(items, n))
        assert got["even"] == (list(range(size)) if size <= n else [k * (size - 1) // max(1, n - 1) for k in range(n)])
        assert got["step"] == (list(range(size)) if size <= n else [k * size // n for k in range(n)])


def test_dominant_colours(spark):
    body = bytes([200, 30, 30] * 300 + [20, 200, 40] * 100 + [255, 255, 255] * 500)
    rows = [("a", bytes(256) + body + bytes(256)), ("short", b"x" * 100), ("dark", bytes(2000)), ("white", b"\xff" * 2000)]
    got = {r["k"]: r["colour"] for r in agg.dominant_colour(spark.createDataFrame(rows, "k string, data binary"), "k", "data").collect()}
    assert got == {"a": "#d01010", "short": "#333333", "dark": "#101010", "white": "#f0f0f0"}


# --- states -------------------------------------------------------------------------------------------------------------------------
def plain_leases(log):
    """A lease protocol told anew: who holds a key until when, and what became of it."""
    owner = until = None
    status, failed, attempts, retry = "missing", None, 0, None
    out = []
    for op, token, t in log:
        if status == "failed" and t - failed > 86_400:
            owner, until, status, failed, attempts, retry = None, None, "missing", None, 0, None
        running = owner is not None and t < until
        if op == "acquire":
            if running:
                out.append("busy")
            elif status == "ready":
                out.append("hit")
            elif status == "failed" and attempts >= 5:
                out.append("held")
            elif status == "failed" and t < retry:
                out.append("waiting")
            else:
                out.append("takeover" if status == "processing" else "granted")
                owner, until, status, attempts = token, t + 90, "processing", attempts + 1
        elif not running or owner != token:
            out.append("not_owner")
        elif op == "renew":
            until = t + 90
            out.append("renewed")
        else:
            owner = until = None
            if op == "ready":
                status, attempts = "ready", 0
                out.append("ready")
            elif op == "fail":
                status, failed, retry = "failed", t, t + min(600, 30 * 2 ** (attempts - 1))
                out.append("failed")
            else:
                status = "ready" if status == "ready" else "missing"
                out.append("released")
    return out


def test_leases_equal_another_telling(spark):
    rng, rows = random.Random(2), []
    for key in [*range(12), None]:
        t = 0.0
        for _ in range(300):
            t += rng.choice([1, 5, 40, 100, 700, 90_000 if rng.random() < 0.05 else 3])
            rows.append((key, rng.choice(["acquire", "acquire", "renew", "ready", "fail", "release"]), rng.choice("ab"), t))
    got = defaultdict(list)
    out = state.replay_leases(spark.createDataFrame(rows, "key long, op string, token string, t double").repartition(5)).collect()
    for r in sorted(out, key=lambda r: (r["t"], r["op"], r["token"])):
        got[r["key"]].append(r["outcome"])
    for key in got:
        assert got[key] == plain_leases([r[1:] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1], r[2]))])
    assert len({o for x in got.values() for o in x}) >= 9


def test_song_sections_deal_songs_by_the_number_of_events(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "EVENTS_A_TASK", 40)
    plan = catalogue.queries()["song_sections"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{SF001}/events.parquet").count() // 40)
    assert f", {n})" in plan and "hashpartitioning(user_id#" in plan


def test_stems_are_made_where_their_plan_lies(spark):
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert dealt(catalogue.queries()["gain_constraints"](spark, SF001)) == 1
    rows = spark.createDataFrame([(1, 1, "verse", "high", 2, "drums", "lead", None)], "plan_id int, idx int, label string, energy string, pos int, stem string, role string, lufs double")
    out = gains.gains(rows)
    assert dealt(out) == 1 and "n_instrumental" not in out.columns and out.first()["gain"] == 1.0


def test_song_sections_make_bars_once_a_step(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["song_sections"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan parquet") == 1 and plan.count("Join") == 1
    assert not re.search(r"hashpartitioning\(song_id#\w+, (bar|stem)#", plan)  # only what is told of a segment is dealt again


def test_segments_told_in_one_grouping_are_as_told_by_each_operator(spark):
    rng = random.Random(5)
    stems = ("vocals", "drums", "bass", "guitar", "piano")
    rows = [(song, stem, bar, rng.choice([0.0, 0.0005, rng.random(), rng.random()])) for song in range(6) for bar in range(5 + 7 * song) for stem in stems if rng.random() < 0.8 or stem == "bass"]
    bars = spark.createDataFrame([*rows, (None, "bass", 0, 1.0)], "song_id long, stem string, bar int, rms double").cache()
    states = sections.bar_states(bars).cache()
    spans = sections.segments(states)
    assert {r["song_id"] for r in states.select("song_id").distinct().collect()} == set(range(6))
    covered = sections.within(states.withColumn("vocal_peak", F.lit(1.0)), spans).cache()
    own = bars.join(covered.select("song_id", "bar", "segment", "vocal_active"), ["song_id", "bar"])
    same = lambda a, b: [[f"{x:.9g}" if isinstance(x, float) else x for x in r] for r in sorted(a.collect())] == [[f"{x:.9g}" if isinstance(x, float) else x for x in r] for r in sorted(b.collect())]
    key = sections.SEGMENT
    want = agg.activity_status(covered, key, "vocal_active", "bar").join(agg.trajectory(covered, key, "bar"), key).join(seq.builds(covered, key, "bar", "norm"), key)
    assert same(sections.placed(bars, covered).select(*own.columns), own.select(*own.columns))
    assert same(sections.told_by_bars(covered).select(*key, "vocal_status", "trajectory", "is_build", "first_quarter"), want.select(*key, "vocal_status", "trajectory", "is_build", "first_quarter"))
    want = agg.density(own, sections.SONG, "segment", "stem", "rms").join(own.where("stem = 'drums'").groupBy(*key).agg(F.avg("rms").alias("drum_mean")), key, "left").join(agg.prominence(own, key, "stem", "vocal_active", "rms", "vocals", 3), key, "left")
    got = sections.told_by_stems(bars, covered, "drums", "vocals").fillna(-1.0)
    assert same(got.select(*key, "density", "drum_mean", "prominence_db"), want.fillna(-1.0).select(*key, "density", "drum_mean", "prominence_db"))
    series = bars.where("song_id is not null").select("song_id", "stem", "bar", "rms").unionByName(states.select("song_id", F.lit("*").alias("stem"), "bar", F.col("norm").alias("rms")))
    assert same(seq.change_signal(series, sections.SONG, "bar", "stem", "rms"), states.where("change is not null").select("song_id", "bar", "change"))
    whole = agg.normalised_buckets(states.select("song_id", "bar", "energy"), sections.SONG, "energy")
    assert same(whole.select("song_id", "bar", "norm", "p10", "p50", "p85"), states.select("song_id", "bar", "norm", "p10", "p50", "p85"))
