"""The day's mixes against the same rules written out over lists."""

import datetime
import math
import random
from collections import Counter, defaultdict

from cantata.operators import mixes

DAY = datetime.date(2024, 6, 30)
KIND = "who int, song int, artist string, families array<string>, year int, added date, plays double, past double"


def fnv(text):
    h = 0x811C9DC5
    for b in text.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def library(who, n, seed):
    r = random.Random(seed)
    genres = ["rock", "pop", "jazz", "folk", "tag:odd"]
    for i in range(n):
        families = r.sample(genres, r.choice([0, 1, 1, 1, 2]))
        added = DAY - datetime.timedelta(r.choice([3, 10, 29, 30, 200, 900]) if who == 1 else r.choice([0, 400, 500, 600]))
        yield who, who * 1000 + i, r.choice(["", *"abcdefghijkl"]), families or None if i % 2 else families, r.choice([None, 1890, 1975, 1988, 1999, 2001, 2024, 2031]), added, float(r.choice([0, 0, 1, 2, 5])), float(r.choice([0, 1, 3]))


def by_hand(rows):
    """One listener's mixes, (kind, key, songs) in turn."""
    songs = [dict(zip(mixes.SONG, r, strict=True)) for r in rows]
    if len(songs) < mixes.LEAST_LIBRARY:
        return []
    votes = defaultdict(Counter)
    for s in songs:
        s["families"] = s["families"] or []
        votes[s["artist"]].update(s["families"])
    for s in songs:
        if not s["families"] and votes[s["artist"]]:
            s["families"] = [min(votes[s["artist"]].items(), key=lambda x: (-x[1], x[0]))[0]]
    of, heard = defaultdict(list), Counter()
    for s in songs:
        for f in s["families"]:
            of[f].append(s)
            heard[f] += s["plays"] / len(s["families"])
    played = sorted((s for s in songs if s["plays"] > 0), key=lambda s: (-s["plays"], s["song"]))
    tried = []
    if len(played) >= mixes.LEAST_PLAYED:
        weights = Counter()
        for s in played[:50]:
            for f in s["families"]:
                weights[f] += s["plays"] / len(s["families"])
        near = sorted(weights, key=lambda f: (-weights[f], f))[:3]
        tried.append(("favorites", "", played[:100], [s for f in near for s in of[f]] if near else songs, "plays", False))
    for f in sorted((f for f in of if len(of[f]) >= mixes.LEAST_GENRE), key=lambda f: (-(heard[f] + 0.01 * len(of[f])), f)):
        more = {s["artist"] for s in of[f]} - {""} if len(of[f]) < mixes.LEAST_SONGS else set()
        tried.append(("genre", f, of[f], [s for s in songs if s["artist"] in more], "plays", True))
    fresh = [s for s in songs if (DAY - s["added"]).days < mixes.FRESH_DAYS]
    if len(fresh) * 2 <= len(songs):
        tried.append(("fresh", "", fresh, [], "added", False))
    tried.append(("rediscover", "", [s for s in songs if s["past"] > 0 and s["plays"] <= 0], [], "past", False))
    liked = sorted((f for f in heard if heard[f] > 0), key=lambda f: (-heard[f], f))[:3]
    tried.append(("discover", "", [s for f in liked for s in of[f] if s["plays"] <= 0 and s["past"] <= 0], [], "plays", True))
    decades = defaultdict(list)
    for s in songs:
        if s["year"] and 1900 <= s["year"] <= DAY.year and s["families"]:
            decades[s["year"] // 10 * 10].append(s)
    every = Counter(s["year"] // 10 * 10 for s in songs if s["year"])
    sums = Counter()
    for s in songs:
        if s["year"]:
            sums[s["year"] // 10 * 10] += s["plays"]
    cores = {}
    for d, own in decades.items():
        weights = Counter()
        for s in own:
            for f in s["families"]:
                weights[f] += (1 + s["plays"]) / len(s["families"])
        top = sorted(weights, key=lambda f: (-weights[f], f))[:2]
        core = [s for s in own if set(top) & set(s["families"])]
        if len(core) >= mixes.LEAST_DECADE:
            cores[d] = core
    for d in sorted(cores, key=lambda d: (-sums[d], -every[d], -d)):
        tried.append(("decade", str(d), cores[d], [], "plays", True))
    artists = defaultdict(list)
    for s in songs:
        artists[s["artist"]].append(s)
    anchors = sorted((a for a in artists if a and len(artists[a]) >= 3), key=lambda a: (-sum(s["plays"] for s in artists[a]), -len(artists[a]), a))
    for a in anchors:
        beside = {f for s in artists[a] for f in s["families"]}
        tried.append(("artist", a, artists[a], [s for s in songs if beside & set(s["families"]) or not (beside or s["families"])], "plays", True))
    given, used, mostly = [], set(), sum(bool(s["families"]) for s in songs) * 2 >= len(songs)
    top = max(s["plays"] for s in songs)
    for kind, key, core, beside, lead, shuffled in tried:
        pool = list({s["song"]: s for s in core + beside}.values())
        full = len(given) >= mixes.MOST_MIXES or sum(k == kind for k, _, _ in given) >= mixes.MOST.get(kind, 1)
        needless = kind == "artist" and (any(x == key for _, x, _ in given) or (sum(k != "artist" for k, _, _ in given) >= 3 and mostly))
        if len(pool) < mixes.LEAST_SONGS or full or needless:
            continue
        draw = lambda s: fnv(f"{DAY}|{s['song']}")
        number = lambda s: s["added"].toordinal() if lead == "added" else s[lead]  # noqa: B023, E731
        seed = min(core, key=lambda s: (-number(s), draw(s) if shuffled else 0, s["song"]))  # noqa: B023
        chosen = compose(sorted(pool, key=lambda s: s["song"]), seed, used, top, key if kind == "artist" else None, draw)
        found = lambda k: k in mixes.DISCOVERIES
        same = any(found(k) == found(kind) and len(set(x) & set(chosen)) > mixes.OVERLAP * min(len(x), len(chosen)) for k, _, x in given)
        if len(chosen) >= mixes.LEAST_SONGS and not same:
            given.append((kind, key, chosen))
            used |= set(chosen)
    return given


def compose(pool, seed, used, top, anchor, draw):
    """The songs of a mix, one by one."""
    target, mix, refill = min(40, len(pool)), [seed], 0
    cap = max(2, math.ceil(target * 0.2))
    while len(mix) < target:
        weights, total = Counter(), 0.0
        for back, s in enumerate(reversed(mix[-12:])):
            if s["families"]:
                total += 0.75**back
                for f in s["families"]:
                    weights[f] += 0.75**back / len(s["families"])
        session = [s["artist"] for s in mix]

        def score(s):
            x = 1.5 * ((draw(s) * 2654435761 + refill * 40503) % 2**32) / 2**32  # noqa: B023
            x += 2.5 * math.log1p(s["plays"]) / math.log1p(top) if s["plays"] > 0 else 0
            x -= 1.5 * (s["song"] in used)
            x += 6 * min(1, sum(weights[f] for f in s["families"]) / total) if total else 0  # noqa: B023
            a = s["artist"]
            if not a:
                return x
            x += 2 * (a == anchor) + 2 * (a == seed["artist"])
            if a not in session:  # noqa: B023
                return x + 1
            return x - 6 * 0.7 ** session[::-1].index(a) - 1.5 * min(4, session.count(a))  # noqa: B023

        scores = {s["song"]: score(s) for s in pool}
        left = [s for s in pool if s not in mix and session.count(s["artist"]) < cap]
        latest, picked, chosen = list(session), set(), []
        while len(chosen) < min(6, target - len(mix)) and left:
            for barred in ({*latest[-3:], *picked}, {latest[-1]}, set()):
                fit = [s for s in left if not s["artist"] or s["artist"] not in barred]
                if fit:
                    break
            best = max(fit, key=lambda s: (scores[s["song"]], -s["song"]))  # noqa: B023
            left.remove(best)
            chosen.append(best)
            latest.append(best["artist"])
            picked.add(best["artist"])
        before = len(mix)
        for s in chosen:
            names = [x["artist"] for x in mix]
            if names.count(s["artist"]) < cap and not (s["artist"] and s["artist"] == names[-1]):
                mix.append(s)
        refill += 1
        if len(mix) == before:
            break
    return [s["song"] for s in mix]


def test_mixes_are_those_worked_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixes, "FIRST_ARTISTS", 2)
    libraries = {1: list(library(1, 260, 1)), 2: list(library(2, 120, 2)), 3: list(library(3, 29, 3))}
    libraries[4] = [(4, 4000 + i, "abc"[i % 3], [], None, DAY - datetime.timedelta(99), 1.0, 0.0) for i in range(60)]
    libraries[5] = [(5, 5000 + i, f"artist {i % 21:02}", None, None, DAY - datetime.timedelta(i % 9 * 40), float(i % 4), 0.0) for i in range(126)]
    df = spark.createDataFrame([r for rows in libraries.values() for r in rows], KIND)
    got = defaultdict(dict)
    for r in mixes.library_mixes(df, DAY).collect():
        got[r["who"], r["turn"], r["kind"], r["key"]][r["place"]] = r["song"]
    wanted = {(who, turn, kind, key): dict(enumerate(songs, 1)) for who, rows in libraries.items() for turn, (kind, key, songs) in enumerate(by_hand(rows), 1)}
    assert {w for w, *_ in wanted} >= {1, 2} and {"favorites", "genre", "fresh", "rediscover"} <= {k[2] for k in wanted}
    assert sorted(got) == sorted(wanted)
    assert got == wanted
    untagged = [k for k in wanted if k[0] == 5]
    assert len([k for k in untagged if k[2] == "artist"]) == 2  # all 21 were tried
    artist_of = {r[1]: r[2] for rows in libraries.values() for r in rows}
    for songs in got.values():
        names = [artist_of[songs[p]] for p in sorted(songs)]
        assert all(a != b or not a for a, b in zip(names, names[1:], strict=False))  # none twice in a row


def test_no_songs_no_mixes(spark):
    assert mixes.library_mixes(spark.createDataFrame([], KIND), DAY).count() == 0
