"""Conversation repair, source divergence and nearest neighbours against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import divergence, neighbours, repair  # noqa: E402

# --- conversation repair


def cheapest(symbols):
    """All edit sequences by depth-first search with memory: symbols of (initial, must go, truncated) to cost, audit."""
    sys.setrecursionlimit(10_000)

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @cache
    def go(i, state, inserts):
        out = []
        if i == len(symbols) and state in ("", "a"):
            out.append((0, ""))
        if inserts < 4:
            for made in "ua":
                if (to := after(state, made)) is not None:
                    cost, audit = go(i, to, inserts + 1)
                    out.append((cost + 3, "I" + audit))
        if i < len(symbols):
            initial, must, cut = symbols[i]
            cost, audit = go(i + 1, state, 0)
            out.append((cost + 4, "D" + audit))
            if not must:
                for edit, price, role in (("K", 0, initial), ("R", 3, "u"), ("R", 3, "a")):
                    if (to := after(state, role)) is not None:
                        cost, audit = go(i + 1, to, 0)
                        out.append((cost + price + 3 * cut, edit + audit))
        return min(out, default=(10**9, ""))

    return go(0, "", 0)


def brute_repair(turns):
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in convs.items():
        name = lambda x: " " if x is None else str(x)
        now = []
        for turn, role, text in rows:
            kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            now += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        now.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in now:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, *_ in now if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(now))
        cost, audit = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(now, faults, strict=True)))
        pieces, state, rows_ = [], "", iter(now)
        for edit in audit:
            made = "assistant" if state == "u" else "user"
            if edit == "I":
                state = made[0]
                pieces.append(made + ":")
                continue
            _, role, text = next(rows_)
            if edit != "D":
                role = role if edit == "K" else made
                state = role[:1]
                pieces.append(f"{role}:{text}")
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest())
    return out


def conversations():
    rng = np.random.default_rng(8)
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "User"]
    texts = ["Yes.", "No!", "well", "", " \n", None, "One. Two", "Why? ", "é?", "end."]
    rows = []
    for conv in range(120):
        n = int(rng.integers(1, 10))
        for turn in range(n):
            regular = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if regular else roles[int(rng.integers(len(roles)))]
            rows.append((conv, None if rng.random() < 0.05 else turn * int(rng.integers(1, 3)), role, texts[int(rng.integers(len(texts)))] if rng.random() < 0.6 else f"text {conv} {turn}."))
    rows += [(None, i, roles[i % 3], f"t{i % 7}.") for i in range(30)] + [(500, 1, "user", "same.")] * 40 + [(501, i, "assistant", "x" * 50_000) for i in range(6)]
    rows += [(502, i % 90, roles[int(rng.integers(5))], f"{int(rng.integers(60))}" + ".!x"[int(rng.integers(3))]) for i in range(300)]
    # every row of a conversation may be damaged away
    gone = next(c for c in range(600, 5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Hello.")]


@pytest.mark.parametrize("block, group", [(256, 256), (3, 2)])
def test_repair_equals_all_edit_sequences(spark, block, group):
    """Whole conversations as one block, and cut into small blocks and groups."""
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS signature", "2 AS copies")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(frame, block, group).collect()}
    assert got == brute_repair(rows)


def test_repair_of_nothing(spark):
    assert repair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# --- source divergence


def brute_divergence(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in spread if spread[t] >= 10)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:10]
            out |= {(lang, s, part, o, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, o) in enumerate(found)}
    return out


def texts():
    rng = np.random.default_rng(9)
    words = ["alpha", "Beta", "GAMMA", "straße", "Éa", "日本", "a\x7fb", "x1y", "İi", "don't", "é-è", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(["en", "fr", None][int(rng.integers(3))], [None, "s1", "s2", "S3", "é"][int(rng.integers(5))], " ".join(rng.choice(words, int(rng.integers(0, 40)), p=None))) for _ in range(300)]
    rows += [("en", "s1", "alpha beta " * 3000), ("en", "hot", "alpha")] + [("en", "hot", "alpha alpha gamma")] * 200
    return rows + [("de", "only", "few words here"), ("de", "other", None), ("es", "alone", "uno"), ("it", "a", ""), (None, None, None)]


@pytest.mark.parametrize("sources, shard, held", [(128, 2048, 1 << 18), (2, 3, 20)])
def test_divergence_equals_brute_force(spark, monkeypatch, sources, shard, held):
    """One shard and block, and small shards, blocks and merges."""
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS place", "'k' AS term", "2 AS n")
    cells = divergence.term_cells(docs)
    groups = divergence.group_sizes(cells)
    want = brute_divergence(rows)
    pairs = {(r["lang"], r["source"], "pair", r["item"], r["value"], r["rank"]) for r in divergence.source_pairs(cells, groups, shard, sources).collect()}
    assert pairs == {r for r in want if r[2] == "pair"}
    if held > 20:
        assert {tuple(r) for r in divergence.divergences(docs).collect()} == want


def test_divergence_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_divergence_shares_are_exact():
    counts = np.array([[0, 5, 10**12], [3, 0, 7]], np.int64)
    size = np.array([9 * 10**14, 10], np.int64)
    want = [[1 + 10**9 * (int(c) + 2) // (int(n) + 6) for c in row] for row, n in zip(counts, size, strict=True)]
    assert divergence.shares(counts, size, 3).tolist() == want


def test_divergence_equals_its_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({divergence.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, divergence.query(spark, sf).select(*columns).collect())) == sorted(want)


# --- nearest neighbours


def brute_nearest(rows, every):
    able = sorted({(i, tuple(np.float64(x) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)})
    out = []
    for q, v in able:
        if q % every == 0:
            near = sorted((np.sqrt(((np.array(w) - np.array(v)) ** 2).sum()), i) for i, w in able if (i, w) != (q, v) and len(w) == len(v))
            out += [(q, k + 1, i, d) for k, (d, i) in enumerate(near[:10])]
    return out


def test_neighbours_of_awkward_rows(spark):
    """Too few vectors to divide: exact, with ties, copies, lengths and vectors that take no part."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(200 + i, [float(i), 1.0]) for i in range(5)]
    rows += [(300, None), (310, []), (320, [0.0, 0.0, 0.0]), (330, [float("nan"), 1.0, 1.0]), (340, [1.0, None, 1.0]), (350, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [rows[7], rows[10], rows[10], (360, [1e160, 1.0, 1.0]), (370, [1e-160, -0.0, 0.0]), (380, [7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS id", "'v' AS v")
    got = neighbours.neighbours(frame, 10).collect()
    want = brute_nearest(rows, 10)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert neighbours.neighbours(frame.limit(0)).collect() == []


@pytest.mark.parametrize("leaf", [4096, 40])
def test_neighbours_recall(spark, leaf):
    """One level and two, over clusters and a group of near copies that holds a third of all rows."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = np.vstack([centres[rng.integers(0, 20, 2000)] + 0.3 * rng.standard_normal((2000, 16)), centres[0] + 0.001 * rng.standard_normal((600, 16)), np.repeat(centres[1:2], 400, 0)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, leaf).collect()
    want = brute_nearest(rows, 20)
    assert [(r["query_id"], r["rank"]) for r in sorted(got)] == [w[:2] for w in sorted(want)]
    have = defaultdict(dict)
    for q, _, i, d in want:
        have[q][i] = d
    met = [(r["vec_id"] in have[r["query_id"]], r) for r in got]
    assert sum(m for m, _ in met) >= 0.9 * len(want)
    assert all(have[r["query_id"]][r["vec_id"]] == r["score"] for m, r in met if m)


def test_balanced_parts_follow_clusters():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((8, 6)) * 5, 40, 0) + 0.1 * rng.standard_normal((320, 6))
    part = neighbours.balanced_parts(neighbours.neighbour_graph(x, 10), 8, rng)
    assert (np.bincount(part, minlength=8) == 40).all()
    assert sum(len(set(part[i : i + 40].tolist())) == 1 for i in range(0, 320, 40)) >= 6
