"""Near-duplicates and benchmark passages against all pairs and plain scans."""

import hashlib
import random
import re

from tessitura.llm import contamination, near

from tests.llm.conftest import edge_rows


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered(t))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least if sets[i] else doc, doc == (least if sets[i] else doc)))
    return sorted(out, key=repr)


def noisy_groups(seed=3):
    rand, rows, n = random.Random(seed), [], 1000
    for _ in range(12):
        base = [f"v{rand.randrange(5000)}" for _ in range(rand.choice([4, 30, 120, 300]))]
        for _ in range(rand.choice([1, 4, 25])):
            own = list(base)
            for _ in range(rand.choice([0, 1, 1, 2, 3])):
                own[rand.randrange(len(own))] = f"z{rand.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    return rows


def test_components_equal_all_pairs(frame, monkeypatch):
    rows = edge_rows() + noisy_groups()
    want = plain_components(rows)
    got = sorted(map(tuple, near.near_duplicates(frame(rows)).collect()), key=repr)
    assert got == want
    monkeypatch.setattr(near, "LEAF", 8)
    assert sorted(map(tuple, near.near_duplicates(frame(rows)).collect()), key=repr) == want
    assert near.near_duplicates(frame([])).count() == 0


def test_one_document_of_each_component_stays(frame):
    rows = noisy_groups(4)
    kept = {r["doc_id"] for r in near.without_near_duplicates(frame(rows)).collect()}
    assert kept == {i for i, _, c, _ in plain_components(rows) if i == c}


def plain_contamination(rows, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, t in items:
        w = re.findall(word, lowered(t))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, t in rows:
        w, hit, names = re.findall(word, lowered(t)), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_on_both_sides_of_the_broadcast_bound(spark, frame):
    passage = [f"p{i}" for i in range(20)]
    items = [(1, " ".join(passage)), (2, "Short ITEM"), (10, " ".join(passage[3:])), (4, None), (5, "..."), (6, "one"), (7, " ".join(["the"] * 15)), (8, "Ünï código")]
    rows = edge_rows() + [
        (20, "x " * 30 + " ".join(passage[:13]) + " y" * 100), (21, " ".join(passage[1:19]).upper()), (22, "short,item one"), (23, "ünï-código ÜNÏ"), (24, " ".join(passage[:12])),
        (25, "the " * 40), (26, " ".join(passage) + " " + " ".join(passage)), (26, "same id other text short item"), (27, "One"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contamination(rows, items)
    for bound in (contamination.BROADCAST_ROWS, 0):
        got = contamination.contamination(frame(rows), bench, bound).drop("text_key").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert contamination.contamination(frame([]), bench).count() == 0
    assert {r["contaminated"] for r in contamination.contamination(frame(rows), bench.limit(0)).collect()} == {False}


def template_pool(seed=5, n=600, pairs=40):
    """Documents that share most of one template, at a similarity of about 0.7, with pairs of near copies inside."""
    rand, rows = random.Random(seed), []
    base = [f"t{i}" for i in range(300)]
    for i in range(n):
        own = list(base)
        for at in rand.sample(range(0, 300, 5), 5):
            own[at] = f"u{i}x{at}"
        rows.append((i, " ".join(own)))
    for k in range(pairs):
        own = rows[20 + 14 * k][1].split(" ")
        own[150 + k] = f"c{k}"
        own[40 + k] = f"d{k}"
        rows.append((n + k, " ".join(own)))
    return rows


def test_pairs_inside_a_large_node_that_does_not_split_are_found(frame, monkeypatch):
    rows = template_pool()
    want = plain_components(rows)
    assert sum(i != c for i, _, c, _ in want) == 40
    monkeypatch.setattr(near, "LEAF", 8)
    assert len(rows) > near.LEAF**2
    assert sorted(map(tuple, near.near_duplicates(frame(rows)).collect()), key=repr) == want
