"""Substring deduplication against windows compared one by one."""

import hashlib
import random
import re

from tessitura.llm import passages

from tests.llm.conftest import edge_rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain(rows):
    firsts = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - 49):
            if i is not None:
                key = tuple(w[j : j + 50])
                firsts[key] = min(firsts.get(key, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k for j in range(len(w) - 49) if i is not None and firsts[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        spans = [s for s in sorted(gone) if s - 1 not in gone]
        ends = [s + 1 for s in sorted(gone) if s + 1 not in gone]
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), list(zip(spans, ends, strict=True))))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], [tuple(s) for s in r["spans"]]) for r in frame.collect()), key=repr)


def rows_with_passages(seed, docs):
    rng = random.Random(seed)
    pool = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.choice([49, 50, 51, 70, 200]))] for k in range(12)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(rng.randrange(5)):
            if rng.random() < 0.5:
                w += [f"u{rng.randrange(10_000)}" for _ in range(rng.randrange(80))]
            else:
                own = list(rng.choice(pool))
                if rng.random() < 0.3:
                    own[rng.randrange(len(own))] = "Edit"
                w += own[: rng.choice([len(own), 60])]
        rows.append((rng.choice([i, i, rng.randrange(docs), None]), rng.choice([" ", "\n", " \t"]).join(w)))
    same = " ".join(f"s{k % 61}" for k in range(130))
    return rows + [(900 + i, same) for i in range(40)] + [(900, same), (None, same), (950, "a " * 300), (951, "a " * 299), (952, same.upper())]


def test_windows_of_earlier_documents_go_whichever_way_anchors_take(frame):
    rows = rows_with_passages(1, 120)
    for limits in ((passages.ANCHOR_WORDS, 2_000), (150, 600), (0, 1)):
        assert result(passages.repeated_passages(frame(rows), *limits)) == plain(rows)


def test_edges(frame):
    rows = edge_rows() + [(12, edge_rows()[-1][1]), (1, "x" * 200_000)]
    assert result(passages.repeated_passages(frame(rows))) == plain(rows)
    assert passages.repeated_passages(frame([])).count() == 0


def test_least_ids_and_matching_statistics_of_a_shard():
    rng = random.Random(3)
    for _ in range(200):
        texts = [([rng.randrange(3) for _ in range(rng.randrange(1, 25))], rng.randrange(9)) for _ in range(rng.randrange(1, 6))]
        shard = passages.ReferenceShard()
        for ids, doc_id in texts:
            shard.add(ids, doc_id)
        shard.seal()
        query = [rng.randrange(4) for _ in range(30)]
        for end, (matched, least) in enumerate(shard.statistics(query, 6), 1):
            held = [n for n in range(min(end, 6) + 1) if n == 0 or any(t[k : k + n] == query[end - n : end] for t, _ in texts for k in range(len(t)))]
            assert matched == max(held)
            if matched == 6:
                assert least == min(d for t, d in texts if any(t[k : k + 6] == query[end - 6 : end] for k in range(len(t))))


def test_keys_of_many_rows_meet_by_broadcast_and_others_by_shuffle(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(900)], "key long, v long")
    right = spark.createDataFrame([(99, 300, "hot")] + [(k, 86, "cold") for k in range(7)], "key long, n long, name string")
    for shares in (2, 1000):
        old, passages.SHARES = passages.SHARES, shares
        try:
            got = sorted(map(tuple, passages.meet(left, right, ["key"], "n", 900).collect()))
        finally:
            passages.SHARES = old
        assert got == sorted(map(tuple, left.join(right, "key").collect())) and len(got) == 900
