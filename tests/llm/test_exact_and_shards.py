"""Exact duplicates and shards against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

from tessitura.llm import exact, sharding

from tests.llm.conftest import edge_rows


def same(rows):
    return sorted(rows, key=repr)


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        normal = re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        ids = [x for x in groups[normal] if x is not None]
        least = min(ids) if ids else None
        out.append((i, least, len(groups[normal]), i == least, hashlib.sha256(normal.encode()).hexdigest()))
    return out


def test_exact_edges_and_spilling(frame):
    rows = edge_rows() + [(100 + i, f"text number {i % 70} " + "pad " * 40) for i in range(400)]
    for table_bytes in (exact.TABLE_BYTES, 4_000):
        got = exact.exact_duplicates(frame(rows), table_bytes).collect()
        assert same(map(tuple, got)) == same(plain_exact(rows))
    assert exact.exact_duplicates(frame([])).count() == 0


def test_grace_groups_hold_the_same_groups_at_any_budget():
    records = [(hashlib.sha256(str(i % 90).encode()).digest(), i % 90, str(i % 90).encode() * 50, i, 1) for i in range(900)]
    small, large = ([r for b in exact.grace_groups(iter(records), n) for r in b.to_pylist()] for n in (500, 1 << 30))
    assert same(small) == same(large) and len(small) == 90


def test_equal_digests_of_different_contents_stay_apart():
    records = [(b"\0" * 32, 0, text, i, 1) for i, text in enumerate([b"x", b"y", b"x", b"z"])]
    got = [r for b in exact.grace_groups(iter(records), 1) for r in b.to_pylist()]
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == [(0, 2), (1, 1), (3, 1)]


def plain_cuts(sizes, shards):
    def cuts(capacity):
        out, held = [], 0
        for i, s in enumerate(sizes):
            if s > capacity:
                return None
            if held + s > capacity:
                out.append(i)
                held = 0
            held += s
        return out if len(out) < shards else None

    return cuts(next(c for c in range(max(sizes), sum(sizes) + 1) if cuts(c) is not None))


def test_shards_are_the_smallest_capacity_over_whole_groups(spark, frame):
    rows = edge_rows() + [(100 + i, f"t{i % 150}" * (1 + i * i % 37)) for i in range(300)]
    for shards, blocks in ((7, 4), (40, 4096)):
        got = sharding.shard(frame(rows), shards, blocks).collect()
        assert len(got) == len(rows)
        by_text = defaultdict(int)
        for _, t in rows:
            by_text[hashlib.md5((t or "").encode()).hexdigest()[:15]] += len((t or "").encode()) + 16
        order = sorted(by_text)
        limits = [int(order[i], 16) for i in plain_cuts([by_text[h] for h in order], shards)]
        want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), sum(int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16) >= c for c in limits)) for _, t in rows)
        assert sorted((r["size"], r["text_crc32"], r["shard"]) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(frame([])).count() == 0
