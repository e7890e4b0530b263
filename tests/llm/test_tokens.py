"""Token records and packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tessitura.llm import packing, records, tokens
from tessitura.llm.common import scratch

from tests.llm.conftest import edge_rows

ODD = ["", " ", "a  b", " lead", "trail ", "a\n b", "a \nb", "x y", "<|endoftext|> in text", "it's we're  O'Neil", "naïve café Ünï", "1 2 333", "tabs\t\tand\r\nlines", "a b", "日本 語", "é É"]


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.public_file(name))
    return [np.array([*e.ids, end], "<u4") for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, spaces):
    texts = ODD + [" ".join(ODD)] + ["x" * 300 + " y"] * 2
    got = tokens.PieceEncoder(name, spaces, memo_bytes=3).encode(texts)
    assert [g for g in got] == [i[:-1].astype("<u2").tobytes() for i in ids_of(name, texts, 0)]


def test_records_round_trip_in_order(spark, frame):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(ODD)]
    got = records.token_records(frame(rows)).collect()
    ids = dict(zip([i for i, _ in rows], ids_of("byte_bpe_50k.json", [t for _, t in rows], 0), strict=True))
    known = sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["start"])
    assert [r["doc_id"] for r in known] == sorted(i for i, _ in rows if i is not None)
    at = min(r["start"] for r in known)
    for r in known:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert records.token_records(frame([])).count() == 0


def test_lost_and_short_files_are_errors(spark, frame, tmp_path):
    folder = f"file://{tmp_path}/records"
    rows = records.write_records(frame([(i, f"text {i}") for i in range(20)]), folder).collect()
    written = {r["part"]: (r["docs"], r["tokens"]) for r in rows}
    assert records.read_records(spark, folder, max(written) + 2, written).count() == 20
    part = next(p for p, (docs, _) in written.items() if docs)
    with pytest.raises(Exception, match="written were"):
        records.read_records(spark, folder, part + 1, written | {part: (written[part][0] + 1, written[part][1])}).count()
    (tmp_path / "records" / records.data_name(part)).unlink()
    with pytest.raises(Exception, match="lost file"):
        records.read_records(spark, folder, max(written) + 1, written).count()


def test_index_reads_one_record_and_checksums_find_damage(spark, frame):
    folder = scratch(spark, "test-records")
    parts = records.write_records(frame([(i, f"text {i}") for i in range(20)]), folder).collect()
    part = next(p["part"] for p in parts if p["docs"] > 1)
    rows = {(r["part"], r["position"]): r["doc_id"] for r in records.read_records(spark, folder, 1 + max(p["part"] for p in parts)).collect()}
    assert len(rows) == 20
    assert records.read_record(folder, part, 1)[0] == rows[part, 1]
    record = records.framed(b"payload")
    pieces = iter([record[:8], record[8:12], b"pAyload", record[-4:]])
    with pytest.raises(ValueError, match="broken record"):
        records.unframed(lambda n: next(pieces))


def test_fillings_use_every_piece_once_and_leave_one_gap():
    rand = np.random.default_rng(5)
    for counts in ({}, {7: 1}, {1500: 10}, {1025: 9, 30: 2}, {int(s): int(n) for s, n in zip(rand.integers(1, 2048, 60), rand.integers(1, 50, 60), strict=True)}):
        shares = packing.fillings(dict(counts))
        used, tails, full = defaultdict(int), defaultdict(int), defaultdict(int)
        for s in shares:
            used[s.size] += (s.high - s.low) * s.length
            for i in range(s.first, s.first + s.high - s.low):
                full[s.sequence + i // s.each] += s.length
                tails[s.sequence + i // s.each] = max(tails[s.sequence + i // s.each], s.offset + i % s.each * s.length + s.length)
        assert used == {k: k * n for k, n in counts.items()}
        assert dict(full) == dict(tails)
        assert sorted(full) == list(range(len(full))) and all(v <= 2048 for v in full.values())
        assert sum(v < 2048 for v in full.values()) <= 1


def test_closest_filling_is_the_best_sum():
    rand = np.random.default_rng(6)
    for _ in range(30):
        counts, room = {int(s): int(n) for s, n in zip(rand.integers(1, 40, 4), rand.integers(1, 4, 4), strict=True)}, int(rand.integers(1, 90))
        sums = {0}
        for size, n in counts.items():
            sums = {a + size * k for a in sums for k in range(n + 1) if a + size * k <= room}
        found = packing.closest_filling(counts, room)
        assert sum(s * n for s, n in found.items()) == max(sums) and all(n <= counts[s] for s, n in found.items())


def test_packing_places_every_id_once(frame):
    rows = [r for r in edge_rows() if r[0] not in (3, None)] + [(100 + i, "word " * (i * 37 % 900)) for i in range(60)]
    ids = dict(zip([i for i, _ in rows], ids_of("word_bpe_49k.json", [t for _, t in rows], 1), strict=True))
    at, places = defaultdict(list), defaultdict(list)
    for r in packing.pack(frame(rows)).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, limit in [(at[i], len(own)) for i, own in ids.items()] + [(p, None) for p in places.values()]:
        end = 0
        for start, length in sorted(spans):
            assert start == end
            end += length
        assert end == limit if limit is not None else end <= 2048
    assert sum(2048 - sum(n for _, n in p) for p in places.values()) < 2048
    assert packing.pack(frame([])).count() == 0
