"""Stages of the pipeline against plain versions, with null ids and repeated ids of different texts."""

import re

import corpus_pipeline
from tessitura.llm import packing

from tests.llm.conftest import edge_rows
from tests.llm.test_exact_and_shards import plain_exact, same
from tests.llm.test_near_and_contamination import lowered, plain_contamination

PASSAGE = " ".join(f"p{i}" for i in range(20))


def stage_rows():
    base = [f"n{i}" for i in range(120)]
    close = " ".join([*base[:60], "other", *base[61:]])
    later = " ".join([*base[:60], "third", *base[61:]])
    return edge_rows() + [
        (30, " ".join(base)), (31, close), (31, "text of its own"), (None, later), (None, "null id and unique"), (40, "a b c"), (40, "second text"), (41, "x y z"), (None, "x  y z"),
        (42, PASSAGE), (42, "clean text"), (None, PASSAGE + " and more"),
    ]


def exact_stage(rows):
    return [r for r, found in zip(rows, plain_exact(rows), strict=True) if found[3]]


def near_stage(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered(t))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    return [r for r, g, s in zip(rows, group, sets, strict=True) if not s or r[0] == least[g]]


def clean_stage(rows):
    return [r for r in rows if not plain_contamination([r], [(1, PASSAGE)])[0][-1]]


def test_each_stage_keeps_the_rows_of_its_plain_version_and_so_does_the_run(spark, frame, tmp_path):
    rows, folder = stage_rows(), str(tmp_path)
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame(rows).write.parquet(f"{folder}/documents.parquet")
    left = rows
    for stage, plain in ((corpus_pipeline.drop_copies, exact_stage), (corpus_pipeline.drop_near_copies, near_stage), (corpus_pipeline.drop_contaminated, clean_stage)):
        got = stage(spark, frame(rows), folder).collect()
        assert same((r["doc_id"], r["text"]) for r in got) == same(plain(rows))
        left = plain(left)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    want, got = (same(map(tuple, x.select(*columns).collect())) for x in (packing.pack(frame(left)), corpus_pipeline.run(spark, folder)))
    assert got == want and {r[0] for r in left} >= {None, 31, 40, 42}
