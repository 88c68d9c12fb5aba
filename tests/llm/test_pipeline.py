"""The pipeline's stages take effect one after the other."""

import re
from collections import Counter

import pytest
from conftest import DATA

from auditspark.llm import decontaminate, pii

ITEM = "quartz lantern bishop meadow copper thistle harbor velvet saffron ember juniper walnut"
PROSE = "The old bridge over the river was built in the last century and since then all the people of the town have walked over it to the market"
HUGE = " ".join(f"{w}{i}" for i in range(40_000) for w in ("stone", "water"))
#: doc_id, text, lang, source, n_chars, and columns named like the stages' own.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _fp string, _set string, score string, target string, _terms string, taken string"
ODD = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (None, PROSE, "en", None), (3, None, "en", "a"), (4, "", "en", "b"), (5, " \n\t", None, "b"), (6, "12 34 !?", "en", "b"), (7, HUGE, "en", None),
    (8, f"{PROSE} so they say, and mail@host.example knows it", "en", "b"), (9, f"Words before it {ITEM} and some words after it", "en", "c"), (10, PROSE.replace("bridge", "tower").replace("town", "place").replace("market", "church") + " and home", "en", "c"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *["clash"] * 7) for r in ODD], COLUMNS).repartition(3)


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def expected(keep):
    return Counter((d, t) for d, t, *_ in ODD if keep(d, t))


def test_odd_rows_by_stage(spark, odd, tmp_path):
    """What each stage does with nulls, blanks, long texts, repeats, ties and clashing columns, one by one."""
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    found = stages["language_id"](spark, odd, folder)
    assert found.columns == odd.columns and rows_of(found) == expected(lambda d, t: t and re.search("[A-Za-z]", t))
    found = stages["near_dedup"](spark, odd, folder)
    assert found.columns == odd.columns
    # Copies of the first text, and texts without words, are one row each; the tower is far enough from the bridge.
    assert rows_of(found) == Counter({(1, PROSE): 1, (3, None): 1, (6, "12 34 !?"): 1, (7, HUGE): 1, **{(r[0], r[1]): 1 for r in ODD[9:12]}})
    found = stages["decontaminate"](spark, odd, folder)
    assert found.columns == odd.columns and rows_of(found) == expected(lambda d, t: d != 9)
    found = stages["personal_data"](spark, odd, folder)
    assert found.columns == odd.columns
    texts = rows_of(found)
    assert texts[(2, PROSE)] == 2 and texts[(3, None)] == texts[(4, "")] == texts[(None, None)] == texts[(7, HUGE)] == 1
    changed = {r.doc_id: (r.text, r.n_chars) for r in found.collect() if r.doc_id == 8}
    assert "[EMAIL]" in changed[8][0] and "@" not in changed[8][0] and changed[8][1] == len(changed[8][0])
    found = stages["source_mix"](spark, odd, folder)
    assert set(odd.columns) - {"taken", "target"} <= set(found.columns) and found.filter("text is null or trim(text) = ''").count() == 0
    sizes = {s: sum(len((t or "").split()) for _, t, _, source in ODD if source == s) for s in ("a", "b", "c", None)}
    taken = Counter()
    for r in found.collect():
        taken[r.source] += r.taken
        assert 0 < r.taken <= 2 * r.size
    for r in found.select("source", "target", "source_size").distinct().collect():
        assert abs(taken[r.source] - r.target) <= 1 and r.source_size == sizes[r.source]


def test_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    assert rows_of(dict(P.STAGES)["decontaminate"](spark, odd, str(tmp_path))) == rows_of(odd)


def test_pipeline(spark):
    import corpus_pipeline as P

    start = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, benchmark = start, spark.read.parquet(f"{DATA}/benchmark.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        after = P.materialize(stage(spark, docs, DATA), f"test-{name}")
        assert after.columns == start.columns
        sizes.append(after.count())
        docs = after
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    assert decontaminate.find_leaks(docs, benchmark).count() == 0
    assert not any(pii.base_spans(r.text) for r in docs.collect())
    last = P.STAGES[-1][1](spark, docs, DATA)
    assert set(start.columns) <= set(last.columns) and 0 < last.count() <= sizes[4]
    assert {r.doc_id for r in P.run(spark, DATA).collect()} == {r.doc_id for r in last.collect()}
