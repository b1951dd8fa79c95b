"""Stages of the pipeline on rows with null, repeated and shared ids."""

import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(seed):
    """Distinct texts of 20 words; ids that are null, occur three times, or stand for two texts."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(20)) for _ in range(60)]
    ids = [*range(50), *[None] * 8, 8, 9]
    rows = list(zip(ids, texts))
    return rows + [(7, texts[7])] * 2


CLASHING = ["score", "lang_pred", "row", "doc", "copy", "copies", "class", "component_id", "size", "key", "a.b"]


def frame(spark, rows):
    """Documents, with columns of the names that stages use inside; each must come back as it went in."""
    more = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t else 0, *[f"{c} {i}" for c in CLASHING]) for i, t in rows], f"{COLUMNS}, {more}")


def kept(stage, spark, df, sf_dir=""):
    found = stage(spark, df, sf_dir)
    assert found.columns == df.columns
    rows = found.collect()
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHING)
    return Counter((r.doc_id, r.text) for r in rows)


def test_mixing_stage_takes_each_row_once_or_twice(spark):
    rows = odd_rows(1)
    got = kept(corpus_pipeline.mixed, spark, frame(spark, rows))
    n = Counter(rows)  # rates are 1.5 for all, as all rows are equally long
    assert set(got) == set(n)
    assert all(n[k] <= got[k] <= 2 * n[k] for k in n)
    assert abs(sum(got.values()) - 1.5 * len(rows)) <= 1


def test_near_copy_stage_keeps_one_row_of_each_text(spark):
    rows = odd_rows(2)
    rows += [(None, rows[3][1]), (None, rows[51][1]), (70, rows[52][1]), (2, rows[5][1]), (None, None), (71, ""), (71, "")]
    got = kept(corpus_pipeline.one_of_near_copies, spark, frame(spark, rows))
    want = Counter([(None, None), (71, ""), (71, "")])
    for text in {t for _, t in rows if t}:
        want[min((i for i, t in rows if t == text), key=lambda i: (i is None, i or 0)), text] = 1
    assert got == want


def test_language_and_toxicity_stages_keep_what_a_model_of_their_own_keeps(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the of and house water this".split()) for _ in range(12))) for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]} vile scum {i}") for i in range(12)] + [(7, rows[7][1]), (None, rows[9][1])]
    none = [(200, None), (201, ""), (202, "123 ...")]
    df = frame(spark, rows + none)
    assert kept(corpus_pipeline.known_language, spark, df) == Counter(rows)
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows if i is not None], "doc_id long, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    got = kept(corpus_pipeline.not_toxic, spark, df, str(tmp_path))
    assert got == Counter([r for r in rows + none if r[0] is None or not 100 <= r[0] < 200])


def test_last_stage_places_every_token_once(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (None, "four " * 3000)]
    got = corpus_pipeline.packed(spark, frame(spark, rows), "").collect()
    whole = Counter()
    for r in got:
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
        whole[r.doc_id] += r.length
    assert whole[2] == 1 and whole[1] % 2 == 0 and whole[None] == max(r.doc_tokens for r in got)
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in spans.values():
        assert [o for o, _ in sorted(found)] == [sum(n for _, n in sorted(found)[:i]) for i in range(len(found))]


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []


def test_texts_stay_where_they_are_while_the_ids_of_what_is_kept_are_few(spark):
    rows = [(i, f"some words of text {i}", "en", "a" if i % 2 else "b", 20) for i in range(40)]
    docs = spark.createDataFrame(rows, COLUMNS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for stage in (corpus_pipeline.one_of_near_copies, corpus_pipeline.mixed):
            assert "SortMergeJoin" not in stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_texts_travel_in_small_batches(spark, tmp_path, name):
    """Whatever the session had before: what a stage returns is computed when the caller asks for it."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(i, "wide words " * 100_000, "en", "web") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    spark.conf.unset(setting)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), str(tmp_path))
        seen = [r[0] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(setting)
    assert sum(seen) == 12 and max(seen) * len(rows[0][1]) < 2 * corpus_pipeline.BATCH_BYTES
