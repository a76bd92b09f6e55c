"""Slices of batches and what workers keep."""

import tracemalloc

import numpy as np
import pyarrow as pa

from seamark.llm import common, langid, nearcopies, repeats


def test_steps_keep_all_rows_in_order():
    texts = ["a" * 50, None, "", "b" * 500, "é" * 30, "", None]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(7)), "text": pa.array(texts, pa.string())}),
               pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}),
               pa.RecordBatch.from_pydict({"id": [7], "text": pa.array([None], pa.string())})]
    got = list(common.steps(iter(batches), "text", 60))
    assert [x for b in got for x in b.column("text").to_pylist()] == [*texts, None]
    # 50 + 0 + 0 + 500 bytes, then 60 (two a letter), then what is left of the batch; the next batch is its own
    assert [b.num_rows for b in got] == [4, 1, 2, 1]
    assert list(common.steps(iter([]), "text", 60)) == []


def test_kept_is_one_thing_and_lean_drops_it():
    made = []
    for name in ("a", "a", "b", "a"):
        common.kept(name, lambda name=name: made.append(name) or name)
    assert made == ["a", "b", "a"]
    assert list(common.lean(iter([1, 2]), keep=True)) == [1, 2] and common._KEPT
    assert list(common.lean(iter([1, 2]))) == [1, 2] and not common._KEPT


def test_workers_get_small_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    s = spark.newSession()
    d = s.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text", "'en' AS lang")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    whole = d.mapInArrow(sizes, "n long, size long").collect()
    assert len(whole) == 1 and whole[0]["size"] > 3 * common.BATCH_BYTES
    for use in (lambda: langid.identify(d, {"en": "some words"}), lambda: nearcopies.sketches(d)):
        s.conf.unset(limit)
        use()
        got = d.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * common.BATCH_BYTES
    s.conf.set(limit, "1m")  # a lower limit stays
    langid.identify(d, {"en": "some words"})
    assert s.conf.get(limit) == "1m"


def test_automaton_is_built_where_it_stays():
    letters = np.random.default_rng(3).zipf(1.4, 30_000) % 24
    text = "".join(" " if i == 0 else chr(96 + int(i)) for i in letters)
    tracemalloc.start()
    try:
        m = langid.Model({"aa": text})
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        a = langid.Automaton(m.codes(text), m.alphabet)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(a.dense) == (a.begin + 1) * m.alphabet and m.alphabet < langid.DENSE
    assert peak < 3 * a.dense.nbytes


def test_block_of_repeats_takes_little_memory():
    part = "".join(chr(97 + int(i)) for i in np.random.default_rng(4).integers(0, 26, 1 << 16))
    text = part * (repeats.BLOCK // len(part))
    short = repeats.LENGTH - repeats.PERIOD + 1
    tracemalloc.start()
    try:
        block = repeats._Block([(1, text)])
        block.lay(repeats.LENGTH)
        block.samples(short)
        block.strings(np.zeros(len(block.sample_heads), bool), repeats.LENGTH, short)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(block.places) == len(text) - repeats.LENGTH + 1
    assert peak < 110_000_000, peak
