import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import common, components, ngram_join, shingles

from . import brute


def words(r, n, vocabulary=100_000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"e{r.randrange(10**6)}"
    return ws


def corpus():
    r = random.Random(3)
    rows, passage = [], words(r, 60)
    base = words(r, 90)
    rows += [" ".join(edited(r, base, r.randrange(5))) for _ in range(80)]  # a family beyond LONG
    rows += [" ".join(words(r, 40) + passage + words(r, 40)) for _ in range(50)]  # a shared passage
    for _ in range(40):
        b = words(r, r.randrange(1, 60))
        rows += [" ".join(edited(r, b, r.randrange(3))) for _ in range(r.randrange(1, 6))]
        rows.append(" ".join(b + words(r, 1)))
    for n in range(1, 9):
        b = words(r, n + 4)
        rows += [" ".join(b), " ".join(b[:-1]), " ".join(b + ["x"]), " ".join(b).upper()]
    rows += ["", None, "  \t ", "one", "ONE", "one two", "é É", "a b c d e f", "A B\nC\td e\x0bf", "a  b c d"]
    rows += [" ".join(words(r, 30_000))]
    r.shuffle(rows)
    rows = list(enumerate(rows, 10))
    return rows + [rows[5]] * 30 + [(None, rows[7][1]), (None, "only without an id here now"), (3, rows[9][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("sig", F.lit("clash")).withColumn("hi", F.lit("clash"))


def test_against_brute_force(spark):
    rows = corpus()
    got = sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows).repartition(5)).collect()), key=str)
    assert got == brute.components(rows)


@pytest.mark.parametrize("most", [0, 48])
def test_every_boundary_gives_the_same_links(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes, per_list: most)
    rows = corpus()[:200]
    got = sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect()), key=str)
    assert got == brute.components(rows)


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("cairnfield.llm.common.BROADCAST_BYTES", -1)
    rows = corpus()[:200]
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect()), key=str) == brute.components(rows)


def bridged():
    """Two passages that most of many texts share, and texts that hold both: one family, two lists."""
    r = random.Random(7)
    passages = [words(r, 60), words(r, 60)]
    rows = []
    for p in passages:
        for _ in range(25):
            own = words(r, 12)
            rows += [" ".join(p + own), " ".join(p + edited(r, own, r.randrange(3)))]
    rows += [" ".join(passages[0] + passages[1] + words(r, 2)) for _ in range(4)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rows", [corpus()[:330], bridged()], ids=["corpus", "bridged"])
def test_the_scan_alone_finds_all_links(spark, monkeypatch, rows):
    """No pair is verified before, every list is long, blocks are small."""
    kinds, units = set(), ngram_join._Join.units

    def seen(self, rows):
        out = units(self, rows)
        kinds.update(r.kind for r in out.select(F.left("unit", F.lit(1)).alias("kind")).distinct().collect())
        return out

    monkeypatch.setattr(ngram_join._Join, "units", seen)
    monkeypatch.setattr(ngram_join._Join, "link", lambda self, pairs: None)
    monkeypatch.setattr(ngram_join, "LONG", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect()), key=str) == brute.components(rows)
    assert kinds == ({"l"} if len(rows) < 150 else {"f", "l"})


def test_bridged_families(spark, monkeypatch):
    rows = bridged()
    monkeypatch.setattr(ngram_join, "LONG", 8)
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect()), key=str) == brute.components(rows)


def test_keep_one(spark):
    rows = corpus()
    df = frame(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = brute.components(rows)
    got = [r.doc_id for r in kept.collect()]
    named = [i for i in got if i is not None]
    assert sorted(named) == sorted([*{i for i, n, c in want if n and i is not None and i == c}] + [i for i, n, c in want if not n and i is not None])
    assert got.count(None) == 2


def test_only_wanted_sets_leave_their_task(spark):
    """A set is larger than its text: those of documents that are in no list must not be shuffled."""
    r = random.Random(5)
    rows = [(i, " ".join(words(r, 30))) for i in range(300)] + [(None, " ".join(words(r, 30)))]
    marks = [ngram_join.fingerprint(s) for s in shingles.batch_sets(pa.array([t for _, t in rows]))]
    wanted = [7, 13, 300]
    held = spark.createDataFrame([(rows[i][0], marks[i][0]) for i in wanted], "holder long, hi long")
    width = ngram_join.filter_width(len(wanted))
    passing = ngram_join._filter(held.select(ngram_join.held_sig(F.col("hi"), F.col("holder")).alias("sig")), width)
    out = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(ngram_join._sets(passing, width), "doc_id long, hi long, lo long, shingles binary").collect()
    assert sorted((r["hi"], r["lo"]) for r in out) == sorted(marks[i] for i in wanted)


def test_shuffles_of_written_tables_leave_no_files(spark):
    tracked = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = tracked()
    rows = common.stage_table(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert tracked() <= before and rows.count() == 100


def test_written_tables_know_their_rows(spark):
    """Also where nothing is left to run: the plan is empty, or turns out so."""
    some = spark.range(1000)
    for rows, n in ((some, 1000), (some.filter("false"), 0), (some.limit(0), 0), (some.filter("id > 5000").distinct(), 0), (spark.createDataFrame([], "id long"), 0)):
        table, seen = common.stage_counted(rows, "rows", F.count_if(F.col("id") > 9).alias("more"))
        assert table.staged_rows == table.count() == n and seen["more"] == max(0, n - 10)


def test_no_jobs_for_counts_of_written_tables(spark, monkeypatch):
    """The driver keeps something of each job: the join runs none for a number that its writes have told."""
    rows = corpus()[:120]
    want = {c for _, n, c in brute.components(rows) if n}
    docs = frame(spark, rows)

    def count(self):
        raise AssertionError("a job of its own")

    with monkeypatch.context() as m:
        m.setattr(type(docs), "count", count)
        kept = ngram_join.keep_one(docs)
    assert want - {None} <= {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("lists, width", [(0, 27), (4_194_303, 27), (4_194_304, 28), (10**9, 29)])
def test_the_filter_grows_with_the_lists(lists, width):
    assert ngram_join.filter_width(lists) == width


def test_keep_one_drops_or_keeps_by_the_smaller_side(spark):
    r = random.Random(9)
    text = " ".join(words(r, 40))
    few = [(i, " ".join(words(r, 40))) for i in range(20)] + [(30, text), (31, text)]
    many = [(i, text) for i in range(20)]
    for rows, want in ((few, [*range(20), 30]), (many, [0]), ([*few, (None, text)], [*range(20), 30, None])):
        assert sorted((x["doc_id"] for x in ngram_join.keep_one(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_signatures_are_sent_as_bits_and_once_for_equal_sets(spark):
    r = random.Random(4)
    text = " ".join(words(r, 400))
    docs = frame(spark, [(i, text) for i in range(50)] + [(100 + i, " ".join(words(r, 400))) for i in range(5)])
    assert {x["component_id"] for x in ngram_join.ngram_join(docs).collect()} == {0, *range(100, 105)}
    counts = spark.sparkContext.broadcast(np.zeros(1 << ngram_join.BUCKET_BITS, np.int64).tobytes())
    width = ngram_join.HOLDER_BITS
    holding = ngram_join._filter(spark.createDataFrame([(i,) for i in (0, *range(100, 105))], "doc_id long").mapInArrow(ngram_join._marked, "sig long"), width)
    rows = docs.mapInArrow(ngram_join._sent(counts, 0, holding, width), "row long, sigs binary").collect()
    each = len(ngram_join.signatures(np.arange(396, dtype=np.uint64), np.zeros(396, np.int64), 0))
    assert sum(len(x["sigs"]) for x in rows) == 4 * 6 * each


@given(st.lists(st.integers(0, 40), max_size=60))
def test_what_is_sent_twice_is_shared(picked):
    every = (np.arange(41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(5)
    batch = ngram_join.by_row(every[np.array(picked, np.int64)])
    got = set()
    for row, sigs in zip(batch.column(0), batch.column(1)):
        one = pa.RecordBatch.from_pydict({"sigs": pa.array([sigs.as_py()], pa.binary())})
        out = next(ngram_join._shared((row,), iter([one]))).to_pylist()[0]
        got |= {(out["row"] << 32) | int(x) for x in np.frombuffer(out["sigs"], np.uint32)}
        bits = next(ngram_join._shared_bits(27)(iter([pa.RecordBatch.from_pydict({"row": pa.array([out["row"]]), "sigs": pa.array([out["sigs"]])})])))
        on = np.unpackbits(np.frombuffer(bits.column(1)[0].as_py(), np.uint8))
        assert set(np.flatnonzero(on).tolist()) == {int(x) >> 15 for x in np.frombuffer(out["sigs"], np.uint32)}
    assert got == {int(every[i]) >> 22 for i in set(picked) if picked.count(i) > 1}


def test_sets_travel_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TRAVEL", 0.5)
    monkeypatch.setattr(ngram_join, "LONG", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    most, rounds = [], ngram_join._Join.rounds

    def seen(self, rows):
        most.append((rows, rounds(self, rows), self.sets.staged_rows))
        return most[-1][1]

    monkeypatch.setattr(ngram_join._Join, "rounds", seen)
    rows = corpus()
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect()), key=str) == brute.components(rows)
    assert max(n for _, n, _ in most) > 1
    assert all(r <= n * max(1, s) / 2 for r, n, s in most)


def test_empty(spark):
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0 and ngram_join.keep_one(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_join(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\x0b\x1c", max_size=30)), max_size=8))
def test_sets_have_the_sizes_and_equalities_of_word_tuples(texts):
    got = list(shingles.batch_sets(pa.array(texts, pa.string())))
    want = [brute.shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((g.tobytes() == h.tobytes()) == (v == w) for g, v in zip(got, want) for h, w in zip(got, want))


def test_words_longer_than_a_part(monkeypatch):
    monkeypatch.setattr(shingles, "PART", 16)
    t = "short " + "x" * 100 + " y " * 30 + "z" * 17
    whole = [s.tolist() for s in shingles.batch_sets(pa.array([t, "a " * 40 + t]))]
    monkeypatch.undo()
    assert whole == [s.tolist() for s in shingles.batch_sets(pa.array([t, "a " * 40 + t]))]


@given(st.integers(1, 400), st.integers(1, 400))
def test_verification_is_exact(a, b):
    x, y = np.arange(a, dtype=np.uint64), np.arange(b // 3, b // 3 + b, dtype=np.uint64)
    inter = len(set(x.tolist()) & set(y.tolist()))
    assert ngram_join.linked(x, y) == (100 * inter >= 75 * (a + b - inter))


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)], "a long, b long")
    got = {r.node: r.comp for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200}
    more = components.extend(spark.createDataFrame([(1, 0), (0, 0), (5, 4), (4, 4)], "node long, comp long"), spark.createDataFrame([(5, 9), (0, 8), (9, 8)], "a long, b long"))
    assert {r.node: r.comp for r in more.collect()} == dict.fromkeys([0, 1, 4, 5, 8, 9], 0)
