import random

from pyspark.sql import functions as F

from tunedata.llm import mixing as M


def brute_targets(sizes):
    """Share by weight, cut at three times the source, share the rest anew, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in rest)
        share = {s: (total - sum(fixed.values())) * weight[s] / w for s in rest} if rest else {}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in above}


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    names = ["b", "a", None, "ü", "Z", "small", ""]
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200]) + "\n\x0bx", rng.choice(names + ["a"] * 6)) for i in range(n)]
    return rows + [(9000, None, "small"), (9001, "", "a"), (9002, "y", "tiny"), (5, "twice", "a"), (5, "twice", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")


def test_targets_and_taken_words(spark):
    rows = corpus()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    longest = {s: max(r["size"] for r in got if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = M.mix(frame(spark, rows).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.copies, r.start)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_follows_the_curriculum(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(900)]
    s = M.schedule(M.mix(frame(spark, rows))).collect()
    pos = [r.position for r in s]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    early = {k: sum(r.source == k for r in s if r.position < 0.5) / sum(r.source == k for r in s) for k in "abc"}
    assert early["a"] > 0.55 and abs(early["b"] - 0.5) < 0.05 and early["c"] < 0.45  # falling, level, rising


def test_scheduled_documents(spark):
    rows = corpus(2, 200)
    docs = frame(spark, rows).drop("size", "target")
    want = {}
    for r in M.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = M.scheduled_documents(docs)
    assert got.columns == docs.columns
    have = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert have == {i: n for i, n in want.items() if n}


def test_empty_and_wordless(spark):
    assert M.mix(frame(spark, []).limit(0)).collect() == []
    got = M.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.target, r.copies) for r in got] == [(0.0, 0), (0.0, 0)]


def test_scheduled_documents_keep_distinct_texts_of_null_and_repeated_ids(spark):
    """Rows with one id (or none) and as many words are documents of their own."""
    rows = [(None if i % 2 else 7, f"t{i} same size", "ab"[i % 4 // 2]) for i in range(40)]
    rows += [(i, "other words of a source", "c") for i in range(100, 140)] + [(8, "equal", "c")] * 2
    docs = frame(spark, rows).drop("size", "target").withColumn("lang", F.when(F.col("text") == "equal", "xx").otherwise("en"))
    mixed, got = M.mix(docs).collect(), M.scheduled_documents(docs)
    texts = {r.text for r in got.collect()}
    assert got.count() == sum(r.copies for r in mixed)
    copies, n = {}, {}
    for r in mixed:
        copies[r.source], n[r.source] = copies.get(r.source, 0) + r.copies, n.get(r.source, 0) + 1
    whole = {s for s in n if copies[s] >= n[s]}  # taken once or more
    assert "a" in whole and {t for _, t, s in rows if s in whole} <= texts
    place = {t: s for _, t, s in rows}
    assert all(r.source == place[r.text] for r in got.collect())
    first = [tuple(r) for r in got.collect()]
    assert first == [tuple(r) for r in M.scheduled_documents(docs.repartition(7)).collect()]


def test_clashing_columns_and_sources_without_number(spark):
    docs = frame(spark, corpus(3, 60)).drop("size", "target")
    plain = [tuple(r) for r in M.scheduled_documents(docs).collect()]
    names = ["key", "position", "mix_key", "Mix_Position", "start", "place"]
    extra = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = M.scheduled_documents(extra)
    assert got.columns == extra.columns
    assert sorted(tuple(r)[:3] for r in got.collect() if r.doc_id != 5) == sorted(r for r in plain if r[0] != 5)
    assert {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(names)))}


def test_rows_equal_in_everything_meet_as_one(spark):
    """A third of all rows without id and text, and another that repeat one row: no window holds them."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.format_string("text %d", "id")).when(F.col("id") % 3 == 1, F.lit("a b c")).alias("text"),
        F.lit("s").alias("source"),
    )
    sized = M.sizes(docs)
    placed = M.streams(sized).collect()
    assert len(placed) == 3000
    at = 0
    for r in sorted(placed, key=lambda r: (r.start, r["size"])):
        assert r.start == at
        at += r["size"]
    assert M.streams(sized).select("h").distinct().count() == 1002


def test_query_counts_the_places_of_the_schedule(spark, tmp_path, monkeypatch):
    """What a document is given comes from the sorted schedule, also where ids are null or repeat."""
    rows = corpus(5, 120) + [(None, "same", "a"), (None, "same", "a"), (None, "other words", "b")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r.doc_id), r["size"], r.taken, -1.0 if r.first_position is None else r.first_position)
    mixed = M.mix(docs).withColumn("taken", F.col("size") * F.col("copies"))
    want = mixed.withColumn("first_position", F.when(F.col("copies") > 0, M._position(F.col("start").cast("double")))).collect()
    got = M.op5_curriculum_mix(spark, str(tmp_path)).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == len(rows)
    whole = M.schedule
    monkeypatch.setattr(M, "schedule", lambda m: whole(m).where("position < 0.5"))
    early = M.op5_curriculum_mix(spark, str(tmp_path)).collect()
    assert len(early) == len(rows)
    places = whole(M.mix(docs)).where("position < 0.5")
    assert sum(r.taken for r in early) == places.agg(F.sum("size")).first()[0] < sum(r.taken for r in got)
    assert all(r.taken == 0 and r.first_position is None for r in early if r.first_position is None or r.first_position >= 0.5)
