"""Hand cases and brute-force comparisons for the table operators."""

import random

import pytest
from pyspark.sql import functions as F

from terrashelf import schemas, session
from terrashelf.operators import audit, crosswalk, distribution, prefix, ranking, upsert
from terrashelf.session import cut
from tests.conftest import rows


def cells(spark, **datasets):
    data = [(name, k, n) for name, d in datasets.items() for k, n in d.items()]
    return spark.createDataFrame(data, "dataset string, key string, n long")


def as_dict(df):
    out = {}
    for dataset, key, n in df.select("dataset", "key", "n").collect():
        assert key not in out.setdefault(dataset, {})
        out[dataset][key] = n
    return out


def plain_rollup(d, size=6, max_cells=10, p=0.75, floor=None):
    """The rules as a recursion over one dict, counts that meet under one key added."""
    if size >= max(map(len, d)):
        size -= 1
    if size < 1 or max_cells < 2 or len(d) <= max_cells:
        return d
    ordered = sorted(d.values())
    need = p * len(ordered)
    limit = next(n for i, n in enumerate(ordered, 1) if i >= need)
    groups = {}
    for k, n in d.items():
        if n < limit:
            groups[k[:size]] = groups.get(k[:size], 0) + n
    new = {}
    for k, n in d.items():
        small = n < limit and (floor is None or groups[k[:size]] < floor)
        key = k[:size] if small else k
        new[key] = new.get(key, 0) + n
    return plain_rollup(new, size - 1, max_cells, p, floor)


def test_statistics(spark):
    got = rows(distribution.statistics(cells(spark, a={"w": 1, "x": 2, "y": 3, "z": 4}, b={"q": 5})))
    assert got == [("a", 4, 10, 3, 1, 2, 1, 4), ("b", 1, 5, 5, 0, 5, 5, 5)]


def test_rollup_adds_counts_that_meet(spark):
    """Where a kept key equals a new prefix, a merge of objects would keep one of 50 and 3; here they add up."""
    df = cells(spark, d={"ab": 50, "abc": 1, "abd": 2, "xyz": 40})
    assert as_dict(distribution.rollup(df, size=2, max_cells=3)) == {"d": {"ab": 53, "xyz": 40}}


def test_rollup_equal_counts_stay(spark):
    d = {f"k{i:02d}": 1 for i in range(20)}
    assert as_dict(distribution.rollup(cells(spark, d=d))) == {"d": d}


def test_rollup_short_enough_stays(spark):
    d = {"abcdefgh": 1, "abcdefgi": 2}
    assert as_dict(distribution.rollup(cells(spark, d=d))) == {"d": d}


def test_rollup_floor(spark):
    df = cells(
        spark,
        d={"a1": 6, "a2": 5, "b1": 1, "b2": 2, "c1": 40, "c2": 30},
    )
    got = as_dict(distribution.rollup(df, size=1, max_cells=3, floor=10))
    assert got == {"d": {"a1": 6, "a2": 5, "b": 3, "c1": 40, "c2": 30}}


def test_rollup_floor_keeps_every_heavy_group(spark):
    """Three groups reach the floor; all of them stay fine."""
    d = {"a1": 6, "a2": 5, "b1": 1, "b2": 2, "c1": 40, "c2": 30, "d1": 6, "d2": 5}
    got = as_dict(distribution.rollup(cells(spark, d=d), size=1, max_cells=3, percentile=0.9, floor=10))
    assert got == {"d": {"a1": 6, "a2": 5, "b": 3, "c1": 40, "c2": 30, "d1": 6, "d2": 5}}


@pytest.mark.parametrize("floor, max_cells", [(None, 10), (None, 4), (30, 6)])
def test_rollup_equals_plain_rules(spark, floor, max_cells):
    rng = random.Random(7)
    data = {}
    for name, sizes in (("even", [5]), ("mixed", [2, 3, 4, 6]), ("few", [3])):
        data[name] = {}
        for _ in range(8 if name == "few" else 250):
            key = "".join(rng.choice("0123") for _ in range(rng.choice(sizes)))
            data[name][key] = rng.choice([1, 1, 2, 3, 5, 8, 40])
    # One dataset holds most of the cells.
    data["hot"] = {f"{i:05d}": i % 17 + 1 for i in range(2000)}
    df = cells(spark, **data)
    got = as_dict(distribution.rollup(df, size=5, max_cells=max_cells, floor=floor))
    assert got == {k: plain_rollup(d, 5, max_cells, 0.75, floor) for k, d in data.items()}
    for k, d in data.items():
        assert sum(got[k].values()) == sum(d.values()) and len(got[k]) <= len(d)


def test_percentile_is_single_precision(spark):
    """0.6 in single precision lies above 0.6: of ten cells the seventh is the limit, not the sixth."""
    d = {f"{i}x": i + 1 for i in range(10)}
    df = distribution.rollup(cells(spark, d=d), size=1, max_cells=2, percentile=0.6)
    assert sorted(k for k in as_dict(df)["d"] if len(k) == 2) == [f"{i}x" for i in range(6, 10)]


def test_share_text(spark):
    df = cells(spark, d={"b": 1, "a": 2, "c": 5})
    assert rows(distribution.share_text(df)) == [
        ("d", 0, 3, "<code>a</code>: 25%, <code>b</code>: 13%, <code>c</code>: 63%")
    ]
    parts = distribution.share_text(df, percent=False, link="x/", separator="|", part_cells=2)
    assert rows(parts) == [
        ("d", 0, 2, '<a href="x/a.geojson"><code>a</code></a>: 2%|<a href="x/b.geojson"><code>b</code></a>: 1%'),
        ("d", 1, 1, '<a href="x/c.geojson"><code>c</code></a>: 5%'),
    ]


def test_longest_prefix_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc%_") for _ in range(n))
    keys = [word(rng.randint(0, 7)) for _ in range(300)] + ["aaaa"] * 150 + [None]
    listed = [word(rng.randint(1, 4)) for _ in range(40)] + ["zz"]
    k = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "i int, k string")
    p = spark.createDataFrame([(x,) for x in listed], "p string")
    got = {r.i: r.matched_prefix for r in prefix.longest_prefix(k, "k", p, "p").collect()}
    want = {
        i: max((x for x in listed if key is not None and key.startswith(x)), key=len, default=None)
        for i, key in enumerate(keys)
    }
    assert got == want


def test_longest_prefix_without_prefixes(spark):
    k = spark.createDataFrame([("a",)], "k string")
    none = spark.createDataFrame([], "p string")
    assert rows(prefix.longest_prefix(k, "k", none, "p")) == [("a", None)]


def test_containing_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["aaaaaaaa"] * 100
    needles = ["a", "ab", "abc", "abcd", "aaaa", "zz", "d d", "", "b" * 30]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, t string")
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    got = {(r.n, r.id) for r in prefix.containing(n, "n", t, "id", "t").collect()}
    assert got == {(x, i) for x in needles if x for i, text in enumerate(texts) if x in text}


def test_stored_pieces_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows_ = [(i, rng.choice([None, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))]), "X" * (i % 5)) for i in range(200)]
    t = spark.createDataFrame(rows_, "id int, t string, u string")
    texts = {"low": "t", "up": "lower(u)"}
    prefix.store_piece_index(t, "id", texts, f"{tmp_path}/index", parts=4)
    asked = [("low", x) for x in ["a", "ab", "abcd", "zz", "abz", "d d", ""]] + [("up", x) for x in ["x", "xxxx", "X", "a"]] + [("none", "a"), ("low", None)]
    n = spark.createDataFrame(asked, "field string, needle string")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("lookup", "lookup")
    found = prefix.containing_indexed(n, f"{tmp_path}/index", t, "id", texts, parts=4)
    assert len(tracker.getJobIdsForGroup("lookup")) == 0
    sc.setJobGroup(None, None)
    text = lambda r, f: {"low": r[1], "up": r[2].lower()}.get(f)
    want = {(f, x, r[0]) for f, x in asked if x for r in rows_ if text(r, f) is not None and x in text(r, f)}
    assert {tuple(r) for r in found.collect()} == want


def test_stored_pieces_of_long_needles_are_rare(spark, tmp_path):
    """Numbers share their pieces of three signs with many rows; a needle is looked up by a piece that few rows hold."""
    t = spark.range(1000, 3000).selectExpr("cast(id as int) id", "concat('https://donor', id, '.example.org') t")
    prefix.store_piece_index(t, "id", {"t": "t"}, f"{tmp_path}/index", parts=4)
    n = spark.createDataFrame([("t", "nor1234.ex"), ("t", "1234"), ("t", "r1234")], "field string, needle string")
    assert rows(prefix.containing_indexed(n, f"{tmp_path}/index", t, "id", {"t": "t"}, parts=4)) == [
        ("t", "1234", 1234), ("t", "nor1234.ex", 1234), ("t", "r1234", 1234)]
    held = spark.read.parquet(f"{tmp_path}/index/counts").where("contains('nor1234.ex', gram)").agg({"n": "min"}).first()[0]
    assert held == 1


def test_crosswalk(spark):
    table = spark.createDataFrame(
        [("Itagui", "O", "8UQ", None), ("Medellin", "C", "8U", None), ("Busbanza", "C", "B57", ["H", "G"])],
        "isolabel_ext string, subprefix string, prefix string, subcells array<string>",
    )
    codes = spark.createDataFrame([("8UQ1",), ("8UR9",), ("B57H2",), ("B57X",), ("Z",)], "cell string")
    assert rows(crosswalk.cells_to_places(codes, "cell", table)) == [
        ("8UQ1", "Itagui", "O", "8UQ", "1"),
        ("8UR9", "Medellin", "C", "8U", "R9"),
        ("B57H2", "Busbanza", "C", "B57", "H2"),
        ("B57X", None, None, None, None),
        ("Z", None, None, None, None),
    ]
    assert crosswalk.overlapping_prefixes(table).count() == 0


def test_numbered_by_slices(spark):
    """A key with half of all rows, copies and null keys."""
    rng = random.Random(1)
    data = [("hot", rng.randint(0, 50)) for _ in range(400)] + [(None, i) for i in range(30)]
    data += [(f"k{i % 40}", i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int").repartition(6)
    got = rows(ranking.numbered(df, ["k"], ["v"], "n"))
    want, seen = [], {}
    for k, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, seen[k]))
    assert got == sorted(want, key=repr)


def test_numbered_deals_rows_out_once(spark, monkeypatch):
    """Rows of ordinary keys meet one exchange; a hot key is cut into slices and gets the same numbers."""
    data = [("hot", i % 90) for i in range(400)] + [(f"k{i % 40}", i) for i in range(300)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(data, "k string, v int").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cold = ranking.numbered(cut(df), ["k"], ["v"], "n")
        plan = cold._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        monkeypatch.setattr(ranking, "HOT_ROWS", 100)
        assert len(ranking.hot_buckets(df, "k")) == 1
        assert rows(ranking.numbered(df, ["k"], ["v"], "n")) == rows(cold)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbered_whole_table(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    got = ranking.numbered(df, [], ["v"], "n")
    assert got.count() == 500 and got.where("n <> v + 1").count() == 0


def scan(existing, incoming, keys):
    """Insert-ignore as a scan in row order."""
    taken = {(i, tuple(r[c] for c in k)) for r in existing for i, k in enumerate(keys) if all(r[c] is not None for c in k)}
    out = []
    for r in incoming:
        mine = {(i, tuple(r[c] for c in k)) for i, k in enumerate(keys) if all(r[c] is not None for c in k)}
        if not mine & taken:
            taken |= mine
            out.append(r["nth"])
    return out


def test_insert_ignore_hand_cases(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y")], "nth int, p string, q string")
    none = df.where("false")
    assert [r[0] for r in rows(upsert.insert_ignore(none, df, [["p"], ["q"]], "nth"))] == [1, 3]
    df = spark.createDataFrame([(1, None, "x"), (2, None, "z"), (3, None, None)], "nth int, p string, q string")
    assert [r[0] for r in rows(upsert.insert_ignore(none, df, [["p"], ["q"]], "nth"))] == [1, 2, 3]


def test_insert_ignore_equals_scan(spark):
    rng = random.Random(11)
    keys = [["p"], ["q", "r"], ["s"]]
    def row(i):
        return {
            "nth": i, "p": rng.choice([None, *range(60)]), "q": rng.randint(0, 9), "r": rng.choice([None, *range(9)]),
            "s": 1 if rng.random() < 0.35 else rng.randint(100, 400),
        }
    existing, incoming = [row(i) for i in range(25)], [row(i) for i in range(240)]
    incoming += [{**incoming[0], "nth": 240 + i} for i in range(120)]
    schema = "nth int, p int, q int, r int, s int"
    e = spark.createDataFrame([tuple(r.values()) for r in existing], schema)
    i = spark.createDataFrame([tuple(r.values()) for r in incoming], schema)
    got = upsert.insert_ignore(e, i, keys, "nth")
    assert sorted(r.nth for r in got.collect()) == scan(existing, incoming, keys)
    # Once inserted, the same rows change nothing any more.
    assert upsert.insert_ignore(e.unionByName(got), i, keys, "nth").count() == 0


def test_upsert_refuses_a_key_twice(spark):
    now = spark.createDataFrame([(1, "a")], "id int, v string")
    twice = spark.createDataFrame([(2, "b"), (2, "c")], "id int, v string")
    with pytest.raises(Exception, match="occurs twice in one load"):
        upsert.upsert(now, twice, "id", ["v"], True).collect()


def test_upsert_actions(spark):
    now = spark.createDataFrame([(1, "a", "i"), (2, "b", "j")], "id int, v string, info string")
    new = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "id int, v string, info string")
    assert rows(upsert.upsert(now, new, "id", ["v"], True)) == [
        (1, "a", "i", "kept"), (2, None, "j", "updated"), (3, "c", "new", "inserted"),
    ]
    assert rows(upsert.upsert(now, new, "id", ["v"], False)) == [
        (1, "a", "i", "kept"), (2, "b", "j", "kept"), (3, "c", "new", "inserted"),
    ]
    assert rows(upsert.outcome_counts(upsert.upsert(now, new, "id", ["v"], True))) == [
        ("inserted", 1), ("kept", 1), ("updated", 1)
    ]


def test_new_subscribers(spark):
    known = spark.createDataFrame([(7, "a@x.org")], "cust_id long, email string")
    sent = spark.createDataFrame(
        [(" A@X.org", "2022-01-01"), ("B@x.org", "2022-01-03"), ("b@x.org ", "2022-01-02"), ("c@x.org", "2022-01-01"), ("@no", "2022-01-01")],
        "email string, d string",
    ).select("email", F.col("d").cast("timestamp_ntz").alias("signature_date"))
    got = rows(upsert.new_subscribers(known, sent).select("cust_id", "email", "is_valid", "confirmed"))
    assert got == [(8, "c@x.org", False, False), (9, "b@x.org", False, False)]
    assert [r[1:] for r in rows(upsert.rejected_emails(sent))] == [
        ("@no", "email of 3 or fewer signs"), ("@no", "email without @ after its first sign")
    ]
    nobody = known.where("false")
    assert rows(upsert.new_subscribers(nobody, sent).select("cust_id")) == [(1,), (2,), (3,)]


def test_audits(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "ref int")
    parent = spark.createDataFrame([(2,), (3,)], "id int")
    assert rows(audit.orphans(child, "ref", parent, "id")) == [("ref", "1", 2)]
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, v string")
    assert rows(audit.duplicate_keys(df, [["k"], ["k", "v"]])) == [("k", "1", 2)]
    files = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "b"), ("g", "c"), ("g", "c")], "fhash string, fname string")
    assert rows(audit.same_content(files)) == [("h", 2, 3, "a", "b")]
    assert rows(audit.same_content_names(files)) == [("h", "a"), ("h", "b")]


def test_next_version(spark):
    df = spark.createDataFrame([("f", 2), ("f", 1), ("g", 5)], "fname string, at int")
    assert rows(audit.next_versions(df, ["fname"], ["at"])) == [("f", 1, 1), ("f", 2, 2), ("g", 5, 1)]
    assert rows(audit.first_per_key(df, ["fname"], ["at"])) == [("f", 1), ("g", 5)]


def test_seed_rows(spark):
    ct = schemas.content_types(spark)
    assert ct.count() == 19 and ct.where("is_useful IS NULL").count() == 4


@pytest.mark.parametrize("floor", [None, 3])
def test_hot_dataset_spreads_over_tasks(spark, floor):
    """One dataset with nine tenths of the cells: no task groups them all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        i = F.col("id")
        cells = spark.range(4000).select(
            F.when(i % 10 == 0, F.lit("b")).otherwise("a").alias("dataset"), F.lpad(F.hex(i), 6, "0").alias("key"),
            (i % 7).alias("n"),
        )
        for made in (distribution._round(cells.withColumn("size", F.lit(6)), 10, 0.75, floor), distribution.share_text(cells, part_cells=50)):
            tasks = made.where("dataset = 'a'").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
            assert len(tasks) == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_discard_deletes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    kept = session.cut(spark.range(3))
    assert kept.count() == 3 and session.discard(spark) == 1 and session.discard(spark) == 0
    with pytest.raises(Exception):
        kept.count()


@pytest.mark.parametrize("n", [24, 10_000])
def test_chain_of_clashes_reports_its_rounds(spark, n):
    """Row i shares a key with the row before it and another with the row after: every second row goes in."""
    told = []
    chain = spark.createDataFrame([(i, f"k{(i + 1) // 2}", f"m{i // 2}") for i in range(n)], "nth long, a string, b string")
    none = spark.createDataFrame([], "a string, b string")
    got = upsert.insert_ignore(none, chain, [["a"], ["b"]], "nth", told.append)
    assert sorted(r.nth for r in got.collect()) == list(range(0, n, 2))
    assert len(told) == 1 and told[0] <= 20


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(upsert, "COMPONENT_ENTRIES", 10)
    chain = spark.createDataFrame([(i, f"k{(i + 1) // 2}", f"m{i // 2}") for i in range(24)], "nth long, a string, b string")
    none = spark.createDataFrame([], "a string, b string")
    got = upsert.insert_ignore(none, chain, [["a"], ["b"]], "nth")
    assert sorted(r.nth for r in got.collect()) == list(range(0, 24, 2))


def test_keys_are_counted_in_one_scan(spark, tmp_path):
    spark.createDataFrame([(i % 7, f"v{i % 3}", None if i % 5 else i) for i in range(60)], "a long, b string, c long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    keys = [["a"], ["a", "b"], ["c"], ["b", "c"]]
    found = audit.duplicate_keys(df, keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert {r.unique_key: r.n_rows for r in found.collect() if r.value in ("0", "0|v0")} == {"a": 9, "a,b": 3}


def test_keys_are_dealt_by_their_number_and_hot_values_first_added_up(spark, monkeypatch):
    df = spark.createDataFrame([(None if i % 11 == 0 else i % 150, "hot" if i % 3 else f"v{i}", i) for i in range(600)], "a long, b string, c long")
    keys = [["a"], ["b"], ["c"], ["b", "a"]]
    want = rows(audit.duplicate_keys(df, keys))
    assert ("b", "hot", 400) in want and len(want) == 251
    monkeypatch.setattr(audit, "LOOKED_AT", 1.0)
    monkeypatch.setattr(audit, "TASK_KEYS", 50)
    dealt = audit.duplicate_keys(df, keys)
    # However the session is set, a task counts no more keys than it was given.
    assert dealt.rdd.getNumPartitions() > 40 and rows(dealt) == want
    monkeypatch.setattr(audit, "HOT_ROWS", 300)
    split = audit.duplicate_keys(df, keys)
    assert "LeftAnti" in split._jdf.queryExecution().executedPlan().toString() and rows(split) == want


def test_stored_upsert_leaves_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.createDataFrame([(i, f"n{i}", i) for i in range(200)], "id long, name string, kept long")
    upsert.store(table, path, "id", 16)
    files = lambda: {r.path: r.modificationTime for r in spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect()}
    before = files()
    sent = spark.createDataFrame([(3, "new", 0), (1000, "added", 7)], "id long, name string, kept long")
    done = upsert.upsert_stored(spark, path, sent, "id", ["name"], True, 16)
    outcome = {r.id: r.action for r in done.collect() if r.action != "kept"}
    assert outcome == {3: "updated", 1000: "inserted"}
    after = files()
    assert len(set(before.items()) & set(after.items())) >= 14
    assert rows(spark.read.parquet(path).drop("_part")) == rows(upsert.upsert(table, sent, "id", ["name"], True).drop("action"))
