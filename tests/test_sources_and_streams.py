"""Readers, caches, sinks and streams on small files of their own."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import coupling as C
from tallyhouse.operators import events as E
from tallyhouse.operators import graph as G
from tallyhouse.operators import inference as I
from tallyhouse.operators import joins as J
from tallyhouse.operators import vectors as V
from tallyhouse.operators import windows as W
from tallyhouse.sources import readers as S
from tallyhouse.streaming import panels as St


def test_report_csv_keeps_na_as_text(spark, tmp_path):
    (tmp_path / "r.csv").write_text('documentID,createdAt,text,fear\n1,2024-01-02 03:04:05,NA,0.5\n2,never,"a\nb",x\n3,,,\n')
    got = {r.documentID: r for r in S.report_csv(spark, str(tmp_path), ["fear"], ["createdAt"]).collect()}
    assert got["1"].text == "NA" and got["1"].fear == 0.5 and got["1"].createdAt.year == 2024
    assert got["2"].fear is None and got["2"].createdAt is None and got["2"].text == "a\nb"
    assert got["3"].text is None


def test_journal(spark, tmp_path):
    (tmp_path / "2024-03-01-a.md").write_text("---\ntitle: \"A dream\"\nlang: en\nsymbols: [water, door]\ntags:\n  - x\n  - y z\n---\n# Head\nI walked home.\n")
    (tmp_path / "b.md").write_text("---\ndate: 2024-05-06\n---\n# only a head\n")
    (tmp_path / "c.md").write_text("---\ndate: 2024-05-06\nlucid: yes\n---\ntext\n")
    got = {r.doc_id: r for r in S.journal(spark, str(tmp_path)).collect()}
    assert set(got) == {"2024-03-01-a", "c"}
    a = got["2024-03-01-a"]
    assert (a.title, a.text, str(a.day), a.symbols, a.tags) == ("A dream", "I walked home.", "2024-03-01", ["water", "door"], ["x", "y z"])
    assert got["c"].lucid == "yes" and str(got["c"].day) == "2024-05-06"


def test_index_lines(spark):
    lines = spark.createDataFrame([("# head",), ("2024 01 02 1 2 3 4 5.667 0 0 0 12",)], "value string")
    r = S.index_lines(lines).first()
    assert (r.k_max, r.k_mean, r.daily_index, r.storm_minor, r.storm_strong) == (5.667, pytest.approx(15.667 / 8), 12, 1, 0)


def test_level_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,VIX\n2024-01-01,.\n2024-01-02,13.2\nbad,1\n")
    assert [(str(r.day), r.value) for r in S.level_csv(spark, str(tmp_path), "DATE", "VIX").collect()] == [("2024-01-02", 13.2)]


def test_event_families(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01", 6.5, "US"), ("b", "no date", 7.0, "US"), ("c", "2024-02-01", None, "FR")], "event_id string, calendar_date_start string, magnitude double, iso3 string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("d", "2024-01-05", 3, "US")], "event_id string, calendar_date_start string, terror_nkill int, iso3 string").write.parquet(str(tmp_path / "t"))
    both = [str(tmp_path / "q"), str(tmp_path / "t")]
    assert S.event_families(spark, both).count() == 4
    assert [r.event_id for r in S.event_families(spark, both, start="2024-01-01", least_magnitude=6).collect()] == ["a"]


def test_posts_and_leads(spark):
    p = spark.createDataFrame([(0.0, "u", "A title of some length", "[deleted]", "f"), (1.0, "[deleted]", "t" * 30, "x", None), (2.0, "v", "hi", "x", None)], "created_utc double, author string, title string, selftext string, link_flair_text string")
    got = S.posts(p).collect()
    assert len(got) == 1 and got[0].text == "A title of some length" and got[0].ts.year == 1970
    t = spark.createDataFrame([("= Head =\n\none\ntwo\nthree\nfour",)], "t string")
    assert t.select(S.lead_section(F.col("t"), 1000, 3).alias("r")).first().r == "one\ntwo\nthree"


def test_caches_compute_only_what_they_lack(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def compute(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.select("k", F.length("k").alias("n"))

    a = spark.createDataFrame([("a",), ("bb",), ("bb",)], "k string")
    assert S.extended_cache(spark, a, path, "k", compute).count() == 3
    assert S.extended_cache(spark, a.union(spark.createDataFrame([("ccc",)], "k string")), path, "k", compute).count() == 4
    assert seen == [["a", "bb"], ["ccc"]]
    S.append_new(a, str(tmp_path / "sink"), "k")
    S.append_new(a, str(tmp_path / "sink"), "k")
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_sinks_and_cards(spark, tmp_path):
    d = spark.createDataFrame([("en", 1), ("ru", 2)], "lang string, v int")
    S.write_reports(d, str(tmp_path / "r"))
    plan = spark.read.parquet(str(tmp_path / "r")).where("lang = 'ru'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan
    S.write_panel(d, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 2
    card = S.data_card(spark, "n", "s", "l", "open", str(tmp_path / "p"), extra={"rows": "2"})
    card.write.json(str(tmp_path / "c"))
    r = S.read_cards(spark, str(tmp_path / "c")).first()
    assert r.bytes > 0 and len(r.sha256) == 64 and r.extra == {"rows": "2"} and r.size.endswith(" B")


def test_streamed_panel_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):
        src.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = St.timed(St.stream(spark, str(tmp_path / "in"), src.schema), late="400 days")
    q = St.tumbling(s, "value", "event_type", "7 days").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("weeks").agg(F.sum("n_reports")).first()[0]
    assert got == src.count() and all(r.start.weekday() == 0 for r in spark.table("weeks").collect())
    q = St.append_scored(St.stream(spark, str(tmp_path / "in"), src.schema), str(tmp_path / "out"), str(tmp_path / "ck"), "event_id", lambda d: d.select("event_id", (F.col("value") * 2).alias("v")))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == src.count() == spark.read.parquet(str(tmp_path / "out")).count()


def test_components_by_labels_and_persistence(spark):
    n = spark.range(7).withColumnRenamed("id", "x")
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (5, 4)], "a long, b long")
    assert {r.x: r.component for r in G.components(e, n, "x").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_event_study_finds_an_injected_step(spark):
    days = spark.range(400).select(F.expr("date_add(date'2023-01-01', int(id))").alias("day"), F.lit(30).alias("n"), (F.pmod(F.col("id") * 7919, F.lit(101)) / 101).alias("v"))
    ev = spark.createDataFrame([(f"2023-{m:02d}-15",) for m in range(2, 12)], "day string").select(F.col("day").cast("date").alias("day"))
    near = J.near_days(ev, 1, 7).select("day").distinct().withColumn("hit", F.lit(2.0))
    hit = days.join(near, "day", "left").withColumn("v", F.col("v") + F.coalesce("hit", F.lit(0.0)))
    a, b = (E.event_study(d, ev, "v", permutations=200).first() for d in (hit, days))
    assert a.p < 0.02 < b.p and a.effect == pytest.approx(2 + b.effect, abs=0.05) and a.n_events == 10 and a.n_dropped == 0


def test_cohesion_equals_pairs(spark):
    u = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "g int, u array<double>")
    assert {r.g: r.cohesion for r in V.cohesion(u, "u", ["g"]).collect()} == {1: 0.0, 2: 1.0}


def test_shuffles_keep_people_apart(spark):
    d = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "i int, p int, v double")
    s = V.within_shift_null(d, "p", "v", "i", 1).collect()
    assert sorted((r.p, r.shuffled) for r in s) == sorted((r.p, r.v) for r in s) and any(r.v != r.shuffled for r in s)


def test_two_way_effects_recover_what_was_put_in(spark):
    rows = [(p, d, 3.0 * p + 2.0 * (d % 2)) for p in range(6) for d in range(10) if (p + d) % 4]
    r = I.two_way_effects(spark.createDataFrame(rows, "p int, d int, v double"), "v", "p", "d").first()
    assert r.var_resid == pytest.approx(0, abs=1e-8) and r.var_beta > 0.8 and r.n_obs == len(rows)


def test_best_split_and_tau(spark):
    s = spark.createDataFrame([(t, float(t >= 12)) for t in range(30)], "t int, v double")
    assert C.best_split(s, "v").first().pos == 12
    k = C.kendall(s.withColumn("g", F.lit(1)), "t", "v", ["g"]).first()
    assert k.tau == pytest.approx(216 / (435 * 216) ** 0.5)


def test_warning_indicators_equal_loops(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=60)
    d = spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "day int, v double")
    for r in W.warning_indicators(d, "v").collect():
        seg = x[max(0, r.day - 27) : r.day + 1]
        if len(seg) >= 28:
            assert r.variance == pytest.approx(seg.var(ddof=1)) and r.ar1 == pytest.approx(np.corrcoef(seg[:-1], seg[1:])[0, 1])


def test_searches_in_several_blocks_equal_one(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    c = V.unit_means(e, "embedding", ["label"]).select("label", F.col("unit").alias("embedding"))
    one = [sorted(map(str, f.collect())) for f in (J.nearest(q, e, "vec_id", "embedding", 3).drop("sim"), J.rank_of_true(q, c, "vec_id", "label", "embedding"))]
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    many = [sorted(map(str, f.collect())) for f in (J.nearest(q, e, "vec_id", "embedding", 3).drop("sim"), J.rank_of_true(q, c, "vec_id", "label", "embedding"))]
    assert one == many and len(one[0]) == 3 * q.count()


def test_kept_identities_beat_relabelled_ones(spark):
    import numpy as np

    from tallyhouse.operators import nulls as N

    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    rows = [(i, w, *map(float, x[i] + rng.normal(0, 0.05, 3))) for i in range(40) for w in (1, 2)]
    r = N.neighbour_overlap(spark.createDataFrame(rows, "p int, w int, a double, b double, c double"), "p", "w", ["a", "b", "c"], draws=50).first()
    assert r.overlap > 0.6 and r.p < 0.05 and abs(r.null_mean - r.chance) < 0.1


def test_aligned_days_are_in_synchrony(spark):
    import numpy as np

    from tallyhouse.operators import nulls as N
    from tallyhouse.operators import replicates as Rep

    rng = np.random.default_rng(1)
    rows = []
    for d in range(30):
        turn = rng.uniform(0, 6.28)
        for u in range(12):
            a = turn + rng.normal(0, 0.3)
            rows.append((d, u, [float(np.cos(a)), float(np.sin(a))]))
    units = spark.createDataFrame(rows, "d int, unit_id int, u array<double>").select(F.expr("date_add(date'2024-01-01', d)").alias("day"), "unit_id", "u")
    s = Rep.synchrony(units, "u", 2, within=10, draws=100, same_weekday=False)
    r = N.stouffer(s).first()
    assert r.stouffer_z > 5 and r.n == 30 and s.agg(F.min("n")).first()[0] == 12
