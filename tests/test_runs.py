"""The batch run: order over several payloads, newest records, incremental batches, repeated and missing numbers."""

import json

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import gold, resolution, schedules
from atlasmill.operators.numbering import numbered
from atlasmill.operators.runs import BatchRun, in_run_order, latest
from atlasmill.sources import payloads as S
from atlasmill.plans import tables as T
from atlasmill.streaming import jobs
from atlasmill.streaming.incremental import IncrementalResolution
from tests.conftest import SF


def test_numbers(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("a.b"))
    got = numbered(rows, ["k"], "n", 10).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(k, k + 10) for k in range(5000)]
    assert numbered(rows.where("k < 0"), ["k"], "n").count() == 0
    equal = numbered(rows.select(F.lit(1).alias("k")), ["k"], "n").collect()
    assert sorted(r["n"] for r in equal) == list(range(5000))


def element(i, name, lat):
    return {"type": "node", "id": i, "lat": lat, "lon": 27.1, "tags": {"name": name}}


def write(path, day, elements):
    path.write_text(json.dumps({"metadata": {"source": "osm", "extracted_at": f"2024-01-{day:02}T00:00:00Z"}, "data": {"elements": elements}}))


def test_places_of_several_payloads(spark, tmp_path):
    """Every payload counts its own rows from 0; the run tells them apart, and of each record the newest counts."""
    (tmp_path / "osm").mkdir()
    write(tmp_path / "osm/a.json", 1, [element(1, "Old", 38.1), element(2, "Two", 38.2)])
    write(tmp_path / "osm/b.json", 2, [element(1, "New", 38.1), element(3, "Three", 38.3)])
    write(tmp_path / "osm/c.json", 2, [element(4, "Four", 38.4), element(5, "Five", 37.0)])
    places = S.overpass_places(S.read_payload(spark, str(tmp_path / "osm"), S.OVERPASS))
    assert sorted(r.ord for r in places.collect()) == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        resolution.Resolution(places)
    assert [(r.ord, r.name_tr) for r in in_run_order(latest(places)).orderBy("ord").collect()] == [(0, "Two"), (1, "New"), (2, "Three"), (3, "Four"), (4, "Five")]
    run = BatchRun.of_files(spark, {"osm": str(tmp_path / "osm")})
    assert {r.cluster: r.isim["tr"] for r in run.places.collect()} == {0: "Two", 1: "New", 2: "Three", 3: "Four"}
    assert {r.metric: r.n for r in run.report().collect()} == {"extracted_osm": 6, "normalized_osm": 6, "geofence_dropped": 1, "silver_total": 4, "discarded": 0, "queued": 0, "merged": 0, "singletons": 4}


def test_datasets_of_one_name(spark, tmp_path):
    """A dataset that several searches found counts once a snapshot, wherever its copies lie; the first one does."""

    def dataset(name, label):
        return {"name": name, "license_id": "", "resources": [{"id": f"r-{label}", "records": [{"_id": "7", "ad": f"Yer {label}", "enlem": "38,4", "boylam": "27,1"}]}]}

    for file, day, sets in (("a", 1, [dataset("x", "a0"), dataset("x", "a1")]), ("b", 1, [dataset("x", "b0"), dataset("y", "b1")]), ("c", 2, [dataset("x", "c0")])):
        (tmp_path / f"{file}.json").write_text(json.dumps({"metadata": {"extracted_at": f"2024-01-{day:02}T00:00:00Z"}, "data": {"datasets": sets}}))
    got = S.ckan_places(S.read_payload(spark, str(tmp_path), S.CKAN)).collect()
    assert sorted(r.name_tr for r in got) == ["Yer a0", "Yer b1", "Yer c0"]


def everything(state):
    places = [(r.id, r.slug, r.members, round(r.kalite_skoru, 2), r.isim) for r in state.places().collect()]
    return sorted(map(tuple, state.clusters().collect())), sorted(places, key=repr), sorted((r.a, r.b) for r in state.queued().collect())


def test_incremental_equals_one_run(spark, tmp_path):
    """Batches in two orders, one of them repeated, with places seen before; then compaction and a further batch."""
    rows = T.raw_places(spark, SF).where("ord < 90")
    once = resolution.Resolution(rows)
    merged = resolution.merge_clusters(once.places.join(once.clusters, "ord"))
    places = [(r.id, r.slug, r.members, round(r.kalite_skoru, 2), r.isim) for r in gold.gold_places(merged, once.cluster_scores()).collect()]
    want = sorted(map(tuple, once.clusters.collect())), sorted(places, key=repr), sorted((r.a, r.b) for r in once.queued().collect())
    part = F.pmod(F.xxhash64(F.col("ord").cast("string")), F.lit(3))
    for name, order in (("x", (0, 1, 2)), ("y", (2, 0, 1))):
        state = IncrementalResolution(spark, str(tmp_path / name))
        for number, which in enumerate(order):
            batch = rows.where((part == which) | (F.col("ord") == 5))
            state.add(batch, number)
            if number == 1:
                state.add(batch, number)  # a batch that is run again replaces its first run
                state.compact()
        assert everything(state) == want
    state.compact()
    assert everything(state) == want


def test_incremental_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows, state = T.raw_places(spark, SF).where("ord < 30"), IncrementalResolution(spark, str(tmp_path / "state"))
    for low, high in ((0, 16), (16, 30)):
        rows.where((F.col("ord") >= low) & (F.col("ord") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state.run(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, state.clusters().collect())) == sorted(map(tuple, resolution.Resolution(rows).clusters.collect()))
    assert spark.read.parquet(str(tmp_path / "state/records")).count() == 30


def test_day_plans(spark):
    """Short routes against all orders of all sets of stops; long ones are feasible, and every stop has a row."""
    from itertools import permutations

    import numpy as np

    rng = __import__("random").Random(3)
    begin, end, speed = 9 * 3600, 17 * 3600, 50 / 3.6
    rows = []
    for r in range(60):
        for i in range(1 + r % 6):
            shut, opens = rng.random() < 0.1, rng.randrange(8, 13) * 3600
            rows.append((r, 100 * r + i, i, 38 + rng.random() / 5, 27 + rng.random() / 5, None if shut else opens, None if shut else opens + rng.randrange(1, 7) * 3600, rng.randrange(1, 6) * 1800))
    rows += [(r, 1000 * r + i, i, 38 + rng.random() / 50, 27 + rng.random() / 50, 8 * 3600, 18 * 3600, 600) for r in (70, 71) for i in range(70)] + [(99, i, i, 38.0, 27.0, 0, 1, 1) for i in range(251)]
    stops = spark.createDataFrame(rows, "route_id long, place_id long, order_index long, lat double, lng double, opens long, closes long, stay long").repartition(5)
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(x)

    def ends(path, s):
        now, at = begin, s[0]
        for j in path:
            if s[j][5] is None:
                return None
            now = max(now + int(schedules.seconds_between(*(np.array(v) for v in (at[3], at[4], s[j][3], s[j][4])), speed)), s[j][5])
            if now + s[j][7] > min(s[j][6], end):
                return None
            now, at = now + s[j][7], s[j]
        return now

    for sets in (1 << 14, 0):
        got = {}
        for x in schedules.day_plans(stops, sets=sets).collect():
            got.setdefault(x.route_id, []).append(x)
        assert {r: len(v) for r, v in got.items()} == {r: len(v) for r, v in by.items()}
        assert {x.status for x in got[99]} == {"over_limit"}
        full = 0
        for r, s in by.items():
            path = [x.order_index for x in sorted((x for x in got[r] if x.visit is not None), key=lambda x: x.visit)]
            assert all((x.status == "closed") == (s[x.order_index][5] is None) for x in got[r] if r != 99)
            if r < 60:
                every = [(-n, ends(p, s), p) for n in range(len(s) + 1) for p in permutations(range(len(s)), n)]
                best = min((n, e) for n, e, _ in every if e is not None)
                mine = (-len(path), ends(path, s))
                assert mine[1] is not None and (mine == best or sets == 0)
                full += mine[0] == best[0]
            elif r < 99:
                assert ends(path, s) is not None and len(path) > 30
        assert full >= (60 if sets else 52)


def test_queue_machine_restarts(spark, tmp_path):
    """Item 1 is answered after two failures, 2 never, 3 twice; a restart between the answers repeats no step."""
    schema = "queue_id long, ts timestamp, kind string, seq long, event string, status string, retry_count int"

    def at(minute):
        return __import__("datetime").datetime(2024, 1, 1, minute // 60, minute % 60)

    items = [(i, at(0), "item", 0, None, "pending", 0) for i in (1, 2, 3)] + [(4, at(0), "item", 0, None, "merged", 0), (1, at(1), "answer", 1, "api_error", None, None)]
    later = [(1, at(2), "answer", 2, "low_confidence", None, None), (1, at(0), "item", 0, None, "pending", 0), (3, at(2), "answer", 1, "reject", None, None), (3, at(3), "answer", 1, "merge", None, None), (9, at(2), "answer", 1, "merge", None, None)]
    last = [(1, at(4), "answer", 3, "merge", None, None)]
    ticks = [[(-1, at(m), "tick", 0, None, None, None)] for m in (200, 400, 600, 800)]
    runs = []
    for rows in (items, later, last, *ticks):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        steps = jobs.queue_machine(jobs.read_events(spark, str(tmp_path / "in"), schema, 1), delay="10 minutes")
        runs.append(jobs.machine_log(steps, str(tmp_path / "log"), str(tmp_path / "checkpoint")))
    got = sorted((r.queue_id, r.step, r.event, r.status, r.retry_count) for r in runs[-1].collect())
    assert got == [
        (1, 0, "queued", "pending", 0), (1, 1, "api_error", "retry", 1), (1, 2, "low_confidence", "retry", 2), (1, 3, "merge", "merged", 2),
        (2, 0, "queued", "pending", 0), (2, 1, "timeout", "retry", 1), (2, 2, "timeout", "retry", 2), (2, 3, "timeout", "rejected", 3),
        (3, 0, "queued", "pending", 0), (3, 1, "reject", "rejected", 0), (4, 0, "queued", "merged", 0),
    ]


def test_queue_items_share_state(spark, tmp_path):
    """Items of neighbouring ids, negative ones and the largest too, move apart from each other, and have few rows of state."""
    schema = "queue_id long, ts timestamp, kind string, seq long, event string, status string, retry_count int"

    def at(minute):
        return __import__("datetime").datetime(2024, 1, 1, minute // 60, minute % 60)

    ids = [*range(-300, 300), (1 << 63) - 1, -(1 << 63)]
    items = [(i, at(i % 7), "item", 0, None, "pending", i % 4) for i in ids]
    answers = [(i, at(50), "answer", 1, "merge" if i % 2 else "low_confidence", None, None) for i in ids if i % 3]
    for rows in (items, answers, *[[(-1, at(m), "tick", 0, None, None, None)] for m in (300, 600, 900)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    steps = jobs.queue_machine(jobs.read_events(spark, str(tmp_path / "in"), schema, 1), delay="10 minutes")
    log = jobs.machine_log(steps, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    want = set()
    for i in ids:
        tries, step, open_ = i % 4, 0, i % 4 < 3
        want.add((i, 0, "queued", "pending", tries))
        if open_ and i % 3:
            step, tries = 1, tries + (i % 2 == 0)
            open_ = i % 2 == 0 and tries < 3
            want.add((i, 1, "merge", "merged", tries) if i % 2 else (i, 1, "low_confidence", "retry" if open_ else "rejected", tries))
        while open_:
            step, tries = step + 1, tries + 1
            open_ = tries < 3
            want.add((i, step, "timeout", "retry" if open_ else "rejected", tries))
    assert sorted((r.queue_id, r.step, r.event, r.status, r.retry_count) for r in log.collect()) == sorted(want)
    state = spark.read.format("statestore").option("stateVarName", "items").load(str(tmp_path / "checkpoint"))
    assert state.count() <= 8


def test_stream_of_places_holds_no_table(spark, tmp_path, monkeypatch):
    """F16 to F18: a batch is dealt over tasks by its rows, and neither it nor the state is broadcast, whatever files say of their size."""
    from atlasmill import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    rows, state = T.raw_places(spark, SF).where("ord < 120"), IncrementalResolution(spark, str(tmp_path / "state"))
    done, spread = [], session.spread

    def seen(df, key, n):
        out = spread(df, key, n)
        done.append((n, out.rdd.getNumPartitions()))
        return out

    for module in ("atlasmill.streaming.incremental", "atlasmill.operators.resolution"):
        monkeypatch.setattr(f"{module}.spread", seen)
    for number in range(2):
        state.add(rows.where(F.col("ord") % 2 == number), number)
    assert len(done) == 6 and all(parts >= n / 10 for n, parts in done)
    for df in (state.clusters(), state.places(), state.queued()):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_route_days_are_planned_once(spark):
    """the query needs no second plan of all routes to know where a route ends."""
    from atlasmill.plans.schedules import route_days

    days = route_days(spark, SF)
    assert days._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = days.where("visit is not null").groupBy("route_id").agg(F.max("visit").alias("last"), F.max(F.when(F.col("route_ends").isNotNull(), F.col("visit"))).alias("ends"), F.count("route_ends").alias("n"))
    assert rows.count() > 0 and rows.where("last <> ends or n <> 1").count() == 0


def test_relations_of_one_table_travel_once(spark, tmp_path):
    """two relations of one DataFrame are sent to their user as one row, and rows become JSON after the shuffle."""
    from atlasmill.operators.accounts import export_users

    path = str(tmp_path / "a b%20c")
    spark.range(40).select((F.col("id") % 4).alias("user_id"), "id", (F.col("id") % 3).alias("at")).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("token", F.expr("uuid()"))
    out = export_users(spark.range(5).select(F.col("id").alias("user_id")), {"a": (rows, "at", ("id", "token")), "one": (rows.where("id < 9").select("user_id", "id"), "id"), "b": (rows, "id", ("token",))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan[plan.index("RepartitionByExpression") :]
    for r in out.collect():
        d = json.loads(r.document)
        assert d["user"] == {"user_id": r.user_id} and list(d) == ["user", "a", "one", "b"]
        mine = [i for i in range(39, -1, -1) if i % 4 == r.user_id]
        assert [x["id"] for x in d["one"]] == [i for i in mine if i < 9]
        assert [x["token"] for x in d["b"]] == [{x["id"]: x["token"] for x in d["a"]}[i] for i in sorted(mine, key=str, reverse=True)]  # order columns are compared as text
        assert [x["id"] % 3 for x in d["a"]] == sorted((i % 3 for i in mine), reverse=True)


def test_pairs_that_can_merge(spark):
    """clusters meet only pairs near enough to merge; none of those is missed, at the equator, in the pilot area or near a pole."""
    reach = resolution.reach_m(0.9)
    assert 14.2 < reach < 14.4 and resolution.reach_m(0.5) is None
    rng = __import__("random").Random(5)
    for lat in (0.0, 38.4, -71.3, 89.99995):
        wide = 2e-4 / max(__import__("math").cos(__import__("math").radians(lat)), 1e-6)
        points = [(i, min(lat + rng.random() * 1e-3, 90.0), min(27.0 + rng.random() * 5 * wide, 179.9)) for i in range(300)]
        places = T.as_raw_place(spark.createDataFrame(points, "ord long, lat double, lng double").withColumn("source", F.lit("osm")).withColumn("name_tr", F.lit("x")))
        every = resolution.candidate_pairs(places)
        near = resolution.pairs_within(places, reach)
        want = {(r.a, r.b) for r in resolution.pair_scores(every).where(F.col("distance_m") <= reach).collect()}
        got = [(r.a_ord, r.b_ord) for r in near.collect()]
        assert len(got) == len(set(got)) and want and want <= set(got) <= {(r.a_ord, r.b_ord) for r in every.select("a_ord", "b_ord").collect()}
        assert lat > 80 or len(got) < every.count() / 2


def test_tables_take_the_pairs_they_need(spark):
    """F6 to F8: the queue and the scores of clusters are those of all candidate pairs, which are not scored whole for them."""
    run = resolution.Resolution(T.raw_places(spark, SF))
    queue = sorted((r.a, r.b, r.total) for r in run.queued().collect())
    scores = sorted((r.cluster, r.members, r.min_score, r.max_score) for r in run.cluster_scores().collect())
    assert "scored" not in run.__dict__
    of = {r.ord: r.cluster for r in run.clusters.collect()}
    inner = {}
    for r in run.scored.collect():
        if of[r.a] == of[r.b]:
            inner.setdefault(of[r.a], []).append(r.total)
    members = list(of.values())
    assert scores == sorted((c, members.count(c), min(inner.get(c, [1.0])), max(inner.get(c, [1.0]))) for c in set(members))
    assert queue == sorted((r.a, r.b, r.total) for r in run.scored.where("total >= 0.6 and total < 0.9").collect() if of[r.a] != of[r.b])


def test_documents_in_lines(spark, tmp_path):
    """F6 to F8: documents of a file count their own rows, and its lines need a key to be told apart; a run makes no table that is not asked for."""

    def line(key, names):
        return json.dumps({"metadata": {"extracted_at": "2024-01-01T00:00:00Z", "idempotency_key": key}, "data": {"elements": [element(i, n, 38.1 + i / 10) for i, n in names]}})

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(line("osm:1:b", [(3, "Three"), (4, "Four")]) + "\n" + line("osm:1:a", [(1, "One"), (2, "Two")]) + "\n")
    run = BatchRun.of_files(spark, {"osm": str(tmp_path / "in")}, lines=True)
    assert [(r.ord, r.name_tr) for r in run.silver.orderBy("ord").collect()] == [(0, "One"), (1, "Two"), (2, "Three"), (3, "Four")]
    assert run.queue().count() == 0 and "merged" not in run.__dict__ and "places" not in run.__dict__
    (tmp_path / "in/b.json").write_text(line(None, [(5, "Five")]) + "\n")
    with pytest.raises(Exception, match="idempotency_key"):
        BatchRun.of_files(spark, {"osm": str(tmp_path / "in")}, lines=True)


def test_hours_without_times(spark):
    """a text without clock times or a word for closed has no slots, whatever days it names; one with either keeps them."""
    from atlasmill.functions.hours import turkish_hours

    texts = ["", "pazartesi, salı", "her gün", "cuma kapalı", "cuma kapali", "salı 9:00-17.30, pazar kapalı", "hafta içi 08:00 - 12:00"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.size(turkish_hours(F.col("t"))).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 1, 2, 5]
