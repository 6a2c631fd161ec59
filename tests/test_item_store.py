"""The item store against whole-table upserts and whole-window clustering: lookups, merges, replays, restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import clusters as C
from storyloom.operators import increments
from storyloom.operators.item_store import ItemStore
from storyloom.operators.upsert import DATE, ITEM_COLUMNS, KEY, apply_upsert, plan_upsert
from storyloom.session import materialize
from storyloom.streaming import jobs

START = datetime.datetime(2026, 5, 10)
SCHEMA = (
    "id bigint, source_id bigint, guid string, author string, title string, url string, canonical_url string, excerpt string, content_html string, image_url string, "
    "published_at timestamp, source_updated_at timestamp, content_fingerprint string, word_count int, status string, correction_note string, topics array<string>, "
    "fetched_at timestamp, updated_at timestamp, first_seen_at timestamp, last_seen_at timestamp, verification_status string, cluster_id bigint"
)
WORDS = [f"word{i}" for i in range(14)]


def entry(rng, i, day=None):
    """An item row; few words, so that titles meet."""
    title = " ".join(rng.sample(WORDS, rng.randint(2, 4))) if rng.random() < 0.9 else ""
    at = START + datetime.timedelta(days=rng.randint(0, 5) if day is None else day, minutes=rng.randint(0, 1400))
    url = f"https://w.example.com/{rng.randint(0, 30)}" if rng.random() < 0.2 else ""
    return {
        "id": i, "source_id": rng.randint(0, 3), "guid": f"g{i % 90}", "author": None, "title": title, "url": "u", "canonical_url": url, "excerpt": None, "content_html": f"body {i}",
        "image_url": None, "published_at": at, "source_updated_at": None, "content_fingerprint": rng.choice(["", f"f{rng.randint(0, 3)}"]), "word_count": 2, "status": rng.choice(["active", "corrected"]),
        "correction_note": None, "topics": ["tech"], "fetched_at": START, "updated_at": START, "first_seen_at": START, "last_seen_at": START, "verification_status": "reported", "cluster_id": None,
    }


def frame(spark, rows):
    return spark.createDataFrame([[r[c.split()[0]] for c in SCHEMA.split(", ")] for r in rows], SCHEMA)


def stored_rows(rng, n):
    rows = {}
    for i in range(1, n + 1):
        r = entry(rng, i)
        rows.setdefault((r["source_id"], r["guid"]), r)
    return list(rows.values())


def plain_rows(df, drop=("id",)):
    return sorted((tuple(r) for r in df.select(*[c for c in ITEM_COLUMNS if c not in drop]).collect()), key=repr)


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Many small plans over few rows: compiling each of them takes longer than running it."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def batches(spark):
    def make(seed, n_stored=60, n_batches=3, size=40):
        rng = random.Random(seed)
        stored = frame(spark, stored_rows(rng, n_stored))
        parts = [frame(spark, [entry(rng, rng.randint(1, 200)) for _ in range(size)]).drop("id").withColumn("ord", F.monotonically_increasing_id()) for _ in range(n_batches)]
        return stored, [materialize(p, "batch") for p in parts]

    return make


@pytest.mark.parametrize("seed", [1])
def test_batches_equal_whole_table_upserts(spark, tmp_path, batches, seed):
    stored, parts = batches(seed)
    store, plain, versions = ItemStore.create(str(tmp_path / "s"), stored, buckets=7), stored, []
    for n, part in enumerate(parts):
        now = F.lit(START + datetime.timedelta(days=9, hours=n))
        plan = plan_upsert(plain, part, now, cut=lambda df: materialize(df, "plain"))
        versions.append(materialize(plan.versions.drop("item_id"), "plain-versions"))
        plain = materialize(apply_upsert(plain, plan.rows), "plain-items")
        store.upsert(part, now, n)
        assert plain_rows(store.items()) == plain_rows(plain)
        if n == 1:
            store.merge(most=1)
            assert plain_rows(store.items()) == plain_rows(plain)
    ids = [r.id for r in store.items().select("id").collect()]
    # Ids are unique, old ones stay, and new ones follow without gaps.
    top = max(r.id for r in stored.collect())
    fresh = sorted(i for i in ids if i > top)
    assert len(set(ids)) == len(ids) and fresh == list(range(top + 1, top + 1 + len(fresh))) and fresh
    want = sorted(repr(tuple(r)) for v in versions for r in v.collect())
    assert sorted(repr(tuple(r)) for r in store.versions().drop("item_id").collect()) == want
    keys = store.tables.read("keys").select("source_id", "guid", "day").collect()
    assert sorted(map(tuple, keys)) == sorted((r.source_id, r.guid, r[DATE]) for r in store.items().collect())


def opened(df):
    return {f.split(f"/{DATE}=")[1].split("/")[0] for f in df.inputFiles() if f"/{DATE}=" in f}


def test_a_batch_opens_its_own_buckets_and_dates(spark, tmp_path):
    rng = random.Random(5)
    rows = stored_rows(rng, 80)
    store = ItemStore.create(str(tmp_path / "s"), frame(spark, rows), buckets=50)
    day = rows[0]["published_at"].date()
    batch = frame(spark, [r for r in rows if r["published_at"].date() == day][:3])
    found = store.lookup(batch)
    assert opened(found.rows) == {str(day)} and found.rows.count() == batch.count()
    buckets = {r.b for r in batch.select(ItemStore.bucket(50).alias("b")).collect()}
    index = store.tables.read("keys", buckets)
    assert {int(f.split("/bucket=")[1].split("/")[0]) for f in index.inputFiles()} == buckets and len(buckets) <= 3
    before = store.tables.manifest()
    store.upsert(batch.drop("id").withColumn("ord", F.lit(1).cast("bigint")), F.lit(START), 0)
    after = store.tables.manifest()
    grown = {t: [p for p, v in after.live[t].items() if v != before.live[t].get(p)] for t in ("items", "keys")}
    assert grown == {"items": [str(day)], "keys": []}
    late = START + datetime.timedelta(days=4)
    assert opened(store.items(since=F.lit(late))) <= {str(late.date() + datetime.timedelta(days=d)) for d in range(3)}
    # A read of some columns opens no body.
    plan = store.items(days=[day]).select("id", "cluster_id")._jdf.queryExecution().executedPlan().toString()
    assert "content_html" not in plan


def test_merge_and_vacuum(spark, tmp_path, batches):
    stored, parts = batches(3, n_batches=2)
    store = ItemStore.create(str(tmp_path / "s"), stored, buckets=4)
    for n, part in enumerate(parts):
        store.upsert(part, F.lit(START), n)
    rows, versions = plain_rows(store.items(), ()), store.versions().count()
    assert max(map(len, store.tables.manifest().live["items"].values())) > 1
    store.merge(most=1)
    assert {len(v) for t in ("items", "keys", "titles") for v in store.tables.manifest().live[t].values()} == {1}
    assert plain_rows(store.items(), ()) == rows and store.versions().count() == versions
    assert store.vacuum(keep=1) > 0 and store.vacuum(keep=1) == 0
    assert plain_rows(store.items(), ()) == rows and store.versions().count() == versions
    live = {f"{DATE}={p}/version={v[0]}" for p, v in store.tables.manifest().live["items"].items()}
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "s" / "items").glob("*/version=*")} == live
    assert len(list((tmp_path / "s" / "manifest").glob("version=*"))) == 1


def test_a_failed_commit_and_a_replay_change_nothing(spark, tmp_path, batches, monkeypatch):
    stored, parts = batches(4, n_batches=2)
    store = ItemStore.create(str(tmp_path / "s"), stored, buckets=4)
    rows = plain_rows(store.items(), ())

    def fail(manifest):
        raise RuntimeError("stopped before the manifest")

    with monkeypatch.context() as m:
        m.setattr(store.tables, "_publish", fail)
        with pytest.raises(RuntimeError):
            store.upsert(parts[0], F.lit(START), 0)
    assert plain_rows(store.items(), ()) == rows and not store.has_done(0)
    # Another batch takes the version of the failed one; its left-over folders do not show.
    store.upsert(parts[1], F.lit(START), 0)
    clean = ItemStore.create(str(tmp_path / "t"), stored, buckets=4)
    clean.upsert(parts[1], F.lit(START), 0)
    assert plain_rows(store.items(), ()) == plain_rows(clean.items(), ()) and store.has_done(0)
    again = ItemStore.open(spark, str(tmp_path / "s"), stored.schema)
    assert plain_rows(again.items(), ()) == plain_rows(clean.items(), ()) and again.facts == clean.facts


def sources(spark):
    rows = [(0, "news", "independent", "a"), (1, "news", "major", "b"), (2, "social", "social", "c"), (3, "news", "independent", "a")]
    return spark.createDataFrame(rows, "id bigint, source_class string, credibility_tier string, source_family string")


def groups(df):
    """Clusters as sets of keys, and the status of every item."""
    by, status = {}, {}
    for r in df.collect():
        by.setdefault(r.cluster_id if r.cluster_id is not None else ("alone", r.source_id, r.guid), set()).add((r.source_id, r.guid))
        status[r.source_id, r.guid] = r.verification_status
    return sorted(map(sorted, by.values())), status


@pytest.mark.parametrize("seed", [1])
def test_clustering_what_changed_equals_clustering_all(spark, tmp_path, batches, seed):
    """Batches that change titles and move the window: after each, the clusters of a rerun over the whole window."""
    stored, parts = batches(seed, n_stored=30, n_batches=2, size=25)
    store, known = ItemStore.create(str(tmp_path / "s"), stored, buckets=4), sources(spark)
    plain, old = stored, spark.createDataFrame([], "id bigint")
    for n, part in enumerate([None, *parts]):
        now = F.lit(START + datetime.timedelta(days=4, hours=14 * n))
        if part is not None:
            store.upsert(part, now, n)
            # The whole-table side takes the ids that the store gave, as the order of ids decides ties.
            ids = store.items().select(*KEY, F.col("id").alias("given"))
            plain = apply_upsert(plain, plan_upsert(plain, part, now).rows).join(ids, KEY).withColumn("id", F.coalesce("id", "given")).select(*ITEM_COLUMNS)
            plain = materialize(plain, "plain")
        increments.cluster_changes(store, known, now)
        whole = C.cluster_and_verify(plain, known, old, now)
        old = materialize(old.select("id").unionByName(whole.clusters.select("id")), "old")
        placed = plain.join(whole.members.withColumnRenamed("cluster_id", "joined"), "id", "left").join(whole.verified.withColumnRenamed("verification_status", "verified"), "id", "left")
        placed = placed.withColumns({"cluster_id": F.coalesce("cluster_id", "joined"), "verification_status": F.coalesce("verified", "verification_status")})
        plain = materialize(placed.select(*ITEM_COLUMNS), "plain")
        assert groups(store.items()) == groups(plain), n
        if n == 1:
            store.merge(most=1)
            store.vacuum()
            assert groups(store.items()) == groups(plain)
    assert store.clusters().count() == old.count() and len(groups(plain)[0]) < plain.count()
    assert {r.id for r in store.clusters().collect()} == set(range(1, old.count() + 1))


def test_a_second_run_pairs_new_titles_only(spark, tmp_path, batches, monkeypatch):
    """What a run looks at: the titles that share a rare token with a new one, and no bodies."""
    rng = random.Random(8)
    rows = [entry(rng, i, day=4) | {"title": f"alpha{i} beta{i} gamma{i}", "guid": f"k{i}", "canonical_url": ""} for i in range(1, 60)]
    store = ItemStore.create(str(tmp_path / "s"), frame(spark, rows), buckets=4)
    now = F.lit(START + datetime.timedelta(days=5))
    increments.cluster_changes(store, sources(spark), now)
    new = [entry(rng, 0, day=4) | {"title": "alpha7 beta7 gamma7 delta", "guid": "new", "source_id": (rows[6]["source_id"] + 1) % 4, "canonical_url": ""}]
    store.upsert(frame(spark, new).drop("id").withColumn("ord", F.lit(1).cast("bigint")), now, 1)
    seen = {}

    def watch(df, name):
        seen[name] = df
        return materialize(df, name)

    monkeypatch.setattr(increments, "materialize", watch)
    done = increments.cluster_changes(store, sources(spark), now)
    assert seen["touched-titles"].count() == 2 and done.members.count() == 2
    for df in seen.values():
        assert "content_html" not in df._jdf.queryExecution().executedPlan().toString()


def test_stream_after_a_restart(spark, tmp_path):
    """Raw entries in files, one a batch, with a stop and a changed entry; the end is what one upsert of all gives."""
    schema = (
        "source_id bigint, guid string, ord bigint, title string, url string, canonical_url string, author string, excerpt string, content_html string, image_url string, "
        "published_at timestamp, updated_at timestamp, status_hint string, correction_note string"
    )
    policy = sources(spark).selectExpr("*", "false AS named_author_required", "array('tech') AS topic_hints")
    now = F.lit(START + datetime.timedelta(days=1))

    def raw(i, text):
        return (i % 4, f"g{i}", i, f"Title {i}", f"https://a.example.com/{i}", None, "A", None, f"<p>{text} {i}</p>", None, START + datetime.timedelta(hours=i % 20), None, None, None)

    files = [[raw(i, "one") for i in range(8)], [raw(i, "two") for i in range(4, 12)], [raw(i, "two") for i in range(6, 14)] + [raw(1, "three")]]
    path, store = str(tmp_path / "in"), ItemStore.create(str(tmp_path / "s"), spark.createDataFrame([], SCHEMA), buckets=4)
    for part in (files[:2], files[2:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)
        jobs.ingest_stream(stream, policy, store, str(tmp_path / "cp"), now, clusters=True, merge_every=2)
        store = ItemStore.open(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema)
    assert store.facts["batch"] == 2
    rows = {r.guid: r for r in store.items().collect()}
    last = {}
    for part in files:
        last |= {r[1]: r[8] for r in part}
    assert {g: r.content_html for g, r in rows.items()} == last and {r.id for r in rows.values()} == set(range(1, 15))
    # Four of the second file changed, most of the third came unchanged, one changed.
    assert store.versions().count() == 4 + 1 and rows["g5"].status == "updated" and rows["g13"].status == "active"
    assert len(list((tmp_path / "s" / "manifest").glob("version=*"))) <= 5
