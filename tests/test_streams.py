"""Streams with state against their batch twins, over any split into batches."""

import datetime
import random

import pytest

from tidemark.operators import views as vw
from tidemark.streaming import jobs

START = datetime.datetime(2024, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stamp(seconds):
    return START + datetime.timedelta(seconds=seconds)


def feed(spark, path, schema, batches):
    """A file a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


@pytest.fixture(autouse=True)
def provider(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("seed", [1, 2])
def test_watched_alerts_follow_the_list_as_it_stood(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema = "symbol string, ts timestamp, action string, sentiment double"
    rows = []
    for t in range(0, 600, 5):
        symbol = rng.choice("AB")
        if rng.random() < 0.25:
            rows.append((symbol, stamp(t), rng.choice(["add", "remove", "add", "other"]), None))
        else:
            rows.append((symbol, stamp(t), None, rng.choice([-0.9, -0.5, -0.3, -0.29, 0.0, 0.49, 0.5, 0.8])))
    rows += [("A", stamp(300), "add", None), ("A", stamp(300), None, -0.8), ("A", stamp(300), "remove", None), ("C", stamp(100), None, -0.9)]
    mixed = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.randint(0, 50)))  # up to 50 s out of order
    size = rng.choice([7, 13])
    batches = [mixed[i : i + size] for i in range(0, len(mixed), size)] + [[("Z", stamp(5000), None, 0.0)], [("Z", stamp(9000), None, 0.0)]]
    stream = feed(spark, tmp_path / "in", schema, batches)
    split = lambda df: (df.where("action IS NULL").select("symbol", "ts", "sentiment"), df.where("action IS NOT NULL").select("symbol", "ts", "action"))
    want = jobs.watched_alerts(*split(spark.createDataFrame(rows, schema))).collect()
    got = run(jobs.watched_alert_stream(*split(stream), late="60 seconds"), f"watch{seed}", "append")
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(got) == key(want) and 5 < len(want)
    assert {r.symbol for r in want} <= {"A", "B"}


def test_watch_list_in_small(spark):
    e = spark.createDataFrame([("A", stamp(1), -0.9), ("A", stamp(3), -0.4), ("A", stamp(4), 0.6), ("A", stamp(6), -0.6), ("A", stamp(8), 0.7)], "symbol string, ts timestamp, sentiment double")
    c = spark.createDataFrame([("A", stamp(2), "add"), ("A", stamp(5), "remove"), ("A", stamp(7), "add"), ("B", stamp(0), "add")], "symbol string, ts timestamp, action string")
    got = [(r.ts, r.previous, r.sentiment, r.kind, r.severity) for r in jobs.watched_alerts(e, c).orderBy("ts").collect()]
    assert got == [(stamp(3), None, -0.4, "drop", "medium"), (stamp(4), -0.4, 0.6, "surge", "low"), (stamp(8), None, 0.7, "surge", "low")]


QUESTIONS = [
    "is a1 safe for the long term", "tcs or infosys, quick view please", "I own T3 and T4, high growth ones", "show me a chart of T5 with its pe ratio", "kya T6 hai", "भारत", "will T7 crash or fall",
    "index fund with few months to go", "T8 T9 T10 and the bank sector", "T11 T12", "T3 again", None, "i hold T13, " + "and a long story " * 9,
]
ALIASES = {"a1": "ALPHA", "tcs": "TCS"}
ALLOWED = [f"T{i}" for i in range(3, 14)]


@pytest.mark.parametrize("known", [0, 9])
def test_live_profiles_equal_the_batch(spark, tmp_path, known):
    rng = random.Random(known)
    log = [(user, turn, rng.choice(QUESTIONS)) for user in ("u", "v", "w") for turn in range(25)]
    schema = "user_id string, turn long, text string"
    before, rest = log[:known] + log[30 : 30 + known], log[known:30] + log[30 + known :]
    rng.shuffle(rest)  # the state does not lean on the order
    batches = [rest[i : i + 11] for i in range(0, len(rest), 11)]
    stream = feed(spark, tmp_path / "in", schema, batches)
    live = jobs.live_profiles(stream, ALIASES, ALLOWED, spark.createDataFrame(before, schema) if known else None)
    got = {}
    for r in run(live, f"profiles{known}", "update"):
        got[r.user_id] = max(got.get(r.user_id, r), r, key=lambda x: x.n)
    want = vw.build_profiles(spark.createDataFrame(log, schema), ALIASES, ALLOWED)
    columns = sorted(want.columns)
    assert {u: [str(r[c]) for c in columns] for u, r in got.items()} == {r.user_id: [str(r[c]) for c in columns] for r in want.collect()}


def test_profiles_in_small(spark):
    rows = [("u", i, q) for i, q in enumerate(["safe bank stocks, i own T3", "yolo T4", "T5 T6 T7 T8 T9 T10 T11 T12 T13 T3 with roce", "10 year view"])]
    p = vw.build_profiles(spark.createDataFrame(rows, "user_id string, turn long, text string"), {}, ALLOWED).first()
    assert (p.n, p.risk, p.horizon, p.sectors, p.owned, p.level, p.language, p.persona) == (4, "aggressive", "long", ["banking"], ["T3"], "expert", "english", "aggressive, long, balanced")
    assert p.tickers == ["T3", "T4", "T5", "T6", "T7", "T8", "T9"]  # five of a question at most
