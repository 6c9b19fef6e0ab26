from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandect.streaming import changelog as S
from tests.conftest import rows

STATE = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField(S.OFFSET, T.LongType())])
MSG = f"id string, v int, {S.OFFSET} bigint, operation string"


def test_messages_are_applied_once(spark):
    state = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], STATE)
    batch = spark.createDataFrame([("a", 9, 4, "update"), ("b", 3, 6, "update"), ("b", 4, 7, "delete"), ("c", 1, 8, "insert"), ("d", None, 9, None), (None, 1, 9, "insert"), ("e", 1, 1, "delete")], MSG)
    got = S.apply_messages(state, batch, "id")
    assert rows(got) == [("a", 1, 5), ("c", 1, 8)]
    assert rows(S.apply_messages(got, batch.where("id = 'c'"), "id")) == rows(got)
    assert rows(S.apply_messages(state, batch.limit(0), "id")) == rows(state)


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source = str(tmp_path / "in")
    state = S.VersionedTable(spark, str(tmp_path / "table"), STATE, "id", 4)
    assert state.version() == -1 and state.read().count() == 0

    def play(checkpoint):
        stream = spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).parquet(source)
        S.follow(stream, state, str(tmp_path / checkpoint), F.col("v") > 0).awaitTermination()

    def feed(data, checkpoint="cp"):
        spark.createDataFrame(data, MSG).coalesce(1).write.mode("append").parquet(source)
        play(checkpoint)

    feed([("a", 1, 1, "insert"), ("b", 0, 2, "insert"), ("c", 5, 3, "insert"), (None, 1, 4, None)])
    assert rows(state.read()) == [("a", 1, 1), ("c", 5, 3)]
    feed([("a", 2, 4, "update"), ("c", 0, 5, "delete")])
    assert rows(state.read()) == [("a", 2, 4)] and state.version() == 1
    # A lost checkpoint: all batches come again in any order, and one more.
    feed([("d", 7, 6, "insert"), ("a", -1, 7, "update")], "new")
    assert rows(state.read()) == [("d", 7, 6)] and state.version() == 4
    play("newer")
    assert rows(state.read()) == [("d", 7, 6)]


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    state = S.VersionedTable(spark, str(tmp_path / "table"), STATE, "id", 8)
    everything = spark.createDataFrame([(f"k{i}", i, i, "insert") for i in range(100)], MSG)
    state.write(S.apply_stored(state.read_stored(), everything, "id"), state.touched(everything))
    one = spark.createDataFrame([("k5", 0, 200, "delete")], MSG)
    touched = state.touched(one)
    state.write(S.apply_stored(state.read_stored(touched), one, "id"), touched)
    after = state.manifest()
    assert len(touched) == 1 and [b for b, v in after.items() if v == 1] == touched and len(after) == 8
    assert state.read().count() == 99
    for _ in range(3):
        state.write(state.read_stored(touched), touched)
    kept = {n for n in state._names() if n.startswith("manifest")}
    assert kept == {"manifest-3", "manifest-4"} and state.read().count() == 99
    assert state._names("v=1") == ["_SUCCESS"]


def test_enrichment_and_dead_letters(spark):
    laws = spark.createDataFrame([("A", "old", 1), ("B", "keep", 2)], "name string, role string, n int")
    msg = spark.createDataFrame([("A", "new", 1), ("A", "newest", 2), ("Z", "lost", 3), (None, "x", 4), ("B", None, 5)], "name string, role string, offset bigint")
    out, dead = S.enrich(laws, msg, "name", ["role"])
    assert rows(out) == [("A", "newest", 1), ("B", "keep", 2)]
    assert sorted(r["offset"] for r in dead.collect()) == [3, 4]


def test_counts(spark):
    have = spark.createDataFrame([("a", 2, 10), ("b", 1, 5)], "k string, n bigint, latest bigint")
    batch = spark.createDataFrame([("a", "insert", 20), ("b", "delete", 30), ("c", "insert", 1), ("a", "update", 40)], "k string, operation string, at bigint")
    assert rows(S.add_counts(have, batch, "k", "at")) == [("a", 3, 40), ("c", 1, 1)]
    assert {tuple(r) for r in S.notify(batch, "t").collect()} == {("insert", 2, "t"), ("delete", 1, "t"), ("update", 1, "t")}


def test_counters_come_with_the_rows(spark):
    df, seen = S.counted(spark.createDataFrame([("a", 1, 1, "insert"), (None, None, 2, None)], MSG), "batch")
    assert df.count() == 2 and seen.get == {"rows": 2, "control": 1}
