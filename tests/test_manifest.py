"""Refreshes by a manifest of files: what they read and what they return."""

import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import incremental as I
from lakeloom.operators import manifest as M
from lakeloom.session import scratch_path
from lakeloom.sources.commits import claim, claims, read_claim, remove_path
from lakeloom.sources.sinks import publish_versioned

SCHEMA = StructType().add("k", "string").add("v", "long")


def totals(df):
    return df.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


class Source:
    """A folder of files and what refreshes of it read."""

    def __init__(self, spark):
        self.spark, self.root = spark, scratch_path(spark, "manifest-test")
        self.folder, self.store = f"{self.root}/in", f"{self.root}/store"
        self.read, self.seen = [], []

    def put(self, name, data):
        df = self.spark.createDataFrame(data, "k string, v bigint").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def refresh(self, **more):
        self.read, self.seen = [], []

        def prepare(df):
            self.read.append({f.split("/")[-2] for f in df.inputFiles()})
            return df

        def compute(df):
            self.seen.append({r.k for r in df.select("k").distinct().collect()})
            return totals(df)

        return M.refresh_files(self.spark, self.folder, self.store, ["k"], compute, prepare, schema=SCHEMA, **more)

    def whole(self):
        return rows(totals(self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.folder)))


def test_only_changed_files_and_those_of_stale_keys_are_read(spark):
    source = Source(spark)
    source.put("one", [("a", 1), ("b", 2), (None, 3)])
    source.put("two", [("b", 4)])
    source.put("with space+{x}[1]", [("c", 5), (None, 6)])
    assert rows(source.refresh()) == source.whole()
    assert source.read[0] == {"one", "two", "with%20space+%7Bx%7D%5B1%5D"}

    assert rows(source.refresh()) == source.whole()
    assert (source.read, source.seen) == ([set(), set()], [set()])

    source.put("two", [("b", 40), ("d", 1)])
    assert rows(source.refresh()) == source.whole()
    # the changed file for its tokens; the files that hold b or d for the result
    assert source.read == [{"two"}, {"one", "two"}] and source.seen == [{"b", "d"}]

    source.put("with space+{x}[1]", [("c", 5), (None, 7)])
    assert rows(source.refresh()) == source.whole()
    assert source.seen == [{None}]

    remove_path(spark, f"{source.folder}/two")
    assert rows(source.refresh()) == source.whole()
    assert source.read == [set(), {"one"}] and source.seen == [{"b"}]


def test_the_same_rows_in_other_files_are_not_stale(spark):
    source = Source(spark)
    source.put("one", [("a", 1), ("b", 2)])
    source.refresh()
    remove_path(spark, f"{source.folder}/one")
    source.put("two", [("b", 2)])
    source.put("three", [("a", 1)])
    assert rows(source.refresh()) == source.whole()
    assert source.read[0] == {"two", "three"} and source.seen == [set()]


def test_multiplicity_nulls_and_definitions_count(spark):
    source = Source(spark)
    source.put("one", [("a", 1), ("b", None)])
    source.refresh()
    source.put("one", [("a", 1), ("a", 1), ("b", 0)])
    assert rows(source.refresh()) == source.whole()
    assert source.seen == [{"a", "b"}]
    source.refresh(definition="second")
    assert source.seen == [{"a", "b"}]


def test_results_in_many_attempts_are_brought_together(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_ATTEMPTS", 3)
    source = Source(spark)
    for turn in range(6):
        source.put(f"part{turn}", [(f"k{turn}", turn), ("last", turn)])
        assert rows(source.refresh()) == source.whole()
        assert source.seen == [{f"k{turn}", "last"}]
    store = M.FileStore(spark, source.store)
    assert store.read("built", store.state()[1]).select("attempt").distinct().count() <= 3


def test_an_empty_folder_has_an_empty_result(spark):
    source = Source(spark)
    source.put("one", [("a", 1)])
    remove_path(spark, f"{source.folder}/one")
    assert rows(source.refresh()) == []
    source.put("one", [("a", 1)])
    assert rows(source.refresh()) == source.whole()
    remove_path(spark, f"{source.folder}/one")
    assert rows(source.refresh()) == []


def test_of_two_refreshes_at_once_one_makes_the_state(spark):
    source = Source(spark)
    source.put("one", [("a", 1)])
    source.refresh()
    store = M.FileStore(spark, source.store)
    number, _ = store.state()
    store.commit(number + 1, "mine")
    with pytest.raises(RuntimeError, match="another refresh"):
        store.commit(number + 1, "theirs")
    assert store.state() == (number + 1, "mine")


def test_claims_have_one_winner(spark):
    root = scratch_path(spark, "claims")
    won = []

    def run(name):
        if claim(spark, f"{root}/marker", name):
            won.append(name)

    threads = [threading.Thread(target=run, args=(f"writer{k}",)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and read_claim(spark, f"{root}/marker") == won[0]
    assert claims(spark, root) == ["marker"] and read_claim(spark, f"{root}/none") is None


def test_of_several_publishers_one_stays_and_no_reader_sees_half(spark):
    root = scratch_path(spark, "publish")
    out, errors = [], []

    def publish(k):
        try:
            df = spark.range(1000).withColumn("by", F.lit(k))
            data, reused = publish_versioned(df, root, "node", "hash")
            out.append((reused, data.agg(F.count(F.lit(1)), F.min("by"), F.max("by")).first()))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=publish, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [reused for reused, _ in out].count(False) == 1
    first = out[0][1]
    assert first[0] == 1000 and first[1] == first[2] and all(seen == first for _, seen in out)
    assert not spark.read.parquet(f"{root}/node/hash").isEmpty()


def test_a_fan_in_is_one_row_an_edge(spark):
    steps = spark.createDataFrame([(f"s{k}", "x") for k in range(20)], "step string, partition string")
    edges = spark.createDataFrame([(f"s{k}", "up") for k in range(20)], "downstream string, upstream string")
    parts = [("up", f"p{k}", f"hash{k}") for k in range(300)]
    frame = lambda rows_: spark.createDataFrame(rows_, "base_id string, partition string, run_hash string")
    got = I.upstream_hashes(steps, edges, frame(parts)).collect()
    assert len(got) == 20 and {r.match for r in got} == {"fan_in"} and len({r.run_hash for r in got}) == 1
    again = I.upstream_hashes(steps, edges, frame(parts[::-1])).first().run_hash
    other = I.upstream_hashes(steps, edges, frame([*parts[:-1], ("up", "p299", "changed")])).first().run_hash
    assert again == got[0].run_hash != other


def test_a_fan_in_of_rows_has_every_hash(spark, sf):
    steps = spark.createDataFrame([(f"s{k}", "x") for k in range(3)], "step string, partition string")
    edges = spark.createDataFrame([(f"s{k}", "up") for k in range(3)], "downstream string, upstream string")
    parts = spark.createDataFrame([("up", f"p{k}", f"hash{k}") for k in range(40)], "base_id string, partition string, run_hash string")
    got = rows(I.upstream_hashes(steps, edges, parts, fan_in="rows"), "step", "run_hash")
    assert got == sorted((f"s{s}", f"hash{k}") for s in range(3) for k in range(40))
    # the query lists the hashes too: 4 partitions and more of some upstreams
    import __spark_entry__ as entry

    wide = entry.queries()["upstream_hashes"](spark, sf).where("match = 'fan_in'")
    assert wide.groupBy("step", "upstream").agg(F.count_distinct("run_hash").alias("n")).agg(F.max("n")).first()[0] > 1
    with pytest.raises(ValueError):
        I.upstream_hashes(steps, edges, parts, fan_in="all")
