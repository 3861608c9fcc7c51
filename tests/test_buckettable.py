import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.sources import buckettable as B
from corpusmill.sources import vectortable

META = '{"source":"%s","category":"%s","chunk_mode":"m","page":%d,"embedding_model":"e"}'


def rows(spark, items):
    """(id, source, text, session) -> rows of the vector table with their order."""
    blank = {f.name: None for f in schema.VECTOR_TABLE.fields}
    made = [
        blank | {"id": i, "text": t, "embedding": [1.0, 2.0], "metadata": META % (src, "c", n), "category": "c", "session_id": s, "filename": src}
        for n, (i, src, t, s) in enumerate(items)
    ]
    df = spark.createDataFrame(made, schema.VECTOR_TABLE)
    return df.withColumn("_seq", F.get_json_object("metadata", "$.page").cast("long"))


def content(spark, root):
    return {r.id: (r.text, r.session_id) for r in B.read(spark, root).collect()}


def files(root, kind="data"):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/{kind}") for f in fs}


def test_a_batch_of_one_source_writes_one_bucket(spark, tmp_path):
    root = str(tmp_path)
    assert B.read(spark, root).count() == 0 and B.facts(spark, root).count() == 0
    items = [(f"f{i}-{p}-0", f"f{i}", f"t{i}.{p}", None) for i in range(12) for p in range(3)]
    first = B.change(spark, root, "v1", rows(spark, items), buckets=16)
    assert len(first) > 4 and content(spark, root) == {i: (t, None) for i, _, t, _ in items}
    before = files(root)
    touched = B.change(
        spark, root, "v2", rows(spark, [("f3-0-0", "f3", "new", None), ("f3-0-0", "f3", "newer", None)]),
        gone=spark.createDataFrame([("f3",)], "source string"), buckets=16,
    )
    assert len(touched) == 1
    want = {i: (t, None) for i, s, t, _ in items if s != "f3"} | {"f3-0-0": ("newer", None)}
    assert content(spark, root) == want
    assert {k: v for k, v in files(root).items() if k in before} == before  # nothing old was written again
    # A deleted source leaves an empty bucket behind, and an unknown one touches nothing.
    assert B.change(spark, root, "v3", gone=spark.createDataFrame([("nobody",)], "source string"), buckets=16) == []
    for n, i in enumerate(range(12)):
        B.change(spark, root, f"w{n}", gone=spark.createDataFrame([(f"f{i}",)], "source string"), buckets=16)
    assert content(spark, root) == {} and B.facts(spark, root).agg(F.sum("rows")).first()[0] == 0


def test_random_changes_equal_one_table(spark, tmp_path):
    rng, root = random.Random(1), str(tmp_path)
    model = {}
    for step in range(5):
        incoming = [
            (f"f{rng.randrange(6)}-{rng.randrange(4)}-0", f"f{rng.randrange(6)}", f"s{step}.{k}", rng.choice([None, "a", "b"])) for k in range(12)
        ]
        gone = [f"f{rng.randrange(6)}"]
        sources = {i: s for i, (_, _, s) in model.items()}
        model = {i: v for i, v in model.items() if sources[i] not in gone}
        for i, s, t, who in incoming:
            model[i] = (t, who, s)
        B.change(spark, root, f"v{step}", rows(spark, incoming), gone=spark.createDataFrame([(g,) for g in gone], "source string"), buckets=4)
        assert content(spark, root) == {i: v[:2] for i, v in model.items()}
    B.delete_sessions(spark, root, "d1", spark.createDataFrame([("a",), ("zz",)], "session_id string"), buckets=4)
    assert content(spark, root) == {i: v[:2] for i, v in model.items() if v[1] != "a"}
    table = B.read(spark, root)
    assert sorted(map(tuple, B.table_stats(spark, root).collect())) == sorted(map(tuple, vectortable.table_stats(table).collect()))
    assert sorted(map(tuple, B.count_by_session(spark, root).collect())) == sorted(map(tuple, vectortable.count_by_session(table).collect()))
    whole = content(spark, root)
    assert B.vacuum(spark, root, keep=1) and content(spark, root) == whole and B.vacuum(spark, root, keep=1) == []


def test_stops_leave_the_old_table(spark, tmp_path):
    root = str(tmp_path)
    one, two = [("f-0-0", "f", "old", None)], [("f-0-0", "f", "new", None)]
    B.change(spark, root, "v1", rows(spark, one), buckets=2)
    B.change(spark, root, "v2", rows(spark, two), buckets=2)
    # Stopped before the manifest, before the facts, and within the data.
    shutil.rmtree(f"{root}/_manifest/{2:012d}")
    assert content(spark, root) == {"f-0-0": ("old", None)}
    assert len(B.change(spark, root, "v2", rows(spark, two), buckets=2)) == 1 and content(spark, root) == {"f-0-0": ("new", None)}
    shutil.rmtree(f"{root}/_manifest/{2:012d}")
    os.remove(f"{root}/facts/v2/_SUCCESS")
    assert content(spark, root) == {"f-0-0": ("old", None)}
    B.change(spark, root, "v2", rows(spark, two), buckets=2)
    assert content(spark, root) == {"f-0-0": ("new", None)}
    os.makedirs(f"{root}/data/v3/bucket=0")
    os.makedirs(f"{root}/_manifest/{3:012d}")
    assert content(spark, root) == {"f-0-0": ("new", None)}
    B.change(spark, root, "v3", rows(spark, one), buckets=2)
    assert content(spark, root) == {"f-0-0": ("old", None)}
    # All manifests lost: an empty table would be wrong.
    shutil.rmtree(f"{root}/_manifest")
    with pytest.raises(RuntimeError):
        B.read(spark, root)


def test_equal_ids_share_a_bucket_and_hot_files_spread(spark, tmp_path):
    ids = spark.createDataFrame([("f-0-0",), ("f-9-12",), ("a-b-1-2",), ("17",), (None,)], "id string")
    got = [r[0] for r in ids.select(B.bucket_of(F.col("id"))).collect()]
    assert got[0] == got[1] and all(0 <= b < B.BUCKETS for b in got)
    items = [(f"hot-{p}-0", "hot", "t", None) for p in range(200)]
    B.change(spark, str(tmp_path), "v1", rows(spark, items), buckets=4)
    assert sum(f.endswith(".parquet") for f in files(str(tmp_path))) > 3
