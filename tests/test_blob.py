"""The stored catalog: what is in it, what reads give, what is refused."""

import os

import numpy as np
import pytest

from veilgrid.functions.params import NOISELESS
from veilgrid.operators.stitch import StitchOwner
from veilgrid.plans.clustering import ClusteringContext, Clusters
from veilgrid.sources.blob import BlobBuilder, BlobReader
from veilgrid.sources.tables import Folder, read_csv, read_table, stored_salt, write_csv, write_table


@pytest.fixture(scope="module")
def blob(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("blob"))
    df = spark.createDataFrame([(f"t{i % 3}", i % 3, float(i % 2)) for i in range(120)], "t string, i long, f double")
    BlobBuilder("b", folder).write(df, salt=b"x", anonymization_params=NOISELESS)
    return folder


def test_a_blob_has_every_pair_and_triple_and_no_salt(spark, blob):
    assert os.listdir(blob) == ["b.blob.zip"]
    reader = BlobReader(spark, "b", blob)
    assert set(reader.catalog) == {(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)}
    assert "salt" not in str(reader.folder.read_json(f"{reader.path}/metadata.json")["anonymization_params"])
    assert (reader.matrix == np.round(reader.matrix, 2)).all() and (reader.entropy == np.round(reader.entropy, 2)).all()
    assert reader.matrix[0, 1] > 0.5 > reader.matrix[0, 2]


def test_reads_are_in_the_order_asked_for(spark, blob):
    reader = BlobReader(spark, "b", blob)
    out = reader.read(["f", "t"])
    assert out.columns == ["f", "t"] and {tuple(r) for r in out.groupBy("f", "t").count().collect()} == {(f, f"t{t}", 20) for f in (0.0, 1.0) for t in range(3)}
    assert reader.stitch_record() == [] and reader.read().columns == ["t", "i", "f"]


def test_missing_tables_are_stitched_from_smaller_ones(spark, blob):
    reader = BlobReader(spark, "b", blob)
    del reader.catalog[0, 1, 2]
    reader.untargeted = lambda columns: Clusters([0, 1], [(StitchOwner.SHARED, [0], [2])])
    out = reader.read(["t", "i", "f"])
    assert abs(out.count() - 120) <= 2 and out.filter("t <> concat('t', i)").count() == 0
    assert [x["owner"] for x in reader.stitch_record()] == ["left", "left", "shared"]
    record = BlobReader(spark, "b", blob)
    del record.catalog[0, 1, 2]
    assert sorted(record._recover((0, 1, 2)).columns) == ["f", "i", "t"]


def test_what_a_blob_refuses(spark, blob, tmp_path):
    reader = BlobReader(spark, "b", blob)
    for bad in (dict(columns=["x"]), dict(columns=["t", "t"]), dict(columns=["t"], target_column="x")):
        with pytest.raises(ValueError):
            reader.read(**bad)
    with pytest.raises(FileNotFoundError):
        BlobReader(spark, "none", blob)
    with pytest.raises(NotADirectoryError):
        BlobReader(spark, "b", str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        BlobBuilder("b", blob)
    assert BlobBuilder("b", blob, force=True, max_cluster_size=4).params.max_cluster_size == 4


def test_parts_of_a_context(spark):
    m = np.arange(25, dtype=float).reshape(5, 5)
    part = ClusteringContext(m, np.arange(5.0)).shrink([1, 3, 4])
    assert part.dependence.tolist() == [[0, 8, 9], [16, 0, 19], [21, 23, 0]] and part.entropy.tolist() == [1, 3, 4]


def test_tables_json_and_salt(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None, "2020-01-02T03:04:05"), (2, None, 1.5, "2021-01-01"), (3, "NA", -2.0, None)], "i int, s string, d double, t string")
    write_csv(df, str(tmp_path / "csv"))
    got = read_csv(spark, str(tmp_path / "csv"))
    assert [f.dataType.typeName() for f in got.schema] == ["integer", "string", "double", "timestamp_ntz"]
    assert {(r.i, r.s, r.d, str(r.t)) for r in got.collect()} == {(1, "a,b", None, "2020-01-02 03:04:05"), (2, None, 1.5, "2021-01-01 00:00:00"), (3, "NA", -2.0, "None")}
    write_table(df, str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).count() == 3
    folder = Folder(spark, tmp_path)
    folder.write_json({"a": [1, None]}, "x.json")
    assert folder.read_json("x.json") == {"a": [1, None]} and folder.local == str(tmp_path) and folder.is_dir("csv")
    for bad in (lambda: folder.read_json("none.json"), lambda: folder.write_json({1, 2}, "y.json"), lambda: read_table(spark, str(tmp_path / "none"))):
        with pytest.raises(OSError):
            bad()
    assert stored_salt(tmp_path) == stored_salt(tmp_path) and len(stored_salt(tmp_path)) == 8
