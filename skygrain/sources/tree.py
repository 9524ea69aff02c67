"""Structure of hierarchical files, as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TREE_NODE


def walk(node, name: str = ""):
    """(kind, name, shape, dtype) of every group and dataset below ``node``; groups come before their members. Other kinds are left out."""
    for key, value in node.items():
        path = f"{name}/{key}" if name else key
        if isinstance(value, dict):
            yield "group", path, None, None
            yield from walk(value, path)
        elif hasattr(value, "shape"):
            yield "dataset", path, [int(n) for n in value.shape], str(value.dtype)
        elif isinstance(value, list):
            yield "dataset", path, [len(value)], type(value[0]).__name__ if value else "none"


@F.udtf(returnType=TREE_NODE)
class JsonTree:
    """The tree of a nested JSON document: lists are datasets, objects are groups."""

    def eval(self, text: str):
        yield from walk(json.loads(text))


@F.udtf(returnType=TREE_NODE)
class HdfTree:
    """The tree of an HDF5 file's bytes. Needs h5py on the executors."""

    def eval(self, content: bytes):
        import io

        try:
            import h5py
        except ImportError as e:
            raise RuntimeError("h5py is needed to read HDF5 files") from e
        found = []

        def note(name, item):
            if isinstance(item, h5py.Dataset):
                found.append(("dataset", name, [int(n) for n in item.shape], str(item.dtype)))
            elif isinstance(item, h5py.Group):
                found.append(("group", name, None, None))

        with h5py.File(io.BytesIO(content), "r") as f:
            f.visititems(note)
        yield from found


def hdf_tree(spark, path: str) -> DataFrame:
    """path, kind, name, shape, dtype of every node of the HDF5 files below a path."""
    spark.udtf.register("skygrain_hdf_tree", HdfTree)
    spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).createOrReplaceTempView("skygrain_hdf_files")
    return spark.sql("SELECT f.path, t.* FROM skygrain_hdf_files f, LATERAL skygrain_hdf_tree(f.content) t")


def nested_tree(conversations: DataFrame) -> DataFrame:
    """The tree walk over conversations written as nested documents: conv_id, kind, name, n."""
    spark = conversations.sparkSession
    spark.udtf.register("skygrain_json_tree", JsonTree)
    turn = F.struct(F.struct(F.col("role").alias("role"), F.array("text").alias("text")).alias("turn"))
    conversations.select("conv_id", "turn", F.to_json(turn).alias("doc")).createOrReplaceTempView("skygrain_documents")
    return spark.sql("SELECT d.conv_id, d.turn, t.kind, t.name, t.shape[0] AS n FROM skygrain_documents d, LATERAL skygrain_json_tree(d.doc) t")
