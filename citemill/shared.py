"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error, as
    executors would each write to a disk of their own.
    """
    uri = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not uri:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="citemill-")
        spark.sparkContext.setCheckpointDir(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return (uri if "://" in uri else "file://" + uri).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder under the shared one."""
    return f"{shared_dir(spark)}/citemill-{name}/{uuid.uuid4().hex}"


def open_file(uri: str, mode: str = "r"):
    """A file of the shared folder, to read at any place or to write; a new file's folder is made where missing."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def remove(uri: str) -> None:
    """A folder of the shared one goes, if it is there."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
