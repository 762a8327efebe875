"""Files and tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names it.  Where the setting is missing in a local session
(tests), a temporary folder takes its place; on a cluster that is an error.  Whatever an attempt of a task
writes gets a fresh name and counts only once the driver has that name in a
manifest, so a repeated task or a lost executor leaves no half-written input.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from citemill.shared import shared_dir


class Made:
    """Folders that an operator has made, and the names of those that its result still reads."""

    def __init__(self):
        self.uris: list[tuple[str, str]] = []
        self.kept: set[str] = set()

    def keep(self, *names: str) -> None:
        self.kept.update(names)


_made: list[Made] = []


@contextmanager
def temporary():
    """Within it, what fresh() names is noted; at the end, all folders go but those of the names that are kept.

    Those of an inner operator that it kept for its result go with the outer one's.
    """
    _made.append(Made())
    try:
        yield _made[-1]
    finally:
        mine = _made.pop()
    for name, uri in mine.uris:
        if name not in mine.kept:
            remove(uri)
        elif _made:
            _made[-1].uris.append((name, uri))


def fresh(spark: SparkSession, name: str) -> str:
    """URI of a new, not yet existing folder under the shared one."""
    uri = f"{shared_dir(spark)}/citemill/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].uris.append((name, uri))
    return uri


ARROW_KEY, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Texts can be long, so Arrow batches get ARROW_ROWS rows at most from here on; a smaller setting of the session stays.

    Plans read the setting when they run, after the function that made them has returned, so it can't be put back there.
    """
    rows = int(spark.conf.get(ARROW_KEY))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set(ARROW_KEY, ARROW_ROWS)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there."""
    uri = fresh(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_write(uri: str):
    """A stream to a new file; its folder is made where missing."""
    system, path = _fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_read(uri: str):
    """A file that can be read at any offset."""
    system, path = _fs(uri)
    return system.open_input_file(path)


def read_bytes(uri: str) -> bytes:
    with open_read(uri) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    with open_write(uri) as f:
        f.write(data)


def read_table(uri: str, column: str, value: int):
    """The rows of a folder of Parquet files whose ``column`` is ``value``, as an Arrow table."""
    from pyarrow import dataset

    system, path = _fs(uri)
    return dataset.dataset(path, filesystem=system, format="parquet").to_table(filter=dataset.field(column) == value)


def remove(uri: str) -> None:
    """The folder and all in it go, if it is there."""
    from pyarrow import fs

    system, path = _fs(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
