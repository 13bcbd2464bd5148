"""Masked copies as files: one ``<stem>.masked<ending>`` for each text, all of them or none."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import masked_name

FORMAT = "masked_files"


@dataclass
class Written(WriterCommitMessage):
    #: (where it was written, where it belongs)
    moves: list


class Writer(DataSourceWriter):
    """Each text is written under a hidden name beside its place. Only the commit, when all tasks are done, moves them there; an
    abort, and a commit that finds two texts for one name or a file in the way, deletes them all."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else os.path.abspath(self.folder))

    def write(self, iterator):
        system, base = self._system()
        moves = []
        for name, text in iterator:
            place = f"{base}/{name}"
            hidden = f"{os.path.dirname(place)}/.{os.path.basename(place)}.{uuid.uuid4().hex}"
            system.create_dir(os.path.dirname(place), recursive=True)
            with system.open_output_stream(hidden) as out:
                out.write((text or "").encode("utf-8"))
            moves.append((hidden, place))
        return Written(moves)

    def commit(self, messages):
        from pyarrow import fs

        system, _ = self._system()
        moves = [m for message in messages if message for m in message.moves]
        places = [place for _, place in moves]
        taken = [] if self.overwrite else [x.path for x in system.get_file_info(places) if x.type != fs.FileType.NotFound]
        if taken or len(set(places)) < len(places):
            self.abort(messages)
            raise FileExistsError(f"files in the way: {taken[:3]}" if taken else "two texts have the same name")
        for hidden, place in moves:
            system.move(hidden, place)

    def abort(self, messages):
        system, _ = self._system()
        for message in messages:
            for hidden, _ in message.moves if message else ():
                try:
                    system.delete_file(hidden)
                except OSError:
                    pass  # moved or never written


class MaskedFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "name string, masked_text string"

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], self.options.get("replace") == "true")


def write_files(spark: SparkSession, released: DataFrame, folder: str, *, root: str = "", overwrite: bool = False) -> None:
    """released (doc_id: the text's path, masked_text): a file for each row in a folder that all executors reach (a local path or a
    URI that pyarrow opens). Below ``root`` the paths of the texts are kept; elsewhere their names alone."""
    spark.dataSource.register(MaskedFiles)
    path = F.col("doc_id").cast("string")
    below = F.when(F.startswith(path, F.lit(root)) & F.lit(bool(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(F.regexp_extract(path, r"[^/]*$", 0))
    names = released.select(F.ltrim(masked_name(below), F.lit("/")).alias("name"), "masked_text")
    names.write.format(FORMAT).option("path", folder).option("replace", str(overwrite).lower()).mode("append").save()
