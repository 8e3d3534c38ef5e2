"""Evaluation logs as they are written: zip containers with a header and one JSON member a sample.

``LogContainers`` is a data source of Python. The driver reads the directories at the containers' ends, not the samples; a partition has
members of about ``PART`` bytes, a part of a large container or several small ones, which its task reads by their places. Filters on run and track are taken by the
driver, which knows both from folder and header, so that other containers are not planned at all.
"""

from __future__ import annotations

import json
import math
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Packed bytes of a partition's members.
PART = 8 << 20
SCHEMA = (
    "run string, file string, track string, version string, mode string, created string, place long, sample string, epoch long, composite double, metadata string, "
    "valid long, fabricated long, unsupportive long, n long, sample_metadata string"
)
MEMBER = re.compile(r"samples/.+\.json")


def _system(path: str):
    """(file system, its own path) of a local folder or of a store that pyarrow knows."""
    import pyarrow.fs as fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class Members(InputPartition):
    """(path, what the header says, (place, name) of members) of some containers."""

    def __init__(self, parts: list[tuple[str, dict, list[tuple[int, str]]]]):
        self.parts = parts


def number(value) -> float | None:
    """A float, from a number or its text; null where it is none, or not finite."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def _sample(sample: dict) -> tuple:
    """The columns of a sample: its first score counts, as it is the judge's."""
    score = next(iter((sample.get("scores") or {}).values()), None) or {}
    more = score.get("metadata") or {}
    cited = more.get("citation_faithfulness") or {}
    counts = tuple(int(number(cited.get(c)) or 0) for c in ("valid", "fabricated", "unsupportive", "n"))
    text = lambda x: json.dumps(x, sort_keys=True) if x else None
    return str(sample.get("id")), int(sample.get("epoch") or 1), number(score.get("value")), text(more), *counts, text(sample.get("metadata"))


class LogContainers(DataSource):
    """Option ``path``: a folder of runs, each a folder of ``*.eval`` files. A row a sample, whether or not it has a score."""

    @classmethod
    def name(cls) -> str:
        return "eval_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.wanted: dict[str, list[set]] = {"run": [], "track": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in self.wanted:
                self.wanted[column].append({f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                yield f

    def _kept(self, column: str, value: str) -> bool:
        return all(value in s for s in self.wanted[column])

    def containers(self) -> Iterator[tuple[str, dict, list[zipfile.ZipInfo]]]:
        """(path, what the header says, members) of the containers that the filters leave, by run and name; broken ones are no containers."""
        import pyarrow.fs as fs

        system, root = _system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted((x for x in found if x.is_file and x.path.endswith(".eval")), key=lambda x: x.path):
            folder, _, name = info.path[len(root.rstrip("/")) + 1 :].rpartition("/")
            if not folder or "/" in folder or not self._kept("run", folder):
                continue
            with system.open_input_file(info.path) as file:
                try:
                    log = zipfile.ZipFile(file)
                    members = [m for m in log.infolist() if MEMBER.fullmatch(m.filename)]
                    header = next((m for m in ("header.json", "_journal/start.json") if m in log.namelist()), None)
                    spec = json.loads(log.read(header)).get("eval") or {} if header else {}
                except (zipfile.BadZipFile, ValueError):
                    continue
            more = spec.get("metadata") or {}
            about = {"run": folder, "file": name, "track": str(more.get("track", "?")), "version": str(more.get("benchmark_version", "?")), "mode": str(more.get("mode", "?")), "created": spec.get("created")}
            if self._kept("track", about["track"]):
                yield info.path, about, members

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        parts: list[tuple[str, dict, list[tuple[int, str]]]] = []
        size = 0
        for path, about, members in self.containers():
            for i, m in enumerate(members):
                if parts and size + m.compress_size > PART:
                    out.append(Members(parts))
                    parts, size = [], 0
                if not parts or parts[-1][0] != path:
                    parts.append((path, about, []))
                parts[-1][2].append((i, m.filename))
                size += m.compress_size
        return [*out, Members(parts)]

    def read(self, partition: Members) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path, about, names in partition.parts:
            head = tuple(about[c] for c in ("run", "file", "track", "version", "mode", "created"))
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as log:
                for place, name in names:
                    try:
                        sample = json.loads(log.read(name))
                    except ValueError:
                        continue
                    yield (*head, place, *_sample(sample))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all containers of a folder of runs; see ``LogContainers``."""
    spark.dataSource.register(LogContainers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("eval_logs").option("path", path).load()


def track_scores(samples: DataFrame) -> DataFrame:
    """Scored samples as rows of ``runs``: of two containers of a run with one track the last by name counts."""
    last = samples.select("run", "track", "file").distinct().groupBy("run", "track").agg(F.max("file").alias("file"))
    rows = samples.join(last, ["run", "track", "file"], "left_semi").where("composite IS NOT NULL")
    return rows.select("run", "track", F.col("sample").alias("item"), "composite", "n", "valid", "fabricated", "unsupportive", F.col("created").alias("ts"), "version", "mode", F.col("place").alias("ord"))


def run_order(samples: DataFrame) -> DataFrame:
    """(idx, run, started, versions, modes, samples): runs by their earliest time, then by name; a run without any time comes last. One row a run."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "/")
    found = samples.groupBy("run").agg(F.coalesce(F.min("created"), F.lit("?")).alias("started"), names("version").alias("versions"), names("mode").alias("modes"), F.count("*").alias("samples"))
    return found.select((F.row_number().over(Window.orderBy("started", "run")) - 1).alias("idx"), "run", "started", "versions", "modes", "samples")


def first_log(samples: DataFrame, has: str = "_synthesis_") -> DataFrame:
    """(run, file, sample, place, sample_metadata) of the first container by name of each run whose name has ``has``; runs without one have no rows."""
    named = samples.where(F.col("file").contains(has))
    first = named.select("run", "file").distinct().groupBy("run").agg(F.min("file").alias("file"))
    return named.join(first, ["run", "file"], "left_semi").select("run", "file", "sample", "place", "sample_metadata")


def write_logs(samples: DataFrame, path: str) -> None:
    """Containers of samples (run, file, track, version, mode, created, place, sample, composite, n, valid, fabricated, unsupportive), one a (run, file), samples in order of place.

    A task writes one container at a time, member by member; its rows come sorted and are not gathered.
    """
    columns = ["run", "file", "track", "version", "mode", "created", "place", "sample", "composite", "n", "valid", "fabricated", "unsupportive"]
    _system(path)[0].create_dir(_system(path)[1], recursive=True)

    def run(rows: Iterator) -> Iterator[int]:
        import uuid

        system, root = _system(path)
        log = made = target = None

        def finish() -> None:
            if log is not None:
                log.close()
                made.close()
                system.move(target[0], target[1])

        for r in rows:
            if target is None or target[2:] != (r["run"], r["file"]):
                finish()
                system.create_dir(f"{root}/{r['run']}", recursive=True)
                # A container appears under its name only once it is whole, whichever attempt of a task wrote it.
                target = (f"{root}/{r['run']}/.{r['file']}-{uuid.uuid4().hex}", f"{root}/{r['run']}/{r['file']}", r["run"], r["file"])
                made = system.open_output_stream(target[0])
                log = zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED)
                more = {"track": r["track"], "benchmark_version": r["version"], "mode": r["mode"]}
                log.writestr("header.json", json.dumps({"status": "success", "eval": {"created": r["created"], "metadata": more}}))
            cited = {"n": r["n"], "valid": r["valid"], "fabricated": r["fabricated"], "unsupportive": r["unsupportive"]}
            score = {"value": r["composite"], "metadata": {"citation_faithfulness": cited}}
            log.writestr(f"samples/{r['sample']}_epoch_1.json", json.dumps({"id": r["sample"], "epoch": 1, "scores": {"judge": score}, "metadata": {"place": r["place"]}}))
        finish()
        return iter(())

    dealt = samples.select(*columns).repartition("run", "file").sortWithinPartitions("run", "file", "place")
    dealt.foreachPartition(run)
