"""Paging sources as a Python data source, batch and stream: answers of a listing API, recorded page by page.

A chain is what one listing gives: the objects of a kind of one source, a page after the other. Pages lie under
`path/object=<kind>/source=<name>/page=<number>_<day>/`, a file with one JSON answer each:
`{"after": <cursor asked with>, "has_more": <bool>, "data": [{"id", "updated", "body"}, ...]}`; the number rises along the chain and the day is the latest
`updated` in the page. A cursor-paged answer names the last id of the page before as `after`; an offset-paged one has a
number there and ends with a page that has no more. Both are read to the last page.

* Batch: folders are listed on the driver, pages read in tasks. Filters on object, source and `updated >=` are taken over: the first two choose
  chains, the third skips pages by their folder's name and rows within a page.
* Stream: the offset is the number of the last page read of each chain, kept in the query's checkpoint; pages
  that come later are read by the next batch, and a restart goes on after the last one.

A page that doesn't follow on the one before it is an error, not a gap. Files are opened through Arrow's file systems, so a
path may be local, HDFS or an object store that Arrow knows.
"""

from __future__ import annotations

import datetime
import json
from collections import defaultdict
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

SCHEMA = "object string, source string, id string, updated date, body string"
#: Pages that one task reads.
RUN = 50


def _listed(path: str) -> dict[tuple[str, str], list[tuple[int, datetime.date, str]]]:
    """The pages of each chain, (number, latest day, folder), in order; from names alone."""
    files, root = _opened(path)
    chains = defaultdict(list)
    for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path.rsplit("/", 3)[-3:]
        if info.type == fs.FileType.Directory and parts[-1].startswith("page=") and parts[0].startswith("object="):
            number, day = parts[2][5:].split("_")
            chains[parts[0][7:], parts[1][7:]].append((int(number), datetime.date.fromisoformat(day), info.path))
    return {chain: sorted(pages) for chain, pages in chains.items()}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _answer(files: fs.FileSystem, folder: str) -> dict:
    part = next(i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.is_file and not i.base_name.startswith(("_", ".")))
    with files.open_input_stream(part) as file:
        return json.loads(file.read())


class Run(InputPartition):
    """Pages of a chain one after another, the answer that the first one follows on (None at a chain's start), and whether the chain ends with the last."""

    def __init__(self, path: str, chain: tuple[str, str], folders: list[str], before: str | None, ends: bool, since: datetime.date | None):
        self.path, self.chain, self.folders, self.before, self.ends, self.since = path, chain, folders, before, ends, since

    def rows(self) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        last = _answer(files, self.before) if self.before else None
        for folder in self.folders:
            page = _answer(files, folder)
            if last is not None:
                follows = page["after"] in (last["data"][-1]["id"], str(int(last["after"] or 0) + len(last["data"])) if str(last["after"] or 0).isdigit() else None)
                if not last["has_more"] or not follows:
                    raise ValueError(f"{folder} doesn't follow on the page before it")
            last = page
            for row in page["data"]:
                updated = datetime.date.fromisoformat(row["updated"])
                if self.since is None or updated >= self.since:
                    yield (*self.chain, row["id"], updated, row["body"])
        if self.ends and last is not None and last["has_more"]:
            raise ValueError(f"the pages of {'/'.join(self.chain)} break off before the last one")


def _runs(path: str, chain: tuple[str, str], pages: list, after: int, whole: bool, since: datetime.date | None = None) -> list[Run]:
    """The pages of a chain behind number `after`, in runs; with `since`, pages without a row of that day or later fall out, and what follows them starts a run of its own."""
    out, folders, before = [], [], None
    for i, (number, day, folder) in enumerate(pages):
        if number <= after or (since is not None and day < since):
            if folders:
                out.append(Run(path, chain, folders, before, False, since))
                folders = []
            continue
        if not folders:
            before = pages[i - 1][2] if i else None
        folders.append(folder)
        if len(folders) == RUN or i == len(pages) - 1:
            out.append(Run(path, chain, folders, before, whole and i == len(pages) - 1, since))
            folders = []
    if folders:
        out.append(Run(path, chain, folders, before, False, since))
    return out


class Pages(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.since, self.wanted = path, None, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes `updated >=` and equality of object and source; what it takes, Spark needn't check again."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("updated",):
                self.since = max(f.value, self.since) if self.since else f.value
            elif isinstance(f, (EqualTo, In)) and f.attribute in (("object",), ("source",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Run]:
        out = []
        for chain, pages in sorted(_listed(self.path).items()):
            if all(value in self.wanted.get(name, {value}) for name, value in zip(("object", "source"), chain)):
                out += _runs(self.path, chain, pages, -1, True, self.since)
        return out or [Run(self.path, ("", ""), [], None, False, None)]

    def read(self, partition: Run) -> Iterator[tuple]:
        yield from partition.rows()


class PageStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"/".join(chain): pages[-1][0] for chain, pages in _listed(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        out = []
        for chain, pages in sorted(_listed(self.path).items()):
            name = "/".join(chain)
            if name in end:
                out += _runs(self.path, chain, [p for p in pages if p[0] <= end[name]], start.get(name, -1), False)
        return out

    def read(self, partition: Run) -> Iterator[tuple]:
        yield from partition.rows()

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """`spark.read.format("recorded_pages").load(path)`, and readStream alike."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Pages:
        return Pages(self.options["path"])

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def write_pages(rows: DataFrame, path: str, page: str, cursor: bool = True) -> None:
    """Records rows (object, source, id, updated, body, and the page's number as column `page`) as answers. With cursor=False pages are asked for by offset."""
    keys = ["object", "source"]
    data = F.array_sort(F.collect_list(F.struct("id", F.col("updated").cast("string").alias("updated"), "body")))
    pages = rows.groupBy(*keys, F.col(page).cast("long").alias("n")).agg(data.alias("data"), F.max("updated").alias("day"))
    # A chain has one row for each page here, so a window over a chain holds counts and ids only.
    heads = pages.select(*keys, "n", F.size("data").alias("size"), F.element_at("data", -1)["id"].alias("last"))
    w = Window.partitionBy(*keys).orderBy("n")
    offset = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("string")
    heads = heads.select(*keys, "n", (F.lag("last").over(w) if cursor else offset).alias("after"), F.lead("last").over(w).isNotNull().alias("has_more"))
    answers = pages.join(heads, [*keys, "n"]).select(*keys, F.format_string("%08d_%s", "n", F.col("day").cast("string")).alias("page"), F.to_json(F.struct("after", "has_more", "data"), {"ignoreNullFields": "false"}).alias("value"))
    answers.write.mode("append").partitionBy("object", "source", "page").text(path)
