"""Incremental walks over captured pages as a stream: offsets are the walks' cursors, partitions are the pages to read."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Captured pages: one row an item, newest first; a page that could not be read has one row with its status and no item.
PAGES = "cycle int, category string, page int, status int, pos int, id bigint, published timestamp_ntz"
READ = "cycle int, category string, page int, pos int, id bigint, published timestamp_ntz"
_SEED = {"watermark": "", "target": "", "resume": 1}


def planned(walk: dict, budget: int) -> list[int]:
    """Page 1 always; a new category reads no more, one with a backlog goes on a page before where it stopped, others read on from page 1."""
    if not walk["watermark"]:
        return [1]
    if walk["resume"] > 1:
        begin = max(2, walk["resume"] - 1)
        return [1, *range(begin, begin + budget - 1)]
    return list(range(1, budget + 1))


def walked(walk: dict, heads: list[tuple[int, bool, str, str]], overlap: timedelta) -> tuple[dict, list[int]]:
    """The walk after one poll, and the pages read in it. `heads`: page, readable, newest and oldest (empty: no items), in the order planned.

    Reading stops at the first page that crosses the watermark less its overlap, that is empty, or that cannot be read. Only the first two close the gap,
    and only then does the watermark move: to what was newest when the gap opened. Else the next poll goes on from where this one stopped.
    """
    seed, behind = not walk["watermark"], walk["resume"] > 1
    newest = walk["target"] if behind else ""
    limit = "" if seed else (datetime.fromisoformat(walk["watermark"]) - overlap).isoformat()
    read, stopped, closed = [], 0, False
    for page, readable, top, bottom in heads:
        if not readable:
            stopped = page
            break
        read.append(page)
        if page == 1 and not behind:
            newest = top
        if not top or (limit and bottom <= limit):
            closed = True
            break
    if seed:
        return ({"watermark": newest, "target": "", "resume": 1} if newest else dict(_SEED)), read
    if closed:
        return {"watermark": newest or walk["watermark"], "target": "", "resume": 1}, read
    if not newest:  # page 1 was not there: nothing is known of a gap
        return dict(walk), read
    return {"watermark": walk["watermark"], "target": newest, "resume": max(2, stopped or read[-1] + 1)}, read


class Page(InputPartition):
    def __init__(self, cycle: int, category: str, page: int):
        self.cycle, self.category, self.page = cycle, category, page


class WalkReader(DataSourceStreamReader):
    """Offsets: the last poll, and every category's watermark, target and next page after it.

    What a poll reads follows from the offset before it, so a batch that is planned again reads the same pages. The driver looks at no more than the newest and oldest
    times of the pages that a poll plans; items are read by the tasks, a page a partition.
    """

    def __init__(self, path: str, budget: int, overlap_minutes: int):
        self.path, self.budget, self.overlap = path, budget, timedelta(minutes=overlap_minutes)
        self._after: dict[int, dict] = {0: self.initialOffset()}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cycle": 0, "categories": {}}

    def _pages(self, cycle: int):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        filesystem, root = FileSystem.from_uri(self.path)
        return ds.dataset(f"{root}/cycle={cycle}", format="parquet", filesystem=filesystem)

    def _cycles(self) -> list[int]:
        from pyarrow.fs import FileSelector, FileSystem

        filesystem, root = FileSystem.from_uri(self.path)
        names = [f.base_name for f in filesystem.get_file_info(FileSelector(root, allow_not_found=True))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("cycle="))

    def _poll(self, before: dict, cycle: int) -> tuple[dict, list[Page]]:
        import pyarrow.compute as pc

        pages, after, read = self._pages(cycle), {}, []
        known = pages.to_table(columns=["category"], filter=pc.field("page") == 1).column("category").unique().to_pylist()
        plans = {c: planned(before["categories"].get(c, _SEED), self.budget) for c in sorted({*known, *before["categories"]})}
        wanted = sorted({p for plan in plans.values() for p in plan})
        heads = pages.to_table(columns=["category", "page", "status", "published"], filter=pc.field("page").isin(wanted)).group_by(["category", "page"]).aggregate([("status", "min"), ("published", "min"), ("published", "max")])
        found = {(r["category"], r["page"]): (r["status_min"] == 200, *(x.isoformat() if x else "" for x in (r["published_max"], r["published_min"]))) for r in heads.to_pylist()}
        for category, plan in plans.items():
            after[category], seen = walked(before["categories"].get(category, _SEED), [(p, *found.get((category, p), (True, "", ""))) for p in plan], self.overlap)
            read += [Page(cycle, category, p) for p in seen if (category, p) in found]
        return {"cycle": cycle, "categories": after}, read

    def _from(self, start: dict) -> Iterator[tuple[dict, list[Page]]]:
        now = start
        for cycle in self._cycles():
            if cycle > start["cycle"]:
                now, pages = self._poll(now, cycle)
                yield now, pages

    def latestOffset(self) -> dict:  # noqa: N802
        now = self._after[max(self._after)]
        for now, _ in self._from(now):
            pass
        self._after = {now["cycle"]: now}
        return now

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [page for now, pages in self._from(start) if now["cycle"] <= end["cycle"] for page in pages]

    def read(self, partition: Page) -> Iterator[tuple]:
        import pyarrow.compute as pc

        wanted = (pc.field("category") == partition.category) & (pc.field("page") == partition.page) & pc.field("id").is_valid()
        for batch in self._pages(partition.cycle).to_batches(columns=["pos", "id", "published"], filter=wanted):
            for row in batch.to_pylist():
                yield partition.cycle, partition.category, partition.page, row["pos"], row["id"], row["published"]

    def commit(self, end: dict) -> None:
        pass


class PageWalk(DataSource):
    """`spark.readStream.format("page_walk")` over captured pages (PAGES, in folders cycle=<n>). Options: path, budget (pages a poll), overlap (minutes)."""

    @classmethod
    def name(cls) -> str:
        return "page_walk"

    def schema(self) -> str:
        return READ

    def streamReader(self, schema) -> WalkReader:  # noqa: N802
        return WalkReader(self.options["path"], int(self.options.get("budget", "3")), int(self.options.get("overlap", "30")))
