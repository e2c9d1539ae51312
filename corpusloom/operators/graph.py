"""Crawls over stored links: level by level, page chains, and jobs that can be taken up again.

A level is one join of the frontier with the links and one anti-join with what was visited; the
tables of a level are persisted, and a CrawlJob writes them to a folder, so that it can be taken up again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.web import host

DEPTH, LIMIT = 1, 10


def crawl(seeds: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], pages: DataFrame, depth: int = DEPTH, limit: int = LIMIT, same_host: bool = True) -> DataFrame:
    """(url, level, place) of the pages a breadth-first crawl reaches from seeds (url, in order of place).

    links: (src, pos, dst), or a function that reads them from rows of pages; it gets those of a level only. `limit` caps the addresses found, seeds included, in the order of their finding; pages
    that aren't stored are found but not expanded. With same_host, links that leave the source's host aren't followed."""
    visited = seeds.select("url", F.lit(0).alias("level"), F.col("place").cast("long").alias("place")).orderBy("place").limit(limit)
    frontier = visited
    for level in range(1, depth + 1):
        room = limit - visited.count()
        if room <= 0:
            break
        read = pages.join(F.broadcast(frontier.select("url")), "url", "left_semi")  # at most `limit` addresses
        edges = links(read) if callable(links) else links.join(F.broadcast(read.select(F.col("url").alias("src")).distinct()), "src", "left_semi")
        if same_host:
            edges = edges.where(host(F.col("src")) == host(F.col("dst")))
        found = edges.join(F.broadcast(frontier.select(F.col("url").alias("src"), "place")), "src").select(F.col("dst").alias("url"), "place", "pos")
        first = found.groupBy("url").agg(F.min(F.struct("place", "pos")).alias("_f")).join(visited, "url", "left_anti")
        new = first.orderBy("_f", "url").limit(room)
        base = limit * level
        place = (F.row_number().over(Window.orderBy("_f", "url")) + base).cast("long")  # at most `limit` rows
        frontier = new.select("url", F.lit(level).alias("level"), place.alias("place")).persist()
        visited = visited.union(frontier).persist()
        if frontier.isEmpty():
            break
    return visited


def page_chain(start: DataFrame, following: DataFrame, most: int = 10) -> DataFrame:
    """(chain, step, url): the next-page links followed from each start (chain, url) until none, a repeat, or `most` pages.

    All chains take a step at once: one join a step."""
    reached = start.select("chain", F.lit(1).alias("step"), "url", F.array("url").alias("_seen"))
    out = reached
    for step in range(2, most + 1):
        joined = reached.join(following.select(F.col("url").alias("_u"), "next"), F.col("url") == F.col("_u"))
        reached = joined.where(F.col("next").isNotNull() & ~F.array_contains("_seen", F.col("next"))).select("chain", F.lit(step).alias("step"), F.col("next").alias("url"), F.array_append("_seen", F.col("next")).alias("_seen")).persist()
        out = out.union(reached)
        if reached.isEmpty():
            break
    return out.select("chain", "step", "url")


class CrawlJob:
    """A first-in first-out crawl whose state is tables in a folder: queue and visited, one version a step.

    States: queued, running, done, failed, cancelled. Taking it up again goes on at the last whole step."""

    def __init__(self, spark, folder: str, depth: int = DEPTH, limit: int = LIMIT):
        self.spark, self.folder, self.depth, self.limit = spark, folder.rstrip("/"), depth, limit

    def _write(self, frame: DataFrame, step: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.folder}/step={step}")

    def start(self, seeds: DataFrame) -> None:
        self._write(seeds.select("url", F.lit(0).alias("level"), F.col("place").cast("long").alias("place"), F.lit("queued").alias("state")), 0)

    def steps(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [str(s.getPath()) for s in system.listStatus(path)]
        whole = [n for n in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
        return sorted(int(n.rpartition("=")[2]) for n in whole if "/step=" in n)

    def status(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/step={self.steps()[-1]}")

    def cancel(self) -> None:
        state = F.when(F.col("state") == "queued", "cancelled").otherwise(F.col("state"))
        self._write(self.status().withColumn("state", state), self.steps()[-1] + 1)

    def run(self, links: DataFrame, pages: DataFrame) -> DataFrame:
        """Levels until nothing is queued; only stored pages below the depth are expanded."""
        while True:
            now = self.status()
            queued = now.where("state = 'queued'")
            level = queued.agg(F.min("level").alias("l")).first()["l"]
            if level is None:
                return now
            front = queued.where(F.col("level") == level)
            ok = front.join(pages.select("url"), "url", "left_semi")
            state = F.when(F.col("_ok"), "done").otherwise("failed")
            finished = front.join(ok.select("url", F.lit(True).alias("_ok")), "url", "left").select("url", "level", "place", state.alias("state"))
            new = now.limit(0)
            room = self.limit - now.count()
            if level < self.depth and room > 0:
                found = links.join(ok.select(F.col("url").alias("src"), "place"), "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("place", "pos")).alias("_f"))
                new = found.join(now, "url", "left_anti").orderBy("_f", "url").limit(room)
                new = new.select("url", F.lit(level + 1).alias("level"), (F.row_number().over(Window.orderBy("_f", "url")) + self.limit * (level + 1)).cast("long").alias("place"), F.lit("queued").alias("state"))
            rest = now.join(front.select("url"), "url", "left_anti")
            self._write(rest.unionByName(finished).unionByName(new), self.steps()[-1] + 1)
