"""Page views of a session, from the browser's own navigation headers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import spread, written

#: How long after a redirect its target still belongs to it.
REDIRECT_WINDOW = 30 * 10**9

DOCUMENTS = "session string, seq long, view int, trigger string, final string"
FIELDS = ("session", "seq", "t", "url", "redirect_to", "site", "user", "mode")


def _session(rows: list[tuple[Any, ...]], window: int) -> list[tuple[Any, ...]]:
    """The view of each document of a session, and the url that the view's redirects end at; one step after another, in one pass."""
    causes, final, redirected, mine = [], [], [], []
    waiting: dict[str, tuple[int, int]] = {}
    for _, _, t, url, redirect_to, site, user, mode in rows:
        since = waiting.pop(url, None)
        if since and t - since[1] <= window:
            view = since[0]
            final[view], redirected[view] = url, True
        else:
            view = len(final)
            causes.append("html" if not mode else "typed" if site == "none" else "user" if user else None)
            final.append(url)
            redirected.append(False)
        mine.append(view)
        if redirect_to:
            waiting[redirect_to] = (view, t)
    cause = [c or ("redirect" if again else "link") for c, again in zip(causes, redirected)]
    return [(r[0], r[1], v, cause[v], final[v]) for r, v in zip(rows, mine)]


def _documents(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of sessions one after another, each in order; a session may go over several batches."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    names = [n.split()[0] for n in DOCUMENTS.split(", ")]

    def made(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[Any, ...]] = []
        for batch in batches:
            out: list[tuple[Any, ...]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and open_[0][0] != row[0]:
                    out += _session(open_, window)
                    open_ = []
                open_.append(row)
            yield made(out)
        yield made(_session(open_, window))

    return run


def page_views(steps: DataFrame, window: int = REDIRECT_WINDOW) -> DataFrame:
    """(session, seq, view, trigger, document) of steps (session, seq, t, url, document, redirect_to, referer, site, user, mode).

    A document request starts a view unless it continues a redirect to its url that is at most `window` old.  Any
    other request belongs to the latest view with its referer's url (as it is at the end of the redirects), else to the latest
    view begun.  What comes before the first view has view -1.

    Only documents, whose redirects are sequential, are read session by session, from sorted partitions.  Requests find their view by a running maximum, and by
    session and url: the last view of that url begun by then.
    """
    dealt = spread(steps.where("document").select(*FIELDS), "session").sortWithinPartitions("session", "t", "seq")
    documents = written(dealt.mapInArrow(_documents(window), DOCUMENTS))
    so_far = Window.partitionBy("session").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.select("session", "seq", "t", "document", "referer").join(documents, ["session", "seq"], "left")
    rows = rows.withColumn("begun", F.max(F.when(F.col("view").isNotNull(), F.struct("view", "trigger"))).over(so_far))
    none = F.struct(F.lit(-1).alias("view"), F.lit(None).cast("string").alias("trigger"))
    asked = written(rows.where("not document").select("session", "seq", F.nullif("referer", F.lit("")).alias("url"), F.coalesce("begun", none).alias("begun")))

    views = documents.groupBy("session", F.col("final").alias("url"), "view").agg(F.first("trigger").alias("trigger"))
    both = views.select("session", "url", F.col("view").alias("at"), F.lit(None).cast("long").alias("seq"), F.struct("view", "trigger").alias("of"), F.lit(None).cast("struct<view:int,trigger:string>").alias("begun"))
    both = both.union(asked.where("url is not null").select("session", "url", "begun.view", "seq", F.lit(None).cast("struct<view:int,trigger:string>"), "begun"))
    upto = Window.partitionBy("session", "url").orderBy("at", F.col("of").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    referred = both.withColumn("_v", F.coalesce(F.last("of", ignorenulls=True).over(upto), "begun")).where("of is null").select("session", "seq", "_v.view", "_v.trigger")
    rest = asked.where("url is null").select("session", "seq", "begun.view", "begun.trigger")
    mine = documents.select("session", "seq", "view", "trigger", F.lit(True).alias("document"))
    return mine.union(referred.union(rest).withColumn("document", F.lit(False)))
