"""Returned units matched to the lots they were sold in, first shipped first.

A lot is a sold line, a return takes units back; both of one client and item are a group. Stock is what was shipped before a
day and not yet returned. It is a sum reflected at zero: units shipped less units returned, plus the largest shortfall so
far, which is what returns couldn't find. Where it comes to zero, all lots so far are used up and what follows is
independent: a busy period. With shortfalls left out, the k-th unit found is the k-th unit shipped, so that lots and returns
are intervals on one axis a group.

Sums are taken without a group in one task. Events are dealt by ranges of (client, item, day, kind, tie-breaking
columns); each task numbers what it has, and a flow is what one part holds of one kind on one day. Windows run over flows: a group
has at most one a day and kind, and one more a part that it reaches into. Periods are packed into tasks of about
``TASK`` events by running sums of their sizes; one that is larger is cut at fixed places of its axis, and an
event goes to the cuts that it reaches into. A task holds its starts and stops as sorted arrays and finds all pieces by
binary search. Costs and refunds are differences of floors of running units, so pieces cut in two add up; these few are
added and numbered at the end.

Defined cases: lines with a null client, item, amount, shipped_at or quantity, or with a quantity below 1, are no lots; a null
discount is none; a null line_no is empty in the checksum and comes first; repeated lines are lots each; ties are equal in all that
orders them, so any order gives the same result; empty tables give an empty result; names of further columns can't
clash, as columns are read by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, written

RETURN, LOT = 0, 1
#: Events of a task on average.
TASK = 20_000
ORDER = ["client_id", "item_id", "day", "kind", "sale_id", "line_no", "q", "c", "d", "tie"]
EVENTS = "client_id long, item_id long, day long, kind int, sale_id long, line_no long, q long, c long, d long, units long, part int, before long, rank long"
PIECES = "client_id long, item_id long, return_no long, piece_no long, return_day long, return_sale_id long, lot_sale_id long, lot_line_no long, units long, lot_left long, refund_cents long, margin_cents long, lot_start long, cut boolean"
RESULT = ["client_id", "item_id", "return_no", "piece_no", "return_day", "return_sale_id", "lot_sale_id", "lot_line_no", "units", "lot_left", "refund_cents", "margin_cents"]


def _cents(col: str) -> Column:
    return F.floor(F.coalesce(F.col(col).cast("double"), F.lit(0.0)) * 100 + 0.5).cast("long")


def _lots(lines: DataFrame, sales: DataFrame, flagged: bool = False) -> DataFrame:
    """(client_id, item_id, day, sale_id, line_no, q, c, d, units, return_day): the last two are null for lots that don't return."""
    lines = lines.where("item_id is not null and amount is not null and shipped_at is not null and quantity >= 1")
    lines = lines.where("flag = 'returned'") if flagged else lines
    h = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))).cast("binary"))
    h = F.when(F.col("flag") == "returned", h)
    day, q = F.unix_date(F.to_date("shipped_at")).cast("long"), F.col("quantity").cast("long")
    own = lines.select(
        F.col("sale_id").cast("long"), F.col("item_id").cast("long"), day.alias("day"), F.col("line_no").cast("long"), q.alias("q"), _cents("amount").alias("c"), _cents("discount").alias("d"),
        (1 + h % (q + 1)).alias("units"), (day + 1 + h % 7).alias("return_day"),
    )
    clients = sales.where("client_id is not null").select(F.col("sale_id").cast("long"), F.col("client_id").cast("long"))
    return own.join(clients.hint("shuffle_hash"), "sale_id")


def used_lots(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """The lots that a return of their client and item may take from."""
    last = _lots(lines, sales, flagged=True).groupBy("client_id", "item_id").agg(F.max("return_day").alias("last"))
    # A key of its own gives the join an exchange on either side, so that adaptive execution can split a hot group.
    key = lambda d: d.withColumn("key", F.xxhash64("client_id", "item_id"))
    last = key(last).toDF("client", "item", "last", "key").hint("shuffle_hash")
    near = key(_lots(lines, sales)).join(last, "key")
    return near.where((F.col("client_id") == F.col("client")) & (F.col("item_id") == F.col("item")) & (F.col("day") < F.col("last"))).drop("client", "item", "last", "key")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EVENTS of a part in their order: units and events of the same flow before each."""
    key, units, rank = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ORDER[:4]])
        size = np.asarray(batch.column("units"))
        at = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        sums, group = np.cumsum(size) - size, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(size))))
        before, number = sums - sums[at][group], np.arange(len(size)) - at[group]
        if key == tuple(keys[:, 0]):
            before[group == 0] += units
            number[group == 0] += rank
        key, units, rank = tuple(keys[:, -1]), before[-1] + size[-1], number[-1] + 1
        yield pa.RecordBatch.from_arrays([*[batch.column(x.split()[0]) for x in EVENTS.split(", ")[:-2]], pa.array(before), pa.array(number)], [x.split()[0] for x in EVENTS.split(", ")])


def events_of(lots: DataFrame) -> DataFrame:
    """EVENTS, written: lots and returns, dealt by ranges of their order."""
    own = lots.withColumn("tie", F.monotonically_increasing_id())
    shipped = own.select("client_id", "item_id", "day", F.lit(LOT).alias("kind"), "sale_id", "line_no", "q", "c", "d", F.col("q").alias("units"), "tie")
    back = own.where("units is not null").select("client_id", "item_id", F.col("return_day").alias("day"), F.lit(RETURN).alias("kind"), "sale_id", "line_no", "q", "c", "d", "units", "tie")
    parts = int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = shipped.unionByName(back).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    return written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_numbered, EVENTS))


def flows_of(events: DataFrame) -> DataFrame:
    """One row a (client, item, day, kind, part): units shipped and found before it, those it finds, its period, returns before it."""
    flow = events.groupBy("client_id", "item_id", "day", "kind", "part").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("client_id", "item_id").orderBy("day", "kind", "part")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    back = F.col("kind") == RETURN
    units = lambda mask: F.when(mask, F.col("units")).otherwise(0)
    sums = flow.select(
        "*",
        F.coalesce(F.sum(units(~back)).over(earlier), F.lit(0)).alias("shipped"),
        F.sum(units(back)).over(so_far).alias("asked"),
        F.coalesce(F.sum(F.when(back, F.col("rows")).otherwise(0)).over(earlier), F.lit(0)).alias("returns"),
    )
    lost = F.greatest(F.lit(0), F.max(F.when(back, F.col("asked") - F.col("shipped"))).over(so_far))
    found = sums.withColumn("lost", F.coalesce(lost, F.lit(0))).withColumn("found_by", F.col("asked") - F.col("lost"))
    found = found.withColumn("found", F.coalesce(F.lag("found_by").over(order), F.lit(0)))
    empty = F.when(back & (F.col("found_by") == F.col("shipped")), 1).otherwise(0)
    return found.withColumn("period", F.coalesce(F.sum(empty).over(earlier), F.lit(0))).drop("asked", "lost", "units")


def packed(flows: DataFrame, task: int) -> DataFrame:
    """(client_id, item_id, period, first, last, cuts, bin): periods that find units, or ask for some, packed into tasks or cut."""
    each = flows.groupBy("client_id", "item_id", "period").agg(
        F.min("found").alias("first"), F.max("found_by").alias("last"), F.sum("rows").alias("rows"), F.min("kind").alias("kind")
    ).where(F.col("kind") == RETURN)
    buckets = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("client_id", "item_id", "period"), F.lit(buckets)))
    cuts = F.least(F.ceil(F.col("rows") / task), F.greatest(F.col("last") - F.col("first"), F.lit(1)))
    each = each.withColumn("cuts", cuts)
    running = F.sum(F.when(F.col("cuts") == 1, F.col("rows")).otherwise(0)).over(Window.partitionBy("bucket").orderBy("client_id", "item_id", "period"))
    return each.withColumn("bin", F.floor(running / task)).select("client_id", "item_id", "period", "first", "last", "cuts", "bucket", "bin")


def settle(table: pa.Table) -> pa.Table:
    """PIECES of one task's lots and returns: ``start`` and ``stop`` on the axis, cut to ``low`` and ``high``."""
    col = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("line_no",)}
    line_no = table.column("line_no").combine_chunks()
    order = np.lexsort((col["kind"], col["start"], col["low"], col["item_id"], col["client_id"]))
    client, item, low = (col[c][order] for c in ("client_id", "item_id", "low"))
    new = np.concatenate([[True], (client[1:] != client[:-1]) | (item[1:] != item[:-1]) | (low[1:] != low[:-1])])[: len(order)]
    group, width = np.cumsum(new) - 1, (col["high"][order] - low)[new]
    # Periods and cuts stand one after the other on one axis for all.
    shift = (np.cumsum(width) - width)[group] - low
    start, stop, high = col["start"][order], col["stop"][order], col["high"][order]
    begin, end = np.clip(start, low, high) + shift, np.clip(stop, low, high) + shift
    back = col["kind"][order] == RETURN
    some = begin < end
    lots, asks = np.flatnonzero(~back & some), np.flatnonzero(back & some)
    edges = np.union1d(begin[lots], begin[asks])
    at_lot, at_ask = np.searchsorted(begin[lots], edges, "right") - 1, np.searchsorted(begin[asks], edges, "right") - 1
    both = (at_lot >= 0) & (at_ask >= 0)
    edges, lot, ask = edges[both], lots[at_lot[both]], asks[at_ask[both]]
    inside = (edges < end[lot]) & (edges < end[ask])
    edges, lot, ask = edges[inside], lot[inside], ask[inside]
    units = np.minimum(end[lot], end[ask]) - edges
    place = edges - shift[lot]
    q, c, d = (col[x][order] for x in "qcd")
    refund = lambda r, n: n * c[r] * (100 - d[r]) // (100 * q[r])
    cost = lambda i, n: n * c[i] // q[i]
    given, taken = place - start[ask], place - start[lot]
    back_cents = refund(ask, given + units) - refund(ask, given)
    margin = back_cents - (cost(lot, taken + units) - cost(lot, taken))
    cut = (start < low) | (stop > high)
    first = np.concatenate([[True], ask[1:] != ask[:-1]])[: len(ask)]
    piece = np.arange(len(ask)) - np.maximum.accumulate(np.where(first, np.arange(len(ask)), 0)) + 1
    pieces = np.bincount(ask, minlength=len(order))
    # What a return doesn't find is its last piece, told by the cut that holds its end.
    asked = col["asked"][order]
    rest = np.flatnonzero(back & (asked > stop - start) & (stop <= high) & ((stop > low) | (start == stop)))
    missing = asked[rest] - (stop - start)[rest]
    rest_cents = refund(rest, asked[rest]) - refund(rest, (stop - start)[rest])
    every, n, m = np.concatenate([ask, rest]), len(ask), len(rest)
    null = pa.nulls(m, pa.int64())
    column = lambda a, b: pa.concat_arrays([pa.array(a.astype(np.int64)), b if isinstance(b, pa.Array) else pa.array(b.astype(np.int64))])
    columns = [
        pa.array(client[every]), pa.array(item[every]), pa.array(col["return_no"][order][every]),
        column(np.where(cut[ask], 0, piece), np.where(cut[rest], 0, pieces[rest] + 1)),
        pa.array(col["day"][order][every]), pa.array(col["sale_id"][order][every]),
        column(col["sale_id"][order][lot], null), pa.concat_arrays([line_no.take(pa.array(order[lot])), null]),
        column(units, missing), column(stop[lot] - place - units, null),
        column(back_cents, rest_cents), column(margin, null), column(start[lot], null), pa.array(cut[every]),
    ]
    return pa.table(columns, [x.split()[0] for x in PIECES.split(", ")])


def match(lines: DataFrame, sales: DataFrame, task: int = TASK) -> DataFrame:
    """RESULT: one row a return and lot it takes from, in the order of ``piece_no``, and one for what it doesn't find."""
    lots = written(used_lots(lines, sales))
    events = events_of(lots)
    flows = written(flows_of(events))
    keys = ["client_id", "item_id", "period"]
    placed = flows.join(packed(flows, task).hint("merge"), keys)
    placed = placed.select(*keys, "day", "kind", "part", "shipped", "found", "found_by", "returns", "first", "last", "cuts", "bucket", "bin")
    own = events.join(placed.hint("shuffle_hash"), ["client_id", "item_id", "day", "kind", "part"])
    back = F.col("kind") == RETURN
    found = lambda n: F.col("found") + F.least(n, F.col("found_by") - F.col("found"))
    start = F.when(back, found(F.col("before"))).otherwise(F.col("shipped") + F.col("before"))
    stop = F.when(back, found(F.col("before") + F.col("units"))).otherwise(F.col("shipped") + F.col("before") + F.col("units"))
    own = own.withColumn("start", start).withColumn("stop", stop).where(back | (F.col("start") < F.col("last")))
    size = F.greatest(F.ceil((F.col("last") - F.col("first")) / F.col("cuts")), F.lit(1))
    number = lambda at: F.least(F.greatest(F.floor((at - F.col("first")) / F.col("size")), F.lit(0)), F.col("cuts") - 1)
    reach = F.sequence(number(F.col("start")), F.greatest(number(F.col("start")), number(F.least("stop", "last") - 1)))
    dealt = own.withColumn("size", size).withColumn("number", F.explode(reach))
    low = F.col("first") + F.col("number") * F.col("size")
    high = F.when(F.col("number") == F.col("cuts") - 1, F.greatest(F.col("last"), low + 1)).otherwise(low + F.col("size"))
    rows = dealt.select(
        F.when(F.col("cuts") == 1, F.xxhash64("bucket", "bin")).otherwise(F.xxhash64(*keys, "number")).alias("task"),
        "client_id", "item_id", "kind", "day", "sale_id", "line_no", "q", "c", "d", "start", "stop", F.col("units").alias("asked"), (F.col("returns") + F.col("rank") + 1).alias("return_no"), low.alias("low"), high.alias("high"),
    )
    pieces = written(rows.groupBy("task").applyInArrow(settle, PIECES))
    discard(lots, events, flows)
    same = ["client_id", "item_id", "return_no", "return_day", "return_sale_id", "lot_start", "lot_sale_id", "lot_line_no"]
    sums = [F.sum(c).alias(c) for c in ("units", "refund_cents", "margin_cents")]
    joined = pieces.where("cut").groupBy(*same).agg(*sums, F.min("lot_left").alias("lot_left"))
    order = Window.partitionBy("client_id", "item_id", "return_no").orderBy(F.asc_nulls_last("lot_start"))
    return pieces.where("not cut").select(*RESULT).unionByName(joined.withColumn("piece_no", F.row_number().over(order).cast("long")).select(*RESULT))
