"""Rules over keyed events, as batch jobs; ``symtab.streaming.events`` has the same rules as streams.

Edits, which need every event of a document in order, are folded in ``applyInPandas`` over one document; all other rules are
joins, aggregates and window expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from symtab.operators.ranges import bins, running_max
from symtab.scratch import cut


def offset_of(text: str, line: int, col: int) -> int:
    """Offset of a 0-based position in UTF-16 units; -1 for a line that is not there."""
    at = 0
    for _ in range(int(line)):
        found = text.find("\n", at)
        if found < 0:
            return -1
        at = found + 1
    return at + int(col) if line >= 0 else -1


def apply_edit(content: str, start: tuple[int, int], end: tuple[int, int], text: str) -> str:
    """Content with the range replaced. A missing line has the offset -1, of which nothing is taken and nothing dropped."""
    a, b = offset_of(content, *start), offset_of(content, *end)
    return content[: max(a, 0)] + text + content[max(b, 0) :]


def _units(text: str) -> str:
    """One character for each UTF-16 unit, so that columns count what editors count."""
    if text.isascii() or max(text) <= "￿":
        return text
    return "".join(map(chr, memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H")))


def _joined(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in units) else units


def fold_document(content: str | None, events: pd.DataFrame) -> str | None:
    """Content after the events, in order; None while a document is not open. Kinds: open, save, close, change."""
    for e in events.itertuples(index=False):
        kind = getattr(e, "event_type", "change")
        text = e.text if isinstance(e.text, str) else None
        if kind == "close":
            content = None
        elif kind in ("open", "save"):
            content = _units(text or "") if content is None else content
        elif e.full_replace:
            content = _units(text or "")
        else:
            content = apply_edit(content or "", (e.start_line, e.start_col), (e.end_line, e.end_col), _units(text or ""))
    return content


ORDER = ["version", "ordinal"]
_FOLDED = "uri string, content string"


def _with_ordinal(edits: DataFrame) -> DataFrame:
    return edits if "ordinal" in edits.columns else edits.withColumn("ordinal", F.lit(0))


def _since_reset(rows: DataFrame) -> DataFrame:
    """Without the events of a document that its last full replacement or closing makes void; dealt out by document."""
    place = F.struct(*ORDER)
    voids = (F.col("event_type") == "close") | (~F.col("event_type").isin("open", "save") & F.coalesce(F.col("full_replace"), F.lit(False)))
    last = F.max(F.when(voids, place)).over(Window.partitionBy("uri"))
    return rows.withColumn("_last", last).filter(F.col("_last").isNull() | (place >= F.col("_last"))).drop("_last")


def fold_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """(uri, content): edits by (version, ordinal), each a range replace or a full one, applied to the result of the one before.

    ``documents`` are the contents at the start; one that only has edits starts empty, one without edits stays as it is.
    """
    start = documents.select("uri", F.lit(None).cast("long").alias("version"), F.lit(-1).alias("ordinal"), F.lit("start").alias("event_type"), F.lit(True).alias("full_replace"), *[F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")], F.col("content").alias("text"))
    rows = _with_ordinal(edits).withColumn("event_type", F.lit("change")).select(*start.columns).unionByName(start)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"uri": pdf["uri"].iloc[:1], "content": [_joined(fold_document(None, pdf.sort_values(ORDER, na_position="first", kind="stable")) or "")]})

    return _since_reset(rows).groupBy("uri").applyInPandas(fold, _FOLDED)


def document_lifecycle(events: DataFrame) -> DataFrame:
    """(uri, content) of the documents that are open at the end: open and save create if absent, close removes, a change on an unknown one starts empty."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        content = fold_document(None, pdf.sort_values(ORDER, kind="stable"))
        return pd.DataFrame({"uri": pdf["uri"].iloc[:1], "content": [None if content is None else _joined(content)]})

    return _since_reset(_with_ordinal(events)).groupBy("uri").applyInPandas(fold, _FOLDED).filter("content is not null")


def accumulate_with_reset(events: DataFrame, key: str = "uri", order: tuple[str, ...] = ("ts", "event_id"), item: str = "item", reset: str = "reset") -> DataFrame:
    """``events`` plus ``items``: the sorted set after each event. A reset event starts the set anew with its own items.

    ``item`` is one item or an array of them, which may be empty; nulls, in it or instead of it, add nothing.

    Between two resets an item adds something only where it comes first. So items are aggregated to their first event, which
    is partial before the shuffle, and the running collection holds those alone: it grows with the set, not with the events.
    """
    by_time = Window.partitionBy(key).orderBy(*order)
    epoch = F.sum(F.coalesce(F.col(reset).cast("int"), F.lit(0))).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    numbered = events.withColumn("_at", F.row_number().over(by_time)).withColumn("_epoch", epoch)
    items = F.col(item) if isinstance(events.schema[item].dataType, ArrayType) else F.array(item)
    single = numbered.select(F.col(key).alias("_key"), "_epoch", "_at", F.explode(items).alias("_item")).filter("_item is not null")
    first = single.groupBy("_key", "_epoch", "_item").agg(F.min("_at").alias("_first"))
    new = first.groupBy("_key", "_first").agg(F.collect_list("_item").alias("_new"))
    inside = Window.partitionBy(key, "_epoch").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = numbered.join(new, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_first")), "left")
    found = F.sort_array(F.flatten(F.collect_list("_new").over(inside)))
    return joined.withColumn("items", found).select(*events.columns, "items")


def debounce(events: DataFrame, keys: list[str], delay: str, ts: str = "ts", order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events that no later one of the same keys follows within the delay. No keys: one scope for all, in slices of time.

    With keys a lead over each key decides. Without, a lead over everything would be one task's work, so events are dealt
    out by slices as long as the delay and each is compared with the rest of its slice and the first of the next.
    """
    gap = F.expr(f"INTERVAL {delay}")
    if keys:
        following = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, *order))
        return events.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") > F.col(ts) + gap)).drop("_next")
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + gap)
    sliced = events.withColumn("_slice", F.floor(seconds / F.greatest(width, F.lit(1))))
    first = sliced.groupBy((F.col("_slice") - 1).alias("_slice")).agg(F.min(ts).alias("_first"))
    ahead = F.lead(ts).over(Window.partitionBy("_slice").orderBy(ts, *order))
    following = F.coalesce(F.col("_next"), F.col("_first"))
    out = sliced.withColumn("_next", ahead).join(first, "_slice", "left")
    return out.filter(following.isNull() | (following > F.col(ts) + gap)).select(*events.columns)


def conflate_times(times: list, service_time) -> list[tuple[int, object]]:
    """(event index, start) of the runs of one key: one at a time, while one runs only the newest arrival is kept.

    An arrival exactly when a run ends counts as pending.
    """
    runs: list[tuple[int, object]] = []
    until = pending = None
    for i, t in enumerate(times):
        if until is not None and t > until and pending is not None:
            runs.append((pending, until))
            until, pending = until + service_time, None
        if until is None or t > until:
            runs.append((i, t))
            until = t + service_time
        else:
            pending = i
    if pending is not None:
        runs.append((pending, until))
    return runs


#: Service times in a slice of a key's events.
SLICE = 1024


def conflate_latest(events: DataFrame, key: str, service_seconds: float, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(key, event_id, start): the tasks that run and when they start, as ``conflate_times`` tells of each key. Rows without a time go.

    A key is *busy* from an event that finds it idle, its head at time t: runs start at t, t + S, t + 2 S, ... (S the service
    time), each with the newest event of the time S before, until that time had none. So all that has to be followed from one
    event to the next is which events are heads; runs are then an aggregate. A head comes first or after a gap above S. A
    gap above 2 S ends any busy time, so its event is a head for certain; one between ends it only for heads whose time,
    modulo S, lies in a range that the gap gives. Each of these ranges is made up of dyadic ranges, in which a head looks for the first gap
    after it: its link. Links are doubled, and heads are those that are reached from certain ones.

    All of it is joins, aggregates and windows over slices of a key's time, so that one key with all events is dealt out too.
    """
    if service_seconds <= 0:
        raise ValueError("a service time is above 0")
    service = round(service_seconds * 1_000_000)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.filter(F.col(ts).isNotNull()).select(F.struct(F.col(key).alias("key")).alias("_key"), micros.alias("_t"), F.col(ts).alias("_ts"), F.col(event_id).alias("_id"))
    # one row for each time: its first and its newest event
    times = rows.groupBy("_key", "_t").agg(F.min("_ts").alias("_ts"), F.min("_id").alias("_first"), F.max("_id").alias("_newest"), F.count("*").alias("_n"))
    times = cut(times.withColumn("_bucket", F.floor(F.col("_t") / service)), "conflate-times")

    # times in one bucket have no gap above S, so gaps are sought between buckets
    buckets = times.groupBy("_key", "_bucket").agg(F.min(F.struct("_t", "_n")).alias("_head"), F.max("_t").alias("_last"))
    slices = F.floor(F.col("_bucket") / SLICE)
    gaps = running_max(buckets, ["_key"], "_bucket", slices, F.col("_last"), "_before", before=True)
    gaps = gaps.select("_key", "_bucket", F.col("_head._t").alias("_at"), (F.col("_head._n") > 1).alias("_several"), "_before")
    width = F.col("_at") - F.col("_before")
    heads = gaps.filter(F.col("_before").isNull() | (width > service)).withColumn("_certain", F.col("_before").isNull() | (width > 2 * service))
    heads = running_max(heads, ["_key"], "_bucket", slices, F.when(F.col("_certain"), F.col("_at")), "_island")
    heads = cut(heads, "conflate-heads")

    true_heads = _reached(heads, service)
    own = buckets.join(true_heads, ["_key", "_bucket"], "left").select("_key", "_bucket", F.col("_at").alias("_own"))
    own = running_max(own, ["_key"], "_bucket", slices, F.col("_own"), "_earlier", before=True)
    placed = times.join(own, ["_key", "_bucket"]).withColumn("_head", F.when(F.col("_t") >= F.col("_own"), F.col("_own")).otherwise(F.col("_earlier")))
    after = F.col("_t") - F.col("_head")
    run = F.ceil(after / service)
    one = lambda n, event: F.struct(n.cast("long").alias("n"), event.alias("id"))
    # a head's own time: it runs at once, and what else comes at that time waits
    at_head = F.when(F.col("_n") > 1, F.array(one(F.lit(0), F.col("_first")), one(F.lit(1), F.col("_newest")))).otherwise(F.array(one(F.lit(0), F.col("_first"))))
    runs = placed.select("_key", "_head", "_t", "_ts", F.explode(F.when(after == 0, at_head).otherwise(F.array(one(run, F.col("_newest"))))).alias("_run"))
    newest = runs.groupBy("_key", "_head", F.col("_run.n").alias("_n")).agg(F.max(F.struct("_t", F.col("_run.id").alias("id"), "_ts")).alias("_of"))
    # the start is reckoned from the event's own time, which keeps its type
    wait = F.col("_head") + F.col("_n") * service - F.col("_of._t")
    start = F.timestamp_add("MICROSECOND", wait, F.col("_of._ts"))
    return newest.select(F.col("_key.key").alias(key), F.col("_of.id").alias(event_id), start.cast(kinds[ts]).alias("start"))


def _reached(heads: DataFrame, service: int) -> DataFrame:
    """(_key, _bucket, _at) of the heads that are certain or that links from certain ones reach.

    ``heads``: (_key, _bucket, _at, _several, _before, _certain, _island), the island being the last certain head's time.
    """
    at = heads.select("_key", "_island", F.col("_at").alias("_asks"), (F.col("_at") + F.col("_several").cast("long")).alias("_place"), F.pmod(F.col("_at"), F.lit(service)).alias("_phase"))
    ends = heads.filter("not _certain").select("_key", "_island", F.col("_at").alias("_gap"), F.col("_before").alias("_place"), F.pmod(F.col("_before"), F.lit(service)).alias("_from"), (F.col("_at") - F.col("_before") - service).alias("_n"))
    # phases from, from + 1, ... (n of them, less than S), around the circle
    arcs = F.array(F.struct(F.col("_from").alias("lo"), F.least(F.col("_from") + F.col("_n"), F.lit(service)).alias("end")), F.struct(F.lit(0).cast("long").alias("lo"), (F.col("_from") + F.col("_n") - service).alias("end")))
    arcs = ends.select("_key", "_island", "_gap", "_place", F.explode(arcs).alias("_arc")).select("_key", "_island", "_gap", "_place", F.col("_arc.lo").alias("_lo"), (F.col("_arc.end") - 1).alias("_hi")).filter("_lo <= _hi")
    levels = (service - 1).bit_length()
    given = bins(arcs, "_lo", "_hi", levels).select("_key", "_island", "_level", "_bin", "_place", "_gap", F.lit(None).cast("long").alias("_asks"))
    several = heads.groupBy("_key", "_island").agg(F.count("*").alias("_heads")).filter("_heads > 1").select("_key", "_island")
    asked = at.join(several, ["_key", "_island"], "left_semi").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    asked = asked.select("_key", "_island", "_level", F.expr("shiftright(_phase, _level)").alias("_bin"), "_place", F.lit(None).cast("long").alias("_gap"), "_asks")
    # the least gap at this place or later, in the same range of phases
    later = Window.partitionBy("_key", "_island", "_level", "_bin").orderBy(-F.col("_place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = given.unionByName(asked).withColumn("_next", F.min("_gap").over(later)).filter("_asks is not null and _next is not null")
    links = cut(found.groupBy("_key", "_asks").agg(F.min("_next").alias("_next")), "conflate-links")
    doubled = [links]
    while not doubled[-1].isEmpty():  # as many times as the longest chain can be halved
        far = doubled[-1].select("_key", F.col("_asks").alias("_next"), F.col("_next").alias("_far"))
        doubled.append(cut(doubled[-1].join(far, ["_key", "_next"]).select("_key", "_asks", F.col("_far").alias("_next")), "conflate-links"))
    reached = heads.filter("_certain").select("_key", F.col("_at").alias("_asks"))
    for some in reversed(doubled[:-1]):
        reached = reached.unionByName(some.join(reached, ["_key", "_asks"], "left_semi").select("_key", F.col("_next").alias("_asks"))).distinct()
        if len(doubled) > 2:
            reached = cut(reached, "conflate-reached")
    return heads.select("_key", "_bucket", "_at").join(reached.select("_key", F.col("_asks").alias("_at")), ["_key", "_at"], "left_semi")
