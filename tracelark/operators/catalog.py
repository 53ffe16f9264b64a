"""The signal catalogue joined with observed traffic: availability, search, references, order and axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .frames import direction_order

#: Hits of a search: default and most (fixed values).
DEFAULT_HITS, MOST_HITS = 25, 50
NOT_SUPPORTED, NOT_PRESENT = "Plotting not yet supported", "Not present in this trace"


def signals(messages: DataFrame, file_id: str = "dbc") -> DataFrame:
    """A row for each signal of a message table."""
    rows = messages.select("can_id", "is_extended", "size_bytes", "raw_frame_decodable", F.col("name").alias("message_name"), F.posexplode("signals").alias("place", "s"))
    return rows.select(F.lit(file_id).alias("file_id"), "can_id", "is_extended", "size_bytes", "raw_frame_decodable", "message_name", "place", F.col("s.name").alias("signal_name"), F.col("s").alias("format"))


def with_sources(catalog: DataFrame, raw_messages: DataFrame, trace_loaded: bool = True) -> DataFrame:
    """The catalogue with a row for each source that sends the message; without traffic one row, with the reason why it cannot be plotted."""
    seen = raw_messages.select("can_id", "is_extended", "channel", "direction", F.lit(True).alias("present"))
    out = catalog.join(seen, ["can_id", "is_extended"], "left")
    reason = F.when(~F.col("raw_frame_decodable"), NOT_SUPPORTED)
    if trace_loaded:
        reason = reason.when(F.col("present").isNull(), NOT_PRESENT)
    sources = F.count("*").over(Window.partitionBy("file_id", "can_id", "is_extended", "size_bytes", "signal_name"))
    badge = F.concat_ws(" · ", F.concat(F.lit("Channel "), "channel"), F.initcap(F.nullif("direction", F.lit("unknown"))))
    label = F.concat_ws(" ", F.concat_ws(".", "message_name", "signal_name"), F.when((sources > 1) & (badge != ""), F.concat(F.lit("["), badge, F.lit("]"))))
    key = F.concat(F.lit('["dbc",'), F.to_json(F.array("file_id")).substr(F.lit(2), F.length(F.to_json(F.array("file_id"))) - 2), F.lit(","), F.concat_ws(",", "can_id", F.col("is_extended").cast("string"), "size_bytes"), F.lit(',"'), "signal_name", F.lit('",'), F.coalesce(F.col("channel").cast("string"), F.lit("null")), F.lit(","), F.coalesce(F.concat(F.lit('"'), "direction", F.lit('"')), F.lit("null")), F.lit("]"))
    return out.withColumns({"key": key, "label": label, "unavailable_reason": reason, "arbitration_id": F.concat(F.lit("0x"), F.upper(F.conv("can_id", 10, 16)))}).drop("present")


def ordered(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("file_id", "can_id", "is_extended", "place", F.col("channel").asc_nulls_first(), direction_order(F.col("direction")))


def search(catalog: DataFrame, query: str, limit: int = DEFAULT_HITS) -> tuple[DataFrame, int]:
    """The rows whose label has all terms of the query or whose identifier they name, and the capped limit; one row beyond the limit tells
    that there are more."""
    limit = min(max(1, limit), MOST_HITS)
    hay, ident = text.folded(F.col("label")), F.lower(F.conv("can_id", 10, 16))
    out = catalog
    for term in text.terms(query):
        out = out.where(text.matches_term(hay, ident, term))
    return out.limit(limit + 1), limit


def tree(catalog: DataFrame, query: str = "", active: list[str] | None = None, hide_unavailable: bool = False, closed: list[str] = (), files: DataFrame | None = None) -> DataFrame:
    """The rows of a selector in order: files, their messages, their signals (kind, key, label, expanded).

    Signals are kept by the query's terms, by being active, and by being available. A filter hides files and messages without signals left;
    without one, a file of ``files`` (file_id) stays though it is empty. Below closed files and messages nothing is shown.
    """
    hay, ident = text.folded(F.col("label")), F.lower(F.conv("can_id", 10, 16))
    rows = catalog.withColumn("message_key", F.to_json(F.struct("file_id", "can_id", "is_extended", "size_bytes", "message_name")))
    for term in text.terms(query):
        rows = rows.where(text.matches_term(hay, ident, term))
    if active is not None:
        rows = rows.where(F.col("key").isin(list(active)))
    if hide_unavailable:
        rows = rows.where("unavailable_reason is null")
    is_open = lambda c: ~F.col(c).isin(list(closed))
    order = ["file_id", "can_id", "is_extended", "message_key", "place", "channel", "way", "level"]
    no = {"can_id": F.lit(None).cast("int"), "is_extended": F.lit(None).cast("boolean"), "message_key": F.lit(None).cast("string"), "place": F.lit(-1), "channel": F.lit(None).cast("int"), "way": F.lit(-1)}
    keep = ["kind", "shown_key", "label", "expanded", *order]
    own = rows.select("file_id")
    if files is not None and not query.strip() and active is None and not hide_unavailable:
        own = own.unionByName(files.select("file_id"))
    tops = own.distinct().withColumns({**no, "kind": F.lit("dbc"), "shown_key": F.col("file_id"), "label": F.col("file_id"), "expanded": is_open("file_id"), "level": F.lit(0)}).select(*keep)
    rows = rows.where(is_open("file_id"))
    names = rows.groupBy("file_id", "can_id", "is_extended", "message_key").agg(F.first("message_name").alias("label"))
    names = names.withColumns({**{k: no[k] for k in ("place", "channel", "way")}, "kind": F.lit("message"), "shown_key": F.col("message_key"), "expanded": is_open("message_key"), "level": F.lit(1)}).select(*keep)
    leaves = rows.where(is_open("message_key")).withColumns({"kind": F.lit("signal"), "shown_key": F.col("key"), "expanded": F.lit(None).cast("boolean"), "way": direction_order(F.col("direction")), "level": F.lit(2)}).select(*keep)
    # what has no identifier of its own comes first, so a file stands before its messages and a message before its signals
    place = ["file_id", F.when(F.col("level") == 0, 0).otherwise(1), *[F.col(c).asc_nulls_first() for c in order[1:]]]
    return tops.unionByName(names).unionByName(leaves).orderBy(*place).select("kind", F.col("shown_key").alias("key"), "label", "expanded")


def resolve(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """For each reference (place, ref) its key, how many rows it could mean, and its state: resolved, missing, ambiguous or repeated.

    A reference is a key, or else a label in any case."""
    by_key = refs.join(catalog.select("key"), F.col("ref") == F.col("key"), "left")
    rest = by_key.where("key is null").select("place", "ref")
    by_label = rest.join(catalog.select("key", F.lower("label").alias("l")), F.lower("ref") == F.col("l"), "left").groupBy("place", "ref").agg(F.count("key").alias("n"), F.min("key").alias("key"))
    both = by_key.where("key is not null").select("place", "ref", F.lit(1).cast("long").alias("n"), "key").unionByName(by_label)
    nth = F.row_number().over(Window.partitionBy(F.when(F.col("n") == 1, F.col("key")).otherwise(F.concat(F.lit("#"), "place"))).orderBy("place"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(nth > 1, "repeated").otherwise("resolved")
    return both.withColumn("state", state).select("place", "ref", "n", F.when(F.col("state") == "resolved", F.col("key")).alias("key"), "state")


def by_locale(text: Column) -> Column:
    """Text that is ordered as people read it: letters with and without accents, small and capital ones stand together."""
    return F.collate(text, "UNICODE")


def value_table_key(descriptions: Column) -> Column:
    """A value table as a JSON array of pairs, in the order of the raw values and then of the labels."""
    entries = F.array_sort(F.transform(descriptions, lambda x: F.struct(x["raw_value"].alias("raw"), by_locale(x["label"]).alias("label"))))
    pair = lambda x: F.concat(F.lit("["), x["raw"].cast("string"), F.lit(","), F.substr(F.to_json(F.array(F.collate(x["label"], "UTF8_BINARY"))), F.lit(2)))
    return F.concat(F.lit("["), F.array_join(F.transform(entries, pair), ","), F.lit("]"))


def legend_order(signals: DataFrame, mode: str) -> DataFrame:
    """By the order of selection, by name, or grouped: value tables first, then by unit, factor and offset. Texts compare by locale."""
    names = [by_locale(F.col(c)) for c in ("signal_name", "message_name", "label", "key")]
    if mode == "selection":
        order = [F.col("selected_at")]
    elif mode == "alphabetical":
        order = names
    else:
        has = F.size("value_descriptions") > 0
        order = [F.when(has, 0).otherwise(1), by_locale(F.when(has, value_table_key(F.col("value_descriptions"))).otherwise(F.col("unit"))), F.col("factor"), F.col("offset"), *names]
    return signals.orderBy(*order)


def axis_units(signals: DataFrame, axes: list[str]) -> DataFrame:
    """The common unit of each axis: blanks do not count, and there is none where signals disagree. An unknown axis means the first one."""
    axis = F.when(F.col("axis").isin(*axes), F.col("axis")).otherwise(axes[0])
    units = F.collect_set(F.nullif(F.btrim("unit"), F.lit("")))
    return signals.groupBy(axis.alias("axis")).agg(F.count("*").alias("n_signals"), units.alias("u")).select("axis", "n_signals", F.when(F.size("u") == 1, F.col("u")[0]).alias("unit"))
