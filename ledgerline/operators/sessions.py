"""Research sessions from an event log, and the replay of a filing cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.prompts import answer_of, quote_of
from ledgerline.sources.staging import staged
from ledgerline.sources.tables import latest_by_key

RECENTS, TTL_SECONDS = 12, 600
#: Messages of a page of a thread.
PAGE_MESSAGES = 100
KEY = ["ticker", "year", "form_type"]
# Fixed value: the filing that a new user sees first.
DEFAULT_KEY = ("CHGG", "2026", "10-K")


def session_key(ticker: str = "ticker", year: str = "year", form: str = "form_type", prefix: str = "session") -> F.Column:
    return F.concat_ws(":", F.lit(prefix), F.upper(ticker), year, F.upper(form))


def latest_sessions(events: DataFrame) -> DataFrame:
    """The last event of each user and session key: (user_id, session_key, *the event), with an empty payload for a missing one."""
    rows = events.withColumns({"session_key": session_key(), "payload": F.coalesce("payload", F.lit(""))})
    return latest_by_key(rows, ["user_id", "session_key"], ["ts", "seq"])


def with_session_defaults(sessions: DataFrame) -> DataFrame:
    """Stored sessions with defaults for fields that old ones lack: empty html, not partial, no anchors."""
    missing = F.array().cast(sessions.schema["document_anchors"].dataType)
    return sessions.withColumns({"document_html": F.coalesce("document_html", F.lit("")), "document_html_partial": F.coalesce("document_html_partial", F.lit(False)), "document_anchors": F.coalesce("document_anchors", missing)})


def recent_filings(events: DataFrame, n: int = RECENTS) -> DataFrame:
    """(user_id, place, ticker, year, form_type): each user's n different keys used last, newest first; spelling counts."""
    used = events.groupBy("user_id", *KEY).agg(F.max(F.struct("ts", "seq")).alias("last"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last")))
    return used.withColumn("place", place).where(F.col("place") <= n).select("user_id", "place", *KEY)


def restore_key(users: DataFrame, active: DataFrame, events: DataFrame, default: tuple[str, str, str] = DEFAULT_KEY) -> DataFrame:
    """(user_id, ticker, year, form_type, origin): a user's last active key if it is whole, else the newest recent, else the default."""
    whole = active.where(" AND ".join(f"{c} IS NOT NULL" for c in KEY)).select("user_id", F.struct(*KEY).alias("_active"))
    recent = recent_filings(events, 1).select("user_id", F.struct(*KEY).alias("_recent"))
    met = users.select("user_id").join(whole, "user_id", "left").join(recent, "user_id", "left")
    given = F.struct(*(F.lit(v).alias(c) for c, v in zip(KEY, default)))
    chosen = F.coalesce("_active", "_recent", given)
    origin = F.when(F.col("_active").isNotNull(), "active").when(F.col("_recent").isNotNull(), "recent").otherwise("default")
    return met.select("user_id", *(chosen[c].alias(c) for c in KEY), origin.alias("origin"))


def threads(messages: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """(*key, n_messages, messages): the ordered messages of each session, none left out, in one row. thread_pages() is for sessions of any length."""
    rest = [c for c in messages.columns if c not in (*key, order)]
    return messages.groupBy(*key).agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct(order, *rest))).alias("messages"))


def thread_pages(messages: DataFrame, key: list[str], order: list[str], size: int = PAGE_MESSAGES) -> DataFrame:
    """(*key, page, first, n_messages, messages): each session's messages in order, `size` of them a row; page counts from 0, first from 1.

    No session is gathered anywhere, however long: messages are dealt by ranges of key and order, and numbered by counts at two levels,
    within a range and over the ranges of a session. A page that goes on from one range to the next is put together from its pieces; the sessions
    that do so are at most one for each pair of ranges. Messages that are equal in order keep the order of their ranges.
    """
    rest = [c for c in messages.columns if c not in key]
    ranged = staged(messages.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    name = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})  # a null field differs from every value
    named = ranged.withColumn("_name", name)
    counts = named.groupBy("_name", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("_name").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = F.count("*").over(Window.partitionBy("_name")) > 1
    ranges = staged(counts.select("_name", "_part", "_first", before.alias("_before"), split.alias("_split")))
    number = F.col("_place") - F.col("_first") + F.col("_before")
    placed = named.join(ranges, ["_name", "_part"]).withColumn("page", F.floor(number / size))
    message = F.struct("_place", F.struct(*rest).alias("message"))
    pieces = placed.groupBy("_name", "_part", *key, "page", "_split").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    pieces = pieces.withColumn("messages", F.transform("messages", lambda m: m["message"]))
    whole = pieces.where("NOT _split").select(*key, "page", "messages")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "messages"))), lambda p: p["messages"]))
    pages = whole.unionByName(pieces.where("_split").groupBy("_name", *key, "page").agg(joined.alias("messages")).drop("_name"))
    return pages.select(*key, "page", (F.col("page") * size + 1).alias("first"), F.size("messages").alias("n_messages"), "messages")


def selection_effects(events: DataFrame, action: str) -> DataFrame:
    """Each selection event as its three effects: a highlight, the selected text, and a user message of kind `selection`."""
    made = F.array(*(F.lit(e) for e in ("highlight", "message", "selected_text")))
    rows = events.where(F.col("action") == action).withColumn("effect", F.explode(made))
    kind = F.when(F.col("effect") == "message", "selection")
    return rows.select("user_id", session_key().alias("session_key"), "ts", "seq", "effect", F.col("payload").alias("text"), kind.alias("kind"))


def chat_messages(events: DataFrame, selected: str, asked: str, answered: str) -> DataFrame:
    """(user_id, session_key, ts, seq, role, kind, content, source_quote): the messages that events add to a session's thread.

    A selection adds a user message of kind `selection`; a question adds one without a kind; an answer adds the assistant's message,
    with what stands behind its quote label as source_quote (null without a quote). Other events add none.
    """
    action, text = F.col("action"), F.coalesce("payload", F.lit(""))
    made = events.where(action.isin(selected, asked, answered))
    answer = action == answered
    return made.select(
        "user_id",
        session_key().alias("session_key"),
        "ts",
        "seq",
        F.when(answer, "assistant").otherwise("user").alias("role"),
        F.when(action == selected, "selection").alias("kind"),
        F.when(answer, answer_of(text)).otherwise(text).alias("content"),
        F.when(answer, F.nullif(quote_of(text), F.lit(""))).alias("source_quote"),
    )


def chat_threads(events: DataFrame, selected: str, asked: str, answered: str) -> DataFrame:
    """(user_id, session_key, n_messages, messages): each session's thread of records (ts, seq, role, kind, content, source_quote), in order."""
    messages = chat_messages(events, selected, asked, answered)
    ordered = messages.select("user_id", "session_key", F.struct("ts", "seq").alias("at"), "role", "kind", "content", "source_quote")
    return threads(ordered, ["user_id", "session_key"], "at")


def switch_filing(switches: DataFrame, stored: DataFrame) -> DataFrame:
    """switches (user_id, session_key, new_text, new_html) with the session after the switch.

    A new text replaces text and html together, an empty one leaves what is stored; the selected text is always cleared,
    messages and highlights stay as stored.
    """
    met = switches.join(stored, ["user_id", "session_key"], "left")
    fresh = F.coalesce(F.length("new_text"), F.lit(0)) > 0
    return met.select(
        "user_id",
        "session_key",
        F.when(fresh, F.col("new_text")).otherwise(F.coalesce("document_text", F.lit(""))).alias("document_text"),
        F.when(fresh, F.coalesce("new_html", F.lit(""))).otherwise(F.coalesce("document_html", F.lit(""))).alias("document_html"),
        F.lit("").alias("selected_text"),
        F.coalesce("n_messages", F.lit(0).cast("long")).alias("n_messages"),
    )


# --- cache replay ------------------------------------------------------------------------------------------------------


def _next_load(times: np.ndarray, ttl: int) -> np.ndarray:
    """For a load at each of the sorted times, the place of the next one; len(times) if there is none."""
    return np.searchsorted(times, times + ttl)


def _last_load(times: np.ndarray, ttl: int) -> np.ndarray:
    """For a load at each of the sorted times, the place of the last load that follows from it, by doubling the steps."""
    after = np.append(_next_load(times, ttl), len(times))
    last = np.append(np.where(after[:-1] == len(times), np.arange(len(times)), -1), -1)
    while (last[:-1] < 0).any():
        last = np.where(last < 0, last[after], last)
        after = after[after]
    return last[:-1]


def _steps(times: np.ndarray, ttl: int) -> tuple[list[int], list[int]]:
    """What a stretch of a key's requests makes of the last load before it: for a load that lapses up to which time, which load is the last.

    The first load of the stretch is its first request after the lapse, if there is one.
    """
    times = np.unique(times)
    exits = times[_last_load(times, ttl)]
    edge = np.append(exits[1:] != exits[:-1], True)  # first loads with the same outcome are one step
    return times[edge].tolist(), exits[edge].tolist()


def replay_cache(requests: DataFrame, key: list[str], ttl_seconds: int = TTL_SECONDS, order: str = "request_id") -> DataFrame:
    """requests (with ts) with cached: whether the key was loaded less than ttl_seconds before.

    A hit does not renew the load, so the loads of a key are a recurrence. It is worked out without gathering a key anywhere:
    requests are dealt by ranges of key and time; each stretch of a key in a range says what it makes of the last load before
    it, whichever that is (a few steps, since chains of loads that begin close to each other soon meet); the stretches of
    a key, narrow rows, are chained; and then every stretch is replayed from the load that it begins with. A key that all requests share
    is spread over all ranges like any others.

    Requests at the same time are taken by `order`. One without a time is not cached and loads nothing; null keys are keys like
    any others, and repeated request identifiers are requests of their own.
    """
    ttl = ttl_seconds * 1_000_000
    name = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})  # a null field differs from every value
    rows = requests.select(F.struct(*requests.columns).alias("row"), name.alias("name"), F.col(order).alias("order"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ranged = rows.where("us IS NOT NULL").repartitionByRange("name", "us")
    ranged = staged(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    narrow = ranged.select("name", "part", "us", "order", "place")

    # Keys that go on from one range to the next: at most one for each pair of ranges, so what is known of them is as small.
    split = F.broadcast(staged(narrow.groupBy("name").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("name")))

    def stretch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *_steps(rows["us"].to_numpy(np.int64), ttl))], columns=["name", "part", "until", "exits"])

    def chain(stretches: pd.DataFrame) -> pd.DataFrame:
        found, loaded = [], None
        for r in stretches.sort_values("part").itertuples():
            found.append((r.name, r.part, loaded))
            at = 0 if loaded is None else int(np.searchsorted(r.until, loaded + ttl))
            loaded = int(r.exits[at]) if at < len(r.until) else loaded
        return pd.DataFrame(found, columns=["name", "part", "loaded"]).astype({"loaded": "Int64"})

    steps = narrow.join(split, "name").select("name", "part", "us").groupBy("name", "part").applyInPandas(stretch, "name string, part int, until array<long>, exits array<long>")
    begun = staged(steps.groupBy("name").applyInPandas(chain, "name string, part int, loaded long"))
    ordered = narrow.join(F.broadcast(begun), ["name", "part"], "left").repartition("name", "part").sortWithinPartitions("name", "part", "us", "order")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, loaded = None, None
        for batch in batches:
            times, names, parts, before = batch["us"].to_numpy(np.int64), batch["name"].to_numpy(), batch["part"].to_numpy(), batch["loaded"]
            starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (parts[1:] != parts[:-1]))) if len(times) else ()
            hits = np.ones(len(times), bool)
            for start, end in zip(starts, [*starts[1:], len(times)]):
                if (names[start], parts[start]) != now:
                    now, loaded = (names[start], parts[start]), None if pd.isna(before.iloc[start]) else int(before.iloc[start])
                own = times[start:end]
                miss = 0 if loaded is None else int(np.searchsorted(own, loaded + ttl))
                while miss < len(own):  # from load to load
                    hits[start + miss], loaded = False, int(own[miss])
                    miss = max(miss + 1, int(np.searchsorted(own, loaded + ttl)))
            yield pd.DataFrame({"place": batch["place"], "cached": hits})

    flags = ordered.select("name", "part", "us", "loaded", "place").mapInPandas(replay, "place long, cached boolean")
    timed = ranged.select("row", "place").join(flags, "place").select("row.*", "cached")
    return timed.unionByName(rows.where("us IS NULL").select("row.*", F.lit(False).alias("cached")))
