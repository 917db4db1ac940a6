"""Cohort retention by per-client activity bit vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

DAY_US = 86_400_000_000
#: Bits of one word of an activity vector.
BITS = 64
#: A client with more than 1/HOT of all events is dealt to SALTS tasks; so at most HOT clients are looked up by broadcast.
HOT, SALTS = 256, 64


def micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, whatever the session's zone; null for null."""
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * DAY_US + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + seconds


def floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def in_cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null and values that aren't finite count 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e16)
    return F.when(finite, F.floor(100 * value + 0.5)).otherwise(F.lit(0)).cast("long")


def events(clicks: DataFrame, arrival: Column, cuts: Sequence[int], starts_with: str = "purchase", client: str = "client_id", ts: str = "ts", kind: str = "kind", value: str = "value") -> DataFrame:
    """client, at, buys, cents, state: equal rows once, without those that have no time or client.

    `state` is the first of the states 0, 1, ... that knows the event: cuts ascend, state i knows what arrives before
    cuts[i], the last one all. An event whose arrival is null is known to the last state only.
    """
    once = clicks.where(F.col(ts).isNotNull() & F.col(client).isNotNull()).distinct()
    state = F.lit(len(cuts))
    for number in reversed(range(len(cuts))):
        state = F.when(arrival < cuts[number], number).otherwise(state)
    buys = F.coalesce(F.col(kind) == starts_with, F.lit(False))
    return once.select(F.col(client).alias("client"), micros(F.col(ts)).alias("at"), buys.alias("buys"), in_cents(F.col(value)).alias("cents"), state.cast("int").alias("state"))


def starts(known: DataFrame, states: int) -> DataFrame:
    """client, rows, starts: each client's first buying event in each state (null where it has none yet)."""
    first = [F.min(F.when(F.col("buys") & (F.col("state") <= s), F.col("at"))) for s in range(states)]
    out = known.groupBy("client").agg(F.count(F.lit(1)).alias("rows"), F.array(*first).alias("starts"))
    return out.where(F.col("starts")[states - 1].isNotNull())


def vectors(known: DataFrame, begun: DataFrame, rows: int, states: int, days: int = 3) -> DataFrame:
    """client, state, cohort, moved, word, mask, cents: one row for each non-zero word of a client's activity vector.

    Bit b of word w is set if the client was active in period BITS * w + b; `cents` is sparse, an array of (bit, sum).
    Events meet their client's starts in salted tasks: each makes the partial vectors of its share, which are OR-ed
    and added by client afterwards. Only clients with more than 1/HOT of the rows are salted.
    """
    hot = begun.where(F.col("rows") * HOT > rows).select("client", F.lit(True).alias("hot"))
    salted = known.join(F.broadcast(hot), "client", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(F.col("rows") * HOT > rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sides = salted.drop("hot").join(begun.withColumn("salt", F.explode(every)).drop("rows"), ["client", "salt"])
    cohort = [floor_div(F.col("starts")[s], days * DAY_US) for s in range(states)]
    moved = F.array_max(F.array(*cohort)) != F.array_min(F.array(*cohort)) if states > 1 else F.lit(False)
    moved = moved & ~F.exists("starts", lambda x: x.isNull())
    seen = [
        F.when((F.col("state") <= s) & (F.col("at") >= F.col("starts")[s]), F.struct(F.lit(s).alias("state"), cohort[s].alias("cohort"), floor_div(F.col("at") - F.col("starts")[s], days * DAY_US).alias("period")))
        for s in range(states)
    ]
    active = sides.select("client", "salt", "cents", moved.cast("long").alias("moved"), F.explode(F.array_compact(F.array(*seen))).alias("x"))
    who = ["client", F.col("x.state").alias("state"), F.col("x.cohort").alias("cohort"), "moved"]
    place = [floor_div(F.col("x.period"), BITS).alias("word"), F.pmod("x.period", F.lit(BITS)).cast("int").alias("bit")]
    sums = active.select(*who, "salt", *place, "cents").groupBy("client", "state", "cohort", "moved", "salt", "word", "bit").agg(F.sum("cents").alias("cents"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    partial = sums.groupBy("client", "state", "cohort", "moved", "salt", "word").agg(F.bit_or(one).alias("mask"), F.collect_list(F.struct("bit", "cents")).alias("cents"))
    return partial.groupBy("client", "state", "cohort", "moved", "word").agg(F.bit_or("mask").alias("mask"), F.flatten(F.collect_list("cents")).alias("cents"))


def active_periods(bits: DataFrame) -> DataFrame:
    """client, state, cohort, moved, period, cents: the set bits of the vectors."""
    bit = F.col("bit")
    here = bits.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)))
    cents = F.aggregate(F.filter("cents", lambda x: x["bit"] == bit), F.lit(0).cast("long"), lambda total, x: total + x["cents"])
    return here.select("client", "state", "cohort", "moved", (F.col("word") * BITS + bit).alias("period"), cents.alias("cents"))


def segments(clients: DataFrame, client: str = "client_id", segment: str = "city", newest: str = "updated_at") -> DataFrame:
    """client, segment: one row a client. Of several rows the newest counts, of equally new ones the greatest segment."""
    text = F.coalesce(F.col(segment).cast("string"), F.lit(""))
    rows = clients.where(F.col(client).isNotNull())
    return rows.groupBy(F.col(client).alias("client")).agg(F.max(F.struct(F.col(newest).alias("new"), text.alias("segment")))["segment"].alias("segment"))


def matrix(clicks: DataFrame, clients: DataFrame, arrival: Column, cuts: Sequence[int], days: int = 3) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents of every cell that has a client.

    Equal rows of clicks (in all their columns, whatever they are called) count once; rows without a time or client
    don't count; a null value is 0 cents, a null kind is no purchase but is activity; ties in time are no matter.
    Clients without a purchase have no cells; those without a row or city have segment ''. An empty table gives no
    rows. Events are read once and written narrow; a hot client's are dealt to SALTS tasks; nothing but a list of at
    most HOT clients is broadcast, nothing goes to the driver but a row count.
    """
    states = len(cuts) + 1
    known = stored(events(clicks, arrival, cuts), "events")
    begun = stored(starts(known, states), "starts")
    cells = active_periods(vectors(known, begun, known.count(), states, days)).join(segments(clients), "client", "left")
    number = F.crc32(F.col("client").cast("string").cast("binary"))
    out = cells.groupBy("state", F.coalesce("segment", F.lit("")).alias("segment"), "cohort", "period").agg(
        F.count(F.lit(1)).alias("users"), F.sum(number).alias("users_crc32"), F.sum("moved").alias("moved"), F.sum("cents").alias("cents")
    )
    return out.select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents")


def late_arrival(click_id: str = "click_id", arrived: str = "arrived_at") -> Column:
    """When a click arrives: h mod 100 days after arrived_at if 3 divides h, the crc32 of its decimal id; null ids aren't late."""
    h = F.crc32(F.col(click_id).cast("string").cast("binary"))
    return micros(F.col(arrived)) + F.when(h % 3 == 0, h % 100).otherwise(0) * F.lit(DAY_US)
