"""Task logs, decisions and reviews: latest state, guarded transitions, the observation matrix, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Decision, reason and fill change by the states of original and compare.
OBSERVATIONS = [
    ("UNOBSERVED", "UNOBSERVED", "NEEDS_REVIEW", "BOTH_SIDES_UNOBSERVED", ""),
    ("UNOBSERVED", "OBSERVED_VALUE", "NEEDS_REVIEW", "ORIGINAL_UNOBSERVED", ""),
    ("UNOBSERVED", "OBSERVED_BLANK", "NEEDS_REVIEW", "ORIGINAL_UNOBSERVED", ""),
    ("OBSERVED_VALUE", "UNOBSERVED", "NEEDS_REVIEW", "COMPARE_UNOBSERVED", ""),
    ("OBSERVED_BLANK", "UNOBSERVED", "NEEDS_REVIEW", "COMPARE_UNOBSERVED", ""),
    ("OBSERVED_BLANK", "OBSERVED_VALUE", "CONFIRMED", "OBSERVED_BLANK_TO_VALUE", "filled"),
    ("OBSERVED_VALUE", "OBSERVED_BLANK", "CONFIRMED", "OBSERVED_VALUE_TO_BLANK", "cleared"),
    ("OBSERVED_BLANK", "OBSERVED_BLANK", "CONFIRMED", "BOTH_SIDES_OBSERVED_BLANK", ""),
]

# Statuses a task may move to.
TRANSITIONS = [("PROCESSING", "PROCESSING"), ("PROCESSING", "COMPLETED"), ("PROCESSING", "FAILED"), ("FAILED", "PROCESSING")]


def observation_decision(rows: DataFrame) -> DataFrame:
    """Adds decision, reason and fill_change to original_state, compare_state, values_equal,
    content_reliable and removed (business content removed or covered on the compare side)."""
    table = rows.sparkSession.createDataFrame(OBSERVATIONS, "original_state string, compare_state string, _decision string, _reason string, _fill string")
    joined = rows.join(F.broadcast(table), ["original_state", "compare_state"], "left")  # eight fixed rows
    both = (F.col("original_state") == "OBSERVED_VALUE") & (F.col("compare_state") == "OBSERVED_VALUE")
    cleared = (F.col("original_state") == "OBSERVED_VALUE") & (F.col("compare_state") == "UNOBSERVED") & F.col("removed") & F.col("content_reliable")
    decision = F.when(cleared, "CONFIRMED").when(both & ~F.col("values_equal") & ~F.col("content_reliable"), "NEEDS_REVIEW").when(both, "CONFIRMED").otherwise(F.coalesce("_decision", F.lit("NEEDS_REVIEW")))
    reason = (
        F.when(cleared, "BUSINESS_CONTENT_REMOVED_OR_COVERED")
        .when(both & F.col("values_equal"), "OBSERVED_VALUES_EQUAL")
        .when(both & F.col("content_reliable"), "OBSERVED_VALUES_DIFFER")
        .when(both, "OBSERVED_VALUE_CONTENT_UNCERTAIN")
        .otherwise(F.coalesce("_reason", F.lit("OBSERVATION_STATE_MATRIX_FALLBACK")))
    )
    fill = F.when(cleared, "cleared").otherwise(F.coalesce("_fill", F.lit("")))
    return joined.select(*rows.columns, decision.alias("decision"), reason.alias("reason"), fill.alias("fill_change"))


def latest(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of each key with the highest revision; the aggregation combines before its shuffle."""
    others = [c for c in log.columns if c not in (key, revision)]
    rows = log.groupBy(key).agg(F.max_by(F.struct(*others), revision).alias("_s"), F.max(revision).alias(revision))
    return rows.select(key, revision, "_s.*")


def upsert(state: DataFrame, changes: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """State after changes: new rows in, old rows replaced but for the columns to keep; revision goes up."""
    a, b = state.alias("a"), changes.alias("b")
    old = F.col(f"a.{key}").isNotNull()
    new = F.col(f"b.{key}").isNotNull()
    columns = []
    for c in state.columns:
        if c == "revision":
            value = F.when(old & new, F.col("a.revision") + 1).when(new, 1).otherwise(F.col("a.revision"))
        elif c in keep:
            value = F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        else:
            value = F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        columns.append(value.alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def allowed(moves: DataFrame) -> DataFrame:
    """The rows whose (status, target) the transition table allows."""
    table = moves.sparkSession.createDataFrame(TRANSITIONS, "status string, target string")
    return moves.join(F.broadcast(table), ["status", "target"], "left_semi")  # four fixed rows


def readable(rows: DataFrame, owner: str, user: str, is_admin: bool) -> DataFrame:
    """Rows with an owner that the user may see: all for an administrator, else the user's own."""
    seen = (F.col(owner) != "") & F.col(owner).isNotNull()
    return rows.where(seen if is_admin else seen & (F.col(owner) == user))


def identity(prefix: str, *parts: Column) -> Column:
    """A stable id: prefix and the first 24 hex digits of the SHA-256 of the parts as JSON."""
    names = [p.alias(f"k{i}") for i, p in enumerate(parts)]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256), 1, 24))


def mutate(state: DataFrame, patches: DataFrame, key: str, owner: str) -> DataFrame:
    """Read, change, write: rows with the patch of their key applied, where a patch column is not null, revision up by
    one. A patch may not change the owner: such a row stays as it is and is marked ``refused``."""
    fields = [c for c in patches.columns if c not in (key, owner)]
    given = patches.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in patches.columns if c != key])
    refused = F.col("_k").isNotNull() & F.col(f"_p_{owner}").isNotNull() & ~F.col(f"_p_{owner}").eqNullSafe(F.col(owner))
    changed = F.col("_k").isNotNull() & ~refused
    value = lambda c: F.when(changed, F.coalesce(f"_p_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.when(changed, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "revision" else F.col(c)
    return state.join(given, F.col(key) == F.col("_k"), "left").select(*[value(c) for c in state.columns], refused.alias("refused"))


def event_frames(messages: DataFrame, key: str, order: str, at: str, payload: list[str], status: str, terminal: list[str], wait: int = 30) -> DataFrame:
    """(key, order, keepalives, frame): messages as server-sent events, up to the first terminal one of each key;
    ``keepalives`` is how many whole waits of seconds went by before the message."""
    window = Window.partitionBy(key).orderBy(order)
    ended = F.max(F.col(status).isin(*terminal).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col(at).cast("timestamp").cast("long") - F.lag(at).over(window).cast("timestamp").cast("long")
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), F.lit("\n\n"))
    rows = messages.withColumn("_ended", F.coalesce(ended, F.lit(0))).withColumn("keepalives", F.coalesce(F.floor(gap / wait), F.lit(0)).cast("long"))
    return rows.where("_ended = 0").select(key, order, "keepalives", frame.alias("frame"))


def observations(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls of a task by stage: attempts over the wire, retries, inputs answered from a cache, failures, seconds waited.

    ``calls``: keys, cache_hit, retry (booleans), outcome, inputs, seconds.
    """
    hit = F.col("cache_hit")
    return calls.groupBy(*keys).agg(
        F.count_if(~hit).alias("attempts"), F.count_if("retry").alias("retries"), F.coalesce(F.sum(F.when(hit, F.col("inputs"))), F.lit(0)).alias("cached_inputs"),
        F.count_if(F.col("outcome") == "error").alias("failures"), F.coalesce(F.sum(F.when(~hit, F.col("seconds"))), F.lit(0.0)).alias("seconds"),
    )
