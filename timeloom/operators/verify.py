"""Claims checked against the events they cite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.identity import packed
from timeloom.functions.text import match_key, quote
from timeloom.functions.timestamps import add_asserted_instant
from timeloom.session import materialize

DEFAULT_TOLERANCE_SECONDS = 1.0
FIELDS = ("datetime", "principal", "action", "object")

_FACTS = "struct<" + ",".join(f"{name}:string" for name in FIELDS) + ">"

VERDICT_COLUMNS = ("ok", "backing_event_id", "reason", "detail")


def tolerance_text(seconds: float) -> str:
    """A duration as hours, minutes and seconds, the way details print it."""
    micros = round(seconds * 1_000_000)
    whole, fraction = divmod(micros, 1_000_000)
    days, rest = divmod(whole, 86_400)
    clock = f"{rest // 3600}:{rest // 60 % 60:02d}:{rest % 60:02d}"
    prefix = f"{days} day{'' if days == 1 else 's'}, " if days else ""
    return prefix + clock + (f".{fraction:06d}" if fraction else "")


def _quoted_list(values: Column) -> Column:
    return F.array_join(F.transform(values, quote), ", ")


def _structural_reason() -> Column:
    """What is wrong with a claim before any event is looked up."""
    asserted = [F.col(f"asserts.{name}") for name in FIELDS]
    empty = F.coalesce(*asserted).isNull()
    return (
        F.when(F.size("malformed_citations") > 0, F.lit("malformed_citation"))
        .when(F.size("citations") == 0, F.lit("no_citations"))
        .when(empty, F.lit("no_assertions"))
    )


def _structural_detail() -> Column:
    # The texts of details here and below, which verdicts carry.
    return (
        F.when(
            F.col("_structural") == "malformed_citation",
            F.concat(
                F.lit("claim carries malformed citations: "), _quoted_list("malformed_citations")
            ),
        )
        .when(F.col("_structural") == "no_citations", F.lit("claim carries no event-id citation"))
        .when(
            F.col("_structural") == "no_assertions",
            F.lit(
                "claim asserts none of the checkable facts (datetime, principal, action, object)"
            ),
        )
    )


def _field_checks(checked: DataFrame, tolerance_seconds: float) -> DataFrame:
    """Per cited event, the first asserted field it does not satisfy."""
    limit = round(tolerance_seconds * 1_000_000)
    short = F.left("_cid", F.lit(12))

    def differs(name: str) -> Column:
        same = match_key(F.col(f"asserts.{name}")) == match_key(F.col(f"_{name}"))
        return F.col(f"asserts.{name}").isNotNull() & ~F.coalesce(same, F.lit(False))

    distance = F.abs(F.unix_micros("_instant") - F.unix_micros("_ts"))
    late = F.col("asserts.datetime").isNotNull() & F.coalesce(distance > limit, F.lit(True))
    failing = (
        F.when(late, F.lit("datetime"))
        .when(differs("principal"), F.lit("principal"))
        .when(differs("action"), F.lit("action"))
        .when(differs("object"), F.lit("object"))
    )
    checked = checked.withColumn("_failing", failing)
    time_detail = F.concat(
        F.lit("asserted time "),
        quote(F.col("asserts.datetime")),
        F.when(F.col("_instant").isNull(), F.lit(" is not a parseable instant")).otherwise(
            F.lit(
                " differs from the cited event's time by more than the tolerance "
                f"({tolerance_text(tolerance_seconds)})"
            )
        ),
        F.lit(" (event "),
        short,
        F.lit(")"),
    )

    def text_detail(name: str) -> Column:
        return F.concat(
            F.lit(f"asserted {name} "),
            quote(F.col(f"asserts.{name}")),
            F.lit(f" does not match the {name} of event "),
            short,
        )

    detail = F.when(F.col("_failing") == "datetime", time_detail)
    for name in FIELDS[1:]:
        detail = detail.when(F.col("_failing") == name, text_detail(name))
    reason = F.when(F.col("_failing") == "datetime", F.lit("time_mismatch")).when(
        F.col("_failing").isNotNull(), F.concat(F.col("_failing"), F.lit("_mismatch"))
    )
    return checked.withColumn("_reason", reason).withColumn("_detail", detail)


def verify_claims(
    claims: DataFrame,
    events: DataFrame,
    tolerance_seconds: float = DEFAULT_TOLERANCE_SECONDS,
    key: tuple[str, ...] = ("claim_id",),
) -> DataFrame:
    """Claims with their verdict: ``ok, backing_event_id, reason, detail``.

    Checks run in a fixed order: malformed citation, no citation, nothing asserted,
    an id that does not exist, then the asserted fields per cited event in citation
    order. The first citation to satisfy every field backs the claim; otherwise the
    first citation's failure is the reason. A null event field satisfies nothing.
    Details never quote the event's own values.

    A claim with one citation meets its event in one join and has its verdict there; a claim
    that fails by its own form meets none. For the others, one row per citation is joined to a
    five-column projection of the events, and the verdicts to their claims.
    """
    return judge_claims(claims, events, tolerance_seconds, key).drop("_event")


def has_repeated_ids(events: DataFrame) -> bool:
    return not events.groupBy(packed(F.col("event_id")).alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def judge_claims(
    claims: DataFrame,
    events: DataFrame,
    tolerance_seconds: float = DEFAULT_TOLERANCE_SECONDS,
    key: tuple[str, ...] = ("claim_id",),
    repeated: bool | None = None,
) -> DataFrame:
    """As ``verify_claims``, with ``_event`` for ``accepted_judged``: the facts of the event behind an
    accepted claim of one citation, as it met them. ``repeated`` tells whether event ids recur, if known.
    """
    repeated = has_repeated_ids(events) if repeated is None else repeated
    staged = add_asserted_instant(claims, F.col("asserts.datetime"), "_instant")
    # Written, because all three ways start from the parsed claims.
    staged = materialize(staged.withColumn("_structural", _structural_reason()), "claims")
    known = events.select(
        F.col("event_id").alias("_cid"),
        F.col("ts").alias("_ts"),
        F.col("principal").alias("_principal"),
        F.col("action").alias("_action"),
        F.col("object").alias("_object"),
        F.col("datetime").alias("_datetime"),
    )
    alone = F.col("_structural").isNotNull()
    named = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in key])
    # Events of one id are looked at together.
    single = ~alone & named & F.coalesce(F.size("citations") == 1, F.lit(False)) & F.lit(not repeated)
    columns = claims.columns
    parts = (
        staged.filter(alone).select(
            *columns,
            F.lit(False).alias("ok"),
            F.lit(None).cast("string").alias("backing_event_id"),
            F.col("_structural").alias("reason"),
            _structural_detail().alias("detail"),
            F.lit(None).cast(_FACTS).alias("_event"),
        ),
        _verified_singly(staged.filter(single), known, tolerance_seconds, columns),
        _verified_jointly(staged.filter(~alone & ~single), known, tolerance_seconds, key, columns),
    )
    return reduce(DataFrame.unionByName, parts)


def _missing_detail(ids: Column) -> Column:
    return F.concat(F.lit("cited event ids do not exist in the store: "), _quoted_list(ids))


def _verified_singly(staged: DataFrame, known: DataFrame, tolerance_seconds: float, columns: list[str]) -> DataFrame:
    """Claims of one citation. Ids of events are even, so each part of them is hashed, and no claim is sorted."""
    one = staged.withColumn("_cid", F.get("citations", 0))
    checked = _field_checks(one.join(known.hint("shuffle_hash"), "_cid", "left"), tolerance_seconds)
    missing = F.col("_ts").isNull()
    ok = ~missing & F.col("_failing").isNull()
    return checked.select(
        *columns,
        ok.alias("ok"),
        F.when(ok, F.col("_cid")).alias("backing_event_id"),
        F.when(missing, F.lit("missing_id")).otherwise(F.col("_reason")).alias("reason"),
        F.when(missing, _missing_detail(F.array("_cid"))).when(ok, F.lit("")).otherwise(F.col("_detail")).alias("detail"),
        F.when(ok, F.struct(*[F.col(f"_{name}").alias(name) for name in FIELDS])).cast(_FACTS).alias("_event"),
    )


def _verified_jointly(
    staged: DataFrame, known: DataFrame, tolerance_seconds: float, key: tuple[str, ...], columns: list[str]
) -> DataFrame:
    """Claims of any number of citations, gathered by ``key``."""
    cited = staged.select(*key, "asserts", "_instant", F.posexplode("citations").alias("_pos", "_cid"))
    joined = _field_checks(cited.join(known, "_cid", "left"), tolerance_seconds)
    missing = F.col("_ts").isNull()
    verdicts = joined.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.when(missing, F.struct(F.col("_pos").alias("pos"), F.col("_cid").alias("cid")))
            )
        ).alias("_missing"),
        F.min_by("_cid", F.when(~missing & F.col("_failing").isNull(), F.col("_pos"))).alias(
            "_backing"
        ),
        F.min_by(F.struct("_reason", "_detail"), F.col("_pos")).alias("_first"),
    )
    result = staged.join(verdicts, list(key), "left")
    has_missing = F.size("_missing") > 0
    ok = ~has_missing & F.col("_backing").isNotNull()
    result = result.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    reason = F.when(has_missing, F.lit("missing_id")).when(~F.col("_ok"), F.col("_first._reason"))
    detail = (
        F.when(has_missing, _missing_detail(F.transform("_missing", lambda item: item["cid"])))
        .when(~F.col("_ok"), F.col("_first._detail"))
        .otherwise(F.lit(""))
    )
    return result.select(
        *columns,
        F.col("_ok").alias("ok"),
        F.when(F.col("_ok"), F.col("_backing")).alias("backing_event_id"),
        reason.alias("reason"),
        detail.alias("detail"),
        F.lit(None).cast(_FACTS).alias("_event"),
    )


def statement_of(verified: Column, backing_event_id: Column) -> Column:
    """The accepted facts as text, from the event's own values only."""
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("at "), verified["datetime"]),
        F.concat(F.lit("principal "), verified["principal"]),
        F.concat(F.lit("action "), verified["action"]),
        F.concat(F.lit("object "), verified["object"]),
    )
    return F.concat(parts, F.lit(" [event "), F.left(backing_event_id, F.lit(12)), F.lit("]"))


def accepted_claims(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """Accepted claims with the backing event's value of each asserted field."""
    return _with_statement(_with_facts(verdicts.filter("ok"), events))


def accepted_judged(judged: DataFrame, events: DataFrame) -> DataFrame:
    """``accepted_claims`` of written ``judge_claims``: only claims of several citations meet their event again."""
    backed = judged.filter("ok AND _event IS NOT NULL")
    others = judged.filter("ok AND _event IS NULL").drop("_event")
    if not others.isEmpty():
        backed = backed.unionByName(_with_facts(others, events))
    return _with_statement(backed)


def _with_facts(accepted: DataFrame, events: DataFrame) -> DataFrame:
    facts = events.select(
        F.col("event_id").alias("backing_event_id"),
        F.struct(*[F.col(name) for name in FIELDS]).cast(_FACTS).alias("_event"),
    )
    return accepted.join(facts, "backing_event_id")


def _with_statement(backed: DataFrame) -> DataFrame:
    verified = F.struct(
        *[
            F.when(F.col(f"asserts.{name}").isNotNull(), F.col(f"_event.{name}")).alias(name)
            for name in FIELDS
        ]
    )
    staged = backed.withColumn("verified", verified).drop("_event")
    return staged.withColumn(
        "statement", statement_of(F.col("verified"), F.col("backing_event_id"))
    )


def asserted_fields(asserts: Column) -> Column:
    """The names of the asserted fields, in order."""
    return F.filter(
        F.array(*[F.when(asserts[name].isNotNull(), F.lit(name)) for name in FIELDS]),
        lambda name: name.isNotNull(),
    )
