"""Decision queue: prompts, validation of answers, source binding, state machine, application.

The model that decides is outside; its answers come in as a DataFrame, so a step of the queue is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.config import DEFAULT, Params
from atlasmill.functions.hours import NONE
from atlasmill.functions.text import shorten, strip_fence

DECISION = "decision string, confidence string, canonical struct<name_tr:string,name_en:string,lat:double,lng:double,primary_source_per_field:map<string,string>>, reasoning string"


def fifo_batch(queue: DataFrame, size: int = 200, daily: int = 1400, params: Params = DEFAULT) -> DataFrame:
    """The oldest open items: pending or to be retried, with retries left."""
    open_items = queue.where(F.col("status").isin("pending", "retry") & (F.col("retry_count") < params.max_retries))
    return open_items.orderBy("created_at", "queue_id").limit(min(size, daily))


# The fields of a candidate that a prompt shows, in order.
PROMPT_FIELDS = (
    "source", "source_id", "name_tr", "name_en", "name_de", "name_fr", "name_ar", "lat", "lng", "canonical_categories",
    "raw_categories", "tags", "wikidata_id", "osm_type", "osm_id", "tarihi_yapim_yili", "unesco", "description_tr",
    "description_en",
)
PROMPT_SLOTS = 14


def candidate_prompt(c: Column, schema: T.StructType) -> Column:
    """A candidate (a struct of `schema`) as compact JSON: null and empty fields left out, long texts cut, at most 14 opening-hour slots."""

    def field(name: str) -> Column:
        kind, value = schema[name].dataType.simpleString(), c[name]
        if kind == "string":
            value = shorten(F.nullif(value, F.lit("")))
        elif kind.startswith("array"):
            value = F.when(F.size(value) > 0, value)
        return value.alias(name)

    slots = F.transform(F.slice(c["opening_hours"], 1, PROMPT_SLOTS), lambda s: F.struct(*[s[k].alias(k) for k in ("day_of_week", "opens_at", "closes_at", "source")]))
    held = F.size(c["opening_hours"]) > 0
    hours = [F.when(held, F.size(c["opening_hours"])).alias("opening_hours_count"), F.when(held, slots).alias("opening_hours")]
    return F.coalesce(F.to_json(F.struct(*[field(name) for name in PROMPT_FIELDS], *hours)), F.lit("{}"))


def user_prompt(pairs: DataFrame) -> Column:
    """The prompt of a queued pair: both candidates and the signals of deduplication, as compact JSON.

    pairs: candidate_a, candidate_b, scores (total, geo, name, category, distance_m) and blocking (geohash) structs.
    """
    a, b = (candidate_prompt(F.col(x), pairs.schema[x].dataType) for x in ("candidate_a", "candidate_b"))
    names = {"score_total": "total", "geo_score": "geo", "name_score": "name", "category_score": "category", "distance_m": "distance_m"}
    signals = F.struct(*[F.col(f"scores.{v}").alias(k) for k, v in names.items()], F.col("blocking.geohash").alias("geohash"))
    return F.concat(F.lit('{"candidate_A":'), a, F.lit(',"candidate_B":'), b, F.lit(',"dedup_signals":'), F.to_json(signals, {"ignoreNullFields": "false"}), F.lit("}"))


def prompt_hash(system: Column, user: Column) -> Column:
    """SHA-256 of both parts with a unit separator between them."""
    return F.sha2(F.concat(system, F.lit("\x1f"), user), 256)


def parse_answer(text: Column) -> DataFrame | Column:
    """Struct of an answer's JSON, fenced or not; null where it is none."""
    return F.from_json(strip_fence(text), DECISION, {"mode": "PERMISSIVE"})


def validate(answers: DataFrame, text: str = "response") -> DataFrame:
    """Add decision, confidence, canonical, sources, reasoning and error (null for a valid answer)."""
    d = answers.withColumn("_d", parse_answer(F.col(text)))
    decision, confidence = F.lower(F.trim("_d.decision")), F.coalesce(F.col("_d.confidence"), F.lit("0")).try_cast("double")
    error = (
        F.when(F.col("_d").isNull() | F.col("_d.decision").isNull() & F.col("_d.confidence").isNull() & F.col("_d.canonical").isNull(), "not_json")
        .when(~F.coalesce(decision.isin("merge", "split", "reject"), F.lit(False)), "decision")
        .when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1), "confidence")
        .when((decision == "merge") & F.col("_d.canonical").isNull(), "canonical")
    )
    reasoning = F.left(F.trim("_d.reasoning"), F.lit(200))
    return d.select(*answers.columns, decision.alias("decision"), confidence.alias("confidence"), F.col("_d.canonical").alias("canonical"), reasoning.alias("reasoning"), error.alias("error"))


def source_bound(sources: Column, a: Column, b: Column) -> Column:
    """True if every field's source is one of the two candidates'; false for no field."""
    allowed = F.array(F.nullif(F.lower(F.coalesce(a, F.lit(""))), F.lit("")), F.nullif(F.lower(F.coalesce(b, F.lit(""))), F.lit("")))
    held = F.map_filter(sources, lambda _, v: v.isNotNull())
    return F.coalesce((F.size(held) > 0) & F.forall(F.map_values(held), lambda v: F.array_contains(F.array_compact(allowed), F.lower(v))), F.lit(False))


def answer_event(params: Params = DEFAULT) -> Column:
    """What an answer (http_status, decision, confidence, error, apply_error) means for its item; null without an answer."""
    return (
        F.when(F.col("http_status").isNull(), None).when(F.col("http_status") != 200, "api_error").when(F.col("error").isNotNull(), "schema_error")
        .when(F.col("confidence") < params.min_confidence, "low_confidence").when(F.coalesce("apply_error", F.lit(False)), "apply_error").otherwise(F.col("decision"))
    )


def transition(queue: DataFrame, answers: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The queue after one round: new status, retry count and the event behind it; items without an answer stay.

    answers: queue_id, http_status, decision, confidence, error and apply_error of the validated answers. Of repeated
    answers to one item the best one counts (a status of 200, then the higher confidence).
    """
    best = F.struct((F.col("http_status") == 200).alias("ok"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), F.coalesce("decision", F.lit("")).alias("decision"))
    fields = ["http_status", "decision", "confidence", "error", "apply_error"]
    once = answers.groupBy("queue_id").agg(F.max_by(F.struct(*fields), best).alias("a")).select("queue_id", *[f"a.{f}" for f in fields])
    d = queue.join(once, "queue_id", "left")
    d = d.withColumn("event", answer_event(params))
    again = F.col("event").isin("api_error", "schema_error", "low_confidence", "apply_error")
    retries = F.col("retry_count") + F.when(again, 1).otherwise(0)
    status = (
        F.when(F.col("event").isNull(), F.col("status")).when(F.col("event") == "apply_error", "retry")
        .when(again, F.when(retries >= params.max_retries, "rejected").otherwise("retry"))
        .when(F.col("event") == "merge", "merged").when(F.col("event") == "split", "approved").otherwise("rejected")
    )
    return d.select("queue_id", status.alias("status"), retries.alias("retry_count"), "event")


def decision_log(moved: DataFrame, answers: DataFrame) -> DataFrame:
    """One log row for every answer, good or bad: what was decided, how sure, and why an item is tried again or given up.

    moved: the queue after transition(). An answer that is an error counts as a rejection with confidence 0.
    """
    d = answers.select("queue_id", "decision", "confidence").join(moved.select("queue_id", "status", "retry_count", "event"), "queue_id")
    broken = F.col("event").isin("api_error", "schema_error")
    failed = F.col("event").isin("api_error", "schema_error", "low_confidence", "apply_error")
    note = F.when(failed, F.concat("event", F.when(F.col("status") == "rejected", "_max_retry").otherwise("_retry"), F.lit(" (retry_count="), F.col("retry_count").cast("string"), F.lit(")")))
    return d.select("queue_id", F.when(broken, "reject").otherwise(F.col("decision")).alias("decision"), F.when(broken, 0.0).otherwise(F.col("confidence")).alias("confidence"), note.alias("note"))


def processor_counters(moved: DataFrame) -> DataFrame:
    """One row of counters over the items that had an answer: applied ones by decision, errors, retries, given up."""
    applied, event = F.col("event").isin("merge", "split", "reject"), F.col("event")
    counts = {
        "processed_ok": applied, "merged": event == "merge", "split": event == "split", "rejected": (event == "reject") | (~applied & (F.col("status") == "rejected")),
        "queued_for_retry": ~applied & (F.col("status") == "retry"), "api_errors": event.isin("api_error", "schema_error"),
    }
    return moved.where("event is not null").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def schedule(batch: DataFrame, commit_every: int = 10, seconds: float = 4.5) -> DataFrame:
    """When each item of a batch is asked, by age: its number, seconds from the start, and the commit it belongs to.

    A batch is bounded (see fifo_batch), so its one window is too.
    """
    number = F.row_number().over(Window.orderBy("created_at", "queue_id"))
    return batch.select("queue_id", number.alias("number")).select("queue_id", "number", ((F.col("number") - 1) * seconds).alias("due_s"), F.ceil(F.col("number") / commit_every).cast("int").alias("commit"))


def histories(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Each item with how often it was asked and its last decision by log number."""
    calls = log.groupBy("queue_id").agg(F.count("*").alias("calls"), F.max_by("decision", "log_id").alias("last_decision"))
    return queue.join(calls, "queue_id", "left").select("queue_id", "status", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"), "last_decision")


# Licence of each source in the attribution of decided places.
LICENCES = {"osm": "ODbL-1.0", "wikidata": "CC0-1.0", "bizizmir": "CC-BY-4.0", "portal": "PublicDomain"}


def clamped(confidence: Column) -> Column:
    """Between 0 and 1, to two decimals."""
    return F.round(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)), 2)


def apply_decisions(decided: DataFrame) -> DataFrame:
    """Places that decided pairs lead to: one for a merge, two for a split, none for a rejection.

    decided: queue_id, decision, confidence, canonical, candidate_a, candidate_b. A merge takes the answer's own names
    and coordinates first, then the candidates' values in their order; lists are united, of opening hours the first slot
    of each day stays. A merge whose sources are not bound to its candidates is aborted: its row carries aborted = true
    and is no place. Candidates without coordinates or without any name give none.
    """
    kind = {f.name: f.dataType.simpleString() for f in decided.schema["candidate_a"].dataType.fields}
    a, b = F.col("candidate_a"), F.col("candidate_b")
    names = ("name_tr", "name_en", "name_de", "name_fr", "name_ar")
    lists, scalars = ("canonical_categories", "raw_categories", "tags"), ("tarihi_yapim_yili", "cover_photo_url", "description_tr", "description_en")
    own = {f.name for f in decided.schema["canonical"].dataType.fields}

    def present(value: Column, name: str) -> Column:
        return F.when(F.trim(value) != "", value) if kind[name] == "string" else value

    def united(name: str) -> Column:
        none = F.expr(f"cast(array() as {kind[name]})")
        return F.array_distinct(F.concat(F.coalesce(a[name], none), F.coalesce(b[name], none)))

    def first_of_days(hours: Column) -> Column:
        return F.filter(hours, lambda s, i: s["day_of_week"].isNotNull() & ~F.exists(F.slice(hours, F.lit(1), i), lambda t: t["day_of_week"] == s["day_of_week"]))

    def credit(*sides: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in LICENCES.items() for x in pair])
        rows = [F.struct(F.lower(F.coalesce(c["source"], F.lit(""))).alias("src"), F.coalesce(c["source_id"], F.lit("")).alias("id")) for c in sides]
        full = F.transform(F.array_distinct(F.array(*rows)), lambda r: F.struct(r["src"].alias("src"), r["id"].alias("id"), F.coalesce(F.element_at(table, r["src"]), F.lit("PublicDomain")).alias("license")))
        return F.filter(full, lambda r: (r["src"] != "") & (r["id"] != ""))

    def place(decision: str, side: str, aborted: Column, value, unite, hours: Column, unesco: Column, credits: Column) -> DataFrame:
        rows = decided.where(F.col("decision") == decision).select(
            "queue_id", F.lit(decision).alias("decision"), F.lit(side).alias("side"), aborted.alias("aborted"), *[value(n).alias(n) for n in (*names, "lat", "lng", *scalars)],
            *[unite(n).alias(n) for n in lists], hours.alias("opening_hours"), F.coalesce(unesco, F.lit(False)).alias("unesco"), credits.alias("kaynak_atif"), clamped(F.col("confidence")).alias("kalite_skoru"),
        )
        return rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.coalesce(*names) != ""))

    def merged(name: str) -> Column:
        sides = [present(a[name], name), present(b[name], name)]
        return F.coalesce(*([present(F.col(f"canonical.{name}"), name)] if name in own else []), *sides)

    bound = source_bound(F.col("canonical.primary_source_per_field"), a["source"], b["source"])
    both_hours = F.concat(F.coalesce(a["opening_hours"], F.expr(NONE)), F.coalesce(b["opening_hours"], F.expr(NONE)))
    out = place("merge", "both", ~bound, merged, united, first_of_days(both_hours), F.coalesce(a["unesco"], F.lit(False)) | F.coalesce(b["unesco"], F.lit(False)), credit(a, b))
    for side, c in (("a", a), ("b", b)):
        out = out.union(place("split", side, F.lit(False), lambda n, c=c: present(c[n], n), lambda n, c=c: c[n], F.coalesce(c["opening_hours"], F.expr(NONE)), c["unesco"], credit(c)))
    kategori = F.when(F.size("canonical_categories") > 0, F.col("canonical_categories")).otherwise(F.col("raw_categories"))
    return out.withColumn("kategori", kategori)


def decision_dashboard(log: DataFrame) -> DataFrame:
    """Answers per decision with counts, mean confidence and error counts."""
    return log.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def confidence_histogram(log: DataFrame, bins: int = 10) -> DataFrame:
    bucket = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return log.where("confidence is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
