"""All reports of a range from one aggregate: events are read once, and grouping sets over what they add up to do the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import columns as C
from tallyspark.operators import activity, reports
from tallyspark.sources.scratch import written

#: The sections of a cube and what each groups by.
SECTIONS = {"total": [], "source": ["source"], "model": ["model"], "project": ["project_path", "project_name"], "session": ["source", "session_key"]}
KEYS = ["source", "model", "project_path", "project_name", "session_key"]


def usage(events: DataFrame) -> DataFrame:
    """Priced events added up by what any report tells apart: tool, session or hour, project, model and quality.

    active_us is the time of each tool's own streams, active_all_us that of
    streams whatever the tool; the smallest event_id stands for a row's order.
    """
    timed = activity.spans(events, "stream_id").withColumnRenamed("active_us", "active_all_us")
    timed = activity.spans(timed.withColumn("_s", F.concat_ws("|", "source", "stream_id")), "_s")
    hour = F.when(F.col("session_id").isNull(), C.hour_floor("ts"))
    keys = ["source", "session_id", hour.alias("hour"), "project_path", "project_name", "quality", "model", "price_known", (F.col("total_tokens") > 0).alias("live")]
    sums = [F.sum(c).alias(c) for c in (*reports.SUMS, "active_us", "active_all_us")]
    return timed.groupBy(*keys).agg(*sums, F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min("event_id").alias("event_id"))


def cube(added: DataFrame) -> DataFrame:
    """A row for each group of each section, of usage(): sums, times, span, quality, sources, models and sessions.

    added should be written, as best attributions are joined to it.  In a
    session's row project and session are those of its best-ranked event.
    Rows without tokens count for the time of totals and sources and for the
    sources of models alone.
    """
    best = reports.best_attribution(added.where("live"))
    known = F.col("best_quality").isNotNull()
    rows = added.join(best, ["source", "session_id"], "left")
    rows = rows.withColumns({"project_path": F.when(known, F.col("best_path")).otherwise(F.col("project_path")), "project_name": F.coalesce(F.when(known, F.col("best_name")).otherwise(F.col("project_name")), F.lit(C.UNKNOWN_PROJECT))})
    rows = rows.withColumn("session_key", C.session_key("session_id", "project_path", "first_at"))
    live = lambda c: F.when(F.col("live"), c)
    meta = F.struct(C.metadata_rank("quality", "project_path", "project_name").alias("rank"), (-F.col("event_id")).alias("at"), F.col("project_path").alias("path"), F.col("project_name").alias("name"), F.col("session_id").alias("id"))
    rows = rows.withColumns({
        "_source": F.col("source"), "_live_source": live(F.col("source")), "_model": live(F.col("model")), "_session": live(F.concat_ws("|", "source", "session_key")), "_first": live(F.col("first_at")),
        "_last": live(F.col("last_at")), "_rank": live(C.quality_rank("quality")), "_meta": live(meta), "_n": F.col("live").cast("int"),
    })
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    grouped = rows.groupingSets([[F.col(c) for c in keys] for keys in SECTIONS.values()], *(F.col(c) for c in KEYS))
    told = grouped.agg(
        F.when(F.grouping("session_key") == 0, "session").when(F.grouping("project_name") == 0, "project").when(F.grouping("model") == 0, "model").when(F.grouping("source") == 0, "source").otherwise("total").alias("section"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*reports.SUMS, "active_us", "active_all_us", "_n")), F.min("_first").alias("first_at"), F.max("_last").alias("last_at"), F.max("_rank").alias("_rank"),
        listed("_source").alias("_all"), listed("_live_source").alias("_live"), listed("_model").alias("models"), F.countDistinct("_session").alias("sessions"), F.max("price_known").alias("price_known"), F.max("_meta").alias("_meta"),
    )
    is_ = lambda *names: F.col("section").isin(*names)
    wanted = F.when(is_("model"), F.col("model").isNotNull()).when(is_("project", "session"), F.col("_n") > 0).otherwise(True)
    return told.where(wanted).select(
        "section", "source", "model", "session_key",
        F.when(is_("session"), F.col("_meta.path")).otherwise(F.col("project_path")).alias("project_path"),
        F.when(is_("session"), F.col("_meta.name")).otherwise(F.col("project_name")).alias("project_name"),
        F.when(is_("session"), F.col("_meta.id")).alias("session_id"),
        *reports.SUMS,
        F.when(is_("total"), F.col("active_all_us")).otherwise(F.col("active_us")).alias("active_us"),
        "first_at", "last_at", reports.quality_name(F.col("_rank")).alias("quality"), F.when(is_("model"), F.col("_all")).otherwise(F.col("_live")).alias("sources"), "models", "sessions", "price_known",
    )


def build(events: DataFrame) -> DataFrame:
    """The cube of priced events as a written table, in two passes over written aggregates and one over the events."""
    return written(cube(written(usage(events))))


def section(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.col("section") == name)


def breakdown(found: DataFrame, shown: int = 4) -> DataFrame:
    """(title, total_tokens, cost_nano, projects, sessions): the dearest attributed projects, the others, and what is untracked.

    One pass adds up all sections, one takes the dearest; the few rows of
    both meet in one.
    """
    measures = ("total_tokens", "cost_nano", "sessions")
    is_ = lambda name: F.col("section") == name
    known, dark = is_("project") & (F.col("quality") != "unknown"), is_("project") & (F.col("quality") == "unknown")
    add = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    whole = found.agg(
        F.struct(*(add(is_("total"), c).alias(c) for c in measures)).alias("all"),
        F.struct(*(add(known, c).alias(c) for c in measures), F.count(F.when(known, 1)).alias("n")).alias("known"),
        F.struct(add(dark, "sessions").alias("sessions"), F.count(F.when(dark, 1)).alias("n")).alias("dark"),
    )
    kinds = {f.name: f.dataType for f in found.schema.fields}
    row = lambda title, tokens, cost, projects, sessions: F.struct(title.alias("title"), tokens.cast(kinds["total_tokens"]).alias("total_tokens"), cost.cast(kinds["cost_nano"]).alias("cost_nano"), projects.cast("long").alias("projects"), sessions.cast("long").alias("sessions"))
    top = reports.ordered(found.where(known), "projects", shown).select(row(F.col("project_name"), F.col("total_tokens"), F.col("cost_nano"), F.lit(1), F.col("sessions")).alias("one"))
    met = whole.unionByName(top, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("all", "known", "dark")), F.collect_list("one").alias("top"))  # at most shown + 1 rows
    seen = lambda c: F.aggregate("top", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x[c]).cast("decimal(38,0)"))
    others = row(F.lit("Other Projects"), *(F.col(f"known.{c}") - seen(c) for c in measures[:2]), F.col("known.n") - F.size("top"), F.col("known.sessions") - seen("sessions"))
    left = lambda c: F.greatest(F.col(f"all.{c}") - F.col(f"known.{c}"), F.lit(0))
    untracked = row(F.lit("Untracked Usage"), left("total_tokens"), left("cost_nano"), F.col("dark.n"), F.col("dark.sessions"))
    rest = F.filter(F.array(others, untracked), lambda x: (x["total_tokens"] > 0) | (x["cost_nano"] > 0))
    return met.select(F.explode(F.concat("top", rest)).alias("x")).select("x.*")


def attributed_cost(found: DataFrame) -> DataFrame:
    """(attributed_nano, cost_nano, attributed_sessions), in one pass."""
    project, known = F.col("section") == "project", F.col("quality") != "unknown"
    cost = lambda when: F.coalesce(F.sum(F.when(when, F.col("cost_nano"))), F.lit(0))
    return found.agg(cost(project & known).alias("attributed_nano"), cost(project).alias("cost_nano"), F.count(F.when((F.col("section") == "session") & known, 1)).alias("attributed_sessions"))


def sessions(found: DataFrame) -> DataFrame:
    return section(found, "session").withColumn("label", C.session_label(F.lit(None).cast("string"), "session_id", "first_at"))


def top_picks(found: DataFrame) -> DataFrame:
    return reports.top_picks(section(found, "project"), sessions(found))
