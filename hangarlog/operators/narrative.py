"""Text columns built from the profile: a report, an export prompt, an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hangarlog.functions.arrays import top_items
from hangarlog.functions.labels import as_json, fixed, lifecycle_verdict, percent_text
from hangarlog.functions.text import title_case

# --- fixed values: the sentences of the report -------------------------------
SENTENCES = {
    "empty": "No records found for WUC %s.",
    "title": "**WUC %s — %s**",
    "scale": "Based on %s maintenance records across %s airframes%s.",
    "dates": " (%s to %s)",
    "burden": "**Burden.** %s man-hours total, averaging %s h per event against a fleet average of %s h.",
    "expensive": "At %sx the fleet rate, each occurrence is more expensive than a typical maintenance action.",
    "cheap": "At %sx the fleet rate, this is cheap per event — frequent rather than costly.",
    "typical": "At %sx the fleet rate, cost per event is about typical.",
    "direction": "**Direction.** %s — %s records in the earliest full years vs %s in the most recent (%s%%), across %s–%s.",
    "partial": " %s is a partial year and was excluded.",
    "why": "**Why it occurs.** The most frequent discrepancy keywords are: %s.",
    "writeup": 'The single most common write-up is "%s" (%s occurrences, %s of all reports).',
    "fixes": "Typical corrective actions involve: %s.",
    "hot": "**Where.** Genuinely concentrated at: %s. These exceed what their overall maintenance volume predicts.",
    "hot_item": "%s (%s vs %s expected, %sx)",
    "spread": (
        "**Where.** No base stands out — this is fleet-wide. Highest raw counts are %s, but each is close to "
        "what its overall maintenance volume predicts."
    ),
    "spread_item": "%s (%s, %sx expected)",
    "months": "**When (seasonality).** Peak months: %s.",
    "years": "Year-over-year: %s.",
    "lifecycle": "**Airframe lifecycle.** Occurrences are %s. Largest band: %s (%s).",
    "none": "spread evenly across airframe age — no lifecycle signal",
    "high-time": "skewed toward high-time airframes (%s%% vs 25%% expected) — consistent with wear-out",
    "low-time": (
        "skewed toward low-time airframes (%s%% vs 25%% expected) — not wear-out; look at install quality "
        "or inspection scheduling"
    ),
    "mid-life": "concentrated mid-life (%s%% vs 25%% expected)",
    "discovery": "**Discovery phase.** %s.",
    "maintenance": "Maintenance type: %s.",
    "together": "**Often opened alongside.** Other WUCs frequently worked on the same job control number: %s.",
}
HOT_INDEX, HOT_RECORDS = 1.5, 3

INSTRUCTIONS = (
    "Write a short report about one work unit code from the profile below. Start with its size and its hours, "
    "say whether it is costly per event or merely frequent, whether it rises or falls, why, when and where it "
    "happens, and end with two or three actions, each tied to a number. Call a base a hotspot only by its "
    "concentration index. Use only numbers of the profile and claim nothing about downtime.\n\nPROFILE:\n"
)


def _say(name: str, *args: Column) -> Column:
    return F.format_string(SENTENCES[name], *args)


def _listed(items: Column, show, sep: str = ", ") -> Column:
    return F.array_join(F.transform(items, show), sep)


def _filled(items: str | Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def _count(n: Column) -> Column:
    return fixed(n, 0, grouped=True)


def narrative(profile: DataFrame) -> DataFrame:
    """Add ``narrative``, one report per code; parts without data are left out."""
    c = F.col
    labor, way = c("labor"), c("trend")
    index = F.bround(labor["burden_index"], 2)
    burden = F.when(labor["total_hours"].isNotNull(), F.concat_ws(
        " ",
        _say("burden", fixed(F.bround(labor["total_hours"], 1), 0, grouped=True),
             fixed(F.bround(labor["mean_hours"], 2), 1), fixed(F.bround(labor["fleet_mean_hours"], 2), 1)),
        F.when(index >= 1.25, _say("expensive", fixed(index, 2)))
        .when(index <= 0.8, _say("cheap", fixed(index, 2)))
        .when(index.isNotNull(), _say("typical", fixed(index, 2))),
    ))
    direction = F.when(way["direction"].isNotNull(), F.concat(
        _say("direction", title_case(way["direction"]), _count(way["earlier_records"]), _count(way["recent_records"]),
             fixed(F.bround(way["change_pct"], 1), 0, signed=True), way["first_full_year"], way["last_full_year"]),
        F.when(way["excluded_year"].isNotNull(), _say("partial", way["excluded_year"])).otherwise(""),
    ))
    first = F.get("top_phrase", F.lit(0))
    words = lambda column, k: _listed(F.slice(column, 1, k), lambda e: e["item"])
    why = F.when(_filled("top_keyword"), _say("why", words("top_keyword", 6)))
    writeup = F.when(_filled("top_keyword") & _filled("top_phrase"), _say(
        "writeup", F.left(first["item"], F.lit(120)), first["n"], percent_text(first["n"], c("total_records"))
    ))
    fixes = F.when(_filled("top_fix_keyword"), _say("fixes", words("top_fix_keyword", 5)))

    shown = F.transform("concentration", lambda e: F.struct(
        (-F.bround(e["index"], 2)).alias("order"), e["records"].alias("records"), title_case(e["base"]).alias("base"),
        F.bround(e["expected"], 1).alias("expected"), F.bround(e["index"], 2).alias("index"),
    ))
    ranked = F.array_sort(shown)
    hot = F.filter(ranked, lambda e: (e["index"] >= HOT_INDEX) & (e["records"] >= HOT_RECORDS))
    hot_text = _listed(F.slice(hot, 1, 3), lambda e: _say(
        "hot_item", e["base"], e["records"], fixed(e["expected"], 0), fixed(e["index"], 1)), "; ")
    busy_text = _listed(F.slice(shown, 1, 3), lambda e: _say("spread_item", e["base"], e["records"], fixed(e["index"], 1)), "; ")
    where = F.when(_filled("concentration"), F.when(F.size(hot) > 0, _say("hot", hot_text)).otherwise(_say("spread", busy_text)))

    # Ties among months keep calendar order, as they stand in the profile.
    numbered = F.transform("months", lambda e, i: F.struct((-e["n"]).alias("neg"), i.alias("i"), e["item"].alias("item")))
    months = F.when(_filled("months"), _say("months", _listed(
        F.slice(F.array_sort(numbered), 1, 3), lambda e: F.format_string("%s (%s)", e["item"], -e["neg"]))))
    lately = F.slice("years", F.greatest(F.lit(1), F.size("years") - 4), 5)
    years = F.when(_filled("years"), _say("years", _listed(lately, lambda e: F.format_string("%s: %s", e["item"], e["n"]), " -> ")))

    numbered = F.transform("hour_bands", lambda e, i: F.struct(
        (-e["n"]).alias("neg"), i.alias("i"), e["band"].alias("band"), e["label"].alias("label")))
    fullest = F.get(F.array_sort(numbered), F.lit(0))
    in_bands = F.aggregate("hour_bands", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    share = 100.0 * -fullest["neg"] / F.greatest(in_bands, F.lit(1))
    verdict = lifecycle_verdict(fullest["band"], share)
    words_of = F.when(verdict == "none", SENTENCES["none"])
    for name in ("high-time", "low-time", "mid-life"):
        words_of = words_of.when(verdict == name, _say(name, fixed(share, 0)))
    lifecycle = F.when(_filled("hour_bands"), _say("lifecycle", words_of, fullest["label"], -fullest["neg"]))

    discovery = F.when(_filled("discovered"), _say("discovery", _listed(
        top_items("discovered", 2),
        lambda e: F.format_string("%s (%s, %s)", e["item"], e["n"], percent_text(e["n"], c("total_records"))), "; ")))
    maintenance = F.when(_filled("maint_type"), _say("maintenance", _listed(
        top_items("maint_type", 2), lambda e: F.format_string("%s (%s)", e["item"], e["n"]), "; ")))
    together = F.when(_filled("cooccurring"), _say("together", _listed(
        top_items("cooccurring", 5), lambda e: F.format_string("%s (%s)", e["item"], e["n"]))))

    dates = F.when(c("first_date").isNotNull(), _say("dates", c("first_date").cast("string"), c("last_date").cast("string")))
    gap = F.lit("")
    after = lambda part: F.when(part.isNotNull(), gap)
    report = F.concat_ws(
        "\n",
        _say("title", c("code"), c("description")),
        _say("scale", _count(c("total_records")), c("affected_assets"), F.coalesce(dates, gap)), gap,
        burden, after(burden), direction, after(direction), why, writeup, fixes, gap, where, after(where),
        months, years, gap, lifecycle, discovery, maintenance, gap, together,
    )
    return profile.withColumn("narrative", F.when(c("total_records") == 0, _say("empty", c("code"))).otherwise(report))


def prompt(profile: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """Add ``prompt``: instructions followed by the profile as JSON. No model is called."""
    body = as_json(F.struct(*[F.col(x) for x in profile.columns]))
    return profile.withColumn("prompt", F.concat(F.lit(instructions), body))


def answer_text(total: DataFrame, discrepancies: DataFrame, fixes: DataFrame, top: int = 5) -> DataFrame:
    """One row of plain text from a count and two top-n tables (item, n)."""
    def listing(df: DataFrame, title: str) -> Column:
        order = F.struct((-F.col("n")).alias("neg"), F.col("item"))
        lines = df.orderBy(F.desc("n"), F.asc("item")).limit(top).agg(F.sort_array(F.collect_list(order)).alias("l")).select(
            F.when(F.size("l") > 0, F.concat(F.lit(title), F.array_join(
                F.transform("l", lambda e: F.format_string("\n- %s (%s)", e["item"], -e["neg"])), ""), F.lit("\n")))
        )
        return lines.scalar()

    found = F.concat_ws(
        "\n", F.concat(F.lit("Total issues: "), _count(F.col("total")), F.lit("\n")),
        listing(discrepancies, "Top discrepancies:"), listing(fixes, "Top fixes:"),
    )
    return total.select(F.when(F.col("total") == 0, "No matching records found.").otherwise(found).alias("answer"))


def code_list_text(breakdown: DataFrame, top: int = 10) -> DataFrame:
    """Numbered list of the first labelled codes of a table (label, n), however long it is."""
    order = F.struct((-F.col("n")).alias("neg"), F.col("label"))
    rows = breakdown.orderBy(F.desc("n"), F.asc("label")).limit(top).agg(F.sort_array(F.collect_list(order)).alias("l"))
    lines = F.transform("l", lambda e, i: F.format_string("%s. %s %s", i + 1, F.rpad(e["label"], F.greatest(F.lit(60), F.length(e["label"])), F.lit(" ")), -e["neg"]))
    return rows.select(F.when(F.size("l") > 0, F.concat(
        F.lit("Top Problem Areas (WUC):\n"), F.array_join(lines, "\n"), F.lit("\n"))).alias("listing"))
