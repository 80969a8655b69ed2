"""Reference normalisation: raw reference ids to ACT:Type:Id, by ordered rules.

The rules read a reference, the snippet around it and its source; a registry of the
provisions that exist (act, local_id, type) settles two questions, as two left joins:
whether an id without a hyphen belongs to the default act, and whether the type is right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that name an act, in the order in which they are tried.
ACT_PHRASES = {
    "Taxation Administration Act 1953": "TAA1953",
    "TAA 1953": "TAA1953",
    "Income Tax Assessment Act 1936": "ITAA1936",
    "ITAA 1936": "ITAA1936",
    "GST Act": "GSTA1999",
    "A New Tax System (Goods and Services Tax) Act 1999": "GSTA1999",
    "Income Tax (Transitional Provisions) Act 1997": "ITTPA1997",
    "Fringe Benefits Tax Assessment Act 1986": "FBTAA1986",
    "Income Tax Rates Act 1986": "ITRA1986",
    "Venture Capital Act 2002": "VCA2002",
    "Wine Tax Act": "WETA1999",
    "Luxury Car Tax Act": "LCTA1999",
    "Constitution": "Constitution",
}
GENERIC_IDS = ["", "act", "n_a", "general", "na", "unknown", "u", "s", "t", "p", "d", "n", "i", "ii", "v", "x"]
OLD_ACT_SCHEDULES = ["2D", "2F", "2G", "2H"]
ROLLED_UP = "subsection|paragraph|subparagraph|table|item|cgtevent"
# The first match counts, so the capital of "Division" is read as a Roman numeral.
ID = r"([0-9]+[A-Z]*-[0-9A-Z]+|[0-9]+[A-Z]*|[IVXLCDM]+)"


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _act(head: Column, known: Column, snippet: Column, default_act: str) -> Column:
    upper = F.upper(snippet)
    act = F.when(F.lit(False), F.lit(None).cast("string"))
    for phrase, name in ACT_PHRASES.items():
        act = act.when(F.contains(upper, F.lit(phrase.upper())), name)
    act = act.when(F.contains(snippet, F.lit("1936")) & ~F.contains(snippet, F.lit("1997")), "ITAA1936")
    act = act.when(F.contains(upper, F.lit("TAXATION ADMINISTRATION ACT")), "TAA1953")
    act = act.when(F.contains(upper, F.lit("TRANSITIONAL PROVISIONS) ACT 1997")), "ITTPA1997")
    return act.otherwise(F.when(known, head).otherwise(F.lit(default_act)))


def _within_schedule(act: Column, schedule: Column, rest: Column) -> Column:
    """A provision of a schedule, or the schedule itself where no id follows."""
    low = F.lower(rest)
    kind = F.when(low.contains("subdivision"), "Subdivision").when(low.contains("division"), "Division").otherwise("Section")
    own = _first(rest, ID)
    whole = F.concat_ws(":", act, F.lit("Schedule"), schedule)
    return F.when(own.isNull(), whole).otherwise(F.concat_ws(":", whole, kind, own))


def normalised(refs: DataFrame, registry: DataFrame, default_act: str) -> DataFrame:
    """`refs` (raw, snippet, source_ref_id and others) with ``ref_id`` and ``corrected`` (the
    registry overruled the type)."""
    names = list(ACT_PHRASES.values())
    clean = F.replace(F.trim("raw"), F.lit("/"), F.lit("_"))
    head = F.split(clean, ":")[0]
    known = F.contains(clean, F.lit(":")) & (head.startswith("ITAA") | (head == "Constitution") | head.isin(names))
    snippet = F.coalesce("snippet", F.lit(""))
    parsed = refs.withColumns({"_clean": clean, "_id": F.when(known, F.regexp_replace(clean, "^[^:]*:", "")).otherwise(clean), "_act": _act(head, known, snippet, default_act)})
    own, act = F.col("_id"), F.col("_act")
    low = F.lower(own)
    schedule = F.upper(_first(own, "(?i)Schedule[_:]([0-9A-Z]+)"))
    old = schedule.isin(OLD_ACT_SCHEDULES)
    part = _first(own, r"(?i)Part[_:]([IVXLCDM]+|[0-9A-Z\-]+)")
    inner = F.when(low.contains("subdivision"), "Subdivision").when(low.contains("division"), "Division")
    inner_id = F.when(low.contains("subdivision"), _first(own, r"(?i)Subdivision[_:]([0-9A-Z\-]+)")).otherwise(_first(own, r"(?i)Division[_:]([0-9A-Z\-]+)"))
    first_schedule = (act == "TAA1953") & (own.contains("Schedule_1") | own.contains("Schedule:1"))
    early = (
        F.when(low.isin(GENERIC_IDS), F.when(F.upper("_clean").isin(names), F.concat(act, F.lit(":Act:General"))))
        .when(F.col("source_ref_id").isNotNull() & (own.rlike(r"(?i)^(Subsection|Paragraph|Subparagraph)[:_][0-9A-Za-z()]+$") | low.isin("this_section", "this_division")), F.col("source_ref_id"))
        .when(first_schedule, _within_schedule(act, F.lit("1"), F.regexp_extract(own, "(?i)^.*Schedule[_:]1(.*)$", 1)))
        .when(schedule.isNotNull(), _within_schedule(F.when(old, "ITAA1936").otherwise(act), schedule, F.regexp_extract(own, "(?i)^.*?Schedule[_:][0-9A-Z]+(.*)$", 1)))
        .when(low.contains("part") & part.isNotNull() & inner_id.isNotNull(), F.concat_ws(":", act, F.lit("Part"), part, inner, inner_id))
    )
    settled = low.isin(GENERIC_IDS) | early.isNotNull()
    found = _first(own, ID)
    staged = parsed.withColumns({"_early": early, "_settled": settled, "_found": found})

    # an id such as 102AG without a hyphen is the older act's, unless the default act has it
    here = registry.where(F.col("act") == default_act).select(F.col("local_id").alias("_found"), F.lit(True).alias("_here")).distinct()
    staged = staged.join(here, "_found", "left")
    older = (act == default_act) & F.col("_found").rlike("^[0-9]+[A-Z]+$") & F.col("_here").isNull()
    staged = staged.withColumn("_act", F.when(older & ~F.col("_settled"), "ITAA1936").otherwise(act))

    term = F.regexp_replace(F.trim(F.regexp_extract(own, "(?i)definition[:_](.+)$", 1)), r"[^\w\-]+", "_")
    defined = low.contains("definition") & (term != "")
    kind = (
        F.when(defined, "Definition")
        .when(F.col("_found").isNull(), F.lit(None))
        .when(low.rlike(ROLLED_UP), "Section")
        .when(low.contains("subdivision"), "Subdivision")
        .when(low.contains("division"), F.when((F.col("_act") == "ITAA1997") & F.col("_found").rlike("^[0-9]+-[A-Z]$"), "Subdivision").otherwise("Division"))
        .when(low.contains("section"), "Section")
        .when(low.contains("part"), "Part")
        .otherwise("Section")
    )
    typed = staged.withColumns({"_kind": kind, "_local": F.when(defined, term).otherwise(F.upper("_found"))})
    right = registry.groupBy(F.col("act").alias("_ract"), F.col("local_id").alias("_rlocal")).agg(F.min("type").alias("_right"))
    joined = typed.join(right, (F.col("_act") == F.col("_ract")) & (F.col("_local") == F.col("_rlocal")), "left")
    other = F.concat_ws(":", "_act", F.lit("Reference"), F.regexp_replace(own, "[^A-Za-z0-9_:]+", "_"))
    plain = F.when(F.col("_kind").isNull(), other).otherwise(F.concat_ws(":", "_act", F.coalesce("_right", "_kind"), "_local"))
    corrected = ~F.col("_settled") & F.col("_right").isNotNull() & (F.col("_right") != F.col("_kind"))
    missing = F.col("raw").isNull() | (F.col("raw") == "")
    ref = F.when(missing, F.lit(None)).when(F.col("_settled"), F.col("_early")).otherwise(plain)
    return joined.select(*refs.columns, ref.alias("ref_id"), F.coalesce(corrected & ~missing, F.lit(False)).alias("corrected"))
