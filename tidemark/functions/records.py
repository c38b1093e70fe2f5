"""Legislative records: stages from status texts, dates, links and contents. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import contains_any


def _has(text: Column, *words: str) -> Column:
    return contains_any(text, list(words))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def us_bill_stage(status: Column, action: Column) -> Column:
    text = F.concat_ws(" ", F.nullif(_text(status), F.lit("")), F.nullif(_text(action), F.lit("")))
    return F.when(_has(text, "signed", "enacted", "chaptered"), "enacted").when(_has(text, "committee"), "in_committee").when(_has(text, "passed"), "passed").otherwise("proposed")


def german_stage(status: Column) -> Column:
    return F.when(_has(status, "verkündet", "abgeschlossen"), "enacted").when(_has(status, "ausschuss"), "in_committee").otherwise("proposed")


def westminster_stage(stage: Column) -> Column:
    """Canada and the UK; these look at the case of letters."""
    return F.when(_text(stage).contains("Royal Assent"), "enacted").when(_text(stage).contains("Committee"), "in_committee").otherwise("proposed")


def irish_stage(status: Column, stage: Column) -> Column:
    return F.when(F.lower(_text(status)) == "enacted", "enacted").when(_has(stage, "committee"), "in_committee").otherwise("proposed")


def brazilian_stage(situation: Column) -> Column:
    return F.when((_text(situation) == "") | _has(situation, "arquivad") & ~_has(situation, "transformado em", "transformada em"), F.lit(None)).when(_has(situation, "transformado em", "transformada em"), "enacted").otherwise("proposed")


def swedish_stage(doc_type: Column) -> Column:
    return F.when(doc_type.isin("mot", "prop"), "proposed").when(doc_type == "sfs", "enacted").when(doc_type == "bet", "in_committee")


def gov_uk_stage(fmt: Column) -> Column:
    return F.when(fmt.isin("open_consultation", "open_call_for_evidence"), "consultation").otherwise("proposed")


def new_zealand_stage(kind: Column, status: Column) -> Column:
    bill = F.when(status == "current", "proposed").when(status == "enacted", "enacted")
    return F.when(kind == "bill", bill).when(status == "in_force", "enacted")


def polish_stage(closure_date: Column, passed: Column) -> Column:
    return F.when(_text(closure_date) == "", "proposed").when(F.coalesce(passed, F.lit(False)), "passed")


def unless_closed(closed: Column) -> Column:
    """Norway and the Netherlands: proposed, nothing claimed once the case is closed."""
    return F.when(~F.coalesce(closed, F.lit(False)), "proposed")


#: SR-02: source -> function of (status, stage, flag) to the stage claimed, null if none.
STAGES = {
    "us": lambda a, b, f: us_bill_stage(a, b),
    "us_federal": lambda a, b, f: F.lit("proposed"),
    "de": lambda a, b, f: german_stage(a),
    "ca": lambda a, b, f: westminster_stage(b),
    "uk": lambda a, b, f: westminster_stage(b),
    "ie": lambda a, b, f: irish_stage(a, b),
    "br": lambda a, b, f: brazilian_stage(a),
    "se": lambda a, b, f: swedish_stage(a),
    "gov_uk": lambda a, b, f: gov_uk_stage(a),
    "nz": lambda a, b, f: new_zealand_stage(a, b),
    "pl": lambda a, b, f: polish_stage(b, f),
    "no": lambda a, b, f: unless_closed(f),
    "nl": lambda a, b, f: unless_closed(f),
    "dk": lambda a, b, f: F.lit("proposed"),
    "at": lambda a, b, f: F.lit("enacted"),
    "eu": lambda a, b, f: F.lit("transposition_notified"),
    "ee": lambda a, b, f: F.lit(None),
    "gr": lambda a, b, f: F.lit(None),
    "jp": lambda a, b, f: F.lit(None),
}


def lifecycle_stage(source: Column, status: Column, stage: Column, flag: Column) -> Column:
    """SR-02: the stage by the source's own rules."""
    return F.coalesce(*(F.when(source == name, rule(status, stage, flag).cast("string")) for name, rule in STAGES.items()))


def window_stage(kind: Column, deadline: Column, now: Column) -> Column:
    """SR-03: kinds comment_days and comment_time are a consultation until the deadline (its day included for the
    first), else nothing claimed and proposed; kind enforcement is passed until the date, else enacted."""
    day, time, today = F.try_to_date(F.substring(deadline, 1, 10)), F.try_to_timestamp(deadline), F.to_date(now)
    open_day, open_time, later = (F.coalesce(x, F.lit(False)) for x in (day >= today, time > now, day > today))
    return (
        F.when(kind == "comment_days", F.when(open_day, "consultation"))
        .when(kind == "comment_time", F.when(open_time, "consultation").otherwise("proposed"))
        .when(kind == "enforcement", F.when(later, "passed").otherwise("enacted"))
    )


def feedback_window(statuses: Column) -> Column:
    """SR-04: struct(is_open, start, end) over an array of (state, start, end): open ones overwrite with what they
    give, a closed one counts while nothing is known."""
    begin = F.struct(F.lit(False).alias("is_open"), F.lit("").alias("start"), F.lit("").alias("end"))

    def step(a: Column, x: Column) -> Column:
        opened = F.coalesce(x["state"] == "OPEN", F.lit(False))
        given = lambda new, old: F.when(_text(new) != "", new).otherwise(old)
        blank = (a["start"] == "") & (a["end"] == "")
        return F.struct(
            (a["is_open"] | opened).alias("is_open"),
            F.when(opened, given(x["start"], a["start"])).when(blank, _text(x["start"])).otherwise(a["start"]).alias("start"),
            F.when(opened, given(x["end"], a["end"])).when(blank, _text(x["end"])).otherwise(a["end"]).alias("end"),
        )

    return F.aggregate(F.filter(F.coalesce(statuses, F.array().cast("array<struct<state:string,start:string,end:string>>")), lambda x: x.isNotNull()), begin, step)


def feedback_stage(window: Column) -> Column:
    """SR-04: the stage of an initiative with such a window."""
    return F.when(window["is_open"], "consultation").otherwise("proposed")


def open_initiatives(df: DataFrame, statuses: str = "statuses", open_only: bool = True) -> DataFrame:
    """SR-04: initiatives with `window` and `lifecycle_stage`; with `open_only` those alone whose feedback is open."""
    out = df.withColumn("window", feedback_window(F.col(statuses))).withColumn("lifecycle_stage", feedback_stage(F.col("window")))
    return out.filter("window.is_open") if open_only else out


def parse_wcf_date(text: Column) -> Column:
    """SR-05: /Date(ms+hhmm)/ as a date there; '' if it can't be read."""
    p = r"/Date\((-?\d+)([+-]\d{4})?\)/"
    t = _text(text)
    ms, offset = F.regexp_extract(t, p, 1).try_cast("long"), F.regexp_extract(t, p, 2)
    minutes = F.when(offset == "", 0).otherwise((F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1))
    return epoch_ms_date(ms + minutes * 60000)


def epoch_ms_date(ms: Column) -> Column:
    """SR-05: milliseconds since 1970 as a date in UTC; '' for null and years beyond 1 to 9999."""
    ok = ms.between(-62135596800000, 253402300799999)
    return F.coalesce(F.when(ok, F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd")), F.lit(""))


def best_format_url(formats: Column) -> Column:
    """SR-06: of an array of (type, url), the last html, else pdf, else xml link; else ''."""
    last = lambda kind: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(formats, lambda x: (x["type"] == kind) & (_text(x["url"]) != "")), lambda x: x["url"])), -1)
    return F.coalesce(last("html"), last("pdf"), last("xml"), F.lit(""))


def public_pdf_url(files: Column) -> Column:
    """SR-06: of an array of (extension, access, url), the first public PDF that has a link; else ''."""
    ok = F.filter(files, lambda x: (F.lower(_text(x["extension"])) == "pdf") & (x["access"] == "PUBLIC") & (_text(x["url"]) != ""))
    return F.coalesce(F.get(ok, F.lit(0))["url"], F.lit(""))


def assemble_content(parts: Column, fetched: Column, least: int = 200) -> Column:
    """SR-07: the fetched text, or the joined metadata where that is longer and the fetched text is short."""
    meta = F.array_join(F.filter(parts, lambda x: F.trim(_text(x)) != ""), "\n\n")
    text = _text(fetched)
    return F.when((F.length(text) < least) & (F.length(meta) > F.length(text)), meta).otherwise(text)


def plain_id(raw: Column) -> Column:
    """SR-10: ids that came as floats, as whole numbers; null if they aren't numbers."""
    return F.floor(raw.try_cast("double")).cast("long").cast("string")


def citation_url(parliament: Column, session: Column, number: Column, fallback: str) -> Column:
    """SR-10: the bill's page, or the fallback where a part is missing."""
    full = F.concat_ws("", F.lit("https://www.parl.ca/legisinfo/en/bill/"), parliament.cast("string"), F.lit("-"), session.cast("string"), F.lit("/"), F.lower(number))
    whole = (_text(parliament.cast("string")) != "") & (_text(session.cast("string")) != "") & (_text(number) != "")
    return F.when(whole, full).otherwise(fallback)
