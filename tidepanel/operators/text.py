"""Event evidence from text columns: captures, feeds, excerpts, places and field validation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions import scalars
from tidepanel.operators import guards

# Russian month names, genitive as in dates and nominative as in monthly titles.
MONTHS_GENITIVE = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
MONTHS_NOMINATIVE = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")
# Month abbreviations of feed dates.
MONTHS_FEED = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _number(text: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), text)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers as text; impossible dates are NULL."""
    joined = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (day != "") & (month > 0), F.try_to_date(joined, "yyyy-MM-dd"))


def written_date(text) -> Column:
    """First «d month yyyy» in the text."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = rf"(\d{{1,2}}) ({'|'.join(MONTHS_GENITIVE)}) (\d{{4}})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return _date(part(3), _number(part(2), MONTHS_GENITIVE), part(1))


def title_date(title) -> Column:
    """Target of a title: «на dd.mm.yyyy», «на d month yyyy» or «на month месяц yyyy» (its first day)."""
    title = F.col(title) if isinstance(title, str) else title
    dotted = r"на (\d{1,2})\.(\d{1,2})\.(\d{4})"
    numeric = _date(F.regexp_extract(title, dotted, 3), F.expr("0") + F.coalesce(F.regexp_extract(title, dotted, 2).try_cast("int"), F.lit(0)), F.regexp_extract(title, dotted, 1))
    named = F.when(title.rlike(rf"на \d{{1,2}} (?:{'|'.join(MONTHS_GENITIVE)}) \d{{4}}"), written_date(title))
    monthly = rf"на ({'|'.join(MONTHS_NOMINATIVE)}) месяц (\d{{4}})"
    first = _date(F.regexp_extract(title, monthly, 2), _number(F.regexp_extract(title, monthly, 1), MONTHS_NOMINATIVE), F.lit("1"))
    return F.coalesce(numeric, named, first)


def title_precision(title) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    monthly = title.rlike(rf"на (?:{'|'.join(MONTHS_NOMINATIVE)}) месяц \d{{4}}")
    return F.when(title_date(title).isNull(), F.lit(None).cast("string")).when(monthly, "month").otherwise("day")


def monthly_early(published, target) -> Column:
    """Published before the target's month begins; unknown when the target is."""
    published, target = (F.col(c) if isinstance(c, str) else c for c in (published, target))
    return published < F.trunc(target, "month")


def parse_captures(captures: DataFrame, host_pattern: str, first: str, last: str) -> DataFrame:
    """(…, title, url, published, available_from, target_date, precision, exclusion) from captured pages.

    The publication date stands in the header, between the address line and the first heading; a date in
    the body does not count. Availability is the day after publication.
    """
    text = F.col("text")
    head = F.regexp_extract(text, r"^([^\n]*) \((https?://[^)\s]+)\)", 0)
    title = F.regexp_extract(text, r"^([^\n]*) \((https?://[^)\s]+)\)", 1)
    url = F.regexp_extract(text, r"^([^\n]*) \((https?://[^)\s]+)\)", 2)
    header = F.substring_index(text, "\n# ", 1)
    published = written_date(F.substring(header, F.length(head) + 1, F.length(header)))
    out = captures.withColumn("title", title).withColumn("url", url).withColumn("published", published)
    allowed = scalars.host_allowed("url", host_pattern)
    inside = F.col("published").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    reason = F.when(F.col("url") == "", "no_address").when(~allowed, "host_not_allowed").when(F.col("published").isNull(), "no_header_date").when(~inside, "publication_outside_history")
    return out.withColumn("exclusion", reason).withColumn("available_from", F.date_add("published", 1)).withColumn("target_date", title_date("title")).withColumn("precision", title_precision("title"))


def feed_items(feeds: DataFrame, first: str, last: str) -> DataFrame:
    """Items of RSS texts on the feed's own host and inside the date range, one row per link."""
    items = feeds.select("feed_url", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("item"))
    tag = lambda name: F.regexp_extract("item", rf"(?s)<{name}>(.*?)</{name}>", 1)
    stamp = r"(\d{1,2}) (\w{3}) (\d{4})"
    date = _date(F.regexp_extract(tag("pubDate"), stamp, 3), _number(F.regexp_extract(tag("pubDate"), stamp, 2), MONTHS_FEED), F.regexp_extract(tag("pubDate"), stamp, 1))
    rows = items.select("feed_url", tag("title").alias("title"), tag("link").alias("link"), date.alias("published"))
    rows = rows.filter(F.col("published").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (scalars.url_host("link") == scalars.url_host("feed_url")))
    return rows.groupBy("link").agg(F.min("published").alias("published"), F.min("title").alias("title"))


def article_excerpt(text, published, source_mark: str, footer: str) -> Column:
    """Text after the line with the publication date up to the footer; NULL for another date or source."""
    text, published = (F.col(c) if isinstance(c, str) else c for c in (text, published))
    line = F.concat_ws(" ", F.dayofmonth(published).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS_GENITIVE]), F.month(published)), F.year(published).cast("string"))
    at = F.instr(text, line)
    after = F.substring(text, at + F.length(line), F.length(text))
    body = F.substring(after, F.instr(after, F.lit("\n")) + 1, F.length(after))
    return F.when(text.contains(source_mark) & (at > 0), F.substring_index(body, footer, 1))


def page_reliable(source, text, published, source_mark: str, minimum: int) -> Column:
    """Right source type, the publication date written in the text, and enough text."""
    source, text, published = (F.col(c) if isinstance(c, str) else c for c in (source, text, published))
    return source.contains(source_mark) & F.coalesce(written_date(text) == published, F.lit(False)) & (F.length(text) >= minimum)


def resolve_place(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """Exact (name, region, year) → id when it is the only one; otherwise abstain with the reason."""
    counted = places.groupBy("name", "region", "year").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    out = mentions.join(counted, ["name", "region", "year"], "left")
    reason = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "ambiguous_exact").otherwise("exact")
    return out.withColumn("status", reason).withColumn("id", F.when(F.col("_n") == 1, F.col("_id"))).drop("_n", "_id")


def quoted_place(quotes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Place named by a token of the quote; an alias of several places, or several places, abstains.

    ``aliases`` is (alias, id). It collapses to one row per token, so a frequent token never multiplies rows.
    """
    per = aliases.groupBy("alias").agg(F.count_distinct("id").alias("_places"), F.min("id").alias("_id"))
    tokens = quotes.select("quote_id", F.explode(F.array_distinct(F.split(F.lower("quote"), " "))).alias("alias"))
    hits = tokens.join(per, "alias").groupBy("quote_id").agg(
        F.max("_places").alias("_worst"), F.count_distinct(F.when(F.col("_places") == 1, F.col("_id"))).alias("_ids"), F.min(F.when(F.col("_places") == 1, F.col("_id"))).alias("_id"))
    out = quotes.select("quote_id").join(hits, "quote_id", "left")
    status = F.when(F.col("_worst").isNull(), "no_alias").when((F.col("_worst") > 1) | (F.col("_ids") > 1), "ambiguous_quote").otherwise("quoted")
    return out.withColumn("status", status).withColumn("id", F.when(F.col("status") == "quoted", F.col("_id"))).select("quote_id", "status", "id")


def validate_event_rows(rows: DataFrame) -> DataFrame:
    """Adds ``errors`` and cleans the confidence. The quote must occur in the whole text, the event must not
    follow its publication, and availability must be the day after publication."""
    problem = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    confidence = F.col("confidence").try_cast("double")
    errors = F.array_compact(F.array(
        problem(F.instr(F.col("text"), F.col("quote")) == 0, "unsupported_quote"), problem(F.col("event_date") > F.col("published"), "future_event_date"),
        problem(F.col("available_from") != F.date_add("published", 1), "availability_mismatch")))
    return rows.withColumn("errors", errors).withColumn("confidence", F.when(confidence.between(0.0, 1.0), confidence))


def batch_problems(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs missing from the outputs, repeated outputs, outputs without an input."""
    missing = inputs.join(outputs, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    repeated = guards.duplicates(outputs, [key]).select(key, F.lit("repeated").alias("problem"))
    foreign = outputs.join(inputs, key, "left_anti").select(key, F.lit("foreign").alias("problem"))
    return missing.unionByName(repeated).unionByName(foreign)
