"""Reading items: prompts, the pluggable reader, reply decoding and the lexicon reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdesk.functions import replies as R
from newsdesk.functions.barrier import computed_once
from newsdesk.functions.terms import longest_terms, texts, with_beginnings
from newsdesk.functions.text import fingerprint, unicode_trim
from newsdesk.operators.decode import with_reply
from newsdesk.sources.catalogue import BANDS

READ_COLUMNS = ("category", "read", "severity", "confidence")

# Fixed value: the instruction a model reader receives before each headline.
PROMPT = """\
You are a neutral news-desk router. Classify the headline into exactly ONE band and give a terse read.
Bands:
- financial: markets, macro, economy, central banks, earnings, commodities, corporate finance
- political: elections, government, policy, legislation, officials, non-violent geopolitics
- technology: software, hardware, AI, chips, platforms, space, science
- catastrophe: war, armed conflict, disaster, mass-casualty, major civil unrest, humanitarian crisis
- drop: sport, celebrity, lifestyle, trivia, or anything not newsworthy for those bands
Rules: pick the DOMINANT frame; never fabricate; do NOT inflate severity.
If a story is both financial and political, choose the frame the headline leads with.
severity: 1 minor, 2 notable, 3 major, 4 seismic. confidence: low|medium|high.
Return ONLY JSON of the form {"category":"","read":"","severity":1,"confidence":""} where read is <=12 words.

"""

# A reader maps the prompts of one Arrow batch to reply texts, or exceptions for failed reads. When it
# raises on a batch it is asked again prompt by prompt, so that one bad item fails alone.
Reader = Callable[[pd.Series], Sequence[object]]


def prompt() -> Column:
    return F.concat(
        F.lit(PROMPT), F.lit("Source: "), F.col("source"), F.lit("\nHeadline: "), F.col("title")
    )


def _answers(reader: Reader, prompts: pd.Series) -> list[object]:
    try:
        return list(reader(prompts))
    except Exception as failure:
        if len(prompts) == 1:
            return [failure]
    return [_answers(reader, prompts.iloc[[at]])[0] for at in range(len(prompts))]


def with_replies(items: DataFrame, reader: Reader, parallelism: int | None = None) -> DataFrame:
    """Add ``raw`` and ``error`` by asking ``reader`` about every item.

    This is the expensive step: filter and de-duplicate first, and write the result down
    before using it twice. ``parallelism`` bounds how many readers run at once.
    """
    asked = items.withColumn("prompt", prompt())
    if parallelism is not None:
        asked = asked.repartition(parallelism)
    schema = T.StructType(
        [*items.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = _answers(reader, batch["prompt"])
            failed = [isinstance(a, Exception) or a is None for a in answers]
            yield batch.drop(columns="prompt").assign(
                raw=[None if f else str(a) for a, f in zip(answers, failed, strict=True)],
                error=[str(a) if f else None for a, f in zip(answers, failed, strict=True)],
            )

    return asked.mapInPandas(ask, schema)


def decoded_reads(answered: DataFrame) -> DataFrame:
    """Replace ``raw`` by the coerced read; undecodable replies get an ``error``."""
    rest = [c for c in answered.columns if c not in ("raw", "error")]
    undecodable = F.when(F.col("_reply").isNull(), F.lit("undecodable reply"))
    reply = with_reply(answered, "raw", "_reply").withColumn("error", F.coalesce("error", undecodable))

    def unless_failed(value: Column, name: str) -> Column:
        return F.when(F.col("error").isNull(), value).alias(name)

    return reply.select(
        *rest,
        unless_failed(R.coerce_category(F.col("_reply.category")), "category"),
        unless_failed(F.col("_reply.read"), "read"),
        unless_failed(R.coerce_severity(F.col("_reply.severity")), "severity"),
        unless_failed(R.coerce_confidence(F.col("_reply.confidence")), "confidence"),
        "error",
    )


def succeeded(reads: DataFrame) -> DataFrame:
    """Reads that count as seen, whatever their category."""
    return reads.where(F.col("error").isNull()).drop("error")


def failed(reads: DataFrame) -> DataFrame:
    """Items to offer again: they are neither seen nor queued."""
    return reads.where(F.col("error").isNotNull()).drop(*READ_COLUMNS)


def is_cleared(min_severity: int) -> Column:
    return (F.col("category") != "drop") & (F.col("severity") >= min_severity)


def cleared(reads: DataFrame, min_severity: int) -> DataFrame:
    """Reads that become cards."""
    return reads.where(is_cleared(min_severity))


def _with_terms(items: DataFrame, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``_terms``: the terms of any group that a title's normalised words hold, found in one pass."""
    every = [t for group in terms.values() for t in group]
    found = computed_once(items, {"_longest": longest_terms(fingerprint(F.col("title")), every)})
    return computed_once(found, {"_terms": with_beginnings(F.col("_longest"), every)}).drop("_longest")


def _of_group(terms: Sequence[str]) -> Column:
    """The terms of a group among those found; most titles have none."""
    return F.when(F.size("_terms") > 0, F.array_intersect("_terms", texts(terms))).otherwise(texts(()))


def lexicon_reads(items: DataFrame, lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """Deterministic reads from term lists per band, computed row by row in the JVM.

    The band with most distinct matched terms wins, earlier bands on ties; no match is
    ``drop``. Terms are normalised words; a title is gone through once for all of them, and no join or
    shuffle is needed.
    """
    counted = _with_terms(items, lexicon).withColumns(
        {f"_hits_{band}": F.size(_of_group(lexicon.get(band, ()))) for band in BANDS}
    )
    most = F.greatest(*[F.col(f"_hits_{band}") for band in BANDS])
    category = F.lit("drop")
    for band in reversed(BANDS):
        category = F.when((most > 0) & (F.col(f"_hits_{band}") == most), F.lit(band)).otherwise(category)
    words = F.split(unicode_trim(F.col("title")), r"\p{IsWhite_Space}+")
    confidence = F.when(most >= 3, "high").when(most == 2, "medium").otherwise("low")
    return counted.select(
        *items.columns,
        category.alias("category"),
        F.array_join(words, " ").alias("read"),
        F.greatest(F.lit(R.MIN_SEVERITY), F.least(F.lit(R.MAX_SEVERITY), most)).alias("severity"),
        confidence.alias("confidence"),
    )


def swept(
    items: DataFrame, sweeps: Mapping[str, Sequence[str]], clock: str | None = None, horizons: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per item and sweep with at least one matching term.

    Only matched sweeps are expanded, so the output is the largest table involved. With a ``clock``
    column, a sweep that has a horizon (an interval such as ``1 DAY``) takes only items that are nearer
    than it to the newest one.
    """
    dated, fresh = items, {}
    if clock and horizons:
        newest = items.agg(F.max(clock)).scalar()
        if all(sweep in horizons for sweep in sweeps):
            # Before the terms are looked for, and down to the scan.
            dated = items.where(reduce(or_, [F.col(clock) > newest - F.expr(f"INTERVAL {h}") for h in sorted(set(horizons.values()))]))
        dated = dated.withColumn("_newest", newest)
        fresh = {sweep: F.col(clock) > F.col("_newest") - F.expr(f"INTERVAL {h}") for sweep, h in horizons.items()}
    hits = F.array(
        *[
            F.struct(
                F.lit(sweep).alias("sweep"),
                F.when(fresh.get(sweep, F.lit(True)), F.array_sort(_of_group(terms))).otherwise(texts(())).alias("terms"),
            )
            for sweep, terms in sweeps.items()
        ]
    )
    matched = {"_hits": F.filter(hits, lambda h: F.size(h["terms"]) > 0)}
    return computed_once(_with_terms(dated, sweeps), matched).select(
        *items.columns, F.inline("_hits")
    )


def recent(rows: DataFrame, clock: str, interval: str = "1 DAY") -> DataFrame:
    """Rows within ``interval`` of the newest one; the newest time is a scalar subquery."""
    newest = rows.agg(F.max(clock)).scalar()
    return rows.where(F.col(clock) > newest - F.expr(f"INTERVAL {interval}"))
