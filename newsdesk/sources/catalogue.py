"""Fixed dimensions: feed catalogue, topic sweeps, skins and category synonyms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions.text import percent_encode, words

BANDS = ("financial", "political", "technology", "catastrophe")
CATEGORIES = (*BANDS, "drop")

# The feed catalogue in its order. A desk is (source, band, url); a sweep
# is (source, band, search query).
DESK, SWEEP = "desk", "sweep"
CATALOGUE = (
    (DESK, "DJ Markets", "financial", "https://feeds.content.dowjones.io/public/rss/RSSMarketsMain"),
    (DESK, "CNBC Top", "financial", "https://www.cnbc.com/id/100003114/device/rss/rss.html"),
    (DESK, "CNBC Markets", "financial", "https://www.cnbc.com/id/20910258/device/rss/rss.html"),
    (DESK, "MarketWatch", "financial", "https://feeds.marketwatch.com/marketwatch/topstories/"),
    (SWEEP, "Fed/Policy", "financial", 'Federal Reserve OR FOMC OR Powell OR "interest rate" OR "rate decision" when:1d'),
    (SWEEP, "Inflation/Data", "financial", 'CPI OR inflation OR "jobs report" OR payrolls OR GDP OR PCE when:1d'),
    (SWEEP, "Equities", "financial", '"stock market" OR "S&P 500" OR Nasdaq OR "Dow Jones" OR earnings when:1d'),
    (SWEEP, "Rates", "financial", '"Treasury yields" OR "bond market" OR "10-year yield" OR "yield curve" when:1d'),
    (SWEEP, "FX/Dollar", "financial", '"US dollar" OR "dollar index" OR DXY OR forex when:1d'),
    (SWEEP, "Oil/Energy", "financial", '"oil prices" OR crude OR OPEC OR "natural gas" OR Brent OR WTI when:1d'),
    (SWEEP, "Gold", "financial", '"gold price" OR bullion OR "precious metals" when:1d'),
    (SWEEP, "Crypto", "financial", 'bitcoin OR ethereum OR crypto OR "digital assets" when:1d'),
    (DESK, "BBC Politics", "political", "https://feeds.bbci.co.uk/news/politics/rss.xml"),
    (DESK, "Guardian Politics", "political", "https://www.theguardian.com/politics/rss"),
    (SWEEP, "Politics", "political", "election OR president OR parliament OR government OR vote OR senate OR congress when:1d"),
    (SWEEP, "Policy/Trade", "political", 'policy OR legislation OR "supreme court" OR diplomacy OR summit OR tariffs OR sanctions when:1d'),
    (DESK, "BBC World", "catastrophe", "https://feeds.bbci.co.uk/news/world/rss.xml"),
    (DESK, "Al Jazeera", "catastrophe", "https://www.aljazeera.com/xml/rss/all.xml"),
    (DESK, "Guardian World", "catastrophe", "https://www.theguardian.com/world/rss"),
    (DESK, "NPR News", "catastrophe", "https://feeds.npr.org/1001/rss.xml"),
    (DESK, "NYT World", "catastrophe", "https://rss.nytimes.com/services/xml/rss/nyt/World.xml"),
    (DESK, "Sky World", "catastrophe", "https://feeds.skynews.com/feeds/rss/world.xml"),
    (SWEEP, "Conflict", "catastrophe", "war OR airstrike OR ceasefire OR military OR offensive OR invasion OR troops when:1d"),
    (SWEEP, "Disaster", "catastrophe", "earthquake OR flood OR wildfire OR hurricane OR explosion OR disaster OR evacuation when:1d"),
    (SWEEP, "Unrest", "catastrophe", 'protest OR unrest OR riot OR coup OR "state of emergency" OR crackdown when:1d'),
    (DESK, "Ars Technica", "technology", "https://feeds.arstechnica.com/arstechnica/index"),
    (DESK, "The Verge", "technology", "https://www.theverge.com/rss/index.xml"),
    (DESK, "Hacker News", "technology", "https://hnrss.org/frontpage"),
    (DESK, "Wired", "technology", "https://www.wired.com/feed/rss"),
    (DESK, "Engadget", "technology", "https://www.engadget.com/rss.xml"),
    (DESK, "TechCrunch", "technology", "https://techcrunch.com/feed/"),
    (DESK, "The Register", "technology", "https://www.theregister.com/headlines.atom"),
    (SWEEP, "AI/Chips", "technology", '"artificial intelligence" OR OpenAI OR "large language model" OR Nvidia OR semiconductors OR chips when:1d'),
    (SWEEP, "Big Tech", "technology", 'Apple OR Google OR Microsoft OR Meta OR Amazon OR Tesla OR "big tech" when:1d'),
)

# Search address around the encoded query.
SEARCH_PREFIX = "https://news.google.com/rss/search?q="
SEARCH_SUFFIX = "&hl=en-US&gl=US&ceid=US:en"

# Accepted spellings of each band in a reply.
CATEGORY_SYNONYMS = {
    "financial": ("financial", "finance", "money", "markets", "economy", "business"),
    "political": ("political", "politics", "policy", "government", "election", "geopolitics"),
    "technology": ("technology", "tech", "science"),
    "catastrophe": ("catastrophe", "crisis", "war", "disaster", "conflict", "humanitarian"),
}

# Label, emoji and 0xRRGGBB accent of each category.
SKINS = (
    ("financial", "FINANCE", "💹", 0x2E7D46),
    ("political", "POLITICS", "🏛", 0xC8922E),
    ("technology", "TECH", "🔬", 0x2F7FD8),
    ("catastrophe", "CRISIS · WAR", "🔴", 0xB23A3A),
    ("drop", "—", "·", 0x555555),
)


def fixed_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A table of constants whose size the planner knows."""
    schema = pa.schema(list(columns.items()))
    records = [dict(zip(columns, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=schema))


def search_url(query: Column) -> Column:
    return F.concat(F.lit(SEARCH_PREFIX), percent_encode(query), F.lit(SEARCH_SUFFIX))


def feeds(spark: SparkSession) -> DataFrame:
    """``feed_ord, kind, source, hint, query, url``: one row per catalogue entry."""
    rows = [
        (at, kind, source, band, place if kind == SWEEP else None, place if kind == DESK else None)
        for at, (kind, source, band, place) in enumerate(CATALOGUE)
    ]
    text = pa.string()
    columns = {
        "feed_ord": pa.int32(), "kind": text, "source": text, "hint": text, "query": text,
        "desk_url": text,
    }
    return (
        fixed_table(spark, columns, rows)
        .withColumn("url", F.coalesce("desk_url", search_url(F.col("query"))))
        .drop("desk_url")
    )


def sweep_terms(spark: SparkSession) -> DataFrame:
    """``sweep, hint, term``: the normalised alternatives of every sweep query."""
    alternatives = F.split(F.regexp_replace("query", r"\s+when:\S+$", ""), r"\s+OR\s+")
    return (
        feeds(spark)
        .where(F.col("kind") == SWEEP)
        .select(F.col("source").alias("sweep"), "hint", F.explode(alternatives).alias("alternative"))
        .select("sweep", "hint", words(F.col("alternative")).alias("term"))
    )


def _terms_by(spark: SparkSession, column: str) -> dict[str, tuple[str, ...]]:
    rows = sweep_terms(spark).collect()
    return {name: tuple(r.term for r in rows if r[column] == name) for name in dict.fromkeys(r[column] for r in rows)}


def sweeps(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """Normalised terms of every sweep of the catalogue."""
    return _terms_by(spark, "sweep")


def alternatives() -> list[str]:
    """What the sweeps look for, as written, in order."""
    queries = [re.sub(r"\s+when:\S+$", "", place) for kind, _, _, place in CATALOGUE if kind == SWEEP]
    return [alternative.strip('"') for query in queries for alternative in re.split(r"\s+OR\s+", query)]


def horizons() -> dict[str, str]:
    """How far back each sweep looks, from the ``when:`` of its query."""
    units = {"h": "HOUR", "d": "DAY"}
    asked = {source: re.search(r"when:(\d+)([hd])\b", query) for kind, source, _, query in CATALOGUE if kind == SWEEP}
    return {source: f"{found[1]} {units[found[2]]}" for source, found in asked.items() if found}


def lexicon(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """Normalised terms of every band: those of its sweeps."""
    return _terms_by(spark, "hint")


def skins(spark: SparkSession) -> DataFrame:
    text = pa.string()
    columns = {"category": text, "label": text, "emoji": text, "color": pa.int32()}
    return fixed_table(spark, columns, list(SKINS))


def synonyms(spark: SparkSession) -> DataFrame:
    """``spelling, category``: the category lookup as a dimension table."""
    rows = [(s, band) for band, spellings in CATEGORY_SYNONYMS.items() for s in spellings]
    return fixed_table(spark, {"spelling": pa.string(), "category": pa.string()}, rows)
