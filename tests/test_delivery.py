"""Cards and channel folders."""

import json

from pyspark.sql import functions as F

from newsdesk.functions.cards import card_json
from newsdesk.operators import delivery, reads
from newsdesk.sources import catalogue
from newsdesk.sources.params import Params

CARDS = "category string, read string, severity int, confidence string, title string, link string, source string"
ROUTES = Params(webhooks={"financial": "money", "political": "policy", "technology": "policy"})


def table(spark):
    rows = [
        (category, "a read", severity, "low", f"{category} story", "http://x", "Desk")
        for category, severity in (("financial", 3), ("political", 2), ("technology", 4), ("catastrophe", 1))
    ]
    return spark.createDataFrame(rows, CARDS)


def test_card_payload(spark):
    card = delivery.themed(table(spark).where("category = 'financial'"), brand="Wire")
    plain, pretty = card.select(card_json(F.col("card")), card_json(F.col("card"), pretty=True)).head()
    assert json.loads(plain) == json.loads(pretty) and "\n" in pretty
    assert json.loads(plain) == {
        "username": "Wire",
        "embeds": [
            {
                "title": "💹 financial story",
                "url": "http://x",
                "color": 0x2E7D46,
                "description": "**a read**",
                "fields": [
                    {"name": "Band", "value": "FINANCE", "inline": True},
                    {"name": "Severity", "value": "●●●○  3/4", "inline": True},
                    {"name": "Confidence", "value": "low", "inline": True},
                ],
                "footer": {"text": "Wire · Desk"},
            }
        ],
    }


def test_channel_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    delivery.write_channels(delivery.routed(table(spark), ROUTES.routes(spark)), path)
    written = spark.read.text(path).collect()
    titles = {(r.channel, json.loads(r.value)["embeds"][0]["title"]) for r in written}
    assert titles == {
        ("money", "💹 financial story"), ("policy", "🏛 political story"), ("policy", "🔬 technology story"),
    }


def test_catalogue_terms_drive_sweeps_and_reads(spark):
    rows = [(0, "Fed: interest rate decision moves the S&P 500"), (1, "State of emergency after flood"), (2, "Sport")]
    items = spark.createDataFrame(rows, "id int, title string")
    swept = {(r.id, r.sweep, tuple(r.terms)) for r in reads.swept(items, catalogue.sweeps(spark)).collect()}
    assert swept == {
        (0, "Fed/Policy", ("interest rate", "rate decision")),
        (0, "Equities", ("s p 500",)),
        (1, "Unrest", ("state of emergency",)),
        (1, "Disaster", ("flood",)),
    }
    read = reads.lexicon_reads(items, catalogue.lexicon(spark)).orderBy("id").collect()
    assert [(r.category, r.severity, r.confidence) for r in read] == [
        ("financial", 3, "high"), ("catastrophe", 2, "medium"), ("drop", 1, "low"),
    ]
