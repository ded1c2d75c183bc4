"""Golden vectors of the scalar functions."""

import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from newsdesk.functions import cards as C
from newsdesk.functions import replies as R
from newsdesk.functions.terms import longest_terms, with_beginnings
from newsdesk.functions.text import fingerprint, percent_encode
from newsdesk.operators.decode import with_reply, with_response
from newsdesk.operators.reads import decoded_reads

FINGERPRINTS = [
    ("Fed holds rates - Reuters", "fed holds rates"),
    ("A - B - C - Reuters", "a b c"),
    ("A - B - ", "a"),
    ("Foo - ", "foo"),
    (" - Reuters", "reuters"),
    ("a - - b", "a"),
    ("Live – BBC", "live bbc"),
    (" S&P 500 up 2.5% ", "s p 500 up 2 5"),
    ("Re-run  of\tvote", "re run of vote"),
    ("Ünïcode ÉTÉ", "ünïcode été"),
    ("line1\nline2 - Src", "line1 line2"),
    ("!!!", ""),
    ("　 x\u0085", "x"),
    ("हिन्दी", "हिन द"),
]


def column(spark, values, name="v", kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_fingerprint(spark):
    titles, wanted = zip(*FINGERPRINTS[:-1], strict=True)
    rows = column(spark, titles).select(fingerprint(F.col("v")).alias("fp")).collect()
    assert [r.fp for r in rows] == list(wanted)


def test_fingerprint_keeps_vowel_signs_that_are_alphabetic(spark):
    # U+093F and U+0940 are alphabetic marks, U+094D (virama) is not.
    row = column(spark, ["हिन्दी"]).select(fingerprint(F.col("v")).alias("fp")).head()
    assert row.fp == "हिन दी"


def plain_fingerprint(title):
    """The rules word by word, on code points."""
    spaces = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    text = title.strip(spaces)
    cut = text.rfind(" - ")
    text = (text[:cut] if cut > 0 else text).lower()
    kept = "".join(c if regex.match(r"[\p{Alphabetic}\p{N}]", c) else " " for c in text)
    return " ".join(kept.split())


def test_fingerprint_on_random_titles(spark):
    pieces = [
        " - ", " -", "- ", "-", " ", "  ", "\t", "\n", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "–", "—", "!", "…",
        "a", "B", "Z9", "É", "ß", "ẞ", "ΑΣ", "ΣΑ", "İ", "ı", "ﬁ", "Ⅷ", "²", "½", "٣", "ि", "्", "क", "中", "ア", "한", "é", "🙂", "𝐀", "_", "$", "1.5",
    ]
    rng = random.Random(1)
    titles = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(3000)]
    rows = column(spark, titles).select("v", fingerprint(F.col("v")).alias("fp")).collect()
    wrong = [(r.v, r.fp, plain_fingerprint(r.v)) for r in rows if r.fp != plain_fingerprint(r.v)]
    assert not wrong, wrong[:5]


def test_percent_encoding(spark):
    pairs = [
        ("a b", "a%20b"),
        ('"S&P 500"', "%22S%26P%20500%22"),
        ("x~y*z+", "x~y%2Az%2B"),
        ("é", "%C3%A9"),
        ("when:1d", "when%3A1d"),
        ("-_.~", "-_.~"),
    ]
    rows = column(spark, [p[0] for p in pairs]).select(percent_encode(F.col("v")).alias("e")).collect()
    assert [r.e for r in rows] == [p[1] for p in pairs]


def found_terms(spark, texts, terms):
    longest = column(spark, texts).withColumn("l", longest_terms(F.col("v"), terms))
    return [sorted(r.t) for r in longest.select(with_beginnings(F.col("l"), terms).alias("t")).collect()]


def test_terms_of_one_pass(spark):
    terms = ["of", "of the", "the people", "people", "a.b", "une", "une fois", "fois de"]
    texts = ["of the people", "often", "axb a.b", "of", "", "une fois de plus", "of the of", "the  people"]
    wanted = [["of", "of the", "people", "the people"], [], ["a.b"], ["of"], [], ["fois de", "une", "une fois"], ["of", "of the"], ["people"]]
    assert found_terms(spark, texts, terms) == wanted
    assert found_terms(spark, ["of the"], []) == [[]]


def test_terms_equal_a_search_for_each(spark):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "b", "ba", "c", "é", "x9"]
    for size in (1, 7, 60):
        terms = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(size)]
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)]
        wanted = [sorted({t for t in terms if f" {t} " in f" {text} "}) for text in texts]
        assert found_terms(spark, texts, terms) == wanted


SEVERITIES = [
    ("1", 1), ("4", 4), ("0", 1), ("7", 4), ("256", 1), ("258", 2), ("260", 4), ("-1", 1),
    ("3.0", 1), ("3e0", 1), ("null", 1), ("true", 1), ("[2]", 1), ('"3"', 3), ('"300"', 1),
    ('"3.0"', 1), ('"x"', 1), ('"-0"', 1), ('"003"', 3), ('" +3 "', 3), ('"+"', 1), ('""', 1),
    ("9223372036854775807", 4), ("9223372036854775810", 2), ("18446744073709551614", 4),
    ("18446744073709551615", 4), ("18446744073709551616", 1), ('{"a":1}', 1), ("0.5", 1),
]


KEYS = [
    ('{"category":"tech","x":1,"x":2}', "tech", None), ('{"category":"a","category":"b"}', None, None),
    ('{"cat\\u0065gory":"a","category":"b"}', None, None), ('{"severity":{"a":1,"a":2}}', "", None),
    ('{"x":{"a":1,"a":2},"severity":2}', "", "2"), ('{"severity":1e400}', None, None), ('{"x":1e400}', "", None),
    ('{"severity":-1e400}', None, None), ('{"category":"z"},"more":1', None, None), ('{"category":"z"}}', None, None),
    ("{'category':'z'}", None, None), ('{"severity":NaN}', None, None), ('{"category":"a\tb"}', None, None),
    ('{"a":[1,{"b":"}"}],"category":"z"}', "z", None), ('["tech","r",2,"high"]', "tech", "2"), ('["tech","r",2,"high",5]', None, None),
]


def test_repeated_keys_and_numbers_beyond_range(spark):
    """Only the four keys must not repeat, and only a severity must be a number that is one."""
    rows = with_reply(column(spark, [raw for raw, _, _ in KEYS], "raw"), "raw", "r").selectExpr("r.category as c", "cast(r.severity as string) as s").collect()
    assert [(r.c, r.s) for r in rows] == [k[1:] for k in KEYS]


def test_severity(spark):
    raws = [f'{{"severity":{value}}}' for value, _ in SEVERITIES]
    replies = with_reply(column(spark, raws, "raw"), "raw", "r")
    rows = replies.select(R.coerce_severity(F.col("r.severity")).alias("s")).collect()
    assert [r.s for r in rows] == [wanted for _, wanted in SEVERITIES]


def test_category_and_confidence(spark):
    categories = {
        "Finance": "financial", "MARKETS": "financial", "geopolitics": "political",
        "science": "technology", "war": "catastrophe", "drop": "drop", "sport": "drop",
        "": "drop", " financial": "drop", "central_bank": "drop",
    }
    rows = column(spark, list(categories)).select(R.coerce_category(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == list(categories.values())
    confidences = {"": "low", "High": "high", "Very Sure": "very sure"}
    rows = column(spark, list(confidences)).select(R.coerce_confidence(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == list(confidences.values())


REPLIES = [
    ("{}", ("drop", "", 1, "low")),
    ('{"category":"tech","severity":3,"extra":1}', ("technology", "", 3, "low")),
    (' {"category":"war","read":"r","confidence":"HIGH"}\n', ("catastrophe", "r", 1, "high")),
    ('["tech","r",2]', ("technology", "r", 2, "low")),
    ('["tech","r",2,"High",5]', None),
    ('{"category":null}', None),
    ('{"category":"tech","read":7}', None),
    ('{"category":"tech"} trailing', None),
    ('{"category":"tech"}],[', None),
    ('{"category":"tech"},1', None),
    ('{"category":"tech","category":"war"}', None),
    ("not json", None),
    ("", None),
    ("3", None),
    ('"tech"', None),
    (None, None),
]


def test_reply_decoding(spark):
    answered = column(spark, [raw for raw, _ in REPLIES], "raw").withColumn(
        "error", F.lit(None).cast("string")
    )
    rows = decoded_reads(answered).collect()
    for (raw, wanted), row in zip(REPLIES, rows, strict=True):
        if wanted is None:
            assert row.error is not None and row.category is None, raw
        else:
            assert row.error is None, raw
            assert (row.category, row["read"], row.severity, row.confidence) == wanted, raw


def test_envelope(spark):
    bodies = [
        (json.dumps({"model": "m", "response": '{"category":"tech"}', "done": True}), '{"category":"tech"}'),
        ('{"response":7}', None),
        ('{"other":"x"}', None),
        ('{"response":"x"} y', None),
        (None, None),
    ]
    rows = with_response(column(spark, [b for b, _ in bodies], "body"), "body", "raw").collect()
    assert [r.raw for r in rows] == [w for _, w in bodies]


def test_meter(spark):
    rows = column(spark, [1, 2, 3, 4], kind="int").select(C.meter(F.col("v")).alias("m")).collect()
    assert [r.m for r in rows] == ["●○○○", "●●○○", "●●●○", "●●●●"]


@pytest.mark.parametrize(
    ("dry", "channel", "failure", "wanted"),
    [
        (True, None, None, "dry"),
        (True, "c", "e", "dry"),
        (False, "c", None, "posted"),
        (False, "c", "e", "failed"),
        (False, None, None, "held"),
    ],
)
def test_outcome(spark, dry, channel, failure, wanted):
    row = spark.createDataFrame([(channel, failure)], "channel string, failure string")
    got = row.select(C.outcome(dry, F.col("channel"), F.col("failure")).alias("o")).head().o
    assert got == wanted
