"""The registered queries restated as SQL over the same tables."""

from __future__ import annotations

from newsdesk.functions.cards import BRAND
from newsdesk.functions.text import WHITE_SPACE
from newsdesk.operators.reads import PROMPT
from newsdesk.operators.status import LOG_LINES, SNAPSHOT_LINES
from newsdesk.plans import views as V
from newsdesk.plans.queries import CAP, CAPACITY, FLOOR, START_UNIX, TICK_CARDS
from newsdesk.sources import catalogue as K
from newsdesk.sources.params import DEFAULTS

POLL_SECONDS = V.POLL_MINUTES * 60
SPACES = "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    cells = (
        ", ".join("NULL" if v is None else text(v) if isinstance(v, str) else str(v) for v in row)
        for row in rows
    )
    return "(VALUES " + ", ".join(f"({row})" for row in cells) + ")"


def with_views(*views: str) -> str:
    """A WITH clause of the named views and of those they build on."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name not in needed:
            for base in BASES.get(name, ()):
                need(base)
            needed.append(name)

    for name in views:
        need(name)
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed) + " "


def trimmed(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"


def fp(column: str) -> str:
    cut = f"regexp_replace({trimmed(column)}, '^(.+) - .*$', '\\1', 's')"
    return f"trim(regexp_replace(lower({cut}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def matches(value: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in pairs.items())
    return f"CASE {value} {whens} END"


def winners(source: str, order: str) -> str:
    """First row of every fingerprint."""
    return (
        f"SELECT * FROM (SELECT *, {fp('title')} AS fp FROM {source} WHERE {trimmed('title')} <> '') "
        f"QUALIFY row_number() OVER (PARTITION BY fp ORDER BY {order}) = 1"
    )


ITEM_ORDER = "feed_ord, entry_ord"
CLEARED = f"category <> 'drop' AND severity >= {FLOOR}"
ROUTE = "CASE category WHEN 'financial' THEN 'money' WHEN 'political' THEN 'policy' WHEN 'technology' THEN 'policy' END"
K_OF_EVENT = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"
EVENT_POLL = f"CAST(floor(epoch(ts) / {POLL_SECONDS}) AS BIGINT)"

title_html = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for written, meant in (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&"),
):
    title_html = f"replace({title_html}, {text(written)}, {text(meant)})"

# What each sweep of the catalogue looks for, normalised, in the catalogue's order.
SWEPT = (
    ("Fed/Policy", "federal reserve|fomc|powell|interest rate|rate decision"),
    ("Inflation/Data", "cpi|inflation|jobs report|payrolls|gdp|pce"),
    ("Equities", "stock market|s p 500|nasdaq|dow jones|earnings"),
    ("Rates", "treasury yields|bond market|10 year yield|yield curve"),
    ("FX/Dollar", "us dollar|dollar index|dxy|forex"),
    ("Oil/Energy", "oil prices|crude|opec|natural gas|brent|wti"),
    ("Gold", "gold price|bullion|precious metals"),
    ("Crypto", "bitcoin|ethereum|crypto|digital assets"),
    ("Politics", "election|president|parliament|government|vote|senate|congress"),
    ("Policy/Trade", "policy|legislation|supreme court|diplomacy|summit|tariffs|sanctions"),
    ("Conflict", "war|airstrike|ceasefire|military|offensive|invasion|troops"),
    ("Disaster", "earthquake|flood|wildfire|hurricane|explosion|disaster|evacuation"),
    ("Unrest", "protest|unrest|riot|coup|state of emergency|crackdown"),
    ("AI/Chips", "artificial intelligence|openai|large language model|nvidia|semiconductors|chips"),
    ("Big Tech", "apple|google|microsoft|meta|amazon|tesla|big tech"),
)

VIEWS = {
    "items": """
        SELECT CAST(substr(source, 4) AS INTEGER) AS feed_ord, doc_id * 16777216 + line_no AS entry_ord,
               line || CASE WHEN doc_id % 3 = 0 THEN ' - ' || source ELSE '' END AS title,
               '' AS link, source, doc_id, CAST(line_no AS INTEGER) AS line_no
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)""",
    "web": f"""
        SELECT {V.PAGES_FEED} AS feed_ord, page_id AS entry_ord, {title_html} AS title, url AS link,
               regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS source
        FROM pages""",
    "pool": "SELECT feed_ord, entry_ord, title, link, source FROM items UNION ALL SELECT * FROM web",
    "doc_batch": winners("items", ITEM_ORDER),
    "web_batch": winners("web", ITEM_ORDER),
    "pool_batch": winners("pool", ITEM_ORDER),
    "web_ledger": "SELECT fp, 0::BIGINT AS poll_id, feed_ord, entry_ord FROM web_batch",
    "upserted": """
        SELECT * FROM web_ledger
        UNION ALL
        SELECT fp, 1::BIGINT, feed_ord, entry_ord FROM doc_batch d
        WHERE NOT EXISTS (SELECT 1 FROM web_ledger w WHERE w.fp = d.fp)""",
    "lines": """
        SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS feed_ord,
               source IS NOT DISTINCT FROM 'src7' AND lang IS NOT DISTINCT FROM 'en' AS cut,
               unnest(string_split(text, chr(10))) AS title,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents""",
    "reads": f"""
        SELECT event_id, {EVENT_POLL} AS poll_id, event_type || ' ' || event_id AS title,
               'https://example.org/e/' || event_id AS link, 'user ' || user_id AS source,
               {matches('event_type', V.CATEGORY_OF_TYPE)} AS category,
               'k is ' || k AS read, k % 4 + 1 AS severity,
               CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
               k % 10 = 0 AS fails
        FROM (SELECT *, {K_OF_EVENT} AS k FROM events)""",
    "cards": f"""
        SELECT r.*, s.label, s.emoji, s.color, {ROUTE} AS channel
        FROM reads r JOIN {values(list(K.SKINS))} s(category, label, emoji, color) USING (category)
        WHERE {CLEARED}""",
    "outcomes": """
        SELECT *, CASE WHEN channel IS NULL THEN 'held' WHEN fails THEN 'failed' ELSE 'posted' END AS outcome,
               CASE WHEN channel IS NULL THEN 'no webhook for ' || label || ' — held'
                    WHEN fails THEN 'post FAILED ' || label || ' — status 500 — busy'
                    ELSE 'posted ' || emoji || ' ' || label || ' — ' || title END AS line
        FROM cards""",
    "parts": f"""
        SELECT event_id, k, k % 4 + 1 AS sev, event_id % 15 AS kind,
               {matches('event_type', V.CATEGORY_OF_TYPE)} AS band,
               {matches('event_type', V.SYNONYM_OF_TYPE)} AS synonym
        FROM (SELECT *, {K_OF_EVENT} AS k FROM events)""",
    "answers": """
        SELECT event_id, k, kind NOT IN (11, 13) AS valid,
               CASE WHEN kind IN (3, 4) THEN 'drop' ELSE band END AS category,
               CASE WHEN kind = 10 THEN '' ELSE 'k is ' || k END AS read,
               CASE WHEN kind = 7 THEN CASE WHEN k % 8 < 1 THEN 1 WHEN k % 8 > 4 THEN 4 ELSE k % 8 END
                    WHEN kind IN (8, 9, 10) THEN 1 ELSE sev END AS severity,
               CASE kind WHEN 0 THEN 'high' WHEN 12 THEN 'high' WHEN 14 THEN 'high' WHEN 2 THEN 'medium' WHEN 5 THEN 'very sure' ELSE 'low' END AS confidence
        FROM parts""",
    "raws": """
        SELECT event_id, CASE
            WHEN kind = 10 THEN '{"category":"' || band || '"}'
            ELSE CASE WHEN kind = 14 THEN '{"more":{"a":1,"a":2},"category":"' ELSE '{"category":"' END || CASE kind WHEN 1 THEN synonym WHEN 2 THEN upper(band) WHEN 3 THEN 'central_bank'
                                             WHEN 4 THEN ' ' || band ELSE band END
              || '","read":"k is ' || k || '","severity":'
              || CASE kind WHEN 5 THEN '"' || sev || '"' WHEN 6 THEN '" +' || sev || ' "' WHEN 7 THEN '' || (256 + k % 8)
                           WHEN 8 THEN '-' || sev WHEN 9 THEN sev || '.0' WHEN 13 THEN '1e999' ELSE '' || sev END
              || ',"confidence":"' || CASE WHEN kind IN (0, 11, 12, 14) THEN 'High' WHEN kind = 1 THEN '' WHEN kind = 2 THEN 'MEDIUM'
                                           WHEN kind = 5 THEN 'Very Sure' ELSE 'low' END
              || CASE WHEN kind = 11 THEN '"} trailing' WHEN kind = 12 THEN '","note":1,"note":2}' ELSE '"}' END
            END AS raw
        FROM parts""",
    "padded": f"SELECT entry_ord, doc_id, line_no, title, ' ' || {fp('title')} || ' ' AS padded FROM items",
    "terms": "SELECT * FROM "
    + values([(b, t, K.BANDS.index(b)) for b, terms in V.LEXICON.items() for t in terms])
    + " t(sweep, term, band_ord)",
    "hits": """
        SELECT entry_ord, doc_id, line_no, sweep, band_ord, count(*) AS n, string_agg(term, '|' ORDER BY term) AS terms
        FROM padded JOIN terms ON contains(padded, ' ' || term || ' ')
        GROUP BY entry_ord, doc_id, line_no, sweep, band_ord""",
    "documented": f"""
        SELECT event_id, event_id % 4 AS kind, k, event_type, user_id
        FROM (SELECT *, {K_OF_EVENT} AS k FROM events)""",
    # Polls one by one: the backlog of severities s and up after each poll's pops.
    "bounds": "SELECT min(poll_id) AS lo, max(poll_id) AS hi FROM reads",
    "counts": f"""
        SELECT poll_id, row_number() OVER (ORDER BY poll_id) AS turn,
               count(event_id) AS reads,
               count(*) FILTER (WHERE {CLEARED}) AS a1,
               count(*) FILTER (WHERE {CLEARED} AND severity >= 2) AS a2,
               count(*) FILTER (WHERE {CLEARED} AND severity >= 3) AS a3,
               count(*) FILTER (WHERE {CLEARED} AND severity >= 4) AS a4
        FROM (SELECT unnest(generate_series(lo, hi)) AS poll_id FROM bounds) LEFT JOIN reads USING (poll_id)
        GROUP BY poll_id""",
    "backlogs": f"""
        SELECT 0::BIGINT AS turn, 0::BIGINT AS b1, 0::BIGINT AS b2, 0::BIGINT AS b3, 0::BIGINT AS b4
        UNION ALL
        SELECT c.turn, greatest(0, b1 + a1 - {CAPACITY}), greatest(0, b2 + a2 - {CAPACITY}),
               greatest(0, b3 + a3 - {CAPACITY}), greatest(0, b4 + a4 - {CAPACITY})
        FROM backlogs b JOIN counts c ON c.turn = b.turn + 1""",
    "flow": """
        SELECT c.*, p.b1 + a1 AS queued,
               p.b1 + a1 - n.b1 AS g1, p.b2 + a2 - n.b2 AS g2, p.b3 + a3 - n.b3 AS g3, p.b4 + a4 - n.b4 AS g4
        FROM counts c JOIN backlogs n ON n.turn = c.turn JOIN backlogs p ON p.turn = c.turn - 1""",
    "gone": """
        SELECT severity, poll_id, n, stronger,
               sum(n) OVER (PARTITION BY severity ORDER BY poll_id) AS upto
        FROM (SELECT poll_id, unnest([1, 2, 3, 4]) AS severity,
                     unnest([g1 - g2, g2 - g3, g3 - g4, g4]) AS n,
                     unnest([g2, g3, g4, 0]) AS stronger FROM flow)""",
    "replayed": """
        SELECT c.*, g.poll_id AS left_poll, g.stronger + c.line_no - (g.upto - g.n) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY poll_id, event_id) AS line_no
              FROM outcomes) c
        JOIN gone g ON g.severity = c.severity AND c.line_no > g.upto - g.n AND c.line_no <= g.upto""",
    "summary": f"""
        SELECT poll_id, a1 AS new, queued,
               sum(reads) OVER (ORDER BY poll_id) AS seen
        FROM flow""",
    "activity": """
        SELECT poll_id, 0::BIGINT AS place,
               'poll: ' || new || ' new · ' || queued || ' queued · ' || CAST(seen AS BIGINT) || ' seen' AS line
        FROM summary
        UNION ALL
        SELECT left_poll, CAST(place AS BIGINT), line FROM replayed""",
    "health": f"""
        SELECT f.feed_ord, f.source, f.hint, coalesce(h.ok, false) AS ok,
               coalesce(h.payloads, 0) AS payloads, coalesce(h.items, 0) AS items, h.reason
        FROM {values([(at, row[1], row[2]) for at, row in enumerate(K.CATALOGUE)])} f(feed_ord, source, hint)
        LEFT JOIN (
            SELECT CAST(substr(source, 4) AS INTEGER) AS feed_ord, count(*) AS payloads,
                   bool_and(NOT cut) AS ok,
                   min(CASE WHEN cut THEN CASE WHEN doc_id % 6 = 4 THEN 'not a JSON feed' ELSE 'malformed XML' END END) AS reason,
                   sum(CASE WHEN NOT cut THEN len(string_split(text, chr(10))) ELSE 0 END) AS items
            FROM (SELECT *, source IS NOT DISTINCT FROM 'src7' AND lang IS NOT DISTINCT FROM 'en' AS cut
                  FROM documents) GROUP BY 1) h USING (feed_ord)""",
}

BASES = {
    "pool": ("items", "web"),
    "doc_batch": ("items",),
    "web_batch": ("web",),
    "pool_batch": ("pool",),
    "web_ledger": ("web_batch",),
    "upserted": ("web_ledger", "doc_batch"),
    "cards": ("reads",),
    "outcomes": ("cards",),
    "answers": ("parts",),
    "raws": ("parts",),
    "padded": ("items",),
    "hits": ("padded", "terms"),
    "bounds": ("reads",),
    "counts": ("reads", "bounds"),
    "backlogs": ("counts",),
    "flow": ("counts", "backlogs"),
    "gone": ("flow",),
    "replayed": ("gone", "outcomes"),
    "summary": ("flow",),
    "activity": ("summary", "replayed"),
}


def query(views: tuple[str, ...], sql: str) -> str:
    clause = with_views(*views) if views else ""
    if "backlogs" in clause:
        clause = clause.replace("WITH ", "WITH RECURSIVE ", 1)
    return clause + sql


LEDGER = "fp, poll_id, feed_ord, entry_ord"
BATCH = "feed_ord, entry_ord, title, link, source, fp"
METER = "repeat('●', severity) || repeat('○', 4 - severity)"
CARD = f"""
    event_id, {text(BRAND)} AS username, emoji || ' ' || title AS title, link AS url,
    CAST(color AS INTEGER) AS color, '**' || read || '**' AS description,
    'Band=' || label || ';Severity=' || {METER} || '  ' || severity || '/4;Confidence=' || confidence AS fields,
    true AS all_inline, {text(BRAND + ' · ')} || source AS footer"""
POSTED = ", ".join(
    f"count(*) FILTER (WHERE outcome = 'posted' AND category = '{b}') AS posted_{b}" for b in K.BANDS
)
READ = "category, read, CAST(severity AS INTEGER) AS severity, confidence"
QUEUE_RANK = "row_number() OVER (ORDER BY severity DESC, event_id)"
HINTED = values([(at, *row) for at, row in enumerate(K.CATALOGUE)])
SEARCH = f"{text(K.SEARCH_PREFIX)} || url_encode(%s) || {text(K.SEARCH_SUFFIX)}"
SPOKEN = f"array_to_string(regexp_split_to_array({trimmed('title')}, '[{SPACES}]+'), ' ')"
COLUMNS_OF_HIT = "arg_max(sweep, n * 10 - band_ord)"

ORACLE = {
    "feed_catalogue": f"""
        SELECT CAST(f.feed_ord AS INTEGER) AS feed_ord, f.kind, f.source, f.hint,
               CASE f.kind WHEN 'desk' THEN f.place ELSE {SEARCH % 'f.place'} END AS url,
               coalesce(n.items, 0) AS items
        FROM {HINTED} f(feed_ord, kind, source, hint, place)
        LEFT JOIN (SELECT CAST(substr(source, 4) AS INTEGER) AS feed_ord,
                          CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS items
                   FROM documents GROUP BY 1) n USING (feed_ord)""",
    "sweep_urls": query(("items",), f"SELECT doc_id, line_no, {SEARCH % 'title'} AS url FROM items"),
    "feed_items_xml": query(
        ("lines",),
        """SELECT feed_ord, doc_id, CAST(line_no AS INTEGER) AS entry_ord,
                  CASE WHEN doc_id % 6 = 4 THEN title ELSE trim(title, chr(9) || chr(13) || ' ') END AS title,
                  'https://example.org/d/' || doc_id || '/' || line_no AS link
           FROM lines WHERE NOT cut""",
    ),
    "page_items": query(("web",), "SELECT * FROM web"),
    "ledger_scan": query(
        ("pool_batch",), "SELECT fp, 0::BIGINT AS poll_id, feed_ord, entry_ord FROM pool_batch"
    ),
    "config_defaults": query(
        ("documented",),
        f"""SELECT event_id, CASE WHEN kind = 2 THEN 'm' || k ELSE {text(DEFAULTS['model'])} END AS model,
                   CASE WHEN kind = 1 THEN 2 ELSE k % 6 END AS min_severity,
                   CAST(CASE WHEN kind = 1 THEN 10 ELSE k % 3 END AS BIGINT) AS poll_minutes,
                   CAST(CASE WHEN kind = 1 THEN 90 ELSE k % 11 END AS BIGINT) AS drip_seconds,
                   1 AS max_per_drop, {text(DEFAULTS['seen_path'])} AS seen_path, 2 AS routes
            FROM documented WHERE kind <> 0""",
    ),
    "tuning_view": query(
        ("documented",),
        """SELECT event_id,
                  CAST(CASE WHEN kind = 1 THEN 2 ELSE k % 6 END AS BIGINT) AS min_severity,
                  CAST(CASE WHEN kind = 1 THEN 10 ELSE k % 3 END AS BIGINT) AS poll_minutes,
                  CAST(CASE WHEN kind = 1 THEN 90 ELSE k % 11 END AS BIGINT) AS drip_seconds,
                  CASE WHEN kind = 0 THEN '' WHEN event_type < 'drop' THEN event_type || ',drop'
                       ELSE 'drop,' || event_type END AS webhook_bands
           FROM documented""",
    ),
    "tuning_clamp": query(
        ("documented",),
        """SELECT event_id, CASE k % 7 WHEN 0 THEN 1 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE k % 7 END AS min_severity,
                  CAST(CASE k % 3 WHEN 0 THEN 1 ELSE k % 3 END AS BIGINT) AS poll_minutes,
                  CAST(CASE WHEN k % 11 < 5 THEN 5 ELSE k % 11 END AS BIGINT) AS drip_seconds
           FROM documented""",
    ),
    "nonblank_items": query(
        ("lines",),
        f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, title FROM lines WHERE {trimmed('title')} <> ''",
    ),
    "gathered_items": query(("pool_batch",), f"SELECT {BATCH} FROM pool_batch"),
    "fingerprint_docs": query(("items",), f"SELECT doc_id, line_no, {fp('title')} AS fp FROM items"),
    "fingerprint_pages": query(("web",), f"SELECT entry_ord AS page_id, {fp('title')} AS fp FROM web"),
    "batch_dedupe": query(("doc_batch",), f"SELECT {BATCH} FROM doc_batch"),
    "seed_ledger": query(
        ("pool_batch",), "SELECT fp, 0::BIGINT AS poll_id, feed_ord, entry_ord FROM pool_batch"
    ),
    "ledger_upsert": query(("upserted",), f"SELECT {LEDGER} FROM upserted"),
    "ledger_capped": query(
        ("upserted",),
        f"SELECT {LEDGER} FROM upserted ORDER BY poll_id DESC, feed_ord DESC, entry_ord DESC LIMIT {CAP}",
    ),
    "ledger_after_poll": query(("upserted",), f"SELECT {LEDGER} FROM upserted"),
    "unseen_items": query(
        ("doc_batch", "web_ledger"),
        f"SELECT {BATCH} FROM doc_batch d WHERE NOT EXISTS (SELECT 1 FROM web_ledger w WHERE w.fp = d.fp)",
    ),
    "suppressed_items": query(
        ("doc_batch", "web_ledger"),
        f"SELECT {BATCH} FROM doc_batch d WHERE EXISTS (SELECT 1 FROM web_ledger w WHERE w.fp = d.fp)",
    ),
    "first_sightings": query(
        ("items",),
        f"""SELECT * FROM ({winners(
            f'(SELECT feed_ord, entry_ord, title, link, source, doc_id // {V.DOCUMENTS_PER_POLL} AS poll_id FROM items)', 'poll_id, ' + ITEM_ORDER)})
            WHERE poll_id > 0""",
    ),
    "topic_sweep": query(("hits",), "SELECT doc_id, line_no, sweep, terms FROM hits"),
    "sweep_recent": """
        SELECT event_id, event_type FROM events
        WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "catalogue_sweeps": f"""
        WITH asked AS (SELECT sweep, sweep_at, unnest(string_split(terms, '|')) AS term,
                              generate_subscripts(string_split(terms, '|'), 1) AS place
                       FROM {values([(sweep, terms, at) for at, (sweep, terms) in enumerate(SWEPT)])} t(sweep, terms, sweep_at)),
        numbered AS (SELECT *, row_number() OVER (ORDER BY sweep_at, place) - 1 AS turn, count(*) OVER () AS n FROM asked),
        fresh AS (SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND event_id % 3 > 0),
        titles AS (SELECT event_id, ' ' || term || ' ' AS title FROM fresh JOIN numbered ON turn = event_id % n)
        SELECT event_id, sweep, string_agg(term, '|' ORDER BY term) AS terms
        FROM titles JOIN asked ON contains(title, ' ' || term || ' ') GROUP BY event_id, sweep""",
    "reader_prompts": query(
        ("items",),
        f"""SELECT doc_id, line_no,
                   md5({text(PROMPT)} || 'Source: ' || source || chr(10) || 'Headline: ' || title) AS prompt_md5
            FROM items""",
    ),
    "reader_replies": query(
        ("web",),
        f"""SELECT page_id, CASE WHEN size % 13 > 0 THEN category END AS category,
                   CASE WHEN size % 13 > 0 THEN size || ' letters' END AS read,
                   CAST(CASE WHEN size % 13 > 0 THEN greatest(1, least(4, size % 6)) END AS INTEGER) AS severity,
                   CASE WHEN size % 13 > 0 THEN 'low' END AS confidence,
                   CASE WHEN size % 13 = 0 THEN 'reader timed out' END AS error
            FROM (SELECT entry_ord AS page_id, length(title) AS size,
                         ({list(K.CATEGORIES)})[length(title) % 5 + 1] AS category FROM web)""",
    ),
    "lexicon_reads": query(
        ("hits",),
        f"""SELECT doc_id, line_no, coalesce(sweep, 'drop') AS category, {SPOKEN} AS read,
                   CAST(greatest(1, least(4, coalesce(n, 0))) AS INTEGER) AS severity,
                   CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS confidence
            FROM padded LEFT JOIN (
                SELECT entry_ord, max(n) AS n, {COLUMNS_OF_HIT} AS sweep FROM hits GROUP BY entry_ord) USING (entry_ord)""",
    ),
    "decode_envelope": query(("raws",), "SELECT event_id, raw FROM raws"),
    "decode_replies": query(
        ("answers",),
        """SELECT event_id, CASE WHEN valid THEN category END AS category, CASE WHEN valid THEN read END AS read,
                  CAST(CASE WHEN valid THEN severity END AS INTEGER) AS severity,
                  CASE WHEN valid THEN confidence END AS confidence,
                  CASE WHEN NOT valid THEN 'undecodable reply' END AS error
           FROM answers""",
    ),
    "failed_reads": query(
        ("answers",), "SELECT event_id, 'undecodable reply' AS error FROM answers WHERE NOT valid"
    ),
    "coerce_category": query(("answers",), "SELECT event_id, category FROM answers WHERE valid"),
    "coerce_severity": query(
        ("answers",), "SELECT event_id, CAST(severity AS INTEGER) AS severity FROM answers WHERE valid"
    ),
    "coerce_confidence": query(("answers",), "SELECT event_id, confidence FROM answers WHERE valid"),
    "cleared_reads": query(("reads",), f"SELECT event_id, category, severity FROM reads WHERE {CLEARED}"),
    "severity_meter": query(("reads",), f"SELECT event_id, {METER} AS meter FROM reads"),
    "skin_cards": query(
        ("reads",),
        f"""SELECT event_id, label, emoji, CAST(color AS INTEGER) AS color
            FROM reads JOIN {values(list(K.SKINS))} s(category, label, emoji, color) USING (category)""",
    ),
    "route_cards": query(("cards",), "SELECT event_id, category, channel FROM cards"),
    "cards": query(("cards",), f"SELECT {CARD} FROM cards"),
    "cards_by_channel": query(
        ("cards",), f"SELECT channel, {CARD} FROM cards WHERE channel IS NOT NULL"
    ),
    "queue_ranked": query(("cards",), f"SELECT event_id, severity, {QUEUE_RANK} AS rank FROM cards"),
    "drip_top": query(
        ("cards",),
        f"""SELECT event_id, category, severity, title FROM cards
            ORDER BY severity DESC, event_id LIMIT {TICK_CARDS}""",
    ),
    "drip_schedule": query(
        ("cards",),
        f"""SELECT event_id, severity, rank, (rank - 1) // 3 AS slot, {START_UNIX} + (rank - 1) // 3 * 90 AS due_unix
            FROM (SELECT event_id, severity, {QUEUE_RANK} AS rank FROM cards)""",
    ),
    "drip_dry": query(
        ("cards",),
        f"""SELECT event_id, 'dry' AS outcome, '[dry] ' || emoji || ' ' || label || ' — ' || title AS line
            FROM cards ORDER BY severity DESC, event_id LIMIT {TICK_CARDS}""",
    ),
    "drip_outcomes": query(
        ("outcomes",), "SELECT event_id, category, channel, outcome, line FROM outcomes"
    ),
    "queue_replay": query(
        ("replayed",),
        """SELECT severity, event_id, poll_id, left_poll, CAST(place AS BIGINT) AS place FROM replayed""",
    ),
    "poll_windows": """
        SELECT CAST(epoch(time_bucket(INTERVAL 10 MINUTES, ts)) AS BIGINT) AS start_unix, count(*) AS items
        FROM events GROUP BY 1""",
    "poll_summary": query(
        ("summary", "activity"),
        """SELECT poll_id, new, queued, CAST(seen AS BIGINT) AS seen, line
           FROM summary JOIN (SELECT poll_id, line FROM activity WHERE place = 0) USING (poll_id)""",
    ),
    "posted_counts": query(("outcomes",), f"SELECT {POSTED} FROM outcomes"),
    "status_snapshot": query(
        ("replayed",),
        f"""SELECT (SELECT count(*) FROM reads) AS seen,
                   (SELECT count(*) FROM cards) - count(*) AS queued, {POSTED},
                   (SELECT max(poll_id) FROM reads) * {POLL_SECONDS} AS last_poll_unix,
                   count(*) FILTER (WHERE outcome = 'posted') AS posted_total,
                   CAST({FLOOR} AS INTEGER) AS min_severity, {V.PARAMS.poll_minutes}::BIGINT AS poll_minutes,
                   {V.PARAMS.drip_seconds}::BIGINT AS drip_seconds, {len(K.CATALOGUE)}::BIGINT AS feeds
            FROM replayed""",
    ),
    "feedcheck": query(
        ("health",),
        """SELECT CAST(feed_ord AS INTEGER) AS feed_ord, source, hint, ok, payloads, CAST(items AS BIGINT) AS items,
                  CASE WHEN ok THEN '[ok ] ' || rpad(source, CAST(greatest(16, length(source)) AS INTEGER), ' ') || ' '
                           || lpad(CAST(items AS VARCHAR), CAST(greatest(3, length(CAST(items AS VARCHAR))) AS INTEGER), ' ')
                           || '  (' || upper(hint[1]) || hint[2:] || ')'
                       ELSE '[ERR] ' || rpad(source, CAST(greatest(16, length(source)) AS INTEGER), ' ') || ' ' || coalesce(reason, 'nothing landed')
                       END AS line
           FROM health""",
    ),
    "feedcheck_rollup": query(
        ("health",),
        """SELECT hint, source, count(*) FILTER (WHERE ok) AS feeds_ok,
                  CAST(sum(CASE WHEN ok THEN items ELSE 0 END) AS BIGINT) AS items,
                  CAST(grouping(hint, source) AS INTEGER) AS level
           FROM health GROUP BY ROLLUP (hint, source)""",
    ),
    "activity_log": query(
        ("activity",), f"SELECT poll_id, place, line FROM activity ORDER BY poll_id DESC, place DESC LIMIT {LOG_LINES}"
    ),
    "recent_log": query(
        ("activity",), f"SELECT poll_id, place, line FROM activity ORDER BY poll_id DESC, place DESC LIMIT {SNAPSHOT_LINES}"
    ),
    "activity_posted": query(
        ("activity",), "SELECT poll_id, place, line FROM activity WHERE line LIKE 'posted%'"
    ),
}
