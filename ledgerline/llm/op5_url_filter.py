"""URL filters by a weighted vocabulary and by rules on host and path.

One Aho-Corasick pass over the url (A-Z lower-cased) finds the vocabulary's terms; a hit counts only where the
characters before and after are no letters or digits. A strict term rejects alone, soft terms do from `soft_needed`
different ones on. Rules go first: a rule fits its host and all subdomains of it if the path starts with the rule's
path, and the longest fitting rule decides.

Vocabulary and rules are parameters: tables (term, weight) and (host, path, verdict), or tuples of such rows. They go to every
executor, so a table of more than MOST_ROWS rows is refused. Terms and hosts are folded as urls are.

Cases: a null url, or one without `://`, has an empty host and path, fits no rule, and is judged on what text it has.
Repeated rows and null identifiers are returned as they came; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import _FOLD, table

# The default vocabulary and rules.
STRICT = (
    "adultfriend", "betting", "bitchute-porn", "camgirl", "camgirls", "casino", "cialis", "crack-download", "escort", "escorts", "fuck",
    "gambling", "hentai", "jackpot", "keygen", "link-farm", "milf", "onlyfans-leak", "payday-loans", "porn", "porno", "pornstar", "roulette",
    "sex", "sexcam", "slot-machine", "spam-farm", "sportsbook", "torrent-crack", "viagra", "warez", "xvideos", "xxx",
)
SOFT = (
    "adult", "affiliate", "bonus", "buy-now", "cash", "cheap", "click-here", "clickbait", "coupon", "credit", "dating", "deals", "discount",
    "earn-money", "free", "giveaway", "hot", "limited-offer", "loan", "loans", "lottery", "mortgage", "pills", "poker", "prize", "promo",
    "replica", "sexy", "sweepstakes", "utm_source", "weight-loss", "win", "winner",
)
SOFT_NEEDED, MOST_ROWS = 2, 5_000_000
VOCABULARY = (*((term, "strict") for term in STRICT), *((term, "soft") for term in SOFT))
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_LOWER = {c: int(_FOLD[c]) for c in range(65, 91)}
#: What a worker made of the parameters that it had last, so that its next task need not.
_MADE: dict = {}
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


def rows_of(given: DataFrame | tuple, n: int) -> list[tuple]:
    """The rows of a parameter table, checked for size, or the tuples that were given."""
    if not isinstance(given, DataFrame):
        return list(given)
    rows = [tuple(r)[:n] for r in given.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows cannot be sent to every executor")
    return rows


class Rules:
    """Rules by host: those of a url's host and of each host above it are looked up, whatever their number."""

    def __init__(self, rows):
        self.paths: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rows:
            self.paths.setdefault(host.translate(_LOWER), []).append((path, verdict))

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule as text, verdict) of the longest rule that fits; of equally long ones that of the longest host."""
        best, above = None, host
        while above:
            for start, verdict in self.paths.get(above, ()):
                if path.startswith(start) and (best is None or len(above) + len(start) > len(best[0])):
                    best = above + start, verdict
            above = above.partition(".")[2]
        return best


def automaton(vocabulary=VOCABULARY):
    """Aho-Corasick over the terms, with whether each is strict; None without terms."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        if folded := (term or "").translate(_LOWER):
            found.add_word(folded, (folded, weight == "strict" or found.get(folded, ("", False))[1]))
    found.make_automaton()
    return found if len(found) else None


def _inside_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def hits(url: str, vocabulary) -> tuple[set[str], set[str]]:
    """The different strict and soft terms of a url."""
    text = url.translate(_LOWER)
    strict, soft = set(), set()
    for last, (term, is_strict) in vocabulary.iter(text):
        if not _inside_word(text, last - len(term)) and not _inside_word(text, last + 1):
            (strict if is_strict else soft).add(term)
    return strict, soft


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, vocabulary: DataFrame | tuple = VOCABULARY, soft_needed: int = SOFT_NEEDED, rules: DataFrame | tuple = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits) of every row."""
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kinds = {"host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(), "strict_hits": pa.int64(), "soft_hits": pa.int64()}
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *(T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in kinds.items())])

    shared = pages.sparkSession.sparkContext.broadcast((rows_of(vocabulary, 2), rows_of(rules, 3)))

    own = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _MADE.get("own") != own:
            _MADE.update(own=own, made=(automaton(shared.value[0]), Rules(shared.value[1])))
        terms, own_rules = _MADE["made"]
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = own_rules.fitting(host, path)
                hard, mild = hits(url, terms) if url and terms else (set(), set())
                rejected = bool(hard) or len(mild) >= soft_needed
                rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if rejected else "allow", len(hard), len(mild)))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _term_sql(terms) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END" for t in terms)


def _rule_sql(column: int) -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    when = (f"WHEN starts_with(path, '{p}') AND (host = '{h}' OR ends_with(host, '.{h}')) THEN '{(h + p, v)[column]}'" for h, p, v in longest_first)
    return f"CASE {' '.join(when)} END"


ORACLE_SQL = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), b AS (
  SELECT page_id, u,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS ruled,
         CAST({_term_sql(STRICT)} AS BIGINT) AS strict_hits, CAST({_term_sql(SOFT)} AS BIGINT) AS soft_hits
  FROM b
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM c
"""
