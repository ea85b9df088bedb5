"""Operator 13: URL filters. DataFrame functions only.

A rule is a pattern over a URL: literal characters, `*` (anything) and `^` (a character that is no
letter, digit, `_`, `-`, `.` or `%`, or an end). `||` at its start anchors it at the start of the host
or of one of its parent domains, `|` at the start or end of the URL; other patterns match anywhere.
A-Z match a-z. A path rule `example.org/es/` fits a host, all its subdomains and paths that start
with its path, letter for letter; it is a pattern like any other, with a regular expression that
reads the host and the path.

A token is a run of letters, digits, `_`, `-`, `%` of the lower-cased URL. A rule's literal tokens are those
that every URL it fits has as a whole: both their sides are literal characters, separators or anchors.
Each rule is filed under that one of its literal tokens which the fewest URLs of the whole table have;
a URL's distinct tokens fetch the rules that may fit it, and only those run their regular expressions.
A rule without literal tokens is filed under a token that every URL has.

The rules are an argument on the driver. Their index is broadcast up to BROADCAST_BYTES; beyond it,
it is joined by shuffle, with the URLs of each frequent token (more than one in HOT_PART of all rows of
tokens) dealt over SALTS salts and its rules copied to each of them.

The longest path rule that fits decides (of equal length the one with the longer host, then the blocking one).
Where none fits, an exception pattern allows, else a pattern that fits blocks, else the URL is allowed.

Defined cases: a null URL or one without `://` has empty host and path, no token and no path rule,
and is allowed unless a pattern without tokens fits; null keys and repeated rows each give their row;
columns of the table other than the keys and the URL are not read; a URL's whole length counts; an empty table gives
an empty result; no rules allow all. Rows are told apart by their place in the scan, which a
repeated task gives again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
BROADCAST_BYTES = 8 << 20
HOT_PART, SALTS = 256, 64
#: The token of every URL, under which rules without a literal token are filed.
EVERY = ""
#: Kinds of rules by precedence.
PATH, EXCEPTION, PATTERN = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "a-z0-9_%-"
HOST_START = r"^[^:/?#]*://(?:[^/?#]*\.)?"

#: Path rules of the query: action and host with path.
PATH_RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
#: Patterns of the query: sellers and farms by host, then pages that hold no text of their own.
PATTERNS = (
    (BLOCK, "||spam-farm."),
    (BLOCK, "||cheap-pills."),
    (BLOCK, "||casino-"),
    (BLOCK, "||ads."),
    (BLOCK, "/login^"),
    (BLOCK, "/cart^"),
    (BLOCK, "/search?"),
    (BLOCK, "/feed/|"),
    (BLOCK, ".pdf|"),
    (BLOCK, ".zip|"),
    (BLOCK, "/tag/*?page="),
    (ALLOW, "||docs.*/search?"),
    (ALLOW, "||blog.*/feed/|"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    kind: int
    regex: str
    tokens: tuple[str, ...]
    #: Path rules: characters of all, of the host.
    size: tuple[int, int] = (0, 0)


def path_rule(action: str, text: str) -> Rule:
    """A rule of a host and a path: example.org/es/. Its regular expression reads the host with the path."""
    host, slash, path = text.partition("/")
    if not host or not slash:
        raise ValueError(f"{text!r} has no host or no path")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), slash + path
    # a label of the host is whole; the last token of the path may go on in a URL
    tokens = re.findall(f"[{WORD}]+", host) + [m[0] for m in re.finditer(f"[{WORD}]+", _low(path)) if m.end() < len(path)]
    return Rule(text, action, PATH, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}", tuple(dict.fromkeys(tokens)), (len(text), len(host)))


def pattern(action: str, text: str) -> Rule:
    """A rule of a pattern; allow makes it an exception. Its regular expression reads the lower-cased URL."""
    body = _low(text)
    domain = body.startswith("||")
    start, end = domain or body.startswith("|"), len(body) > 1 and body.endswith("|")
    body = body[2 if domain else int(start) : len(body) - end]
    regex = "(?s)" + (HOST_START if domain else "^" if start else "")
    for c in body:
        regex += ".*" if c == "*" else rf"(?:[^.{WORD}]|\z)" if c == "^" else _quoted(c)
    tokens = []
    for m in re.finditer(f"[{WORD}]+", body):
        left = start if m.start() == 0 else body[m.start() - 1] != "*"
        right = end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            tokens.append(m[0])
    return Rule(text, action, EXCEPTION if action == ALLOW else PATTERN, regex + r"\z" * end, tuple(dict.fromkeys(tokens)))


def _low(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _quoted(text: str) -> str:
    return re.sub(r"([!-.:-@\[-^`{-~])", r"\\\1", text)


def default_rules() -> list[Rule]:
    return [path_rule(*r) for r in PATH_RULES] + [pattern(*r) for r in PATTERNS]


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #; A-Z as a-z. Empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What comes after the host, before ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL."""
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit(f"([{WORD}]+)"), F.lit(1)))


def rarest(urls: DataFrame, rules: list[Rule]) -> dict[str, str]:
    """For each rule the one of its tokens that the fewest rows of urls (tokens) have, the first in order of equal ones; EVERY without tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        asked = F.broadcast(asked) if sum(map(len, wanted)) < BROADCAST_BYTES else asked
        # a row for each token of a rule at most
        counts = {r.token: r.n for r in urls.select(F.explode("tokens").alias("token")).join(asked, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=EVERY) for r in rules}


def _fetched(urls: DataFrame, rules: list[Rule], filed: dict[str, str]) -> DataFrame:
    """urls, a row for each token and each rule that it fetches and that fits; rule is null where none does."""
    rows = [(filed[r.name], r.name, r.action != BLOCK, r.kind, r.regex, -r.size[0], -r.size[1]) for r in rules]
    index = urls.sparkSession.createDataFrame(rows, "token string, rule string, mild boolean, kind int, regex string, size int, host_size int")
    each = urls.withColumn("found_by", F.explode(F.array_append("tokens", EVERY))).drop("tokens")
    subject = F.when(F.col("kind") == PATH, F.concat("host", "path")).otherwise(F.coalesce(F.translate("url", UPPER, LOWER), F.lit("")))
    fits = (each.found_by == index.token) & F.regexp_like(subject, F.col("regex"))
    if sum(len(r[1]) + len(r[4]) for r in rows) < BROADCAST_BYTES:
        return each.join(F.broadcast(index), fits, "left")
    known = each.select(F.col("found_by").alias("token")).join(index.select("token").distinct(), "token", "left_semi")
    least = each.agg(F.count("*")).first()[0] // HOT_PART
    hot = [r.token for r in known.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > least).select("token").collect()]  # HOT_PART tokens at most
    salted = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
    each = each.withColumn("salt", F.when(salted("found_by"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0))
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(salted("token"), SALTS - 1).otherwise(0)))).hint("shuffle_hash")
    fits = (each.found_by == index.token) & (each.salt == index["copy"]) & F.regexp_like(subject, F.col("regex"))
    return each.join(index, fits, "left")


def judge(pages: DataFrame, rules: list[Rule], keys: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """keys, host, path, rule (the path rule that decides, else null), pattern (the one that decides, else null), verdict of every row of pages."""
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("two rules have the same text")
    held = {f"key{i}": F.col(f"`{k}`") for i, k in enumerate(keys)}
    link = F.col(f"`{url}`").cast("string")
    tokens = F.coalesce(tokens_of(link), F.array().cast("array<string>"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in held.items()], link.alias("url"), host_of(link).alias("host"), path_of(link).alias("path"), tokens.alias("tokens"))
    found = _fetched(urls, rules, rarest(urls.select("tokens"), rules)).where((F.col("found_by") == EVERY) | F.col("rule").isNotNull())
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct("kind", "size", "host_size", "mild", "rule")))
    best_of = found.groupBy("row", *held, "host", "path").agg(best.alias("best"))
    kind, name = F.col("best.kind"), F.col("best.rule")
    return best_of.select(
        *[F.col(h).alias(k) for h, k in zip(held, keys, strict=True)],
        "host",
        "path",
        F.when(kind == PATH, name).alias("rule"),
        F.when(kind != PATH, name).alias("pattern"),
        F.when(kind.isNull() | F.col("best.mild"), ALLOW).otherwise(BLOCK).alias("verdict"),
    )
