"""URL verdicts from pattern rules indexed by their rarest literal token.

A rule is a host (with all its subdomains) and a path beginning, or a wildcard
pattern over the whole URL. Every rule becomes one regular expression, and of
the literal tokens it needs, the one that the fewest URLs hold becomes its
index key; how many hold each is counted over all URLs first. A URL's tokens
fetch the candidate rules, and only those run their expression. The longest
host rule that fits wins; without one, any fitting block pattern blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        # path tokens only where they are whole: the last one may go on in the URL
        whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", self.path.lower())
        return re.findall(r"[a-z0-9]+", self.host) + whole

    def regex(self) -> re.Pattern:
        return re.compile(rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}", re.S)


@dataclass(frozen=True)
class Pattern:
    """``*`` stands for anything, ``^`` for a separator or an end; matches host and path."""

    verdict: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    def tokens(self) -> list[str]:
        return [t for p in self.pattern.split("*") for t in re.findall(r"(?<=\^)[a-z0-9]+(?=\^)", p)]

    def regex(self) -> re.Pattern:
        body = re.escape(self.pattern).replace(r"\*", ".*").replace(r"\^", r"(?:\A|\Z|[^a-z0-9])")
        return re.compile(rf"(?:.*?){body}", re.S)


# The rules of the registered query.
RULES = (HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"),
         HostRule("block", "example.org", "/en/1"), HostRule("allow", "com", "/fr/"),
         HostRule("block", "com", "/de/"))
PATTERNS = tuple(Pattern("block", p) for p in (
    "^casino^", "^poker^", "^pills^", "^viagra^", "^porn^", "^xxx^", "^adult^", "^spam^", "^malware^",
    "^phishing^", "^warez^", "^torrent^", "^click^*^tracker^", "^free^*^download^"))
WAVE_RULES = 200_000         # rules sent to every task at once: some tens of MB
TOKEN = "[a-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: list[str], host: str, path: str) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, over all rows."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("/", host, path)), F.lit(f"({TOKEN})"), 1))
    # the rules are a list in the driver's memory, so is the list of their tokens
    rows = (urls.select(F.explode(held).alias("token")).join(F.broadcast(wanted), "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return {r["token"]: r["n"] for r in rows.collect()}     # at most one row a token of the rules


STATE = "page_id long, host string, path string, rule string, fit string, pattern string"


def url_filter(pages: DataFrame, rules=RULES, patterns=PATTERNS, id_col: str = "page_id",
               url_col: str = "url", wave_rules: int = WAVE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern for every row.

    A null URL or one without ``://`` has an empty host and path, fits no rule
    and is allowed. Host rules of equal length are ranked by name. Repeated rows
    and null ids are judged each; an empty table gives an empty result; other
    columns are ignored. Rules are tried in waves of ``wave_rules``, each over
    the best rule and pattern found so far; between waves the rows are written.
    """
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(pages[url_col]).alias("host"),
                        path_of(pages[url_col]).alias("path"))
    every = [*rules, *patterns]
    needed = sorted({t for r in every for t in r.tokens()})
    counts = token_counts(urls, needed, "host", "path") if needed else {}
    none = F.lit(None).cast("string")
    out = urls.select("*", none.alias("rule"), none.alias("fit"), none.alias("pattern"))
    for at in range(0, len(every), wave_rules):
        if at:
            out = stored(out, "url-wave")
        out = out.mapInArrow(partial(_try, index=indexed(every[at:at + wave_rules], counts)), STATE)
    verdict = F.coalesce("fit", F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern")


def indexed(rules: list, counts: dict[str, int]) -> dict[str | None, list]:
    """Rules by their rarest token."""
    index: dict[str | None, list] = defaultdict(list)
    for r in rules:
        rarest = min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)
        index[rarest].append(r)              # a rule without a whole token is tried on every URL
    return dict(index)


def _try(batches: Iterator[pa.RecordBatch], index: dict[str | None, list]) -> Iterator[pa.RecordBatch]:
    """The longest fitting rule and the first blocking pattern, over those of waves before."""
    token, always = re.compile(TOKEN), index.get(None, [])
    regex = lru_cache(maxsize=100_000)(lambda r: r.regex())       # compiled when first fetched
    for batch in batches:
        best, fits, pattern = [], [], []
        for host, path, name, fit, block in zip(*(batch.column(c).to_pylist() for c in (
                "host", "path", "rule", "fit", "pattern"))):
            low = f"{host}/{path}".lower()
            for r in (*always, *(r for t in set(token.findall(low)) for r in index.get(t, ()))):
                if isinstance(r, HostRule):
                    if (name is None or (len(name), name) < (len(r.name), r.name)) and regex(r).match(f"{host}\n{path}"):
                        name, fit = r.name, r.verdict
                elif (block is None or r.name < block) and regex(r).match(low):
                    block = r.name
            best.append(name)
            fits.append(fit)
            pattern.append(block)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "host", "path")),
             *(pa.array(c, pa.string()) for c in (best, fits, pattern))],
            ["page_id", "host", "path", "rule", "fit", "pattern"])
