"""URL filters: a sort-merge range join of urls and rules by canonical keys.

A key is the host's labels in reverse; a rule's host is a prefix of the keys of its subdomains, so
it stands for an interval of keys, and intervals are nested or apart.  Each task sorts its urls by
key and sweeps them along the sorted hosts of the rules with a stack of those whose interval is open.
The paths of one host's rules are prefixes, so they are nested intervals as well: sorted, each with
the one around it.  The innermost around a url's path is found by bisection and a walk outwards; the
longest over the stack wins.  The urls are not shuffled.  Rules go to the tasks in blocks of a
fixed size, one sweep per block, each keeping the better rule.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BATCH_ROWS, arrow_schema, small_batches

#: Rules of one sweep; what a task holds of them is bounded by this.
BLOCK_RULES = 100_000
#: Ends a label in a key; below every character of a host.
MARK = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DDL = "page_id long, host string, path string, key string, rule string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, or empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end, or empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def host_key(host: str) -> str:
    return "".join(label + MARK for label in reversed(host.split(".")))


def _better(new: tuple[str, str], old: tuple[str, str] | None) -> bool:
    """Whether the rule (text, verdict) is longer; of equal rules, blocking ones win."""
    return old is None or (len(new[0]), *new) > (len(old[0]), *old)


class HostRules:
    """The rules of one host: sorted path prefixes, each with its rule and the prefix around it."""

    def __init__(self, host: str, paths: dict[str, str]):
        self.paths = sorted(paths)
        self.rules = [(host + p, paths[p]) for p in self.paths]
        self.around, open_ = [], []
        for k, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(k)

    def longest(self, path: str) -> tuple[str, str] | None:
        """The rule (text, verdict) with the longest prefix of ``path``."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return self.rules[k] if k >= 0 else None


def host_rules(rules: list[tuple[str, str, str]]) -> list[tuple[str, HostRules]]:
    """(key, rules) of each host in the order of the keys; ``rules`` are (verdict, host, path)."""
    hosts: dict[str, dict[str, str]] = {}
    for verdict, host, path in rules:
        own = hosts.setdefault(host, {})
        own[path] = max(verdict, own.get(path, ""))
    return sorted(((host_key(h), HostRules(h, p)) for h, p in hosts.items()), key=lambda x: x[0])


def _sweep(hosts: list[tuple[str, HostRules]]):
    """Maps sorted urls to their rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = 0, []
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            rows = batch.to_pydict()
            for k, (key, path) in enumerate(zip(rows["key"], rows["path"], strict=True)):
                while at < len(hosts) and hosts[at][0] <= key:
                    stack = [x for x in stack if hosts[at][0].startswith(x[0])]
                    stack.append(hosts[at])
                    at += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                best = (rows["rule"][k], rows["verdict"][k]) if rows["rule"][k] else None
                for _, own in stack:
                    rule = own.longest(path)
                    if rule and _better(rule, best):
                        best = rule
                if best:
                    rows["rule"][k], rows["verdict"][k] = best
            yield pa.RecordBatch.from_pydict(rows, schema=arrow_schema(_DDL))

    return run


def _blocks(rules: DataFrame | list[tuple[str, str, str]]) -> Iterator[list]:
    """The rules in blocks of about BLOCK_RULES."""
    if isinstance(rules, list):
        kept = [r for r in rules if r[1]]
        for at in range(0, len(kept), BLOCK_RULES):
            yield kept[at : at + BLOCK_RULES]
        return
    kept = rules.select("verdict", "host", "path").filter("host is not null and host <> ''")
    n = -(-kept.count() // BLOCK_RULES)
    for b in range(n):
        part = kept.filter(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == b)
        yield [(r["verdict"], r["host"], r["path"] or "") for r in part.collect()]


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | list[tuple[str, str, str]],
    default: str = "allow",
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row of ``pages``.

    ``rules`` are (verdict, host, path), as a list or a table.  A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest (host and path together)
    wins, then the greater text, then block over allow.  Without a rule, ``rule`` is null and the
    verdict is ``default``.  Urls of any length are read whole; those that are null or without ``://`` have an empty host and path, which
    no rule fits.  Rules with an empty host are ignored.  Repeated rows come out as often as they
    come in; an empty table gives an empty table; other columns are ignored.
    """
    reverse = F.array_join(F.reverse(F.split("host", r"\.")), MARK)
    out = small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
    ).select(
        "page_id",
        "host",
        "path",
        F.concat(reverse, F.lit(MARK)).alias("key"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"),
    )
    for block in _blocks(rules):
        out = out.sortWithinPartitions("key").mapInArrow(_sweep(host_rules(block)), _DDL)
    return out.select("page_id", "host", "path", "rule", "verdict")
