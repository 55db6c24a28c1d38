"""URL filters by a sort-merge range join of canonical keys.

A host's labels are reversed ("www.example.org" -> "org,example,www,"), so a rule's host and all its subdomains are the
keys that start with the rule's key: an interval. Urls are dealt by Spark to ranges of keys that hold about as many rows
each and sorted there; equal keys are split by a number of the row, so a hot host, and copies of one page, fill several
ranges. In a range, rules and urls are swept once in order of key: the stack holds the rules whose intervals are open,
nested in each other, and a url looks through it for the longest rule whose path starts the url's. The longest rule is that of the most characters in host and path; of equals, the least as text.

A url that no rule fits gets the default verdict. Null urls, and those without "://", have empty host and path, which no
rule fits. Repeated rows stay, each with its verdict; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions


def host_of(url):
    """After the first "://" up to "/", "?", "#" or the end; A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: str) -> str:
    return "".join(f"{label}," for label in reversed(host.split("."))) if host else ""


class Sweep:
    """Rules met in order of key by urls in order of key; rules: (key, path, name, verdict). The stack holds the open ones."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.rules, self.order = rules, sorted(range(len(rules)), key=lambda i: (rules[i][0], rules[i][1], rules[i][2]))
        self.n, self.stack = 0, []

    def of(self, key: str, path: str) -> int:
        """The place of a url's rule, or -1. Keys do not fall from call to call."""
        rules, order, stack = self.rules, self.order, self.stack
        while self.n < len(order) and rules[order[self.n]][0] <= key:
            i = order[self.n]
            own = rules[i][0]
            while stack and not own.startswith(stack[-1][0]):
                stack.pop()
            if not stack or stack[-1][0] != own:
                stack.append((own, {}))
            stack[-1][1].setdefault(rules[i][1], i)
            self.n += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = (-1, "", -1)
        for _, paths in stack:
            # the rules of one host nest by path too: only prefixes of this path can fit
            for size in {len(p) for p in paths}:
                i = paths.get(path[:size], -1) if size <= len(path) else -1
                if i >= 0:
                    rank = (len(rules[i][2]), rules[i][2])
                    if rank[0] > best[0] or rank[0] == best[0] and rank[1] < best[1]:
                        best = (*rank, i)
        return best[2]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every page. rules: (host, path, verdict); a rule's name is host + path.

    The rules, a list of the caller, go to all tasks; a task's range takes those from its first key on.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(sorted({(reversed_key(h.lower()), p, h.lower() + p, v) for h, p, v in rules}))
    cut = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # by the row, not by its values: copies of one page part as well
    keyed = cut.withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), ","), F.lit(",")))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = keyed.repartitionByRange(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt").select("page_id", "host", "path", "key")

    def swept(batches):
        sweep, known = Sweep(sent.value), {}
        for batch in batches:
            rule, verdict, last = [], [], None
            for k, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    last = k
                    known.clear()
                i = known.get(path)
                if i is None:
                    i = sweep.of(k, path)
                    if len(known) < 1 << 16:
                        known[path] = i
                rule.append(sweep.rules[i][2] if i >= 0 else None)
                verdict.append(sweep.rules[i][3] if i >= 0 else default)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(cut.dtypes)["page_id"]
    return dealt.mapInArrow(swept, f"page_id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("page_id", key)
