"""Operator 6, URL filters: allow and block rules first, then a naive Bayes model of segmented host and path tokens.

Host labels are split into words by Viterbi over unigram frequencies, counted over the words of all page titles; words
of a share of `least_share` or more are kept, which are at most 1 / least_share. The multinomial model learns from the
pages that a rule decides: its counts are exact, token by token, over all of them. Weights of frequent tokens (1 / COMMON
or more of all tokens of all pages, so COMMON at most) go to the workers, those of all others are joined. A page that no
rule decides is blocked if the model finds that likelier.

Null urls and urls without `://` have an empty host and path, no rule, and the verdict of the model's prior (allow if the
model saw no page of one class). Repeated rows give repeated results, an empty table gives none, null ids stay null.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinward.llm.common import ascii_lower, bounded_batches, cut, keep

COMMON = 1 << 15
_WORD = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path-prefix

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as (text, verdict); null if none does."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def title_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over all titles."""
    title = F.regexp_extract(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select(F.explode(F.split(F.lower(title), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").count().withColumnRenamed("count", "n")


def fit_words(pages: DataFrame, *, html_col: str = "html", least_share: float = 1e-5) -> dict[str, float]:
    """Log probabilities of the frequent title words: 1 / least_share of them at most."""
    words = title_words(pages, html_col)
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.where(F.col("n") >= least_share * total).toArrow().to_pydict()
    return {w: math.log(n / total) for w, n in zip(rows["word"], rows["n"], strict=True)}


def segment(label: str, words: dict[str, float], longest: int = 24) -> list[str]:
    """The likeliest split of letters into words; unknown words cost more the longer they are."""
    floor = math.log(1e-5)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            w = label[start:end]
            options.append((best[start][0] + words.get(w, floor - 2.3 * len(w)), start))
        best.append(max(options))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


@dataclass
class UrlModel:
    words: dict[str, float]
    weight: dict[str, float] = field(default_factory=dict)  # log ratio of block to allow of a frequent token
    rare: DataFrame | None = None  # (token, weight) of the other tokens of ruled pages; None without a prior
    unseen: float = 0.0
    prior: float = -math.inf
    known: dict[str, list[str]] = field(default_factory=dict)

    def tokens(self, host: str, path: str) -> list[str]:
        if host not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[host] = ["h:" + w for part in host.split(".")[:-1] or [host] for x in _WORD.findall(part) for w in (segment(x, self.words) if x.isalpha() else [f"#{len(x)}"])]
        return self.known[host] + ["p:" + (x if x.isalpha() else f"#{len(x)}") for x in _WORD.findall(path.lower())]

    def score(self, host: str, path: str) -> tuple[float, list[str]]:
        """Log odds of block by the prior and the frequent tokens, and the tokens that are still to be looked up."""
        tokens = self.tokens(host, path)
        return self.prior + sum(self.weight[t] for t in tokens if t in self.weight), [t for t in tokens if t not in self.weight]


def parsed(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, ruled): ruled is the rule's verdict."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parts = keep(pages, id_col, url_col).select(id_col, host.alias("host"), path.alias("path")).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return parts.select(id_col, "host", "path", F.col("_rule.text").alias("rule"), F.col("_rule.verdict").alias("ruled"))


def fit_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_share: float = 1e-5, smooth: float = 0.5) -> UrlModel:
    """Counts each token over all pages, by rule; COMMON rows and a few sums at most come to the driver."""
    bounded_batches(pages.sparkSession)
    model = UrlModel(fit_words(pages, html_col=html_col, least_share=least_share))
    words = replace(model)
    rows = parsed(pages, rules, id_col=id_col, url_col=url_col).select("host", "path", "ruled")

    def counted(held: Counter[tuple[str, str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "ruled", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str | None]] = Counter()
        for batch in batches:
            for host, path, ruled in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held["", ruled] += 1  # no token is empty: this counts pages
                for t in words.tokens(host, path):
                    held[t, ruled] += 1
            if len(held) > 50_000:
                yield counted(held)
                held.clear()
        yield counted(held)

    def of(verdict: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ruled") == verdict, F.col("n"))), F.lit(0))

    counts = cut(rows.mapInArrow(count, "token string, ruled string, n long").groupBy("token").agg(of("block").alias("block"), of("allow").alias("allow"), F.sum("n").alias("n")), "url-tokens")
    ruled_pages = counts.where("token = ''").first()
    block, allow = (ruled_pages.block, ruled_pages.allow) if ruled_pages else (0, 0)
    if block and allow:
        tokens = counts.where("token <> ''")
        sums = tokens.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.sum("n").alias("n"), F.count_if(F.col("block") + F.col("allow") > 0).alias("seen")).first()
        total = {v: (sums[v] or 0) + smooth * (sums.seen + 1) for v in ("block", "allow")}
        model.prior = math.log(block / allow)
        model.unseen = math.log(total["allow"] / total["block"])
        common = F.col("n") * COMMON >= (sums.n or 0)
        model.weight = {r.token: math.log((r.block + smooth) / (r.allow + smooth)) + model.unseen for r in tokens.where(common).collect()}
        model.rare = tokens.where(~common & (F.col("block") + F.col("allow") > 0)).select("token", (F.log((F.col("block") + smooth) / (F.col("allow") + smooth)) + model.unseen).alias("weight"))
    return model


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_odds) for each row of pages."""
    rows = parsed(pages, rules, id_col=id_col, url_col=url_col)
    bounded_batches(pages.sparkSession)
    local = replace(model, rare=None)
    names = [id_col, "host", "path", "rule", "ruled", "block_odds", "rest"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(i).to_pylist() for i in (1, 2))
            odds = [local.score(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in odds], pa.float64()), pa.array([x[1] for x in odds], pa.list_(pa.string()))], names=names)

    judged = rows.mapInArrow(judge, f"`{id_col}` {rows.dtypes[0][1]}, host string, path string, rule string, ruled string, block_odds double, rest array<string>")
    if model.rare is not None:
        # equal rows are one until their tokens are added up; no token that is looked up has more than 1 / COMMON of all
        waiting = judged.where(F.size("rest") > 0).groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias("copies")).withColumn("token", F.explode("rest"))
        found = waiting.join(model.rare, "token", "left").withColumn("weight", F.coalesce("weight", F.lit(model.unseen)))
        added = found.groupBy(*[F.col(f"`{n}`") for n in [*names, "copies"]]).agg(F.array_sort(F.collect_list("weight")).alias("weights"))
        added = added.withColumn("block_odds", F.aggregate("weights", F.col("block_odds"), lambda acc, x: acc + x)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        judged = judged.where(F.size("rest") == 0).unionByName(added.select(*[F.col(f"`{n}`") for n in names]))
    verdict = F.coalesce("ruled", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return judged.select(F.col(f"`{id_col}`"), "host", "path", "rule", verdict.alias("verdict"), "block_odds")
