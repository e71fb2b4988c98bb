"""Operator 2, secret scans, by DataFrame functions alone.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). The method adds others: runs of
key-like characters, without what base spans cover, are scored by two character Markov models, of random strings and of
ordinary identifiers. A run whose log-likelihood ratio reaches `threshold` nats becomes a span of kind `random`. In other
runs every stretch of `min_run` characters or more is scored, so that a name or path before or after a key cannot cancel
it: the best stretches that reach the threshold, widened to whole letter and digit groups, are spans. Stretches with less
than `threshold` nats of ordinary characters between them are one. Positions are code points, ends exclusive.

Work grows with the length of a text, or with the power 1.5 of its number of matches where that is more.

Null texts count as empty and have no spans. Repeated rows give repeated results, an empty table gives none, null ids
stay null. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.llm.common import keep

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
GROUPED = 63  # the first of these, without separators
#: Texts are cut into blocks of so many code points, since the way to a place in a text leads through all before it.
BLOCK = 1024
#: Words of identifiers; ordinary samples are put together from them.
IDENTIFIER_WORDS = (
    "account action active address after agent allow amount answer append archive argument array asset async attribute author available average background balance batch before binary block body border branch "
    "bridge browser buffer build button bytes cache callback cancel capacity category channel character check child client clock close cluster collection color column command comment commit common compare complete component "
    "config connection constant container content context control convert copy counter create current cursor customer daily database date debug default define delete delivery depth description destination detail device digest directory "
    "disable display distance document domain download driver duplicate duration dynamic element enable encode end engine entity entry environment error event example exception execute exist export extension external factory failure feature "
    "fetch field file filter final first flag folder font footer force format forward frame frequency function gateway general generate global graph group handler hash header height hidden history host identifier ignore image import "
    "include index initial input insert instance integer interface internal invalid item iterator join journal kernel keyboard label language last layout length level library limit link list listener load local location lock logger lookup "
    "manager mapping margin master match matrix maximum measure member memory menu merge message metadata method metric minimum mode model module monitor mount name native network next node normal notification number object offset open "
    "operation option order origin output owner package page parameter parent parse partition path pattern payment payload percent period permission physical pipeline pixel platform player plugin point policy pool position prefix previous "
    "price primary print priority process product profile progress project property protocol provider proxy public query queue random range rating reader record recursive reference refresh region register release remote remove render replace "
    "report repository request require reset resource response result retry return reverse route router runtime sample scale schedule schema scope screen script scroll search section select sender sequence server service session setting "
    "shadow shape shared signal simple size snapshot socket sort source space special speed stack standard start state statement static status storage stream string structure style submit success suffix summary support switch symbol system "
    "table target task template test text thread threshold time title total trace track transaction transfer transform transition translate tree trigger type unique unit update upload user utility valid value variable vector version view "
    "visible volume warning watch weight width window worker workflow wrapper write year zone that with from this there their which would these other through between another nation tion thing shall where while"
).split()


def labelled_samples(spark: SparkSession, n: int = 1500) -> DataFrame:
    """(label, text): n strings of each kind, made by rule from digests: random keys (1) and ordinary identifiers (0)."""
    ids = spark.range(n, numPartitions=2)
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    key = F.base64(F.unhex(digest))
    flat = F.translate(key, "+/=", "")
    random = ids.select(F.explode(F.array(digest, key, flat, F.upper(digest), F.upper(flat), F.lower(flat))).alias("text")).withColumn("label", F.lit(1))
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))

    a, b, c, d = (word(k) for k in range(4))
    number = F.pmod(F.xxhash64("id"), F.lit(2100)).cast("string")
    ordinary = ids.select(
        F.explode(
            F.array(
                F.concat_ws("_", a, b, c), F.concat_ws("-", b, c, a), F.concat_ws("/", a, b, c, number), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(a, b, c, d), F.concat(F.initcap(a), F.initcap(b), number), F.upper(F.concat_ws("_", a, b)),
                F.concat_ws("-", F.lit("20"), F.lpad(F.pmod(F.col("id"), F.lit(12)).cast("string"), 2, "0"), number), F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), 30), F.concat(F.col("id").cast("string"), number, number, number, number),
            )
        ).alias("text")
    ).withColumn("label", F.lit(0))
    return random.unionByName(ordinary)


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of transitions in thousandths of a nat, row by row over ALPHABET."""

    ratios: tuple[int, ...]

    def steps(self, text: Column) -> Column:
        """(before, code, ratio) of each transition: the characters' places in ALPHABET, and thousandths of a nat."""
        k = len(ALPHABET)
        table = F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<int>")
        codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        n = F.greatest(F.length(text) - 1, F.lit(0))
        return _let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.struct(a.alias("before"), b.alias("code"), F.element_at(table, (a - 1) * k + b).alias("ratio"))))

    def ratio(self, text: Column) -> Column:
        """Nats by which `text`, of characters of ALPHABET, is likelier as a random string."""
        return F.aggregate(self.steps(text), F.lit(0).cast("long"), lambda acc, x: acc + x["ratio"]) / 1000.0

    def stretches(self, text: Column, least: int, threshold: float) -> Column:
        """(start, end) of the stretches of `least` characters or more of `text` whose ratio reaches `threshold`, widened.

        One pass over sums of ratios: a stretch runs from the least sum that is `least` characters or more behind to the
        greatest since, and is closed once the sum has fallen by `threshold`, from where the next one may start. A stretch
        starts after the last separator before it and ends before the next one; one that is closed within such a group of
        letters, digits and plus signs is held until the group ends.
        """
        limit = round(1000 * threshold)
        none, pairs = F.lit(None).cast("int"), F.array().cast("array<struct<start:int,end:int>>")
        start = {
            "at": F.lit(0), "sum": F.lit(0), "group": F.lit(0), "late_sum": F.lit(0), "late_group": F.lit(0), "floor": F.lit(0), "low": none, "low_at": none,
            "best": F.lit(0), "start": none, "end": none, "top": F.lit(0), "open": F.lit(False), "held": none, "done": F.lit(0), "out": pairs,
        }
        kinds = {k: "int" for k in start} | {k: "long" for k in ("sum", "late_sum", "low", "best", "top")} | {"open": "boolean"}

        def changed(acc: Column, **new: Column) -> Column:
            return F.struct(*[(new[k].cast(v) if k in new and k != "out" else new.get(k, acc[k])).alias(k) for k, v in kinds.items()])

        def added(acc: Column, when: Column, a: Column, b: Column) -> dict[str, Column]:
            span = F.struct(F.greatest(a, acc["done"]).alias("start"), b.alias("end"))
            return {"out": F.when(when & (b > acc["done"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]), "done": F.when(when, b).otherwise(acc["done"])}

        def moved(acc: Column, x: Column) -> Column:
            """One character on: the sum up to it, and that up to the character from which on they are `least`."""
            at = acc["at"] + 1
            parted = x["code"] > GROUPED
            late_group = F.when(x["late"]["before"] > GROUPED, at - (least - 1)).otherwise(acc["late_group"])
            more = added(acc, parted & acc["held"].isNotNull(), acc["held"], at)
            return changed(acc, at=at, sum=acc["sum"] + x["ratio"], late_sum=acc["late_sum"] + F.coalesce(x["late"]["ratio"], F.lit(0)), late_group=late_group, open=acc["open"] & ~parted, end=F.when(acc["open"] & ~parted, at + 1).otherwise(acc["end"]), held=F.when(~parted, acc["held"]), **more)

        def raised(acc: Column) -> Column:
            lower = (acc["at"] - (least - 1) >= acc["floor"]) & (acc["low"].isNull() | (acc["late_sum"] < acc["low"]))
            low, low_at = F.when(lower, acc["late_sum"]).otherwise(acc["low"]), F.when(lower, acc["late_group"]).otherwise(acc["low_at"])
            better = F.coalesce(acc["sum"] - low > acc["best"], F.lit(False))

            def new(name: str, value: Column) -> Column:
                return F.when(better, value).otherwise(acc[name])

            return changed(acc, low=low, low_at=low_at, best=new("best", acc["sum"] - low), start=new("start", low_at), end=new("end", acc["at"] + 1), top=new("top", acc["sum"]), open=acc["open"] | better)

        def closed(acc: Column) -> Column:
            fallen = (acc["best"] >= limit) & (acc["top"] - acc["sum"] >= limit)
            more = added(acc, ~acc["open"], acc["start"], acc["end"])
            held = F.when(acc["open"], F.coalesce(acc["held"], acc["start"])).otherwise(acc["held"])
            return F.when(fallen, changed(acc, floor=acc["at"], low=none, best=F.lit(0), open=F.lit(False), held=held, **more)).otherwise(changed(acc))

        def last(acc: Column) -> Column:
            end = F.when(acc["held"].isNotNull() | acc["open"], acc["at"] + 1).otherwise(acc["end"])
            return added(acc, acc["held"].isNotNull() | (acc["best"] >= limit), F.coalesce(acc["held"], acc["start"]), end)["out"]

        def over(acc: Column, block: Column) -> Column:
            # every step copies the state, so what is found leaves it block by block
            state = F.aggregate(block, acc["state"], lambda st, x: _let(_let(moved(st, x), raised), closed))
            return _let(state, lambda st: F.struct(changed(st, out=pairs).alias("state"), F.concat(acc["all"], st["out"]).alias("all")))

        def of(steps: Column) -> Column:
            late = F.concat(F.array_repeat(F.lit(None).cast("struct<before:int,code:int,ratio:int>"), least - 1), steps)
            pieces = F.zip_with(steps, F.slice(late, F.lit(1), F.size(steps)), lambda x, y: F.struct(x["code"].alias("code"), x["ratio"].alias("ratio"), y.alias("late")))
            return _let(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK)))

        zero = F.struct(F.struct(*[(v if k == "out" else v.cast(kinds[k])).alias(k) for k, v in start.items()]).alias("state"), pairs.alias("all"))
        return F.aggregate(_let(self.steps(text), of), zero, over, lambda acc: F.concat(acc["all"], last(acc["state"])))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (none below 0) what `plus` makes of all before it, 0 for the first.

    Arrays grow by copies, so they grow within blocks of about the root of their number.
    """

    def run(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0)).cast("array<int>"), lambda acc, x: F.concat(acc, F.array(plus(F.element_at(acc, -1), x))))

    def of(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
        return _let(F.transform(blocks, run), lambda within: _let(run(F.transform(within, lambda w: F.element_at(w, -1))), lambda starts: F.flatten(F.transform(within, lambda w, i: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: plus(F.get(starts, i), x))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(of(v)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def train_markov(samples: DataFrame, smooth: float = 0.5) -> MarkovPair:
    """Counts transitions of both labels; at most 2 * len(ALPHABET) squared counts come to the driver."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2))))
    rows = samples.where(F.length("text") > 1).select("label", pair.alias("pair")).groupBy("label", "pair").count().collect()
    count = {(r.label, r.pair): r["count"] for r in rows}
    k = len(ALPHABET)
    out = []
    for a in ALPHABET:
        total = [sum(count.get((y, a + b), 0) for b in ALPHABET) for y in (0, 1)]
        for b in ALPHABET:
            p = [(count.get((y, a + b), 0) + smooth) / (total[y] + smooth * k) for y in (0, 1)]
            out.append(round(1000 * math.log(p[1] / p[0])))
    return MarkovPair(tuple(out))


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"

def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, inner) of all leftmost matches that don't overlap, from the gaps between them; inner is what `group` holds."""
    found, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), inner.alias("inner")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), x["inner"].alias("inner")))

    def placed(all_: Column) -> Column:
        before = _running(F.transform(all_, lambda x: x["gap"] + x["hit"]), _sum)
        at = F.zip_with(all_, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["hit"]).alias("end"), x["inner"].alias("inner")))
        return F.filter(at, lambda x: x["end"] > x["start"])

    return _let(sizes, placed)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def _replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with what spans cover replaced, where a span starts that no earlier one covers, by mark(characters covered by it).

    Spans come by start; characters that two spans cover count for the first.
    """

    def of(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            some = F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), lambda i: F.substring(F.get(blocks, i), F.greatest(a - i * BLOCK, F.lit(0)) + 1, b - i * BLOCK - F.greatest(a - i * BLOCK, F.lit(0))))
            return F.when(a < b, F.array_join(some, "")).otherwise("")

        reached = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        parts = F.zip_with(spans, reached, lambda s, r: F.concat(between(r, s["start"]), mark(F.struct(s["start"], s["end"], r.alias("reached")))))
        return F.concat(F.array_join(parts, ""), between(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), of))


def _with_spans(docs: DataFrame, model: MarkovPair, text_col: str, min_value: int, min_run: int, threshold: float) -> DataFrame:
    """(row, text, base, spans): the caller's columns are all within row, so that none can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast(SPAN)
    run = f"[{ALPHABET.replace('-', '')}-]{{{min_run},}}"

    def all_of(pattern: str, kind: str) -> Column:
        return F.when(text.rlike(pattern), F.transform(_matches(text, pattern), lambda m: _span(kind, m["start"], m["end"]))).otherwise(none)

    assign = F.transform(F.filter(_matches(text, ASSIGN, 1), lambda m: F.length(m["inner"]) >= min_value), lambda m: _span("assign", m["start"], m["end"]))
    rows = rows.withColumn("base", F.array_sort(F.concat(F.when(text.rlike(ASSIGN), assign).otherwise(none), all_of(ACCESS, "access"), all_of(HEX, "hex"))))
    # what is left of a run beside base spans is a run of its own
    rows = rows.withColumn("left", F.when(text.rlike(run), _replaced(text, F.col("base"), lambda s: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], s["reached"]), F.lit(0))))))

    def of_run(m: Column) -> Column:
        whole = model.ratio(m["inner"]) >= threshold
        parts = F.transform(model.stretches(m["inner"], min_run, threshold), lambda s: _span("random", m["start"] + s["start"], m["start"] + s["end"]))
        return F.when(whole, F.array(_span("random", m["start"], m["end"]))).otherwise(parts)

    rows = rows.withColumn("random", F.when(F.col("left").rlike(run), F.flatten(F.transform(_matches(F.col("left"), run), of_run))).otherwise(none))
    return rows.select("row", "text", "base", F.when(F.size("random") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "random"))).alias("spans"))


def secret_spans(docs: DataFrame, model: MarkovPair, *, id_col: str = "doc_id", text_col: str = "text", min_value: int = 8, min_run: int = 20, threshold: float = 10.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, spans): arrays of (start, rank, end, kind) by start, then by kind as in KINDS; `carry` names columns to keep."""
    own = list(dict.fromkeys((id_col, *carry)))
    found = _with_spans(keep(docs, *dict.fromkeys((*own, text_col))), model, text_col, min_value, min_run, threshold)
    return found.select(*[F.col("row")[c].alias(c) for c in own], "base", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by `mark`."""
    return _replaced(text, spans, lambda s: F.when(s["start"] >= s["reached"], F.lit(mark)).otherwise(""))


def redact_secrets(docs: DataFrame, model: MarkovPair, *, text_col: str = "text", length_col: str | None = "n_chars", min_value: int = 8, min_run: int = 20, threshold: float = 10.0) -> DataFrame:
    """docs with their secrets replaced and, if there is such a column, the length in code points set anew.

    All other columns, whatever their names, stay as they are; null texts stay null.
    """
    found = _with_spans(docs, model, text_col, min_value, min_run, threshold)
    found = found.select("row", "spans", redacted(F.col("text"), F.col("spans")).alias("text"))

    def column(c: str) -> Column:
        new = {text_col: F.col("text"), length_col: F.length("text").cast(docs.schema[c].dataType)}.get(c)
        return (F.col("row")[c] if new is None else F.when(F.size("spans") > 0, new).otherwise(F.col("row")[c])).alias(c)

    return found.select(*[column(c) for c in docs.columns])
