"""Repair of conversations by the cheapest edits, as a fold of Spark SQL expressions.

A repaired conversation has the roles ``(system? (user assistant)+)?``. Its turns are kept (``K``), given another role (``R``), deleted
(``D``) or put in (``I``); the automaton of the pattern has four states, and ``aggregate`` carries for each the cheapest (cost, audit)
that ends there, the least of native structs: by cost, then by the audit string in ASCII order. Equal costs with the same turns read
never make one audit a prefix of another, so what is least so far stays least whatever follows.

Rows are ranged and sorted by conversation and turn once, and a conversation is folded in slices of at most ``SLICE`` turns that lie in
one range: a conversation with a third of all rows is many slices, in many tasks. A slice that does not begin its conversation is folded
from each state, and a second fold chains the slices. Only audits, one letter a turn, come together in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, read_table

#: Turns that one fold reads.
SLICE = 512
#: The automaton's states: nothing yet; after a system turn; after a user turn; after a user and an assistant turn.
STATES = ("start", "system", "user", "whole")
DELETE, REROLE, INSERT = 3, 2, 2
_WAY = "struct<cost:bigint,audit:string,path:array<int>>"
_PIECES = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Repair:
    """``report``: one row per conversation, with the faults found, the cost and the audit. ``slices``: the repaired turns, in order of
    ``at`` within a conversation, as arrays of ``(role, text)``."""

    report: DataFrame
    slices: DataFrame

    def turns(self) -> DataFrame:
        """``conv_id, slice, place, role, text``: the repaired turns in order of slice and place."""
        return self.slices.select("conv.conv_id", F.col("at").alias("slice"), F.posexplode("pieces").alias("place", "t")).select("conv_id", "slice", "place", "t.role", "t.text")


def _way(cost: Column, audit: Column, path: Column) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"), path.alias("path"))


def _go(way: Column, cost: Column | int, letter: Column | str, allowed: Column | None = None) -> Column:
    """``way`` with one more edit; null where there is no such way."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    more = _way(way["cost"] + cost, F.concat(way["audit"], letter), way["path"])
    return F.when(way.isNotNull() if allowed is None else way.isNotNull() & allowed, more)


def _with_inserts(s: Column) -> Column:
    """A user or assistant turn put in at this place, or both."""
    user = F.least(s["user"], *(_go(s[p], INSERT, "I") for p in ("start", "system", "whole")))
    whole = F.least(s["whole"], _go(s["user"], INSERT, "I"), *(_go(s[p], 2 * INSERT, "II") for p in ("start", "system")))
    return F.struct(s["start"].alias("start"), s["system"].alias("system"), user.alias("user"), whole.alias("whole"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _states(**ways: Column) -> Column:
    return F.struct(*(ways.get(s, F.lit(None).cast(_WAY)).cast(_WAY).alias(s) for s in STATES))


def _read(acc: Column, t: Column) -> Column:
    """The four ways after one more turn, inserts behind it included."""
    able, late = ~t["bad"], t["late"]

    def made(role: str) -> tuple[Column, Column]:
        own = t["initial"] == role
        return F.when(own, late).otherwise(late + REROLE), F.when(own, "K").otherwise("R")

    out = {s: _go(acc[s], DELETE, "D") for s in STATES}
    out["system"] = F.least(out["system"], _go(acc["start"], late, "K", able & (t["initial"] == "s")))
    out["user"] = F.least(out["user"], *(_go(acc[p], *made("u"), able) for p in ("start", "system", "whole")))
    out["whole"] = F.least(out["whole"], _go(acc["user"], *made("a"), able))
    return _let(F.struct(*(out[s].alias(s) for s in STATES)), _with_inserts)


def _fold(turns: Column, begins: str) -> Column:
    """The cheapest ways through a slice that begin in a state; inserts before a slice belong to the one before, if there is one."""
    nothing = _states(**{begins: _way(F.lit(0).cast("bigint"), F.lit(""), F.array().cast("array<int>"))})
    return F.aggregate(turns, _with_inserts(nothing) if begins == "start" else nothing, _read)


def _chain(slices: Column) -> Column:
    """The cheapest ways through all slices; ``path`` has the state before each slice."""

    def add(acc: Column, x: Column) -> Column:
        def joined(n: int, begins: str, ends: str) -> Column:
            a, b = acc[begins], x["ways"][n][ends]
            return F.when(a.isNotNull() & b.isNotNull(), _way(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"]), F.concat(a["path"], F.array(F.lit(n)))))

        return F.struct(*(F.least(*(joined(n, p, q) for n, p in enumerate(STATES))).alias(q) for q in STATES))

    return F.aggregate(slices, _states(start=_way(F.lit(0).cast("bigint"), F.lit(""), F.array().cast("array<int>"))), add)


def _rendered(turns: Column, audit: Column, begins: Column) -> Column:
    """The repaired turns of a slice by its part of the audit."""
    none = F.struct(F.lit(0).alias("n"), begins.alias("state"), F.array().cast(_PIECES).alias("out"))

    def step(acc: Column, letter: Column) -> Column:
        t, own = F.get(turns, acc["n"]), F.when(acc["state"] == 2, "assistant").otherwise("user")
        role = F.when(letter == "K", t["role"]).otherwise(own)
        piece = F.struct(role.alias("role"), F.when(letter == "I", "").otherwise(t["text"]).alias("text"))
        state = F.when(letter == "D", acc["state"]).when((letter == "K") & (t["initial"] == "s"), 1).when(acc["state"] == 2, 3).otherwise(2)
        return F.struct(
            (acc["n"] + F.when(letter == "I", 0).otherwise(1)).alias("n"),
            state.alias("state"),
            F.when(letter == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).cast(_PIECES).alias("out"),
        )

    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    return F.aggregate(letters, none, step, lambda acc: acc["out"])


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> Repair:
    """The cheapest repair of each conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``; other columns do not matter).

    A row's first fault counts: ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (does not
    end in ``.``, ``!`` or ``?``). Blank and duplicate rows are deleted; a truncated one that stays costs one more. ``illegal`` counts
    neighbours whose roles' initials are not ``su``, ``ua`` or ``au``. ``gaps`` are the whole numbers that are missing between the least and
    the greatest turn.

    A null role or text counts as one space. Rows go by turn, null turns first, equal turns by role, then by the text's SHA-256, so
    repeated rows stand side by side. Null ids are one conversation. ``conversations`` may name more ids, which are reported without
    faults where ``rows`` has none of them; an empty table gives no rows.
    """
    some = "[^\\x20\\x09-\\x0D]"
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    clean = rows.select(F.struct("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text")).withColumn("digest", F.sha2("text", 256))
    order = ["conv", "turn", "role", "digest"]
    ranged = clean.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    blank, ended = ~F.col("text").rlike(some), F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    ranged = materialize(ranged.select("*", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended")), "conversation-turns")
    # the upper bits of the numbers tell the range: a slice is a stretch of one conversation in one range
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("conv", "part").agg(F.min("at").alias("low"))
    parts = parts.withColumn("opens", F.row_number().over(Window.partitionBy("conv").orderBy("part")) == 1)
    # a row is no duplicate if it is the first of its role and text; each first finds its slice by its number
    firsts = ranged.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).withColumn("part", F.shiftright("at", 33))
    firsts = firsts.join(parts.select("conv", "part", "low"), ["conv", "part"]).groupBy("conv", "part", _slice().alias("slice")).agg(F.collect_list("at").alias("firsts"))

    cut = ranged.join(parts, ["conv", "part"]).withColumn("slice", _slice())
    near = Window.partitionBy("conv", "part", "slice").orderBy("at")
    flagged = cut.select("*", F.lag("initial").over(near).alias("before"), F.lag("turn").over(near).alias("last_turn"))
    jars = F.col("before").isNotNull() & ~_legal(F.col("before"), F.col("initial"))
    new_turn = F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("turn") != F.col("last_turn")))
    turn = F.struct("at", "turn", "role", "text", "initial", "blank", "ended", jars.alias("jars"), new_turn.alias("new_turn"))
    sliced = flagged.groupBy("conv", "part", "slice").agg(F.first("opens").alias("opens"), F.array_sort(F.collect_list(turn)).alias("turns"))
    sliced = sliced.join(firsts, ["conv", "part", "slice"], "left")

    def judged(t: Column) -> Column:
        again = ~t["blank"] & ~F.coalesce(F.array_contains("firsts", t["at"]), F.lit(False))
        bad = t["blank"] | again
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), t["initial"].alias("initial"), t["turn"].alias("turn"), t["jars"].alias("jars"), t["new_turn"].alias("new_turn"), t["blank"].alias("blank"), again.alias("again"), bad.alias("bad"), F.when(bad | t["ended"], 0).otherwise(1).cast("bigint").alias("late"))

    told = sliced.select("conv", (F.col("opens") & (F.col("slice") == 0)).alias("opens"), F.col("turns")[0]["at"].alias("at"), F.transform("turns", judged).alias("turns"))
    count = lambda test: F.size(F.filter("turns", test)).cast("bigint")
    numbers = F.transform("turns", lambda t: t["turn"])
    first, last = F.col("turns")[0], F.element_at("turns", -1)
    ways = F.when(F.col("opens"), F.array(_fold(F.col("turns"), "start"))).otherwise(F.array(*(_fold(F.col("turns"), s) for s in STATES)))
    folded = told.select(
        "conv", "at", "turns", ways.alias("ways"),
        count(lambda t: t["blank"]).alias("blank"), count(lambda t: t["again"]).alias("duplicate"), count(lambda t: t["late"] == 1).alias("truncated"),
        count(lambda t: t["jars"]).alias("illegal"), count(lambda t: t["new_turn"]).alias("distinct"),
        F.array_min(numbers).alias("least"), F.array_max(numbers).alias("greatest"), first["turn"].alias("first_turn"), last["turn"].alias("last_turn"),
        first["initial"].alias("first_initial"), last["initial"].alias("last_initial"),
    )
    folded = materialize(folded, "conversation-slices")
    chained = materialize(_chained(folded.drop("turns"), conversations), "conversation-chains")
    report = chained.select("conv.conv_id", "head", F.coalesce(F.col("greatest") - F.col("least") + 1 - F.col("distinct"), F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    return Repair(report, _repaired(folded, chained))


def _chained(slices: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """One row per conversation: its slices' counts together, what their borders add, and the best way through all."""
    if conversations is not None:
        ids = conversations.select(F.struct("conv_id").alias("conv")).distinct()
        slices = slices.unionByName(ids, allowMissingColumns=True)
    each = F.struct("at", *(c for c in slices.columns if c not in ("conv", "at")))
    together = slices.groupBy("conv").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), each))).alias("slices"))
    ways = together.select("*", _chain(F.col("slices")).alias("ways"))
    ended = ways.select("conv", "slices", F.least("ways.start", "ways.whole").alias("best"), F.coalesce(F.col("ways.whole") <= F.col("ways.start"), F.col("ways.whole").isNotNull()).alias("whole"))

    def over_borders(test) -> Column:
        """How many pairs of neighbouring slices pass the test."""
        most = F.greatest(F.size("slices") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("slices", F.lit(1), most), F.slice("slices", F.lit(2), most), lambda a, b: F.coalesce(test(a, b), F.lit(False)))
        return F.size(F.filter(pairs, lambda x: x)).cast("bigint")

    total = lambda c: F.aggregate("slices", F.lit(0).cast("bigint"), lambda n, s: n + s[c])
    return ended.select(
        "conv", "slices", "best", "whole", F.get("slices", F.lit(0))["at"].alias("head"), *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (total("illegal") + over_borders(lambda a, b: ~_legal(a["last_initial"], b["first_initial"]))).alias("illegal"),
        (total("distinct") - over_borders(lambda a, b: a["last_turn"] == b["first_turn"])).alias("distinct"),
        F.array_min(F.transform("slices", lambda s: s["least"])).alias("least"), F.array_max(F.transform("slices", lambda s: s["greatest"])).alias("greatest"),
    )


def _repaired(folded: DataFrame, chained: DataFrame) -> DataFrame:
    """Each slice's turns after repair, from the state in which the best way comes to it."""
    ends = F.coalesce(F.get("best.path", F.col("k") + 1), F.when(F.col("whole"), 3).otherwise(0))
    step = chained.select("head", "best", "whole", F.size("slices").alias("n_slices"), F.posexplode(F.transform("slices", lambda s: s["at"])).alias("k", "at"))
    step = step.select("head", "n_slices", "at", F.get("best.path", F.col("k")).alias("begins"), ends.alias("ends"))
    way = F.get("ways", F.when(F.size("ways") == 1, 0).otherwise(F.col("begins")))
    audit = F.get(F.array(*(way[s]["audit"] for s in STATES)), F.col("ends"))
    return folded.select("conv", "at", "turns", "ways").join(step, "at").select("conv", "head", "n_slices", "at", _rendered(F.col("turns"), audit, F.col("begins")).alias("pieces"))


def _slice() -> Column:
    return F.floor((F.col("at") - F.col("low")) / SLICE)


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def _hash_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal ``head``, whatever its length: only a batch is held."""
    head, state, schema = None, None, pa.schema([("head", pa.int64()), ("repaired_sha256", pa.string())])
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
    for batch in batches:
        out = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if h != head:
                if state:
                    out.append((head, state.hexdigest()))
                head, state = h, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(text.encode("utf-8", "replace"))
        if out:
            yield rows(out)
    if state:
        yield rows([(head, state.hexdigest())])


def repaired_digests(slices: DataFrame) -> DataFrame:
    """``head, repaired_sha256`` of the repaired ``role:text`` lines. A conversation in one slice is hashed where it is; the texts of longer ones
    stream through a hash in order, since SHA-256 has no parts."""
    lines = F.array_join(F.transform("pieces", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    shown = slices.where(F.size("pieces") > 0).select("head", "n_slices", "at", lines.alias("lines"))
    short = shown.where("n_slices = 1").select("head", F.sha2("lines", 256).alias("repaired_sha256"))
    long = shown.where("n_slices > 1").repartition("head").sortWithinPartitions("head", "at").select("head", "lines")
    return short.unionByName(long.mapInArrow(_hash_long, "head long, repaired_sha256 string"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults put in by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    repair = repair_conversations(damage(rows), rows)
    told = repair.report.join(repaired_digests(repair.slices), "head", "left")
    return told.drop("head").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
