"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regex yields a Boolean query over trigrams that any matching text must hold (Cox, 2012).
The index holds, for each trigram that some rule asks for, the posting lists of the texts with it, in chunks of texts of bounded
size. Lists of a conjunction are intersected chunk by chunk, a rule's conjunctions united, and only the
texts that remain are verified with the regex. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, read_table, row_key


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the dialect that Java's and Python's regexes share; ``group`` must have at least
    ``least`` characters, else the match is dropped (it still uses up its characters)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base rules come first and in this order.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 1),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", 0, 1),
)

#: Texts whose postings share a chunk, about: a posting list holds so many numbers of 8 bytes at most.
CHUNK_TEXTS = 16_384
#: Matches that are folded in one go.
FOLD = 256
#: More exact strings than this for a piece of a regex, and it counts as unknown.
MOST_STRINGS = 16


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of lower-case trigrams, one of which every match holds; ``[]``: no such trigrams.

    Walks Python's own parse of the regex. A piece is a set of exact strings where there are few, else
    unknown; neighbouring exact pieces are joined, and what stands between unknown ones must occur.
    """
    from re import _constants as C
    from re import _parser

    def exact(items) -> set[str] | None:
        """All strings, in lower case, that the items can match."""
        found = {""}
        for op, arg in items:
            if op is C.LITERAL:
                more = {chr(arg).lower()}
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is C.SUBPATTERN:
                more = exact(arg[3])
            elif op is C.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 2:
                one = exact(arg[2])
                more = None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
            else:
                more = None
            if more is None or len(found) * len(more) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in more}
        return found

    items, runs, held = list(_parser.parse(pattern)), [], []
    for item in items:
        if exact([*held, item]) is not None:
            held.append(item)
        else:
            runs.append(held)
            held = [item] if exact([item]) is not None else []
    choices = [[_trigrams(s) for s in exact(run)] for run in [*runs, held] if run]
    choices = [c for c in choices if all(c)]
    if not choices:
        return []
    best = max(choices, key=lambda c: (min(map(len, c)), -len(c)))  # the run whose shortest string is longest
    return sorted(set(best), key=sorted)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """A filled array in slices of ``FOLD`` elements: folds that append to a list then copy at most so many."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")), lambda b: F.slice(items, b * FOLD + 1, F.lit(FOLD)))


def matches(text: Column, rule: Rule) -> Column:
    """Array of ``(start, end)`` of the rule's matches: leftmost, non-overlapping, in code points.

    The lengths of the pieces between matches and of the matches give every place, first within slices of the matches, then
    moved by what stands before the slice; too short ones are dropped.
    """
    lengths = lambda x: F.transform(x, lambda v: F.length(v))
    found = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    judged = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else found
    zipped = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), found.alias("hit"), judged.alias("judged"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["judged"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def moved(parts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + p["at"])
        shift = lambda p, n: F.transform(p["out"], lambda s: F.struct((s["start"] + n).alias("start"), (s["end"] + n).alias("end")))
        return F.flatten(F.transform(parts, lambda p, i: _let(before(i), lambda n: shift(p, n))))

    # the piece after the last match has no match beside it
    folded = _let(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda zs: _let(F.transform(_blocks(zs), lambda b: F.aggregate(b, start, add)), moved))
    # most texts hold none: one search settles that
    return F.when(text.rlike(rule.pattern), folded).otherwise(F.array().cast(_PLACES))


def _found(text: Column, rule: Rule) -> Column:
    """The matches as ``(start, rank, kind, end)``, so that sorting puts them by place, then by rule."""
    rank = RULES.index(rule) if rule in RULES else len(RULES)
    return F.transform(matches(text, rule), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))


_PLACES = "array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def postings(rows: DataFrame, rules: tuple[Rule, ...], chunks: int) -> DataFrame:
    """The inverted index ``(trigram, chunk, texts)``: a trigram's sorted-out posting list of the chunk's texts (``pid``). Equal texts of
    an id are one; lists are made in each partition before they are shuffled."""
    wanted = sorted(set().union(*(t for r in rules for t in trigram_query(r.pattern))))
    # a column of its own, so that it is worked out once a text; a filter on what
    # follows, such as a plain explode brings, would put it back into each use
    low = rows.select("pid", F.lower("text").alias("low"))
    held = low.select("pid", F.filter(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in wanted)), lambda t: t.isNotNull()).alias("held"))
    posted = held.select("pid", F.explode_outer("held").alias("trigram")).where("trigram is not null")
    return posted.groupBy("trigram", F.pmod("pid", F.lit(chunks)).alias("chunk")).agg(F.collect_set("pid").alias("texts"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(pid, kinds)``: the rules of which some conjunction is met. A conjunction's posting lists of a chunk are intersected, shortest first."""
    terms = [(r.kind, sorted(t)) for r in rules for t in trigram_query(r.pattern)]
    asks = F.array(*(F.struct(F.lit(n).alias("term"), F.lit(kind).alias("kind"), F.lit(len(t)).alias("size"), F.array(*map(F.lit, t)).alias("trigrams")) for n, (kind, t) in enumerate(terms)))
    asked = index.select("trigram", "chunk", "texts", F.explode(F.filter(asks, lambda a: F.array_contains(a["trigrams"], F.col("trigram")))).alias("a"))
    lists = asked.groupBy("a.term", "a.kind", "a.size", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.size("texts").alias("n"), "trigram", "texts"))).alias("lists"))
    whole = lists.where(F.size("lists") == F.col("size"))  # a trigram that no text of the chunk has ends the matter
    met = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(1))), F.col("lists")[0]["texts"], lambda held, x: F.array_intersect(held, x["texts"]))
    return whole.select("kind", F.explode(met).alias("pid")).groupBy("pid").agg(F.collect_set("kind").alias("kinds"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id``, ``key``, the columns in ``carry`` and ``spans`` (sorted; empty where nothing is found).

    A null text counts as empty. Rows with the same id and text are judged alike, and each stays. Texts
    travel only where a rule's trigrams are met; other rows move no text. Other columns don't matter.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    rows = docs.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    # texts are named by a hash of id and text: where two shared one, both would be verified
    rows = rows.withColumn("pid", F.xxhash64("doc_id", "key"))
    indexed = tuple(r for r in rules if queries[r.kind])
    full = [r for r in rules if not queries[r.kind]]
    hits = rows.select("pid").where(F.lit(False)).select("pid", F.lit(None).cast("long").alias("h_key"), F.lit(None).cast(_SPANS).alias("more"))
    if indexed:
        chunks = max(1, math.ceil(docs.count() / CHUNK_TEXTS))
        index = materialize(postings(rows, indexed, chunks), "secret-postings")
        found = materialize(candidates(index, indexed).withColumnRenamed("pid", "f_pid"), "secret-candidates")
        # any match holds the first trigram of one of the conjunctions: this cheap test keeps other texts out of the shuffle
        firsts = sorted({min(t) for r in indexed for t in queries[r.kind]})
        low = rows.select("pid", "key", "text", F.lower("text").alias("low"))
        some = low.where(F.exists(F.array(*map(F.lit, firsts)), lambda t: F.contains("low", t)))
        spans = F.concat(*(F.when(F.array_contains("kinds", r.kind), _found(F.col("text"), r)).otherwise(F.array().cast(_SPANS)) for r in indexed))
        joined = some.join(found, F.col("pid") == F.col("f_pid")).select("pid", "key", spans.alias("more"))
        hits = joined.where(F.size("more") > 0).groupBy("pid", F.col("key").alias("h_key")).agg(F.first("more").alias("more"))
        hits = materialize(hits, "secret-hits")
    own = F.concat(*(_found(F.col("text"), r) for r in full)) if full else F.array().cast(_SPANS)
    scanned = rows.select("doc_id", "key", "pid", own.alias("own"), *carry)
    hits = hits.withColumnRenamed("pid", "h_pid")
    both = scanned.join(hits, (F.col("pid") == F.col("h_pid")) & (F.col("key") == F.col("h_key")), "left")
    return both.select("doc_id", "key", F.array_sort(F.concat("own", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"), *carry)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row the counts of the base kinds, the digest of the base spans, and all spans as text."""
    spans = secret_spans(docs, rules)

    def shown(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in rules if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return spans.select("doc_id", *map(count, kinds), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans become one mark.

    ``n_chars``, where it is there, follows the new text. A null text stays null.
    """
    names = docs.columns
    # every column travels under another name, so that none clashes with those made here
    carried = docs.select(*(F.col(c).alias(f"_own_{c}") for c in names), F.col("doc_id"), F.col("text"))
    found = secret_spans(carried, rules, tuple(f"_own_{c}" for c in names))
    def blotted(spans: Column, base: Column, piece: Column) -> Column:
        """The piece of text that starts at ``base`` and ends with the last of the spans, blotted."""
        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))

        def add(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, acc["at"] - base + 1, s["start"] - acc["at"])
            new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

        return F.aggregate(spans, start, add, lambda acc: F.array_join(acc["out"], ""))

    # slices of spans each work on their own stretch of the text, so that the cost grows with the text and not with its square
    text, stops = F.col("_own_text"), F.transform("spans", lambda s: s["end"])
    last = lambda ends, n: F.coalesce(F.array_max(F.slice(ends, F.lit(1), n)), F.lit(0))

    def slices(ends: Column) -> Column:
        done = lambda b, i: _let(last(ends, i * FOLD), lambda base: _let(F.substring(text, base + 1, F.greatest(last(ends, (i + 1) * FOLD), base) - base), lambda piece: blotted(b, base, piece)))
        rest = _let(F.array_max(ends), lambda top: F.substring(text, top + 1, F.length(text)))
        return F.concat(F.array_join(F.transform(_blocks(F.col("spans")), done), ""), rest)

    clean = F.when(F.size("spans") > 0, _let(stops, slices)).otherwise(text)
    done = found.select(*(clean.alias("text") if c == "text" else F.col(f"_own_{c}").alias(c) for c in names))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else done


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def python_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """The same spans by Python's own regexes, to test against."""
    out = []
    for rank, rule in enumerate(rules):
        out += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]
