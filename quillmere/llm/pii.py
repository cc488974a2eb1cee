"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how far each can be trusted, and
what they say together teaches a final classifier of spans, which also sees words that no labeler knows.

The texts are read once. A task finds the base spans by their expressions, and candidates by wider ones; each candidate gets the votes of
regex, gazetteer and context labelers and a window of the words around it. Votes are counted over all documents, by pattern, so the
reliabilities (Dawid and Skene, 1979) rest on every candidate while the driver sees only patterns. The classifier is fitted on a bounded
draw of windows with the probabilities of their patterns as targets, and judges every candidate. Base spans stay whatever it says.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_rows, materialize, read_table, text_chunks

#: Kinds of the base spans, and those that candidates may add, in the order of output.
BASE = ("email", "ip", "card", "phone")
ADDED = ("hidden_email", "local_phone", "id_number", "iban", "name", "street")
KINDS = BASE + ADDED
#: At most so many windows teach the classifier, an equal share of each kind.
MAX_TRAIN_WINDOWS = 20_000
#: Hashed features of the classifier, its ridge and its steps.
BUCKETS, RIDGE, STEPS = 1 << 13, 1e-3, 300
#: A candidate of an added kind counts from this probability on: clean texts are to be left alone.
THRESHOLD = 0.8
#: Text that is worked on at a time in a task, and characters looked at on either side of a candidate.
CHUNK_BYTES, AROUND = 4 << 20, 60

# Public lists for the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int io info biz dev app co me ai eu uk us de fr es it nl be ch at pl se no dk fi ie pt gr cz hu ro ru ua tr in cn jp kr br mx ar ca au nz za".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "353", "358", "380", "420", "971", "972")
FIRST_NAMES = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen anna maria peter paul laura julia martin hans klaus jürgen petra sabine wolfgang jean pierre marie claire luc sophie camille jose juan carlos luis ana carmen pablo elena ahmed fatima wei li yuki raj priya olga ivan".split())
CUES = {
    "email": "mail email e-mail contact write correo courriel kontakt".split(),
    "ip": "ip address host server adresse dirección from client".split(),
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment".split(),
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono whatsapp".split(),
    "id_number": "ssn social security passport id-number ausweis".split(),
    "iban": "iban account bank konto compte cuenta transfer".split(),
    "name": "mr mrs ms dr prof name herr frau madame señor señora dear signed sincerely".split(),
    "street": "address lives street adresse wohnt calle rue".split(),
}
CUES |= {"hidden_email": CUES["email"], "local_phone": CUES["phone"]}
AGAINST = frozenset("version v release order invoice item isbn issn page pages line chapter section total sum price usd eur build commit hash sha token key id no nr ref reference example placeholder".split())

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is taken whole, with or without three more behind dots, so that none is tried from within
_IP = re.compile(r"[0-9][0-9]*+((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIDDEN = re.compile(r"[ ]?(?:\(at\)|\[at\]|\{at\}| at )[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}| dot )[ ]?[A-Za-z0-9-]{1,63})+", re.I)
_WIDE = {
    "local_phone": re.compile(r"[(0-9][0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{4}"),
    "id_number": re.compile(r"[0-9][0-9][0-9]-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z][A-Z][0-9][0-9](?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?"),
    "name": re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?=[ ]([A-ZÀ-Þ][a-zß-ÿ]{1,30}))"),  # so that the second word may begin another
    "street": re.compile(r"[0-9][0-9]{0,4}[ ](?:[A-Z][a-z]{1,30}[ ]){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Ln|Blvd)"),
}
_words = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    return (sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _local_part(text: str, low: int, at: int) -> int:
    """Where the local part of an address begins that ends before ``at``."""
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind: emails, addresses of four parts up to 255, card numbers of 14 to 19 digits with a good check sum, and
    phone numbers of 10 to 15 digits behind a plus. Leftmost and not overlapping within a kind; a match that fails its test is dropped
    and uses up its characters. An email is sought from its ``@``, so nothing steps back over a long run."""
    out, last = [], 0
    for m in _AT.finditer(text) if "@" in text else ():
        begin = _local_part(text, last, m.start())
        if begin < m.start():
            out.append((begin, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if m[1] and all(map(_octet, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def wide_spans(text: str) -> list[Span]:
    """Candidates of the added kinds; those glued to letters or digits are none."""
    out = []
    if "dot" in text or "DOT" in text or "Dot" in text:
        for m in _HIDDEN.finditer(text):
            begin = _local_part(text, max(0, m.start() - 64), m.start())
            if begin < m.start():
                out.append((begin, KINDS.index("hidden_email"), m.end()))
    for kind, pattern in _WIDE.items():
        for m in pattern.finditer(text):
            end = m.end(1) if kind == "name" else m.end()
            before, after = text[max(0, m.start() - 1) : m.start()], text[end : end + 1]
            if kind == "name" and not _may_be_name(text, m):
                continue
            if not (before.isalnum() or before in ("+", "-", ".", "_", "/", "=") and before or after.isalnum() or after in ("_", "=") and after):
                out.append((m.start(), KINDS.index(kind), end))
    return sorted(out)


def _may_be_name(text: str, m: re.Match) -> bool:
    """Two capitalised words are a candidate only behind a cue or with a listed first name."""
    if m[0].lower() in FIRST_NAMES:
        return True
    before = _words.findall(text[max(0, m.start() - 20) : m.start()].lower())
    return bool(before) and before[-1] in CUES["name"]


# --- labelers: each takes the kind, the span's text, the words before it, the words after it and the characters beside it ---


def _format(kind, span, before, after, sides):
    """Regex: the usual way to write such a thing, or a way to write something else."""
    digits = re.sub(r"[^0-9]", "", span)
    if digits and len(set(digits)) == 1:
        return "-"
    strict = {
        "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "ip": r"[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}", "card": r"[0-9]{4}([ -]?[0-9]{4}){2}[ -]?[0-9]{2,7}",
        "phone": r"\+[1-9][0-9]{0,2}[ -]?\(?[0-9]{1,4}\)?([ .-]?[0-9]{2,4}){2,4}", "hidden_email": r"\S+ ?[([{]at[)\]}] ?\S+.*", "local_phone": r"(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}",
        "id_number": r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}( [A-Z0-9]{4}){3,7}( [A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", "street": r".* (Street|Avenue|Road|Lane|Drive|Boulevard)",
    }.get(kind)
    return "0" if strict is None else "+" if re.fullmatch(strict, span) else "-"


def _check(kind, span, before, after, sides):
    """Regex: what sums, lengths and ranges say."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "card":
        return "+" if luhn(digits) else "-"
    if kind == "iban":
        code = re.sub(r"\s", "", span)
        return "+" if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else "-"
    if kind == "ip":
        return "-" if span.startswith(("0.", "127.", "255.")) else "+"
    if kind == "id_number":
        return "-" if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    if kind in ("phone", "local_phone"):
        return "+" if 9 <= len(digits) <= 13 else "-"
    return "0"


def _listed(kind, span, before, after, sides):
    """Gazetteer: top domains, calling codes and first names."""
    words = _words.findall(span.lower())
    if kind in ("email", "hidden_email"):
        return "+" if words and words[-1] in TOP_DOMAINS else "-"
    if kind == "phone":
        return "+" if span[1:].startswith(CALLING_CODES) else "-"
    if kind == "name":
        return "+" if words and words[0] in FIRST_NAMES else "-"
    return "0"


def _cue(kind, span, before, after, sides):
    """Context: a word before it that announces such a thing, or something else."""
    return "+" if set(CUES[kind]) & set(before) else "-" if AGAINST & set(before[-2:]) else "0"


def _company(kind, span, before, after, sides):
    """Context: other personal data close by."""
    return "+" if "@" in sides[2] or re.search(r"\+[0-9]", sides[2]) else "0"


def _standing(kind, span, before, after, sides):
    """Context: stands free in the line, or inside quotes, paths and assignments."""
    return "-" if set(sides[0] + sides[1]) & set("\"'`=/\\#&{}<>_") else "+" if (not sides[0] or sides[0].isspace()) and (not sides[1] or sides[1].isspace() or sides[1] in ".,;!?") else "0"


LABELERS = (_format, _check, _listed, _cue, _company, _standing)


@dataclass(frozen=True)
class Candidate:
    start: int
    kind: int
    end: int
    votes: str
    window: str


def candidate(text: str, span: Span) -> Candidate:
    """The span with its votes, and what the classifier sees of it: kind, shape, words around, characters beside."""
    start, k, end = span
    kind, inside = KINDS[k], text[start:end]
    left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    before, after = _words.findall(left.lower())[-4:], _words.findall(right.lower())[:2]
    sides = (left[-1:], right[:1], left + " " + right)
    votes = "".join(label(kind, inside, before, after, sides) for label in LABELERS)
    shape = re.sub(r"[a-zß-ÿ]{3,}", "aa", re.sub(r"[^\W\d_a-zß-ÿ]", "A", re.sub(r"[0-9]", "0", inside[:64])))
    return Candidate(start, k, end, votes, "\x1f".join([kind, shape, " ".join(re.sub("[0-9]", "0", w) for w in before), " ".join(re.sub("[0-9]", "0", w) for w in after), left[-1:], right[:1]]))


# --- reliabilities ---

#: What is thought of a labeler before anything is counted: the chance of +, 0 and - for personal data and for the rest, and its weight in votes.
PRIOR, PRIOR_WEIGHT = {"+": (0.55, 0.1), "0": (0.35, 0.35), "-": (0.1, 0.55)}, 20.0


def learn_reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]]]:
    """From vote patterns and their counts: each pattern's probability of personal data, and each labeler's chance of each vote for personal
    data and for the rest. Expectation-maximisation with the prior above, begun with the prior."""
    if not patterns:
        return {}, []
    n = np.array([c for _, c in patterns], float)
    hot = np.array([[[v == x for x in "+0-"] for v in votes] for votes, _ in patterns], float)  # pattern, labeler, vote
    prior = np.array([PRIOR[x] for x in "+0-"])  # vote, class
    chance = np.repeat(prior[None], hot.shape[1], axis=0)
    share = 0.5
    for _ in range(rounds):
        fit = np.einsum("plv,lvc->pc", hot, np.log(chance)) + np.log([share, 1 - share])
        p = 1 / (1 + np.exp(np.clip(fit[:, 1] - fit[:, 0], -50, 50)))
        weight = np.stack([p * n, (1 - p) * n], axis=1)
        chance = np.einsum("plv,pc->lvc", hot, weight) + PRIOR_WEIGHT * prior[None]
        chance /= chance.sum(axis=1, keepdims=True)
        share = (weight[:, 0].sum() + PRIOR_WEIGHT / 2) / (n.sum() + PRIOR_WEIGHT)
    return {votes: float(x) for (votes, _), x in zip(patterns, p)}, [{x: tuple(c[k]) for k, x in enumerate("+0-")} for c in chance]


# --- classifier ---


def features(window: str) -> list[int]:
    kind, shape, before, after, left, right = window.split("\x1f")
    marks = [f"k{kind}", f"l{kind}{left}", f"r{kind}{right}"] + [f"s{kind}{shape[i : i + 3]}" for i in range(max(1, len(shape) - 2))]
    marks += [f"b{w}" for w in before.split()] + [f"b{kind}{w}" for w in before.split()] + [f"a{kind}{w}" for w in after.split()]
    return sorted({zlib.crc32(m.encode("utf-8", "replace")) % BUCKETS for m in marks})


def fit(windows: list[str], target: list[float]) -> np.ndarray:
    """Ridge logistic regression on probabilities, by Adam; zeros, a probability of a half, from no windows."""
    w = np.zeros(BUCKETS)
    if not windows:
        return w
    found = [features(x) for x in windows]
    row, col = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
    y, m, v = np.asarray(target), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for step in range(1, STEPS + 1):
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)), -30, 30))) - y
        g = np.bincount(col, miss[row], BUCKETS) / len(y) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def probability(w: np.ndarray, window: str) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[features(window)].sum(), -30, 30))))


# --- jobs ---

_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([*_SPAN, ("votes", pa.string()), ("window", pa.string())])
_SPAN_SQL = "array<struct<start:bigint,kind:int,end:bigint>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, CHUNK_BYTES):
        base, wide = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            own = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            wide.append([vars(candidate(text, x)) for x in [*own, *wide_spans(text)]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(wide, pa.list_(_CANDIDATE))], names=["doc_id", "base", "candidates"])


def find_candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, the ``base`` spans and all ``candidates`` with votes and windows, written once: the texts are not read again."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_extract, f"doc_id {kind}, base {_SPAN_SQL}, candidates array<struct<start:bigint,kind:int,end:bigint,votes:string,window:string>>")
    return materialize(found, "pii-candidates")


@dataclass(frozen=True)
class Trained:
    """``weights`` of the classifier; ``reliabilities``: of each kind and labeler the chance of each vote for personal data and for the rest."""

    weights: np.ndarray
    reliabilities: dict[str, list[dict[str, tuple[float, float]]]]
    patterns: dict[tuple[int, str], float]


def train(found: DataFrame, most: int = MAX_TRAIN_WINDOWS) -> Trained:
    """Reliabilities from the votes of all candidates, by pattern; the classifier from at most ``most`` distinct windows."""
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", F.col("c.window").alias("text"))
    counted = each.groupBy("kind", "votes").count().collect()
    patterns, reliabilities = {}, {}
    for k, kind in enumerate(KINDS):
        own = sorted((r.votes, r["count"]) for r in counted if r.kind == k)
        if own:
            chances, reliabilities[kind] = learn_reliabilities(own)
            patterns |= {(k, votes): p for votes, p in chances.items()}
    drawn = sorted((r.text, r.kind, r.votes) for r in bounded_rows(each, most, "kind").select("text", "kind", "votes").collect()) if counted else []
    return Trained(fit([x for x, _, _ in drawn], [patterns[k, votes] for _, k, votes in drawn]), reliabilities, patterns)


def _judge(weights: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, likely = [], []
            for own, wide in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
                kept = [(b["start"], b["kind"], b["end"]) for b in own]
                scored = {(c["start"], c["kind"], c["end"]): probability(weights, c["window"]) for c in wide}
                more = sorted((x[0] - x[2], -p, x) for x, p in scored.items() if x[1] >= len(BASE) and p >= threshold)
                taken = set()
                for s, _, e in kept:
                    taken.update(range(s, e))
                for _, _, x in more:  # the longest first, since a part of a span is no span of its own
                    if taken.isdisjoint(range(x[0], x[2])):
                        taken.update(range(x[0], x[2]))
                        kept.append(x)
                kept.sort()
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in kept])
                likely.append([scored[x] for x in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(spans, pa.list_(_SPAN)), pa.array(likely, pa.list_(pa.float64()))], names=["doc_id", "base", "spans", "likely"])

    return run


def personal_data(docs: DataFrame, most: int = MAX_TRAIN_WINDOWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id``, ``base`` and ``spans`` (arrays of start, kind as a place in ``KINDS`` and end, in code points, sorted) and ``likely``,
    the classifier's probability of each span.

    Every base span is among ``spans``, whatever its probability; an added span overlaps no other. A null text counts as empty; rows are
    judged one by one, so repeated rows and null ids each stay. Other columns do not matter. Without candidates nothing is added.
    """
    found = find_candidates(docs)
    trained = train(found, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_judge(trained.weights, threshold), f"doc_id {kind}, base {_SPAN_SQL}, spans {_SPAN_SQL}, likely array<double>")


def shown(spans: str):
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    told = personal_data(read_table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")

    return told.select("doc_id", *map(count, range(len(BASE))), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
