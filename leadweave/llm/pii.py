"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans come from strict patterns and always stay. Loose patterns give more candidates (numbers with other
groupings, written-out addresses, names behind a title, keys and tokens, card numbers inside longer runs of digits). On each candidate, base or not, five labelers vote yes (1),
no (-1) or abstain (0): a format pattern, a gazetteer, words before, the characters around, and its shape.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability without labels; its posteriors
then train a logistic span classifier on features that the labelers don't see all of. Candidates it accepts are added
if they overlap no base span of their document.

Everything that reads text is an SQL expression; the driver sees counts by vote and feature pattern only, of
which there are at most |KINDS| * 3^5 * 4 * 2.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The base patterns by kind, in the order of the contract.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, written so that no match or failed try goes back over a long run: possessive repeats, and for mail
#: addresses a start at a run's first character or where the last match ended only.
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
}
#: Candidates beyond the base patterns.
LOOSE = {
    "number": r"(?<![\w.])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,5}(?![\w])",
    "address": r"(?i)[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63}){1,4}",
    "name": r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Mlle|Sra?)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])",
    "card_run": r"(?<![\w.+])[0-9]{14,19}(?![\w])",
}
# Gazetteers. Common top-level domains, calling codes, issuer prefixes of cards, given names, and prefixes of issued keys.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "ai", "app", "dev", "co", "me", "tv", "us", "ca", "mx", "br", "ar", "cl", "uk", "ie", "fr", "de", "at", "ch", "es", "pt", "it", "nl", "be", "lu",
    "dk", "se", "no", "fi", "is", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "tr", "ru", "ua", "eu", "il", "za", "ng", "ke", "eg", "ma", "in", "pk", "cn", "hk", "tw", "jp", "kr", "sg", "my", "th", "vn", "ph", "id", "au", "nz",
)
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "385", "386", "420", "421", "852", "886", "966", "971", "972",
)
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
NAMES = (
    "Alexander", "Alice", "Ana", "Andrea", "Andrew", "Anna", "Anne", "Antoine", "Antonio", "Barbara", "Carlos", "Carmen", "Charles", "Christian", "Claire", "Daniel", "David", "Elena", "Elisabeth", "Emily", "Emma", "Eva", "Fernando",
    "Francisco", "Franz", "Friedrich", "George", "Hannah", "Hans", "Heinrich", "Helena", "Henri", "Isabel", "James", "Jan", "Jean", "John", "Jose", "Joseph", "Juan", "Julia", "Karl", "Katharina", "Laura", "Linda", "Louis", "Lucia",
    "Luis", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Michel", "Miguel", "Nicolas", "Olivia", "Patricia", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Rafael", "Richard", "Robert", "Sarah", "Sofia", "Sophie",
    "Stefan", "Susan", "Thomas", "Victoria", "William", "Wolfgang",
)
KEY_PREFIXES = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|sk_test_|pk_live_|SG\.|eyJ|ya29)"
SECRET_CUES = r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|key|bearer|authorization|credentials?)\b[\x22'\s]{0,3}[:=]{0,2}>?[\s\x22']{0,3}$"
SECRET_NEGATIVE_CUES = r"(?i)\b(?:commit|sha1?|sha256|md5|checksum|hash|digest|etag|uuid|integrity|rev|revision)\b\W{0,6}$"
CUES = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|cell|card|visa|konto|address|host|from|name|signed|kontakt|telefon|correo|courriel)\b\W{0,3}$"
NEGATIVE_CUES = r"(?i)\b(?:version|v|isbn|issn|order|page|pp|vol|section|id|sha|token|build|license|licence)\b\W{0,4}$"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = (*BASE, *LOOSE)
#: Kinds whose strict check is arithmetic: a candidate that fails it teaches the models, but is never added.
VETO = ("card", "ip", "card_run")
LABELERS = ("format", "gazetteer", "before", "around", "shape")
#: EM: rounds, and the votes that each labeler is credited with before any are counted (yes on true, no on false).
ROUNDS, PRIOR_HITS, PRIOR_MISSES = 40, 40.0, 10.0
CONTEXT = 40
#: Base spans of a document up to which all are looked at for each candidate, not found by bisection.
FEW = 32
#: Matches whose places are summed up at once.
CHUNK = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Places are summed up by chunks of CHUNK matches, so that lists are copied within a chunk and once for each chunk only.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    at = lambda acc, x: acc["pos"] + F.length(x["gap"])
    nothing = F.array().cast("array<struct<start:int,end:int,s:string>>")
    add = lambda acc, x: F.when(x["hit"].isNull(), acc).otherwise(
        F.struct(
            (at(acc, x) + F.length(x["hit"])).alias("pos"),
            F.concat(acc["out"], F.array(F.struct(at(acc, x).alias("start"), (at(acc, x) + F.length(x["hit"])).alias("end"), x["hit"].alias("s")))).alias("out"),
        )
    )
    one = lambda part, pos: F.aggregate(part, F.struct(pos.alias("pos"), nothing.alias("out")), add)
    chunk = lambda acc, k: F.transform(F.array(one(F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)), acc["pos"])), lambda done: F.struct(done["pos"].alias("pos"), F.concat(acc["out"], F.array(done["out"])).alias("out")))[0]
    whole = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(pairs) / CHUNK).cast("int")), F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<struct<start:int,end:int,s:string>>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(pairs) <= CHUNK, one(pairs, F.lit(0))["out"]).otherwise(whole)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn check."""
    d, n = _digits(s), F.length(_digits(s))
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, F.lit(9)).otherwise(F.lit(0))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(F.when((n - i) % 2 == 1, doubled(i)).otherwise(digit(i)), F.lit(0)))
    return total % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match of a base pattern is a span."""
    n = F.length(_digits(s))
    if kind == "ip":
        return s.rlike(f"^(?:{_PART}\\.){{3}}{_PART}$")
    if kind == "card":
        return (n >= 14) & (n <= 19) & F.when((n >= 14) & (n <= 19), luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _candidate(text: Column, kind: str, x: Column) -> Column:
    """A match with its votes and features."""
    s, n = x["s"], F.length(_digits(x["s"]))
    before = F.substr(text, F.greatest(x["start"] - (CONTEXT - 1), F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
    left, right = F.when(x["start"] > 0, F.substr(text, x["start"], F.lit(1))).otherwise(F.lit("")), F.substr(text, x["end"] + 1, F.lit(1))
    part_of = left.rlike("[\\p{L}\\p{N}_=#/]") | right.rlike("[\\p{L}\\p{N}_=#/]")
    strict = {
        "number": (n >= 9) & (n <= 12) & (F.length(s) - n >= 2),
        "address": s.rlike(r"(?i)(?:\(at\)|\[at\])"),
        "name": s.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$"),
        "secret": s.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32,128})$") | (s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")),
        "card_run": valid("card", s),
    }.get(kind)
    strict = valid(kind, s) if strict is None else strict
    listed = {
        "email": F.lower(F.regexp_extract(s, r"\.([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS),
        "address": F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS),
        "ip": ~s.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."),
        "card": _digits(s).rlike(ISSUERS),
        "phone": _digits(s).rlike("^(?:" + "|".join(CALLING_CODES) + ")"),
        "number": s.rlike(r"^\([0-9]{2,5}\)") | s.rlike(r"^[0-9]{3}[-./][0-9]{3}[-./][0-9]{4}$"),
        "name": s.rlike(r"\b(?:" + "|".join(NAMES) + r")\b"),
        "secret": s.rlike(KEY_PREFIXES) | ~s.rlike(r"[A-Za-z]{12,}"),
        "card_run": s.rlike(ISSUERS),
    }[kind]
    shape = {
        "email": F.length(s) <= 64,
        "address": F.length(s) <= 64,
        "ip": F.length(s) >= 11,
        "card": n == 16,
        "phone": s.rlike(r"[\x20().-]"),
        "number": n >= 10,
        "name": F.length(s) >= 10,
        "secret": (n >= 4) & (F.length(s) >= 24),
        "card_run": n == 16,
    }[kind]
    votes = [_vote(strict, ~strict), _vote(listed, ~listed), _vote(before.rlike(SECRET_CUES if kind == "secret" else CUES), before.rlike(SECRET_NEGATIVE_CUES if kind == "secret" else NEGATIVE_CUES)), _vote(~part_of, part_of), _vote(shape, ~shape)]
    size = F.when(n == 0, F.lit(0)).when(n < 10, F.lit(1)).when(n < 14, F.lit(2)).otherwise(F.lit(3))
    groups = s.rlike(r"[\x20().-]")
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *[v.alias(name) for v, name in zip(votes, LABELERS, strict=True)], size.alias("size"), groups.alias("groups"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): the base spans and all candidates of each row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text, marked = F.col("text"), F.col("text").rlike("[0-9@]")
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    asks = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": marked, "card": marked, "number": marked, "address": F.contains(F.lower(text), F.lit("at")) & text.rlike(r"(?i)[(\[]at[)\]]"), "name": F.lit(True), "secret": text.rlike("[A-Za-z0-9_+/-]{20}"), "card_run": text.rlike("[0-9]{14}")}
    for kind, pattern in (_FAST | LOOSE).items():
        rows = rows.withColumn(kind, F.when(asks[kind], matches(text, pattern)).otherwise(none))
    span = lambda kind, k: F.transform(F.filter(F.col(kind), lambda x: valid(kind, x["s"])), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(*[span(kind, k) for k, kind in enumerate(BASE)]))
    # A run of digits that is too short for a card is no candidate for one, and a secret has letters and digits.
    worth = {"card": lambda x: F.length(_digits(x["s"])) >= 13, "secret": lambda x: x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]")}
    judged = lambda kind: F.transform(F.filter(F.col(kind), worth.get(kind, lambda x: F.lit(True))), lambda x: _candidate(text, kind, x))
    found = F.concat(*[judged(kind) for kind in KINDS])
    return rows.select("doc_id", base.alias("base"), found.alias("found"))


@dataclass(frozen=True)
class Model:
    """reliability: of a vote by kind, labeler and truth; weights: of the classifier's features; prior by kind."""

    prior: dict[str, float]
    reliability: dict[tuple[str, str, bool, int], float]
    weights: dict[str, float]


def em(patterns: dict[tuple[str, tuple[int, ...]], float], rounds: int = ROUNDS) -> tuple[dict[str, float], dict, dict]:
    """Priors, reliabilities and the posteriors of (kind, votes) from counts, by the Dawid-Skene model."""
    prior = {k: 0.5 for k in KINDS}
    start = lambda true, vote: (0.6 if (vote == 1) == true and vote else 0.2)
    reliability = {(k, j, true, v): start(true, v) for k in KINDS for j in LABELERS for true in (True, False) for v in (-1, 0, 1)}
    posterior: dict = {}
    for _ in range(rounds):
        for (kind, votes), _n in patterns.items():
            log = {t: math.log(prior[kind] if t else 1 - prior[kind]) + sum(math.log(reliability[kind, j, t, v]) for j, v in zip(LABELERS, votes, strict=True)) for t in (True, False)}
            posterior[kind, votes] = 1 / (1 + math.exp(min(700.0, log[False] - log[True])))
        weight: dict = defaultdict(float)
        total: dict = defaultdict(float)
        for (kind, votes), n in patterns.items():
            for true, share in ((True, posterior[kind, votes]), (False, 1 - posterior[kind, votes])):
                total[kind, true] += n * share
                for j, v in zip(LABELERS, votes, strict=True):
                    weight[kind, j, true, v] += n * share
        for kind in KINDS:
            prior[kind] = (total[kind, True] + PRIOR_MISSES) / (total[kind, True] + total[kind, False] + 2 * PRIOR_MISSES)
            for j in LABELERS:
                for true in (True, False):
                    credit = {v: PRIOR_HITS if (v == 1) == true and v else PRIOR_MISSES for v in (-1, 0, 1)}
                    for v in (-1, 0, 1):
                        reliability[kind, j, true, v] = (weight[kind, j, true, v] + credit[v]) / (total[kind, true] + sum(credit.values()))
    return prior, reliability, posterior


def _features(kind: str, votes: tuple[int, ...], size: int, groups: bool) -> list[str]:
    return ["bias", f"kind:{kind}", f"size:{size}", f"groups:{groups}", *[f"{j}:{v}" for j, v in zip(LABELERS, votes, strict=True) if v], f"{kind}:{LABELERS[0]}:{votes[0]}"]


def train(counts: list[tuple]) -> Model:
    """The model from rows (kind, votes..., size, groups, n): EM, then logistic regression on its posteriors."""
    patterns: dict = defaultdict(float)
    for kind, *votes, _size, _groups, n in counts:
        patterns[kind, tuple(votes)] += n
    prior, reliability, posterior = em(dict(patterns))
    rows = [(_features(kind, tuple(votes), size, groups), posterior[kind, tuple(votes)], n) for kind, *votes, size, groups, n in counts]
    weights: dict[str, float] = defaultdict(float)
    scale = sum(r[2] for r in rows) or 1.0
    squared: dict[str, float] = defaultdict(lambda: 1e-8)
    for _ in range(300):
        slope: dict[str, float] = defaultdict(float)
        for names, target, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in names)))))
            for f in names:
                slope[f] += (p - target) * n / scale
        for f, g in slope.items():
            g += 1e-4 * weights[f]
            squared[f] += g * g
            weights[f] -= 0.3 * g / math.sqrt(squared[f])
    return Model(prior, reliability, dict(weights))


def learn(found: DataFrame) -> Model:
    """Train on all candidates of ``found``; only counts by pattern come to the driver."""
    one = found.select(F.inline("found"))
    keys = ["kind", *LABELERS, "size", "groups"]
    return train(sorted(tuple(r) for r in one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()))


def _score(model: Model, x: Column) -> Column:
    w = lambda name: F.lit(float(model.weights.get(name, 0.0)))
    pick = lambda col, values, name: F.create_map(*[y for v in values for y in (F.lit(v), w(f"{name}:{v}"))])[col]
    total = w("bias") + pick(x["kind"], KINDS, "kind") + pick(x["size"], range(4), "size") + F.when(x["groups"], w("groups:True")).otherwise(w("groups:False"))
    for j in LABELERS:
        total = total + F.when(x[j] == 0, F.lit(0.0)).otherwise(F.coalesce(pick(x[j], (-1, 1), j), F.lit(0.0)))
    own = F.create_map(*[y for k in KINDS for v in (-1, 0, 1) for y in (F.lit(f"{k}:{v}"), w(f"{k}:{LABELERS[0]}:{v}"))])
    return total + own[F.concat_ws(":", x["kind"], x[LABELERS[0]].cast("string"))]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (start, k, end, kind) in order of start and kind.

    base has what the strict patterns find; spans has these and what the classifier adds, in the kinds of LOOSE or, for a base
    kind whose strict check failed, with "_like" behind it. Null and empty texts have none; repeated rows repeat; other columns are
    ignored; an empty table gives an empty one.
    """
    found = cut(candidates(docs, id_col, text_col))
    model = learn(found)
    # Spans of a kind don't overlap and stand in order, so that of each kind only the last that starts before x ends can reach into it.
    own = F.transform(F.array(*[F.lit(kind) for kind in BASE]), lambda kind: F.filter("base", lambda b: b["kind"] == kind))
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    before = lambda spans, x: F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= F.size(spans)) & (F.get(spans, at + k - 1)["start"] < x["end"]), at + k).otherwise(at))
    last = lambda x: F.transform("own", lambda spans: F.get(spans, before(spans, x) - 1))
    reach = lambda x: F.when(F.size("base") <= FEW, F.col("base")).otherwise(last(x))
    apart = lambda x: ~F.exists(reach(x), lambda b: b.isNotNull() & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    found = found.withColumn("own", F.when(F.size("base") > FEW, own))
    added = F.filter(F.col("found"), lambda x: apart(x) & ~(x["kind"].isin(*VETO) & (x[LABELERS[0]] < 0)) & (_score(model, x) >= 0))
    order = F.create_map(*[y for k, kind in enumerate(KINDS) for y in (F.lit(kind), F.lit(k))])
    kind = lambda x: F.when(x["kind"].isin(*BASE), F.concat(x["kind"], F.lit("_like"))).otherwise(x["kind"])
    more = F.transform(added, lambda x: F.struct(x["start"].alias("start"), (order[x["kind"]] + len(BASE)).alias("k"), x["end"].alias("end"), kind(x).alias("kind")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
