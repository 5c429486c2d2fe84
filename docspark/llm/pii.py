"""Personal data: strict patterns, and further spans by weak supervision.

Main path: DataFrame functions only.  Base spans are the leftmost matches of four patterns that pass their checks.  Around
them stands a wider set of candidates: matches that failed a check, obfuscated addresses ("handle"), national numbers ("number") and
keys that are long or begin like one ("secret").  Five labelers vote on each candidate (1: personal, -1: not, 0: no opinion): pattern, gazetteer,
context words (up to 40 characters before, no further than the last match of the kind; a bare number that nothing announces is voted against),
neighbouring characters, and variety of characters (these two only vote against).  Votes are counted over all documents by pattern of votes, of which there are
at most 7 * 3**5; expectation-maximisation over those counts estimates each labeler's reliability, and a logistic span classifier
is fitted to the resulting probabilities.  It becomes one Spark expression.  Spans of the three further kinds that score at least
``THRESHOLD`` and touch no base span are added; base spans always stay.

Offsets are code points, ends exclusive.  Null or empty text: no spans.  Repeated rows are treated alike.  Empty table: empty result, a
classifier that adds nothing.  Rows keep their columns as asked for; where one of them is called ``spans``, give the new column another name.

The candidates of all texts are written once: votes are counted and spans are chosen from them.  Work grows in proportion to a text's length
and matches: places are running sums, contexts come from the text between matches, overlaps from sorted spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import spread, written
from docspark.llm.native import between, greatest_before, let, sums_before, text_blocks

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("handle", "number", "secret")
LABELERS = ("pattern", "gazetteer", "context", "neighbours", "variety")
#: Belief in each labeler beforehand, and the weight of that belief.
BELIEF, PRIOR = (1.0, 1.0, 3.0, 0.5, 0.5), 0.4
THRESHOLD = 0.9

# Java forms of the patterns.  Possessive loops match the same strings as greedy ones here and keep no stack for long runs;
# a match may only begin where a run begins or the last match ended, which spares trying every suffix of a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[a-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[a-z0-9-]++)++",
    "number": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?:\G|(?<![A-Za-z0-9_]))(?:xox[abprs]-[A-Za-z0-9-]{10,}+|AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])|AIza[0-9A-Za-z_-]{35}|[sp]k_(?:live|test)_[A-Za-z0-9]{16,}+|[A-Za-z0-9_]{32,}+)",
}
#: A cheap test that every text with a match passes.
PREFILTER = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){9}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "handle": lambda t: t.rlike(r"(?i)[\[(]at[\])]"),
    "number": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"(?:\G|(?<![A-Za-z0-9_]))(?:[A-Za-z0-9_]{32}|AKIA|AIza|xox[abprs]-|[sp]k_(?:live|test)_)"),
}

# Gazetteers and context words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl", "mx", "ar")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
KEY_PREFIXES = ("ghp_", "gho_", "sk_", "pk_", "AKIA", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza")
CUES = {
    "email": ("mail", "contact", "correo", "adresse", "write to", "courriel"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "appel"),
    "handle": ("mail", "contact", "correo", "adresse", "write to", "courriel"),
    "number": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "appel"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "credential", "bearer"),
}
COUNTER_CUES = ("isbn", "version", "invoice", "serial", "commit", "sha-", "sha1", "sha256", "md5", "checksum", "page", "doi")


def matches(text: Column, kind: str, body: Callable[[Column, Column], Column], none: Column) -> Column:
    """``body`` of the matches of a pattern in a text and the texts between them; ``none`` where there is no match."""
    p = PATTERNS[kind]
    some = lambda f: F.when(F.size(f) > 0, let(F.split(text, p, -1), lambda g: body(f, g))).otherwise(none)
    return F.when(PREFILTER[kind](text), let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), some)).otherwise(none)


def located(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, text, left, near>> from matches and the texts between them.

    left: up to 40 characters before, back to the start of the match before; near: the characters next to it.
    """
    size = lambda c: F.char_length(c).cast("long")

    def one(before: Column) -> Callable[[Column, Column], Column]:
        def at(m: Column, i: Column) -> Column:
            left = F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(40))
            after = F.get(gaps, i + 1)
            after = F.when(after == "", F.coalesce(F.get(found, i + 1), F.lit(""))).otherwise(after)
            near = F.concat(F.right(left, F.lit(1)), F.substring(after, 1, 1))
            start = F.get(before, i) + size(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + size(m)).alias("end"), m.alias("text"), left.alias("left"), near.alias("near"))

        return at

    lengths = F.transform(found, lambda m, i: size(m) + size(F.get(gaps, i)))
    return let(sums_before(lengths), lambda before: F.transform(found, one(before)))


def valid(kind: str, m: Column) -> Column:
    """Whether a match passes the check of its kind."""
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "card":
        return F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("(?i)" + "|".join(w.replace(".", r"\.") for w in words))


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a located candidate, in the order of LABELERS."""
    m, left, near = s["text"], s["left"], s["near"]
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")
    domain = rf"(?i)[.\])] ?(?:{'|'.join(TOP_DOMAINS)})$"
    if kind in KINDS:
        pattern = vote(valid(kind, m), ~valid(kind, m))
    elif kind == "handle":
        pattern = vote(m.rlike(r"(?i)[\[(]dot[\])]"))
    elif kind == "number":
        pattern = vote(m.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"))
    else:
        pattern = vote(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), ~m.rlike("[0-9]"))
    gazetteer = {
        "email": vote(m.rlike(domain)),
        "handle": vote(m.rlike(domain)),
        "ip": vote(m.rlike("^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]"), m.rlike("^0*(?:0|127|255)[.]")),
        "card": vote(m.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")),
        "phone": vote(m.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})")),
        "number": vote(m.rlike(r"^\(?[2-9]"), m.rlike(r"^\(?[01]")),
        "secret": vote(m.rlike(f"^(?:{'|'.join(KEY_PREFIXES)})")),
    }[kind]
    context = vote(_any_of(left, CUES[kind]), F.lit(True) if kind == "number" else _any_of(left, COUNTER_CUES))
    neighbours = vote(F.lit(False), near.rlike("[A-Za-z0-9_@]"))
    several = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^A-Za-z0-9]+", ""), ""))) - 1
    least = {"email": 3, "handle": 3, "ip": 2, "card": 4, "phone": 4, "number": 4, "secret": 8}[kind]
    return [pattern, gazetteer, context, neighbours, vote(F.lit(False), several < least)]


def _candidates(text: Column, kind: str) -> Column:
    def one(s: Column) -> Column:
        v = dict(zip(LABELERS, votes(kind, s), strict=True))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v[x].alias(x) for x in LABELERS))

    none = F.array().cast(f"array<struct<kind: string, start: bigint, end: bigint, {', '.join(f'{x}: tinyint' for x in LABELERS)}>>")
    return matches(text, kind, lambda f, g: F.transform(located(f, g), one), none)


def candidates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Kept columns (doc_id if none are named), and ``__c_<kind>``: the candidates of each kind with their votes; written."""
    text = F.coalesce("text", F.lit(""))
    made = spread(docs).select(*(keep or ["doc_id"]), *(_candidates(text, k).alias(f"__c_{k}") for k in KINDS + MORE_KINDS))
    return written(made, "candidates")


Pattern = tuple[str, tuple[int, ...]]


def vote_counts(found: DataFrame) -> dict[Pattern, int]:
    """How often each pattern of votes occurs, over all candidates."""
    each = found.select(F.explode(F.concat(*(f"__c_{k}" for k in KINDS + MORE_KINDS))).alias("c"))
    rows = each.groupBy("c.kind", *(f"c.{x}" for x in LABELERS)).count().collect()
    return {(r["kind"], tuple(r[x] for x in LABELERS)): r["count"] for r in rows}


def estimate(counts: dict[Pattern, int], rounds: int = 100) -> dict[Pattern, float]:
    """Probability of each pattern of votes to be personal data, by expectation-maximisation.

    Labelers are independent given the truth; each has a table of votes per truth, no opinion says nothing, and each kind has its own share of personal data.
    ``BELIEF`` says how far a labeler is trusted beforehand: it weighs the votes that the first probabilities rest on, and the pseudo-votes
    that favour agreement, which count ``PRIOR`` as much as the real ones.
    """
    p = {k: min(max(0.5 + 0.18 * sum(b * x for b, x in zip(BELIEF, k[1], strict=True)), 0.02), 0.98) for k in counts}
    pseudo = 1 + PRIOR * sum(counts.values())
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        table = [[{-1: pseudo * 4 ** -(b * y), 1: pseudo * 4 ** -(b * (1 - y))} for y in (0, 1)] for b in BELIEF]
        for (kind, v), n in counts.items():
            q = p[kind, v]
            share = prior.setdefault(kind, [1.0, 1.0])
            for y, w in ((0, 1 - q), (1, q)):
                share[y] += n * w
                for j, x in enumerate(v):
                    if x:
                        table[j][y][x] += n * w
        new = {}
        for kind, v in counts:
            score = math.log(prior[kind][1]) - math.log(prior[kind][0])
            for j, x in enumerate(v):
                if not x:
                    continue
                score += math.log(table[j][1][x] / sum(table[j][1].values())) - math.log(table[j][0][x] / sum(table[j][0].values()))
            new[kind, v] = 1 / (1 + math.exp(-max(min(score, 30.0), -30.0)))
        moved = max((abs(new[k] - p[k]) for k in p), default=0.0)
        p = new
        if moved < 1e-7:
            break
    return p


def _features(kind: str, v: Sequence[int]) -> list[float]:
    return [1.0, *(float(x > 0) for x in v), *(float(x < 0) for x in v), *(float(kind == k) for k in KINDS + MORE_KINDS)]


def train(counts: dict[Pattern, int], p: dict[Pattern, float], steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier of spans, fitted to the probabilities; log counts weigh the patterns."""
    w = [0.0] * len(_features(KINDS[0], [0] * len(LABELERS)))
    rows = [(_features(*k), p[k], math.log1p(n)) for k, n in sorted(counts.items())]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps if rows else 0):
        g = [ridge * x for x in w]
        for x, y, n in rows:
            q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for j, a in enumerate(x):
                if a:
                    g[j] += n / total * (q - y) * a
        w = [a - rate * 4 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(found: DataFrame) -> list[float]:
    """The span classifier for these candidates; an empty list, which adds nothing, where there are none."""
    counts = vote_counts(found)
    return train(counts, estimate(counts)) if counts else []


def _score(kind: str, c: Column, w: list[float]) -> Column:
    n = len(LABELERS)
    z = F.lit(w[0] + w[1 + 2 * n + (KINDS + MORE_KINDS).index(kind)])
    for j, x in enumerate(LABELERS):
        z = z + F.when(c[x] > 0, w[1 + j]).when(c[x] < 0, w[1 + n + j]).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def find(found: DataFrame, model: list[float], keep: list[str] | None = None, threshold: float = THRESHOLD, name: str = "spans") -> DataFrame:
    """Kept columns (doc_id if none are named) and ``name``: array<struct<kind, start, end, base, score>>, from candidates.

    Base spans stand first, kind by kind as in KINDS, then those that the classifier adds, kind by kind as in MORE_KINDS; each kind in order.
    """

    def span(kind: str, c: Column, base: bool) -> Column:
        score = F.lit(1.0) if base else _score(kind, c, model)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(base).alias("base"), score.alias("score"))

    def base_of(kind: str) -> Column:
        return F.transform(F.filter(f"__c_{kind}", lambda c: c["pattern"] == 1), lambda c: span(kind, c, True))

    def more_of(kind: str) -> Column:
        return F.filter(F.transform(f"__c_{kind}", lambda c: span(kind, c, False)), lambda s: s["score"] >= threshold)

    base = F.concat(*map(base_of, KINDS))
    spans = let(base, lambda b: F.concat(b, _free(b, F.concat(*map(more_of, MORE_KINDS))))) if model else base
    return found.select(*(keep or ["doc_id"]), spans.alias(name))


def detect(docs: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, name: str = "spans") -> DataFrame:
    """``find`` with a classifier fitted to the same documents, whose texts are read once."""
    found = candidates(docs, keep)
    return find(found, fit(found), keep, threshold, name)


def _free(base: Column, more: Column) -> Column:
    """The spans of ``more`` that touch none of ``base``, kind by kind: all are sorted, then compared with the furthest base end before and the next base start after."""
    far = 2**62

    def chosen(all_: Column) -> Column:
        end = greatest_before(F.transform(all_, lambda x: F.when(x["s"]["base"], x["s"]["end"]).otherwise(-1)), -1)
        start = greatest_before(F.reverse(F.transform(all_, lambda x: F.when(x["s"]["base"], -x["s"]["start"]).otherwise(-far))), -far)
        kept = lambda e, n: F.filter(all_, lambda x, i: ~x["s"]["base"] & (F.get(e, i) <= x["s"]["start"]) & (-F.get(n, i) >= x["s"]["end"]))
        return let(end, lambda e: let(F.reverse(start), lambda n: F.transform(kept(e, n), lambda x: x["s"])))

    placed = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("more"), s.alias("s"))))
    of_kind = lambda a, k: F.filter(a, lambda s: s["kind"] == k)
    by_kind = lambda a: F.concat(*(of_kind(a, k) for k in MORE_KINDS))
    return let(more, lambda m: F.when(F.size(m) > 0, let(let(placed, chosen), by_kind)).otherwise(m))


def count_base(spans: Column, kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named after the first."""

    def done(ordered: Column, blocks: Column, reached: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            new = F.concat(between(blocks, F.get(reached, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= F.get(reached, i), new).otherwise("")

        rest = between(blocks, F.array_max(F.transform(ordered, lambda s: s["end"])), F.char_length(text).cast("long"))
        return F.concat(F.array_join(F.transform(ordered, piece), ""), rest)

    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ends = lambda o: greatest_before(F.transform(o, lambda s: s["end"]), 0)
    new = let(placed, lambda o: let(text_blocks(text), lambda b: let(ends(o), lambda r: done(o, b, r))))
    return F.when(F.size(spans) > 0, new).otherwise(text)
