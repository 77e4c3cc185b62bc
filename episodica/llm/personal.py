"""Personal data: patterns, and weak supervision for what they leave open, in Spark's own functions.

Four patterns with checks give the base spans. Candidates beside them are runs of seven to nineteen
digits, runs of capitalised words (names), street addresses, and spelt-out mail addresses. On each
candidate labelers vote yes, no or nothing: the patterns, the candidate's shape, gazetteers (given
names, kinds of streets, issuer prefixes, country codes, mail domains), the words before it, those
after it, and the number of digits. Spark counts how often each combination of votes and features
occurs; from these counts, as many as there are combinations whatever the corpus, expectation
maximisation estimates for each kind of candidate how far each labeler can be relied on, and a
logistic classifier of spans is fitted to the posteriors. Its features are the span's and its
context's own (kind, length, case, digits, what stands beside it), and words of the context, next
to the votes. It decides on the candidates that are no base spans, and adds only those on which at
least AGREED labelers vote yes and fewer vote no: how far labelers can be relied on is known from
where they agree, so of a lone vote nothing is known but the prior.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.expressions import apart, matches, running
from episodica.llm.tables import cut, id_texts

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms and look-behinds find the same matches as the plain patterns, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OTHERS = ("number", "name", "address", "handle")
#: Fixed values of the gazetteers and of the context labelers.
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Way|Court|Place|Square"
ROADS = "straße|strasse|str\\.|weg |platz |allee |gasse |rue |avenue |boulevard |calle "
GIVEN = (
    "Anna Maria Thomas Michael Peter John James Mary Robert Patricia Jennifer Linda David William Richard Susan Joseph Jessica Sarah Karen Daniel Laura Paul "
    "Mark Emma Olivia Sophie Claire Pierre Jean Marie Louis Camille Antoine Julie Nicolas Carlos Juan José Luis Ana Carmen Lucía Pablo Elena Miguel Javier "
    "Hans Klaus Jürgen Wolfgang Ursula Heike Sabine Stefan Andreas Christian Martin Julia Lena Felix Lukas Jonas Ahmed Fatima Mohamed Ali Wei Li Yuki Olga Ivan Eva"
).split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRIES = r"^\+(1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
DOMAINS = r"(?i)[. ](com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info|biz)$"
PERSONAL = r"(?i)\b(tel|phone|mobile|fax|call|mail|e-mail|contact|card|account|iban|ssn|passport|visa|ip|address|id|name|mr|mrs|ms|dr|dear|herr|frau|madame|monsieur|señor|señora|lives at|resident|patient|customer|write to|reach|signed)\b[.:#\s\w]{0,12}$"
IMPERSONAL = r"(?i)\b(version|isbn|issn|page|figure|order|total|sum|chapter|section|table|doi|bytes|lines|build|model|price|city of|river|mount|lake|university of|the|museum|battle of)\b[.:#\s]{0,4}$|[$€£]$"
AFTER_YES = r"(?i)^[,;:.)\s]{0,3}(born|lives|phone|tel|email|mail|mobile|aged|wrote|said|says|signed|expires|exp\b|cvv|apt|flat|zip|floor)"
AFTER_NO = r"(?i)^[,;:.)\s]{0,3}(university|river|museum|company|inc|ltd|gmbh|bytes|lines|items|pages|euros?|dollars?|percent|km|kg|units)\b|^ ?[%€]"
CANDIDATES = {
    "number": r"(?<![0-9A-Za-z._/+-])[0-9](?:[\x20.-]?[0-9]){6,18}(?![0-9A-Za-z_/-])",
    "name": r"(?<![\p{L}0-9])\p{Lu}\p{Ll}++(?:[ -]\p{Lu}\p{Ll}++){1,2}(?![\p{L}0-9])",
    "address": rf"(?<![0-9A-Za-z])[0-9]{{1,5}}[a-z]? (?:\p{{Lu}}\p{{Ll}}+ ){{1,3}}(?:{STREETS})\b|(?<!\p{{L}})\p{{Lu}}\p{{L}}{{2,30}}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?\b|(?<![0-9])[0-9]{{1,4}},? (?:rue|avenue|boulevard|calle) (?:de la |de |del |du )?\p{{Lu}}\p{{Ll}}+",
    "handle": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,40}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,40} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,6}\b",
}
AGREED = 2
VOTERS = ("pattern", "shape", "gazetteer", "before", "after", "digits")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,votes:string,features:string>>"
#: A feature is a character at its place, or a word of the context; no is a word in none of the lists.
FEATURES = ("kind", "length", "digits", "case", "left", "right", "label", "parts")


_DIGITS = "regexp_replace(m.found, '[^0-9]', '')"
_N = f"char_length({_DIGITS})"
_LUHN = f"""aggregate(transform(reverse(split({_DIGITS}, '')), (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (s, x) -> s + x) % 10 = 0"""
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: SQL over a match m: which matches of a pattern count.
VALID = {
    "ip": rf"m.found RLIKE r'^{_BYTE}(?:\.{_BYTE}){{3}}$'",
    "card": f"{_N} BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"{_N} BETWEEN 9 AND 15",
}


def _like(what: str, pattern: str) -> str:
    return f"{what} RLIKE r'{pattern}'"


def _vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN '1' WHEN {no} THEN '0' ELSE '-' END"


def _votes(kind: str) -> str:
    """SQL of one character for each of VOTERS: 1 yes, 0 no, - nothing."""
    nothing = "'-'"
    groups = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}$|^\(?0[0-9]{2,4}[ )/-]|[(+]"
    impossible = r"^[0-9]+\.[0-9]+$|^(19|20)[0-9]{2}[ .-]?[01][0-9][ .-]?[0-3][0-9]|^([0-9])\2+$|^(19|20)[0-9]{2}-(19|20)[0-9]{2}$"
    given = rf"(?:^|[ -])(?:{'|'.join(GIVEN)})(?:$|[ -])"
    places = r"^(?:New|North|South|East|West|Saint|San|Los|The|A|An|In|On|At|It|We|He|She|They|This|That|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|September|October|November|December)[ -]"
    found = "m.found"
    shape = {
        "email": _vote(_like(found, "^[A-Za-z]")),
        "name": _vote(_like(found, r"^\p{Lu}\p{Ll}{1,11}[ -]\p{Lu}\p{Ll}{2,14}$"), _like(found, r"\p{L}{16,}")),
        "address": _vote(_like(found, "[0-9]")),
        "handle": _vote(_like(found, r"[\[(]")),
    }.get(kind, _vote(_like(found, groups), _like(found, impossible)))
    gazetteer = {
        "email": _vote(_like(found, DOMAINS)),
        "handle": _vote(_like(found, DOMAINS)),
        "phone": _vote(_like(found, COUNTRIES)),
        "card": _vote(_like(found, ISSUERS), "true"),
        "ip": _vote(_like(found, r"^(10|127|192\.168)\.")),
        "number": _vote(f"{_N} >= 13 AND {_like(_DIGITS, ISSUERS)} AND {_LUHN}", f"{_N} >= 17"),
        "name": _vote(_like(found, given), _like(found, places)),
        "address": _vote(_like(found, rf" (?:{STREETS})$|{ROADS}")),
    }[kind]
    digits = {
        "card": _vote(f"{_N} IN (15, 16)", "true"),
        "phone": _vote(f"{_N} >= 10"),
        "number": _vote(f"{_N} IN (9, 10, 11, 12, 15, 16)", "true"),
    }.get(kind, nothing)
    before = _vote(_like("m.before", PERSONAL), _like("m.before", IMPERSONAL))
    after = _vote(_like("m.after", AFTER_YES), _like("m.after", AFTER_NO))
    pattern = "'1'" if kind in KINDS else nothing
    return f"concat({pattern}, {shape}, {gazetteer}, {before}, {after}, {digits})"


def _features(kind: str) -> str:
    """SQL of one character for each of FEATURES, so that few combinations occur in any corpus."""
    case = lambda *pairs: "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs[:-1]) + f" ELSE '{pairs[-1]}' END"
    beside = lambda x: case((f"{x} = ''", "^"), (_like(x, r"\p{L}"), "a"), (_like(x, "[0-9]"), "0"), (_like(x, r"\s"), "_"), ".")
    size = "char_length(m.found)"
    parts = (
        "'" + "eicpnmah"[(*KINDS, *OTHERS).index(kind)] + "'",
        case((f"{size} < 10", "s"), (f"{size} < 16", "m"), (f"{size} < 24", "l"), "x"),
        case((f"{_N} = 0", "0"), (f"{_N} < 9", "1"), (f"{_N} < 13", "2"), "3"),
        case((_like("m.found", r"^\p{Lu}"), "U"), (_like("m.found", r"^\p{Ll}"), "l"), "0"),
        beside("right(m.before, 1)"),
        beside("left(m.after, 1)"),
        case((_like("m.before", r"[:=#]\s?$"), ":"), (_like("m.before", r"[.!?]\s+$|^$"), "!"), "-"),
        case((_like("m.found", "[ -].*[ -].*[ -]"), "3"), (_like("m.found", "[ -].*[ -]"), "2"), (_like("m.found", "[ .-]"), "1"), "0"),
    )
    return f"concat({', '.join(parts)})"


def _spans(kind: str) -> str:
    """SQL of the spans of the matches in column `matched <kind>`."""
    good = f"filter(`matched {kind}`, m -> {VALID[kind]})" if kind in VALID else f"`matched {kind}`"
    one = f"named_struct('kind', '{kind}', 'start', m.start, 'end', m.end, 'votes', {_votes(kind)}, 'features', {_features(kind)})"
    return f"coalesce(transform({good}, m -> {one}), cast(array() AS {SPAN}))"


def with_candidates(rows: DataFrame) -> DataFrame:
    """rows with spans of their column text: base spans, by kind and start, then the other candidates that overlap none.

    Where candidates overlap, those of the later kinds stay. A cheap test spares most texts a pattern, and each step is a
    projection of its own, so nothing is found twice.
    """
    text = F.col("text")
    there = {
        "email": "contains(text, '@')",
        "ip": _like("text", r"[0-9]\.[0-9]"),
        "card": _like("text", r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": _like("text", r"\+[0-9]"),
        "number": _like("text", r"[0-9](?:[\x20.-]?[0-9]){6}"),
        "name": _like("text", r"\p{Lu}\p{Ll}+[ -]\p{Lu}\p{Ll}"),
        "address": _like("text", "[0-9]") + " AND " + _like("text", rf"(?:{STREETS})\b|{ROADS}"),
        "handle": _like("text", r"(?i)\(at\)|\[at\]| at ") + " AND " + _like("text", r"(?i)\(dot\)|\[dot\]| dot "),
    }
    every = PATTERNS | CANDIDATES
    rows = rows.withColumns({f"matched {k}": F.when(F.expr(there[k]), matches(text, every[k])) for k in every})
    found = {"spans": F.concat(*(F.expr(_spans(k)) for k in KINDS))} | {f"found {k}": F.expr(_spans(k)) for k in OTHERS}
    rows = rows.withColumns(found).drop(*(f"matched {k}" for k in every))
    for kind in reversed(OTHERS):
        rows = rows.withColumn("spans", F.concat("spans", apart(F.col("spans"), F.col(f"found {kind}"))))
    return rows.drop(*(f"found {k}" for k in OTHERS))


def reliabilities(counts: dict[str, float], rounds: int = 50) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of positives, P(vote | class) by labeler, vote 1, 0 or - and class, posterior of each combination) by EM.

    Starts from the majority of the votes cast. Imaginary votes keep probabilities off zero and say that a labeler is
    more often right than wrong, which tells the classes apart where few votes are cast.
    """
    combos = sorted(counts)
    n = np.array([counts[c] for c in combos], dtype=float)
    votes = np.array([["10-".index(c) for c in v] for v in combos], dtype=np.int64).reshape(len(combos), -1)
    signs = (votes == 0).sum(1) - (votes == 1).sum(1)
    post = np.where(signs > 0, 0.9, np.where(signs < 0, 0.1, 0.3))
    prior, rates = 0.5, np.zeros((votes.shape[1], 3, 2))
    for _ in range(rounds):
        prior = (1 + n @ post) / (3 + n.sum())
        for k in range(votes.shape[1]):
            for c in range(3):
                held = n * (votes[:, k] == c)
                rates[k, c] = held @ (1 - post), held @ post
            rates[k] += np.array([[0.5, 3.0], [3.0, 0.5], [2.0, 2.0]])
            rates[k] /= rates[k].sum(0)
        logs = np.log(rates)
        z = np.log(prior / (1 - prior)) + sum(logs[k, votes[:, k], 1] - logs[k, votes[:, k], 0] for k in range(votes.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return prior, rates, dict(zip(combos, post.tolist()))


def agreed(votes: str) -> bool:
    return votes.count("1") >= max(AGREED, votes.count("0") + 1)


def _inputs(votes: str, features: str) -> list[str]:
    """What a span tells the classifier: its kind with each vote, and with each other feature."""
    kind = features[0]
    said = [f"v{k}{kind}{c}" for k, c in enumerate(votes) if c != "-"]
    return ["kind" + kind, *said, *(f"f{k}{kind}{c}" for k, c in enumerate(features) if k)]


def classifier(counts: dict[tuple[str, str], float], post: dict[tuple[str, str], float], rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic function of spans, by input, fitted to the posteriors by gradient steps of falling size."""
    combos = sorted(counts)
    names = sorted({x for c in combos for x in _inputs(*c)})
    at = {x: k for k, x in enumerate(names)}
    x = np.zeros((len(combos), len(names)))
    for k, c in enumerate(combos):
        x[k, [at[i] for i in _inputs(*c)]] = 1.0
    y, n = np.array([post[c] for c in combos]), np.array([counts[c] for c in combos], dtype=float)
    n = n / n.sum() * min(n.sum(), 10_000.0)
    w, square = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.02 * w
        square += slope**2
        w -= 0.5 * slope / (np.sqrt(square) + 1e-9)
    return {name: float(v) for name, v in zip(names, w) if abs(v) > 1e-6}


def learn(candidates: DataFrame) -> dict[str, float]:
    """Counts the combinations of votes and features over all candidates, in column spans, and fits the classifier to them.

    What reaches the driver is a row for each combination: features have few values and no text, so their number does
    not grow with the corpus.
    """
    seen = F.transform("spans", lambda s: F.concat(s["votes"], s["features"]))
    found = candidates.select(F.explode(seen).alias("seen")).groupBy("seen").count().collect()
    rows = [{"votes": r["seen"][: len(VOTERS)], "features": r["seen"][len(VOTERS) :], "count": r["count"]} for r in found]
    post = {}
    for kind in {r["features"][0] for r in rows}:
        mine = [r for r in rows if r["features"][0] == kind]
        counts: dict[str, float] = {}
        for r in mine:
            counts[r["votes"]] = counts.get(r["votes"], 0) + r["count"]
        of_votes = {v: p if agreed(v) else min(p, 0.5) for v, p in reliabilities(counts)[2].items()}
        post |= {(r["votes"], r["features"]): of_votes[r["votes"]] for r in mine}
    return classifier({(r["votes"], r["features"]): r["count"] for r in rows}, post) if rows else {}


def decide(weights: dict[str, float], threshold: float) -> Column:
    """Of the column spans: base spans, and those other candidates that labelers agree on and whose probability reaches the threshold."""
    base = "s.kind IN ({})".format(", ".join(f"'{k}'" for k in KINDS))
    if not weights:
        return F.expr(f"filter(spans, s -> {base})")
    table = "map({})".format(", ".join(f"'{x}', {w!r}D" for x, w in weights.items()))
    of = lambda what, letter: f"coalesce({table}[concat('{what}', left(s.features, 1), {letter})], 0D)"
    said = [of(f"v{k}", f"substring(s.votes, {k + 1}, 1)") for k in range(len(VOTERS))]
    said += [of(f"f{k}", f"substring(s.features, {k + 1}, 1)") for k in range(1, len(FEATURES))]
    z = " + ".join([of("kind", "''"), *said])
    votes = lambda c: f"char_length(replace(s.votes, '{c}', ''))"  # noqa: E731  without those of one kind
    agree = f"{len(VOTERS)} - {votes('1')} >= greatest({AGREED}, {len(VOTERS)} - {votes('0')} + 1)"
    return F.expr(f"filter(spans, s -> {base} OR ({agree} AND 1 / (1 + exp(-({z}))) >= {threshold!r}D))")


def find_personal(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, votes, features) of every row of docs, base spans first.

    Only doc_id and text are read; a null text counts as empty and has no spans. Base spans of different kinds may
    overlap; learned ones (number, name, address, handle) overlap neither base spans nor each other. A candidate that
    labelers agree on and whose probability equals the threshold is added. Very long texts are read whole, in time that grows with their length
    and with n log n of their matches. Repeated rows stay, and count as often in what is learned. An empty table gives
    an empty result.
    """
    found = cut(with_candidates(id_texts(docs)).select("doc_id", "spans"))  # the patterns run once over all texts
    return found.select("doc_id", decide(learn(found), threshold).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans become the one that starts first.

    A null text stays null, texts without spans stay as they are. Repeated rows stay. Columns may have any names. An empty
    table gives an empty result.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = with_candidates(rows).withColumn("spans", decide(learn(with_candidates(id_texts(docs))), threshold))
    text = F.col("text")
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    rows = rows.withColumn("spans", F.sort_array(F.transform("spans", place)))
    rows = rows.withColumn("furthest", running(F.transform("spans", lambda s: s["end"]), F.greatest))
    rows = rows.withColumn("letters", F.when(F.size("spans") > 0, F.slice(F.split(text, ""), 1, F.greatest(F.char_length(text), F.lit(1)))))
    some = lambda a, b: F.array_join(F.slice("letters", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")

    def one(s: Column, i: Column) -> Column:
        done = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("furthest", i - 1))
        return F.when(s["start"] >= done, F.concat(some(done, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    tail = some(F.element_at("furthest", -1), F.char_length(text).cast("long"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", one), ""), tail)).otherwise(F.col("row.text"))
    rows = rows.select("row", clean.alias("clean"))
    return rows.select(*(F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
