"""Operator 1: personal data by weak supervision, with DataFrame and SQL functions only.

Exact base patterns (email, ip, card, phone) always count. Beyond them, wider patterns propose candidate spans, labelers vote on
each (format, gazetteer, context, surroundings: -1, 0 or 1), expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is for each kind, and a logistic span classifier is trained on the resulting posteriors. It sees the votes
and the shape of the span itself, its length and its share of digits, which no labeler looks at.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, texts_of

# The base patterns. Possessive forms match the same spans without backtracking; a match starts where the run of
# its first class starts, or where the match before ended (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
OCTETS = r"\A0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z"

# Area codes of the North American plan, largest cities first by number.
AREA_CODES = "201|202|203|206|210|212|213|214|215|216|267|281|301|303|305|310|312|313|314|315|323|347|401|402|404|405|407|408|410|412|413|414|415|416|417|432|469|480|502|503|504|505|510|512|513|514|515|516|520|602|604|612|613|614|615|616|617|619|626|646|650|702|703|704|713|714|718|720|786|801|802|803|804|805|808|813|816|817|818|901|904|907|908|909|914|916|917|919|949|954|972"
# Candidates beyond the base, each with a format check, a gazetteer (what it lists, and the votes for listed and for
# other spans), and words that speak for it in the 40 characters before.
CANDIDATES = {
    "email_spelled": {
        "find": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{2,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,24}){1,4}",
        "format": r"(?i)(?:\(at\)|\[at\]|\{at\}).*(?:\(dot\)|\[dot\]|\.)|\bat\b.*\bdot\b",
        "known": (r"(?i)(?:\.|dot\W{0,3})(?:com|org|net|edu|gov|io|de|fr|es|uk|info|example)\z", 1, -1),
        "context": r"(?i)e-?mail|contact|reach|write|correo|courriel|kontakt",
    },
    "phone_local": {
        "find": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
        "format": r"\A(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}([ .-]))[2-9][0-9]{2}[ .-][0-9]{4}\z",
        "known": (rf"\A\(?(?:{AREA_CODES})(?![0-9])", 1, 0),
        "context": r"(?i)phone|tel|call|fax|mobile|cell|contact|telefon|téléphone|llame",
    },
    "national_id": {
        "find": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "format": r"\A(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\z",
        "known": (r"\A(?:078-05-1120|123-45-6789|219-09-9999|457-55-5462)\z", -1, 0),
        "context": r"(?i)ssn|social|security|insurance|id\b|identity",
    },
    "iban": {
        "find": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "format": r"\A[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,36}\z",
        "known": (r"\A(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|PL|SE|DK|FI|NO)", 1, -1),
        "context": r"(?i)iban|account|bank|konto|compte|cuenta",
    },
    "secret": {
        "find": r"(?i)(?<![a-z0-9_])(?:api[_-]?key|token|secret|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+=-]{8,}+[\"']?",
        "format": r"(?i)[0-9a-f]{16,}+|(?=[A-Za-z]*[0-9])[A-Za-z0-9_/+=-]{12,}",
        "known": (r"[=:]\s*[\"']?(?:sk-|pk_|ghp_|gho_|glpat-|xox[abp]-|AKIA|AIza|eyJ)", 1, 0),
        "context": r"(?i)config|export|set|login|user|auth|###|\$\$\$|&&&",
    },
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|part|serial|page|chapter|fig(?:ure)?|section|no)\W{0,3}\z"
LABELERS = ("format", "known", "context", "clear")
#: Shape of a span: binary logarithm of its length, 7 at most, and fourths of it that are digits.
SHAPE = {"size": "cast(least(7, floor(log2(length(x.found)))) as int)", "digits": "cast(floor(4 * length(regexp_replace(x.found, '[^0-9]', '')) / length(x.found)) as int)"}


def _literal(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches of pattern in text as array<struct<start, end, found>>, in code points.

    Starts are sums of the lengths of pieces and matches before, taken in groups of 256 so that many matches don't cost their square.
    """
    p = _literal(pattern)
    return f"""transform(array(struct(regexp_extract_all({text}, {p}, 0) as m, split({text}, {p}, -1) as p)), w ->
        transform(array(transform(w.m, (x, i) -> cast(length(w.p[i]) + length(x) as bigint))), l ->
            transform(array(transform(sequence(0, size(l) div 256), g -> aggregate(slice(l, g * 256 + 1, 256), 0L, (a, x) -> a + x))), s ->
                transform(array(transform(sequence(0, size(l) div 256), g -> aggregate(slice(s, 1, g), 0L, (a, x) -> a + x))), o ->
                    transform(w.m, (x, i) -> transform(array(o[i div 256] + aggregate(slice(l, (i div 256) * 256 + 1, i % 256), 0L, (a, y) -> a + y) + length(w.p[i])), b ->
                        struct(b as start, b + length(x) as end, x as found))[0]))[0])[0])[0])[0]"""


def base_spans(text: str = "text") -> dict[str, Column]:
    """Valid base spans of each kind as columns; kinds whose sign the text lacks aren't searched."""
    ok = {
        "email": "true",
        "ip": f"x.found rlike {_literal(OCTETS)}",
        "card": "length(regexp_replace(x.found, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace(x.found, '[^0-9]', ''))",
        "phone": "length(regexp_replace(x.found, '[^0-9]', '')) between 8 and 15",
    }
    empty = "cast(array() as array<struct<start: bigint, end: bigint, found: string>>)"
    needs = {k: f"instr({text}, '{NEEDS[k]}') > 0" if k in NEEDS else f"{text} rlike '[0-9]'" for k in BASE}
    return {k: F.expr(f"if({needs[k]}, filter({spans_of(text, BASE[k])}, x -> {ok[k]}), {empty})") for k in BASE}


def candidate_spans(text: str, taken: str) -> Column:
    """Candidates of all kinds that overlap no base span, with votes and shape: array<struct<kind, start, end, format, known,
    context, clear, size, digits>>.

    format is 1 or -1 by the kind's check; known is the gazetteer's vote; context is 1 by a word before, -1 by a word against, else 0; clear is 1 if the
    span stands alone between signs that aren't letters or digits, else -1.
    """
    parts = []
    for kind, c in CANDIDATES.items():
        near = f"substring({text}, cast(greatest(x.start - 39, 1) as int), cast(least(x.start, 40) as int))"
        around = f"concat(substring({text}, cast(greatest(x.start, 1) as int), if(x.start > 0, 1, 0)), substring({text}, cast(x.end + 1 as int), 1))"
        votes = f"""struct('{kind}' as kind, x.start as start, x.end as end,
            if(x.found rlike {_literal(c["format"])}, 1, -1) as format, if(x.found rlike {_literal(c["known"][0])}, {c["known"][1]}, {c["known"][2]}) as known,
            case when {near} rlike {_literal(AGAINST)} then -1 when {near} rlike {_literal(c["context"])} then 1 else 0 end as context,
            if({around} rlike '[A-Za-z0-9]', -1, 1) as clear, {", ".join(f"{e} as {n}" for n, e in SHAPE.items())})"""
        parts.append(f"transform(filter({spans_of(text, c['find'])}, x -> not exists({taken}, b -> b.start < x.end and x.start < b.end)), x -> {votes})")
    empty = "cast(array() as array<struct<kind: string, start: bigint, end: bigint, format: int, known: int, context: int, clear: int, size: int, digits: int>>)"
    worth = f"{text} rlike '[0-9]' or {text} rlike '(?i)[ (\\\\[{{]at[ )\\\\]}}]|token|secret|passw|pwd|key'"
    return F.expr(f"if({worth}, concat({', '.join(parts)}), {empty})")


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50, prior: float = 0.5) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a span is personal data, for each kind and vote pattern, by expectation-maximisation over pattern counts.

    Votes are independent given the truth. Reliabilities start from 0.7 and carry two made-up spans of each sort, so that a
    labeler is never taken for certain and keeps its direction.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        rate = prior
        table = [{1: {1: 0.7, 0: 0.2, -1: 0.1}, 0: {1: 0.1, 0: 0.2, -1: 0.7}} for _ in LABELERS]
        post = {}
        for _ in range(rounds):
            for v, _n in rows:
                yes, no = rate, 1 - rate
                for t, x in zip(table, v, strict=True):
                    yes, no = yes * t[1][x], no * t[0][x]
                post[v] = yes / (yes + no)
            total = sum(n for _, n in rows)
            rate = (sum(post[v] * n for v, n in rows) + 2 * prior) / (total + 2)
            for j, t in enumerate(table):
                for truth in (1, 0):
                    start = {1: 0.7, 0: 0.2, -1: 0.1} if truth else {1: 0.1, 0: 0.2, -1: 0.7}
                    mass = {x: 2 * start[x] for x in (1, 0, -1)}
                    for v, n in rows:
                        mass[v[j]] += n * (post[v] if truth else 1 - post[v])
                    whole = sum(mass.values())
                    t[truth] = {x: m / whole for x, m in mass.items()}
        out |= {(kind, v): p for v, p in post.items()}
    return out


def train_classifier(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], posterior: dict, steps: int = 300, rate: float = 0.5) -> dict[str, list[float]]:
    """Logistic weights for each kind, fitted to the posteriors of the votes: intercept, labelers, then the shape's numbers (in eighths).

    rows hold the kind, votes, shape and count. Weights decay, most for the shape, so that votes decide where shapes are alike.
    """
    out = {}
    groups = defaultdict(list)
    for kind, v, shape, n in rows:
        groups[kind].append(((1, *v, *(x / 8 for x in shape)), n, posterior[kind, v]))
    for kind, examples in groups.items():
        w, whole = [0.0] * len(examples[0][0]), sum(n for _, n, _ in examples)
        decay = [0.001] * (1 + len(LABELERS)) + [0.01] * len(w)
        for _ in range(steps):
            slope = [d * x for d, x in zip(decay, w)]
            for x, n, p in examples:
                z = sum(a * b for a, b in zip(w, x, strict=True))
                d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / whole
                slope = [s + d * a for s, a in zip(slope, x, strict=True)]
            w = [a - rate * s for a, s in zip(w, slope, strict=True)]
        out[kind] = w
    return out


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans, base array, and extra, the candidate spans that the classifier takes.

    base and extra hold (kind, start, end) with starts in code points and ends exclusive. Null text is empty; repeated rows give
    equal results; an empty table gives none; texts may be of any length; other columns are ignored, whatever their names. Texts are
    read once and never shuffled. The driver sees only counts of votes and shapes: 5 kinds times 36 votes times 8 * 5 shapes at most.
    """
    kinds = list(BASE)
    found = texts_of(docs).withColumns({f"_{k}": c for k, c in base_spans().items()})
    found = found.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in kinds])).withColumn("_candidates", candidate_spans("text", "_base"))
    spans = F.concat(*[F.expr(f"transform(_{k}, x -> struct('{k}' as kind, x.start as start, x.end as end))") for k in kinds])
    rows = stored(found.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in kinds], spans.alias("base"), "_candidates"), "spans")
    counts = rows.select(F.explode("_candidates").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in (*LABELERS, *SHAPE)]).count().collect()
    shaped = sorted((r["kind"], tuple(r[v] for v in LABELERS), tuple(r[v] for v in SHAPE), r["count"]) for r in counts)
    votes: dict[tuple[str, tuple[int, ...]], int] = defaultdict(int)
    for kind, v, _, n in shaped:
        votes[kind, v] += n
    weights = train_classifier(shaped, estimate([(kind, v, n) for (kind, v), n in sorted(votes.items())]))
    terms = [*(f"x.{v}" for v in LABELERS), *(f"x.{v} / 8D" for v in SHAPE)]
    cases = " ".join(f"when '{k}' then {w[0]!r}D + " + " + ".join(f"({a!r}D) * {t}" for a, t in zip(w[1:], terms, strict=True)) for k, w in weights.items())
    taken = f"filter(_candidates, x -> case x.kind {cases} else -1D end >= {math.log(threshold / (1 - threshold))!r}D)" if weights else "filter(_candidates, x -> false)"
    extra = F.expr(f"transform({taken}, x -> struct(x.kind as kind, x.start as start, x.end as end))")
    return rows.select("doc_id", *[f"n_{k}" for k in kinds], "base", extra.alias("extra"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: the base spans, those that the method adds (n_ columns by kind), and whether there is any."""
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    added = [F.expr(f"cast(size(filter(extra, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in CANDIDATES]
    both = (F.size("base") + F.size("extra")).cast("long")
    return out.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.expr(joined.format("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined.format("concat(base, extra)")).alias("spans"),
        *added, both.alias("n_spans"), (both > 0).alias("has_personal_data"),
    )
