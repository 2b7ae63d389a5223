"""Personal data found by fixed patterns and by weakly supervised labelers, in SQL only.

Base spans are what the patterns of the four kinds match and their checks accept.
Further candidates (obfuscated addresses, digit groups that no base pattern or check
accepts, long key-like strings) get votes from labelers that use a pattern, a
gazetteer of trigger words, the characters around, and check digits or character mix.
Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is; its posteriors are the soft labels from which a naive Bayes classifier of spans
(length, shape, trigger word, neighbours, check digits, all given the kind) is trained.  Candidates
for which the classifier's odds are above one and that touch no base span are added.

Patterns use possessive repeats and run-start look-behinds, so long runs of one
character class take linear time and no recursion.  Each pattern passes over a text once, putting a
mark on both sides of its matches; positions are sums of the lengths of what stands between
the marks, a window per document.  Whole texts are never shuffled.

Results for odd input: null and empty texts have no spans and the digest of the empty
string; rows with a null or repeated doc_id are each reported; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import saved, small, table

# The base patterns, in the order in which kinds are listed.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates of the labelers, by the kind that they would be added as.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?+[\(\[]at[\)\]] ?+[A-Za-z0-9-]++(?: ?+(?:\.|[\(\[]dot[\)\]]) ?+[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?+[0-9]{3}\)?+[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
KINDS = ["email", "ip", "card", "phone", "secret"]
#: Words in front of a span that speak for its kind.
GAZETTEER = {  # English, German, French, Spanish
    "email": "mail|contact|write to|address|kontakt|schreib|adresse|courriel|courrier|écri|correo|escrib|direcci",
    "card": "card|visa|amex|master|credit|debit|payment|karte|zahlung|kredit|carte|paiement|tarjeta|pago|crédit|crédito",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|anruf|handy|mobil|rufnummer|appel|portable|móvil|llama|teléfono|téléphone",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|kennwort|schlüssel|geheim|zugang|mot de passe|jeton|clé|contraseña|clave|secreto",
}
CONTEXT = 24
LABELERS = 4
EM_ROUNDS = 25
#: What labelers are taken for at first (against, for, no opinion), for real candidates and others, and with how
#: many candidates' weight that is kept.
FIRST_YES, FIRST_NO, FIRST_WEIGHT = (0.1, 0.5, 0.4), (0.4, 0.1, 0.5), 30.0

#: Put around matches; where a text has it itself it counts as another character that no pattern names.
MARK, INSTEAD = "\ufdd0", "\ufffd"
#: Added to the sums of soft labels.
SMOOTH = 0.5

_KEEP = {
    "email": "text like '%@%'",
    "ip": r"text rlike '[0-9]\\.[0-9]'",
    "card": r"text rlike '[0-9][ -]?[0-9]'",
    "phone": r"text rlike '\\+[0-9]'",
    "loose_email": r"text rlike '[(\\[]at[)\\]]'",
    "loose_phone": r"text rlike '[0-9]{3}[ .-][0-9]{4}'",
    "loose_card": r"text rlike '[0-9][ -]?[0-9]{3}'",
    "loose_secret": r"text rlike '[A-Za-z0-9_-]{20}'",
}


def _marked(pattern: str, key: str) -> Column:
    """The text cut at both sides of every match: gaps at even places, matches at odd ones; null where there can be none."""
    cut = F.split(F.regexp_replace("safe", pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.expr(_KEEP[key]), cut)


def _matches(kind: str, parts: Column, base: bool) -> Column:
    """Matches of one kind, the length of the text before each, and its context."""
    odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
    found = F.transform(
        odd,
        lambda i: F.struct(
            F.get(parts, i).alias("span"), F.length(F.get(parts, i - 1)).alias("gap"),
            (F.lit("") if base else F.right(F.get(parts, i - 1), F.lit(CONTEXT))).alias("before"), (F.lit("") if base else F.left(F.get(parts, i + 1), F.lit(1))).alias("after"),
        ),
    )
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.when(F.size(parts) > 1, found).alias("found"))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(each, lambda x: x - F.when(x > 9, 9).otherwise(0)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, span: Column) -> Column:
    digits = _digits(span)
    n = F.length(digits)
    parts = F.split(span, r"\.")
    octet = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3
    ip = F.forall(parts, lambda x: octet(x) & (F.coalesce(F.when(octet(x), x.cast("decimal(38,0)")), F.lit(256)) <= 255))
    return (
        F.when(kind == "email", True).when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(10, 15))
    )


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of all rows, and all valid base spans and loose candidates with their places."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows = rows.select("doc_id", "text", F.translate("text", MARK, INSTEAD).alias("safe"))
    rows = rows.select("doc_id", *[_marked(p, k).alias(f"at_{k}") for k, p in BASE.items()], *[_marked(p, f"loose_{k}").alias(f"at_loose_{k}") for k, p in LOOSE.items()])
    sets = [_matches(k, F.col(f"at_{k}"), True) for k in BASE] + [_matches(k, F.col(f"at_loose_{k}"), False) for k in LOOSE]
    rows = rows.select("doc_id", F.filter(F.array(*sets), lambda x: F.size(x["found"]) > 0).alias("sets"))
    rows = saved(rows.withColumn("rid", F.monotonically_increasing_id()))  # fixed once written
    each = rows.select("rid", F.posexplode("sets").alias("place", "s")).select("rid", "place", "s.kind", "s.base", F.posexplode("s.found").alias("pos", "x"))
    each = each.select("rid", "place", "kind", "base", "pos", "x.*").withColumn("n", F.length("span"))
    whole = Window.partitionBy("rid", "place").orderBy("pos")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(whole).cast("long")).withColumn("start", F.col("end") - F.col("n"))
    each = each.where(~F.col("base") | _valid(F.col("kind"), F.col("span")))
    return rows.select("rid", "doc_id"), each.select("rid", "kind", "base", "start", "end", "span", "before", "after")


def _votes(kind: Column, span: Column, before: Column, after: Column) -> list[Column]:
    """Votes of the labelers on a candidate: 1 for, 0 against, 2 no opinion."""
    digits = _digits(span)
    n = F.length(digits)
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(2)
    mixed = span.rlike("[0-9]") & span.rlike("[A-Za-z]")
    pattern = (
        F.when(kind == "secret", vote(span.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|xox[a-z]|AKIA|eyJ)[A-Za-z0-9_-]+)$"), ~mixed))
        .when(kind == "card", vote(F.lit(False), ~n.between(13, 19))).when(kind == "phone", vote(span.rlike(r"^\("), F.lit(False))).otherwise(vote(span.rlike(r"dot|\.[A-Za-z]{2,}$"), F.lit(False)))
    )
    near = F.lower(before)
    words = F.lit(None).cast("boolean")
    for k, w in GAZETTEER.items():
        words = F.when(kind == k, near.rlike(w)).otherwise(words)
    around = vote(before.rlike("[=:\"'(] ?[\"']?$"), after.rlike("[A-Za-z0-9]") | before.rlike("[A-Za-z0-9]$"))
    check = (
        F.when(kind == "card", F.when(_luhn(digits), 1).otherwise(0)).when(kind == "secret", F.when(mixed & (F.length(F.regexp_replace(span, "[^0-9]", "")) >= 4), 1).otherwise(0))
        .when(kind == "phone", vote(span.rlike("^[(]?[2-9]"), span.rlike("^[(]?[01]"))).otherwise(2)
    )
    return [pattern, F.when(words, 1).otherwise(2), around, check]


def reliabilities(patterns: DataFrame, rounds: int = EM_ROUNDS) -> DataFrame:
    """EM over (votes array<int>, n): the same rows with the posterior that the candidate is real.

    patterns has a row for each combination of votes, 3 ** LABELERS at most.
    """
    one = patterns.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("all"))
    cells = LABELERS * 3
    posterior = lambda p, s: _posterior(p, s)

    def step(s: Column, _: Column) -> Column:
        each = F.transform(F.col("all"), lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p, s).alias("q")))
        sums = lambda weight, start: F.transform(
            F.sequence(F.lit(0), F.lit(cells - 1)),
            lambda c: (F.aggregate(F.filter(each, lambda p: F.element_at(p["votes"], (F.floor(c / 3) + 1).cast("int")) == c % 3), F.lit(0.0), lambda a, p: a + weight(p)) + F.element_at(F.array(*map(F.lit, start)), c % 3 + 1) * FIRST_WEIGHT)
            / (F.aggregate(each, F.lit(0.0), lambda a, p: a + weight(p)) + F.lit(FIRST_WEIGHT)),
        )
        yes, no = (lambda p: p["n"] * p["q"]), (lambda p: p["n"] * (F.lit(1.0) - p["q"]))
        prior = (F.aggregate(each, F.lit(0.0), lambda a, p: a + yes(p)) + 1.0) / (F.aggregate(each, F.lit(0.0), lambda a, p: a + p["n"]) + 2.0)
        return F.struct(prior.alias("prior"), sums(yes, FIRST_YES).alias("yes"), sums(no, FIRST_NO).alias("no"))

    first = F.struct(
        F.lit(0.5).alias("prior"),
        F.array(*[F.lit(x) for _ in range(LABELERS) for x in FIRST_YES]).alias("yes"),
        F.array(*[F.lit(x) for _ in range(LABELERS) for x in FIRST_NO]).alias("no"),
    )
    fitted = one.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step))
    return fitted.select(F.explode(F.transform("all", lambda p: F.struct(p["votes"].alias("votes"), _posterior(p, F.col("fit")).alias("q")))).alias("x")).select("x.*")


def _posterior(p: Column, s: Column) -> Column:
    def likelihood(table: Column) -> Column:
        return F.aggregate(F.transform(p["votes"], lambda v, j: F.element_at(table, j * 3 + v + 1)), F.lit(1.0), lambda a, x: a * x)

    yes, no = s["prior"] * likelihood(s["yes"]), (F.lit(1.0) - s["prior"]) * likelihood(s["no"])
    return yes / (yes + no)


def _marks(kind: Column, span: Column, before: Column, after: Column) -> Column:
    """What the classifier sees of a candidate: one value for each feature."""
    has = lambda *classes: F.concat(*[F.when(span.rlike(f"[{x}]"), y).otherwise("") for x, y in classes])
    digits = F.length(_digits(span))
    _, word, around, check = _votes(kind, span, before, after)
    return F.array(
        has(("a-z", "a"), ("A-Z", "A"), ("0-9", "0"), ("(", "b"), (r"\s", "s"), (r"\-", "-"), (".", ".")), F.floor(F.least(F.length(span), F.lit(80)) / 4).cast("string"), F.floor(F.least(10 * digits / F.length(span), F.lit(10))).cast("string"),
        word.cast("string"), around.cast("string"), check.cast("string"), F.when(before.rlike(r"[=:]\s*[\"']?$"), "set").when(before.rlike("[A-Za-z0-9/_.#-]$"), "glued").otherwise("free"), F.when(after.rlike("[A-Za-z0-9/_#-]"), "glued").otherwise("free"),
    )


def _classified(found: DataFrame) -> DataFrame:
    """Loose candidates with the log odds of the span classifier."""
    args = F.col("kind"), F.col("span"), F.col("before"), F.col("after")
    mixed = "kind <> 'secret' or span rlike '[0-9]' and span rlike '[A-Za-z]'"
    rows = saved(found.where("not base").where(mixed).select("rid", "kind", "start", "end", F.array(*_votes(*args)).alias("votes"), _marks(*args).alias("marks")))
    soft = saved(reliabilities(rows.groupBy("votes").agg(F.count("*").alias("n"))))  # 3 ** LABELERS rows at most
    rows = rows.join(F.broadcast(soft), "votes").select("rid", "kind", "start", "end", "q", "marks")
    each = rows.select("rid", "kind", "start", "end", "q", F.posexplode("marks").alias("feature", "mark"))
    # a row for each value of eight features of four kinds, a few hundred in all
    seen = saved(each.groupBy("kind", "feature", "mark").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")))
    whole = Window.partitionBy("kind", "feature")
    share = lambda k: F.log((F.col(k) + SMOOTH) / (F.sum(k).over(whole) + SMOOTH * F.count("*").over(whole)))
    # the prior odds of a kind stand with its first feature, so they count once
    prior = F.when(F.col("feature") == 0, F.log((F.sum("yes").over(whole) + SMOOTH) / (F.sum("no").over(whole) + SMOOTH))).otherwise(0.0)
    weights = saved(seen.select("kind", "feature", "mark", F.round(share("yes") - share("no") + prior, 6).alias("weight")))
    scored = each.join(small(weights), ["kind", "feature", "mark"])
    return scored.groupBy("rid", "kind", "start", "end").agg(F.sum("weight").alias("score"))


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, digest of the base spans, all spans, counts of added and all spans."""
    rows, found = spans(docs)
    found = saved(found)
    base = found.where("base").select("rid", "kind", "start", "end", F.lit(True).alias("base"))
    added = _classified(found).where("score > 0").select("rid", "kind", "start", "end", F.lit(False).alias("base"))
    both = base.unionAll(added)
    order = Window.partitionBy("rid").orderBy("start", F.desc("base"), F.desc("end"), "kind")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    taken = F.max(F.when(~F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & F.coalesce(later >= F.col("end"), F.lit(True)) & (F.coalesce(taken, F.lit(0)) <= F.col("start"))
    both = both.withColumn("free", free).where("base or free")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", "start", "end")
    listed = both.groupBy("rid").agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sum((~F.col("base")).cast("long")).alias("n_added"),
        F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "base", name.alias("name")))).alias("all"),
    )
    out = rows.join(listed, "rid", "left")
    text = lambda xs: F.coalesce(F.concat_ws(",", F.transform(xs, lambda x: x["name"])), F.lit(""))
    return out.select(
        "doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(text(F.filter("all", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), text(F.col("all")).alias("spans"),
        F.coalesce("n_added", F.lit(0).cast("long")).alias("n_added"), F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_spans"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
